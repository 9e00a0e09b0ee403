"""Operator 2 against trying every rule."""

import re

import numpy as np
import pytest

from sievework.llm.queries import OP2_SQL, URL_RULES, op2_url_filter
from sievework.llm.url_filter import DigestArray, judge_urls
from tests.conftest import canonical, duck

URLS = [
    None, "", "example.com/en/7", "http://example.com/en/7", "https://WWW.Example.COM/en/712?x=/en/", "http://example.com/en", "http://example.com/EN/7", "http://xexample.com/en/1", "http://com/en/1",
    "ftp://a.b.example.net/de/8", "http://example.net/de/7#/de/8", "http://example.net/de/88/x", "http://net/de/", "http://org/es/", "http://a.org/es", "http://a.org?/es/", "http://a.org/es/://b.com/en/",
    "x://", "x:///en/", "x://com/en/\nz", "http://a://com/en/", "http://éx.com/en/é", "http://com./en/", "http://.com/en/", "http://example.com/en/7" + "y" * 100000,
]


def judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def frame(spark, urls):
    return spark.createDataFrame([(k if k else None, u, "h", "p", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string")


def test_against_every_rule(spark):
    got = judge_urls(frame(spark, URLS + URLS[:4]).repartition(3), URL_RULES).collect()
    want = [((k if k else None), *judge(u)) for k, u in enumerate(URLS + URLS[:4])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table_and_no_rules(spark):
    assert judge_urls(frame(spark, URLS).limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in judge_urls(frame(spark, URLS), [], default="block").collect()} == {"block"}


def test_colliding_digests_are_confirmed(tmp_path):
    DigestArray.write(f"{tmp_path}/r", URL_RULES)
    rules = DigestArray(f"{tmp_path}/r")
    first = int(rules.keys[2])
    assert rules.find([b"not\x00there"], np.array([first], np.uint64)) == [None]
    assert rules.find([b"com\x00/en/", b"com\x00/en"]) == ["block", None]
    assert isinstance(rules.keys.base, np.memmap) or isinstance(rules.keys, np.memmap)


def test_equal_lengths_prefer_the_longer_host(spark):
    rules = [("a.com", "/", "block"), ("com", "/xy", "allow")]
    got = judge_urls(frame(spark, ["http://a.com/xy"]), rules).head()
    assert (got["rule"], got["verdict"]) == ("a.com/", "block")


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = op2_url_filter(spark, sf)
    rel = duck(sf).execute(OP2_SQL)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), [d[0] for d in rel.description])


@pytest.mark.parametrize("bad", ["://", "a", None])
def test_no_host(spark, bad):
    r = judge_urls(frame(spark, [bad]), URL_RULES).head()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == ("", "", None, "allow")
