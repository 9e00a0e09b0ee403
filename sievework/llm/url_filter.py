"""Operator 2: URL rules in a sorted digest array.

The rules (host, path, verdict) become one file: sorted 64-bit xxhash keys, string offsets and the rule strings
themselves.  The file is shipped to every node with SparkContext.addFile and memory-mapped by the Python
workers, so all workers of a node share its pages and nothing is copied into their heaps.  For each URL the
candidates are its host's suffixes at label bounds times its path's prefixes of the lengths that rules have,
longest first.  All candidates of a batch are hashed, looked up with one vectorised binary search, and every hit
is confirmed against the stored full string, so colliding digests cannot give a wrong verdict.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased.  Path: from there up to `?`, `#` or
the end.  Of the rules that fit, the longest host + path string wins, of equally long ones that with the longer
host.  A URL that no rule fits gets the default verdict.

Defined results for odd input: a null URL or one without `://` has empty host and path and fits no rule (but an
empty host never matches); a null id is carried; repeated rows are each judged; an empty table gives no rows;
other columns are ignored whatever their names.  Probes per URL are at most (labels of the longest rule host) x (different path lengths among
the rules), however many labels the URL's host has.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import named, ship

SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_arrays: dict[str, "DigestArray"] = {}


def _joined(host: str, path: str) -> bytes:
    return f"{host}\x00{path}".encode()


class DigestArray:
    """A memory-mapped, sorted array of 64-bit digests with the strings behind them."""

    @staticmethod
    def write(file: str, rules: list[tuple[str, str, str]]) -> None:
        rows = sorted((xxhash.xxh64_intdigest(_joined(h, p)), _joined(h, p), v) for h, p, v in rules)
        keys = np.array([k for k, _, _ in rows], "<u8")
        blobs = [s + b"\x00" + v.encode() for _, s, v in rows]
        ends = np.cumsum([0] + [len(b) for b in blobs]).astype("<u8")
        lengths = np.array(sorted({len(p) for _, p, _ in rules}), "<u8")
        labels = max([0, *[h.count(".") + 1 for h, _, _ in rules]])
        with open(file, "wb") as f:
            f.write(np.array([len(keys), len(lengths), labels], "<u8").tobytes() + lengths.tobytes() + keys.tobytes() + ends.tobytes() + b"".join(blobs))

    def __init__(self, file: str):
        whole = np.memmap(file, np.uint8, "r")
        n, m, self.labels = whole[:24].view("<u8").tolist()
        self.path_lengths = whole[24 : 24 + 8 * m].view("<u8").tolist()[::-1]
        at = 24 + 8 * m
        self.keys = whole[at : at + 8 * n].view("<u8")
        self.ends = whole[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.blob = whole[at + 16 * n + 8 :]

    def find(self, probes: list[bytes], keys: np.ndarray | None = None) -> list[str | None]:
        """The verdict stored for each probe string. keys: their digests, if not xxhash's (for tests)."""
        if keys is None:
            keys = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), np.uint64, len(probes))
        out: list[str | None] = [None] * len(probes)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(high > low).tolist():
            for k in range(low[i], high[i]):  # more than one only where digests collide
                stored = self.blob[int(self.ends[k]) : int(self.ends[k + 1])].tobytes()
                if stored.startswith(probes[i] + b"\x00"):
                    out[i] = stored[len(probes[i]) + 1 :].decode()
        return out


def candidates(host: str, path: str, path_lengths: list[int], labels: int) -> list[tuple[str, str]]:
    """Rules that could fit, in order of precedence. labels: of the longest rule host."""
    if not host:
        return []
    last = host.rsplit(".", labels)
    suffixes = [".".join(last[i:]) for i in range(1 if len(last) > labels else 0, len(last))]
    found = [(h, path[:n]) for h in suffixes for n in path_lengths if n <= len(path)]
    return sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))


def _judge(batches: Iterator[pa.RecordBatch], name: str, default: str) -> Iterator[pa.RecordBatch]:
    if name not in _arrays:
        _arrays[name] = DigestArray(SparkFiles.get(name))
    rules = _arrays[name]
    for batch in batches:
        ids, hosts, paths = batch.columns
        probes, counts, strings = [], [], []
        for host, path in zip(hosts.to_pylist(), paths.to_pylist()):
            own = candidates(host, path, rules.path_lengths, rules.labels)
            counts.append(len(own))
            strings += own
            probes += [_joined(h, p) for h, p in own]
        verdicts = rules.find(probes)
        rule_out, verdict_out, at = [], [], 0
        for n in counts:
            hit = next((i for i in range(at, at + n) if verdicts[i] is not None), None)
            rule_out.append(None if hit is None else "".join(strings[hit]))
            verdict_out.append(default if hit is None else verdicts[hit])
            at += n
        yield pa.RecordBatch.from_arrays([ids, hosts, paths, pa.array(rule_out, pa.string()), pa.array(verdict_out, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row. rules: (host, path, verdict), hosts in lower case."""
    spark = pages.sparkSession
    ship(spark)
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    file = os.path.join(tempfile.mkdtemp(prefix="sievework-"), name)
    DigestArray.write(file, rules)
    spark.sparkContext.addFile(file)
    url = F.coalesce(named(url_col).cast("string"), F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "^[\\s\\S]*?://([\\s\\S]*)$", 1)).otherwise(F.lit(""))
    split = pages.select(named(id_col).cast("long").alias("page_id"), after.alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    return split.mapInArrow(lambda it: _judge(it, name, default), SCHEMA)
