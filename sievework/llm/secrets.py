"""Operator 6: secret scan with a randomness test battery, in DataFrame functions only.

Base patterns (assign, access, hex) are found leftmost and non-overlapping, with their places in code points.
Beside them, every long run of encoding characters is a candidate.  Its encoding is inferred from its letters
(decimal, hex, base32, one case of letters, letters, base62, base64), each letter gets its number there, and the
battery tests the numbers as draws from a uniform alphabet:

* chi-squared of the letter counts (upper tail),
* number of runs above and below the middle of the alphabet (two-sided),
* serial correlation of neighbours (two-sided).

A candidate that the battery rejects isn't random.  One that it doesn't reject may just be too short to tell, so
the chance is computed that text-like letters of that length would look as uniform: chi-squared then has a mean
that grows with the length.  Those chances are false-discovery controlled over all candidates of the table
(Benjamini-Hochberg, weighted by length with mean weight 1), read off a histogram of at most 4,000 bins, so
no sort and no collected candidates are needed.  What passes both is a span of kind `random`.

Everything is per row but the histogram: no shuffle of texts, no skew.  Texts are read once; the
short rows that result are checkpointed.

Defined results for odd input: a null text counts as empty and has no spans; a null id is carried; repeated rows
are each scanned (and their candidates count each); an empty table gives no rows; other columns are ignored
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, named

ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"  # a run of fewer is dropped anyway, and runs can't overlap
CANDIDATE = "[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: Fixed values: (encoding, pattern of the whole candidate, letters in order). The first that fits holds.
ENCODINGS = [
    ("decimal", "[0-9]+", "0123456789"),
    ("hex", "[0-9a-f]+", "0123456789abcdef"),
    ("hex_upper", "[0-9A-F]+", "0123456789ABCDEF"),
    ("base32", "[A-Z2-7]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "[a-z]+", "abcdefghijklmnopqrstuvwxyz"),
    ("base36", "[a-z0-9]+", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", "[A-Za-z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "[A-Za-z0-9+/]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "[A-Za-z0-9_-]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "[\\s\\S]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="),
]
#: Text-like letters: the chance that two are equal, and the spread of its letters' chances.
TEXT_SAME, TEXT_SPREAD = 0.066, 0.0015


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, the pieces between them), both empty arrays where nothing matches."""
    hit = text.rlike(pattern)
    none = F.array().cast("array<string>")
    return F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(hit, F.split(text, pattern, -1)).otherwise(none)


#: Matches are placed in blocks of so many, so that no list grows match by match over a whole text.
_BLOCK = 64


def _places(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """For each kind, from m_kind and p_kind, array<struct<s int, e int, m string>> in code points."""
    rest = [c for c in rows.columns if c not in {f"{x}_{k}" for x in "mp" for k in kinds}]
    empty = "cast(array() as array<struct<s:int,e:int,m:string>>)"
    paired = rows.select(*rest, *[F.expr(f"zip_with(m_{k}, slice(p_{k}, 1, size(m_{k})), (m, p) -> struct(m, char_length(p) as gap, char_length(m) as n))").alias(k) for k in kinds])
    cut = paired.select(*rest, *[F.expr(f"transform(sequence(0, greatest(0, (size({k}) - 1) div {_BLOCK})), b -> slice({k}, b * {_BLOCK} + 1, {_BLOCK}))").alias(k) for k in kinds])
    begun = cut.select(*rest, *kinds, *[
        F.expr(
            f"aggregate(transform({k}, b -> aggregate(b, 0, (a, x) -> a + x.gap + x.n)), struct(0 as at, cast(array() as array<int>) as out), "
            "(a, x) -> struct(a.at + x as at, concat(a.out, array(a.at)) as out), a -> a.out)"
        ).alias(f"at_{k}")
        for k in kinds
    ])
    return begun.select(*rest, *[
        F.expr(
            f"flatten(zip_with({k}, at_{k}, (b, low) -> aggregate(b, struct(low as at, {empty} as out), (a, x) -> struct(a.at + x.gap + x.n as at, "
            "concat(a.out, array(named_struct('s', a.at + x.gap, 'e', a.at + x.gap + x.n, 'm', x.m))) as out), a -> a.out)))"
        ).alias(k)
        for k in kinds
    ])


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal (an approximation of the logistic kind, absolute error below 2e-4, in order at all z)."""
    t = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), 1.5976 * z + 0.07056 * z * z * z))
    return 1 / (1 + F.exp(t))


def _encoding(token: Column) -> Column:
    """struct<letters, body>: the inferred alphabet, and the token without padding."""
    body = F.regexp_replace(token, "=+$", "")
    letters = F.lit(ENCODINGS[-1][2])
    for _, pattern, alphabet in reversed(ENCODINGS[:-1]):
        letters = F.when(token.rlike(f"^{pattern}$"), F.lit(alphabet)).otherwise(letters)
    return F.struct(letters.alias("letters"), body.alias("body"))


def _scored(column: str) -> Column:
    """The candidates of a row with their tests: array<struct<s, e, n, p_random, log_text>>."""
    base = F.transform(F.col(column), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _encoding(x["m"]).alias("t")))
    base = F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.char_length(x["t"]["letters"]).cast("double").alias("k"), F.transform(F.split(x["t"]["body"], ""), lambda c: F.instr(x["t"]["letters"], c) - 1).alias("codes"), F.transform(F.split(x["t"]["letters"], ""), lambda c: F.char_length(F.replace(x["t"]["body"], c, F.lit("")))).alias("left")))

    def counted(x: Column) -> Column:
        n = F.size(x["codes"]).cast("double")
        high = F.transform(x["codes"], lambda c: (c >= x["k"] / 2).cast("int"))
        total = F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + c)
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), n.alias("n"), x["codes"].alias("codes"),
            F.aggregate(x["left"], F.lit(0.0), lambda a, c: a + (n - c) * (n - c)).alias("squares"),
            (total / n).alias("mean"),
            F.aggregate(high, F.lit(0.0), lambda a, c: a + c).alias("up"),
            F.aggregate(F.zip_with(F.slice(high, 2, F.size(high) - 1), F.slice(high, 1, F.size(high) - 1), lambda a, b: (a != b).cast("double")), F.lit(1.0), lambda a, c: a + c).alias("runs"),
        )

    def moments(x: Column) -> Column:
        off = F.transform(x["codes"], lambda c: c - x["mean"])
        size = F.size(x["codes"])
        return F.struct(
            *[x[c].alias(c) for c in ("s", "e", "k", "n", "squares", "up", "runs")],
            F.aggregate(off, F.lit(0.0), lambda a, c: a + c * c).alias("spread"),
            F.aggregate(F.zip_with(F.slice(off, 2, size - 1), F.slice(off, 1, size - 1), lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c).alias("lag"),
        )

    def z_scores(x: Column) -> Column:
        n, k = x["n"], x["k"]
        chi = k / n * x["squares"] - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        cross = 2 * x["up"] * (n - x["up"])
        z_runs = F.when((cross <= n) | (cross == 0), F.lit(9.0)).otherwise((x["runs"] - 1 - cross / n) / F.sqrt(cross * (cross - n) / (n * n * (n - 1))))
        z_lag = F.when(x["spread"] <= 0, F.lit(9.0)).otherwise((x["lag"] / x["spread"] + 1 / n) * F.sqrt(n))
        same = F.greatest(F.lit(TEXT_SAME), 1.8 / k)
        text_mean = (k - 1) + (n - 1) * (k * same - 1)
        text_sd = F.sqrt(2 * (k - 1) + 4 * (n - 1) * k * k * TEXT_SPREAD)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), n.alias("n"), z_chi.alias("z_chi"), F.abs(z_runs).alias("z_runs"), F.abs(z_lag).alias("z_lag"), ((text_mean - chi) / text_sd).alias("z_text"))

    def judged(x: Column) -> Column:
        least = F.least(normal_tail(x["z_chi"]), 2 * normal_tail(x["z_runs"]), 2 * normal_tail(x["z_lag"]))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["n"].alias("n"), (1 - F.pow(1 - F.least(least, F.lit(1.0)), 3)).alias("p_random"), (-F.log10(normal_tail(x["z_text"]))).alias("log_text"))

    for step in (counted, moments, z_scores, judged):
        base = F.transform(base, step)
    return base


def _spans(kind: int, column: Column) -> Column:
    return F.transform(column, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", level: float = 1e-3, random_level: float = 1e-3, bins_per_decade: int = 100) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans of every row.

    level: false-discovery rate among spans of kind random; random_level: the battery's significance level.
    """
    rows = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("t"))
    m_assign, p_assign = _found(F.col("t"), ASSIGN)
    values = F.when(F.size("m_assign") > 0, F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    m_access, p_access = _found(F.col("t"), ACCESS)
    m_hex, p_hex = _found(F.col("t"), HEX)
    m_any, p_any = _found(F.col("t"), CANDIDATE)
    parts = rows.select("doc_id", "t", m_assign.alias("m_assign"), p_assign.alias("p_assign"), m_access.alias("m_access"), p_access.alias("p_access"), m_hex.alias("m_hex"), p_hex.alias("p_hex"), m_any.alias("m_any"), p_any.alias("p_any"))
    parts = parts.withColumn("values", values).drop("t")
    places = _places(parts, ("assign", "access", "hex", "any"))
    kept = places.select(
        "doc_id",
        F.expr("filter(transform(assign, (x, i) -> named_struct('s', x.s, 'e', x.e, 'm', values[i])), x -> char_length(x.m) >= 8)").alias("assign"),
        F.expr("filter(access, x -> x.e - x.s >= 16)").alias("access"),
        F.col("hex"),
        F.col("any"),
    )
    drop_text = lambda c: F.transform(F.col(c), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    kept = kept.select("doc_id", drop_text("assign").alias("assign"), drop_text("access").alias("access"), drop_text("hex").alias("hex"), _scored("any").alias("any"))
    kept = checkpointed(kept)
    tested = kept.select(F.explode("any").alias("x")).select("x.n", "x.log_text")
    total, mean = tested.agg(F.count(F.lit(1)), F.avg("n")).first()
    cut = float("inf")
    if total:
        weighted = F.col("log_text") + F.log10(F.col("n") / F.lit(mean))
        bins = tested.groupBy(F.greatest(F.lit(0), F.least(F.lit(40 * bins_per_decade), F.floor(weighted * bins_per_decade))).cast("int").alias("bin")).count()
        above = 0
        for bin_, n in sorted(((r["bin"], r["count"]) for r in bins.collect()), reverse=True):  # at most 40 decades of bins
            above += n
            if 10 ** (-bin_ / bins_per_decade) <= level * above / total:
                cut = bin_ / bins_per_decade
    lucky = lambda x: (x["p_random"] >= random_level) & (F.floor((x["log_text"] + F.log10(x["n"] / F.lit(mean or 1.0))) * bins_per_decade) / bins_per_decade >= F.lit(cut))
    done = kept.withColumn("random", F.filter("any", lucky))
    base = F.concat(_spans(1, F.col("assign")), _spans(2, F.col("access")), _spans(3, F.col("hex")))
    return done.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        _joined(base).alias("base_spans"),
        _joined(F.concat(base, _spans(4, F.col("random")))).alias("spans"),
    )
