"""Small tables with everything that may go wrong."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("kept", T.IntegerType()), T.StructField("score", T.StringType()), T.StructField("row", T.LongType()), T.StructField("slot", T.LongType())])
WORDS = "the of and a to in is that it was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows, partitions=3):
    """rows: (doc_id, text) or (doc_id, text, source); the other columns clash with names that operators use."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", -1, "x", 5, "y", 7, 9) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions) if full else spark.createDataFrame([], DOCS)


def odd_rows(seed=0):
    """Nulls, empty and blank texts, copies in white space and case, near copies, a huge text, repeated rows and ids, a null id."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    words = base.split()
    near = words.copy()
    near[60] = "changed"
    far = words.copy()
    for k in range(0, 120, 9):
        far[k] = "other"
    rows = [
        (10, base), (3, base.replace(" ", "\n  ")), (7, base.upper()), (12, " ".join(near)), (13, " ".join(far)), (14, base + " Ünïcode 日本語"),
        (20, None), (21, ""), (22, " \t\n"), (23, "one two"), (24, "One  two"), (25, "two one"), (26, "a b c d e"), (27, "A b c d e"),
        (30, base), (30, base), (31, "same id"), (31, "other text under the same id"), (None, "null id"), (None, base), (40, prose(rng, 40000)), (41, "x" * 50000),
    ]
    return rows + [(100 + k, prose(rng, rng.randint(1, 60))) for k in range(40)]
