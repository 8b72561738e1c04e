"""Small tables with every awkward case."""

import random

from pyspark.sql import types as T

CLASHING = ["token", "sid", "m", "size", "component", "line_doc", "words", "mix_doc", "keep_id", "place"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in CLASHING),
    ]
)


def prose(rng, n, lang="en"):
    syllables = {"en": "th er on an re he in ed nd ha at en", "de": "sch ung ein ich der lich ü ß keit ver au be"}[lang].split()
    words = ["".join(rng.choices(syllables, k=rng.choice([1, 1, 2, 3]))) for _ in range(n)]
    lines = [" ".join(words[i : i + 15]) for i in range(0, n, 15)]
    return ".\n".join(lines)


def edited(rng, text, edits):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), min(edits, len(words))):
        words[i] = "edit" + str(rng.randrange(10**6))
    return " ".join(words)


def edge_rows():
    """Nulls in any column, empty, blank, very long and repeated texts, repeated rows, negative and null ids."""
    rng = random.Random(4)
    long_text = prose(rng, 30_000)
    shared = prose(rng, 80)
    texts = [
        (0, None, None, None), (1, "", "en", "a"), (2, " \n\t ", None, "b"), (3, "one", "en", None), (4, "one", "de", "a"),
        (5, long_text, "en", "a"), (6, "x" * 200_000, "en", "a"), (7, "... !!! 12 34", "en", "b"), (8, shared, "en", "a"),
        (9, shared, "de", "b"), (9, shared, "de", "b"), (-3, edited(rng, shared, 1), "en", "a"), (None, shared, "en", "a"),
        (None, None, "en", None), (2**62, "Ünï ß é \u0301 \U0001f600 a\x1cb\x85c\u2003d", "fr", "c"), (11, "a b c d", "en", "a"), (12, "A B c D", "en", "a"),
    ]
    texts += [(100 + i, prose(rng, 40 + i, "de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en", "abc"[i % 3]) for i in range(40)]
    return [(i, t, lang, source, None if t is None else len(t), *("x" for _ in CLASHING)) for i, t, lang, source in texts]


def edge_documents(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, texts):
    """Rows from (doc_id, text) or (doc_id, text, lang, source)."""
    rows = [(*row, None, None)[:4] for row in texts]
    return spark.createDataFrame(rows, T.StructType(SCHEMA.fields[:4])).repartition(4)


def edge_labels(spark):
    rows = [(i, 1, int(i % 4 == 0)) for i in range(0, 140)] + [(8, None, None), (None, 1, 1), (8, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
