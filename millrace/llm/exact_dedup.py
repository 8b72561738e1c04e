"""Exact duplicates by two passes over a Bloom filter.

The first pass finds which places of two bit sets are hit by more than one row, by grouping the
places of all rows, once for each set; only rows with both places hit twice can have an equal, and
only the prints of those are shuffled and grouped. All others pass straight through as groups of one.

Texts are equal when identical; null counts as empty, and empty texts equal each other. The
row with the largest ``doc_id`` stays (null ids are smallest). Rows repeated with one id are
one document and share its verdict. An empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, written

BITS_PER_ROW = 16
# Largest bit set (32 MiB, two are broadcast). With more rows than it suits, more of them are
# grouped than need be, in the end all: the same result by a plain shuffle of fixed-size rows.
MAX_BITS = 1 << 28
# Groups with over a thousandth of all rows, at most this many, are looked up without a shuffle.
HOT_GROUPS = 1000


def _repeated_places(rows: DataFrame, place: Column, name: str) -> DataFrame:
    """Bitmaps, by bucket, of the places that two rows or more hit."""
    twice = rows.select(place.alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")
    return twice.groupBy(F.bitmap_bucket_number("place").alias(f"{name}_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias(f"{name}_bits")
    )


def _hit(name: str) -> Column:
    """Whether the bit of place ``name`` is set in the bitmap beside it."""
    byte = f"conv(hex(substring({name}_bits, CAST({name}_bit DIV 8 AS INT) + 1, 1)), 16, 10)"
    return F.expr(f"coalesce(getbit(CAST({byte} AS BIGINT), CAST({name}_bit % 8 AS INT)) = 1, false)")


def possibly_repeated(rows: DataFrame, n_rows: int, columns: tuple[str, str], max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` and ``repeated``: true for every row with an equal, and rarely for another."""
    bits = min(max_bits, 1 << max(15, (BITS_PER_ROW * n_rows - 1).bit_length()))
    marked = rows
    for name in columns:
        place = F.col(name).bitwiseAND(F.lit(bits - 1))
        bitmaps = _repeated_places(rows, place, name)  # bits / 8 bytes at most
        marked = (
            marked.withColumn(f"{name}_bucket", F.bitmap_bucket_number(place))
            .withColumn(f"{name}_bit", F.bitmap_bit_position(place))
            .join(F.broadcast(bitmaps), f"{name}_bucket", "left")
        )
    return marked.select(*rows.columns, (_hit(columns[0]) & _hit(columns[1])).alias("repeated"))


def exact_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` for each row."""
    text = F.coalesce(docs["text"], F.lit(""))
    prints = written(
        docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), fold(1, text).alias("a"), fold(2, text).alias("b")),
        "exact-prints",
    )
    n_rows = prints.count()
    marked = written(possibly_repeated(prints, n_rows, ("a", "b"), max_bits).drop("a", "b"), "exact-marked")
    alone = marked.where(~F.col("repeated")).select("*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    suspects = marked.where("repeated")
    groups = written(
        suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups"
    )
    hot = F.col("group_size") * HOT_GROUPS > n_rows
    looked_up = suspects.join(F.broadcast(groups.where(hot)), "text_sha256", "left")
    found = looked_up.where(F.col("group_size").isNotNull())
    rest = looked_up.where(F.col("group_size").isNull()).drop("keep_id", "group_size").join(groups.where(~hot), "text_sha256")
    return (
        alone.unionByName(found)
        .unionByName(rest)
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of equals, with all its columns; ``doc_id`` must identify documents."""
    dropped = exact_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
