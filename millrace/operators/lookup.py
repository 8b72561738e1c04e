"""Lookup of at most one row per event, as a left join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The frequency sketch tracks so many keys for each one that can be hot, within the sketch's own limit.
_TRACKED = 10
_MOST_TRACKED = 1_000_000
# Words of the bitmap of a batch's keys: 8 million bits, which are broadcast.
KEY_WORDS = 1 << 17


def reduce_dimension(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``; equal orders go by the other columns.

    The minimum is taken on the map side first, so a key with many copies sends
    one row per task.
    """
    values = [name for name in rows.columns if name not in (key, order)]
    first = rows.groupBy(key).agg(F.min(F.struct(order, *values)).alias("first"))
    return first.select(key, *[F.col("first")[name].alias(name) for name in values])


def key_profile(
    events: DataFrame, on: str, partitions: int | None = None
) -> tuple[list[tuple[object, int]], int]:
    """The hot keys as ``hot_keys`` gives them, and the number of events."""
    partitions = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # fewer than half as many keys as partitions can be worth more than two partitions each
    reported = max(partitions // 2, 1)
    tracked = min(max(_TRACKED * reported, 1000), _MOST_TRACKED)
    top, total = events.agg(
        F.expr(f"approx_top_k({on}, {min(reported, tracked)}, {tracked})"), F.count(F.lit(1))
    ).head()
    fair = total / partitions
    return [(item, math.ceil(count / fair)) for item, count in top or [] if count > 2 * fair], total


def hot_keys(
    events: DataFrame, on: str, partitions: int | None = None
) -> list[tuple[object, int]]:
    """Keys worth more than two partitions of events, with the number of parts to cut them into.

    ``partitions`` is that of the session's shuffles unless given. One pass with a mergeable sketch of fixed size. The list only steers how
    the join is spread, never its result, and the parts sum up to
    ``partitions`` plus one per key at most.
    """
    return key_profile(events, on, partitions)[0]


def prune_lookup(lookup: DataFrame, key: str, events: DataFrame, on: str, words: int = KEY_WORDS) -> DataFrame:
    """The rows of ``lookup`` that an event may find: their key's bit is set in a bitmap of the events' keys.

    The bitmap has ``words`` words of 64 bits, however many events there are. Keys that share a bit let a
    row through that no event finds; the join drops it. The null key's row always stays.
    """

    def place(column: str) -> list[Column]:
        hashed = F.xxhash64(column)
        return [F.pmod(F.shiftright(hashed, 6), F.lit(words)).alias("key_word"), F.pmod(hashed, F.lit(64)).cast("int").alias("key_bit")]

    keys = events.where(F.col(on).isNotNull()).select(*place(on))
    bitmap = keys.groupBy("key_word").agg(F.bit_or(F.expr("shiftleft(1L, key_bit)")).alias("key_bits"))
    placed = lookup.select("*", *place(key)).join(F.broadcast(bitmap), "key_word", "left")
    found = F.expr(f"`{key}` IS NULL OR getbit(key_bits, key_bit) = 1")
    return placed.where(found).select(*lookup.columns)


def lookup_small(events: DataFrame, lookup: DataFrame, on: str, key: str, only: Column) -> DataFrame:
    """Left lookup against a side known to fit in memory: no shuffle of the events."""
    right = F.broadcast(lookup.withColumnRenamed(key, "lookup_key").withColumn("found", F.lit(True)))
    return events.join(right, only & F.col(on).eqNullSafe(F.col("lookup_key")), "left").drop("lookup_key")


def lookup_large(
    events: DataFrame,
    lookup: DataFrame,
    on: str,
    key: str,
    only: Column,
    spread: list[str],
    hot: list[tuple[object, int]],
) -> DataFrame:
    """Left lookup by a sort-merge join that no key can overload.

    Events of a hot key go to one of its parts by a hash of the ``spread``
    columns, and its lookup row is copied to each part. Events that look
    nothing up get parts of their own, where no lookup row is.
    """
    spark = events.sparkSession
    key_type = events.schema[on].dataType.simpleString()
    parts = spark.createDataFrame(hot, f"hot_key {key_type}, parts int")
    hashed = F.xxhash64(*spread)
    salted_events = (
        events.join(F.broadcast(parts), F.col(on).eqNullSafe(F.col("hot_key")), "left")
        .withColumn(
            "salt",
            F.when(~only, -1 - F.pmod(hashed, F.lit(1 << 20)))
            .otherwise(F.pmod(hashed, F.coalesce("parts", F.lit(1))))
            .cast("int"),
        )
        .drop("hot_key", "parts")
    )
    salted_lookup = (
        lookup.withColumnRenamed(key, "lookup_key")
        .withColumn("found", F.lit(True))
        .join(F.broadcast(parts), F.col("lookup_key").eqNullSafe(F.col("hot_key")), "left")
        .withColumn(
            "lookup_salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        )
        .drop("hot_key", "parts")
    )
    return salted_events.join(
        salted_lookup.hint("merge"),
        F.col(on).eqNullSafe(F.col("lookup_key")) & (F.col("salt") == F.col("lookup_salt")),
        "left",
    ).drop("lookup_key", "salt", "lookup_salt")


def lookup_laid_out(
    events: DataFrame,
    lookup: DataFrame,
    on: str,
    key: str,
    only: Column,
    hot: list[tuple[object, int]],
) -> DataFrame:
    """Left lookup in a table that lies in buckets by its key: only events are shuffled.

    Events of a hot key, of the null key and those that look nothing up stay where they are, as the rows they can
    find are at most one a hot key and one more.
    """
    apart = F.col(on).isin([item for item, _ in hot if item is not None])
    stay = F.col(on).isNull() | apart | ~F.coalesce(only, F.lit(False))
    few = lookup.where(F.col(key).isNull() | F.col(key).isin([item for item, _ in hot if item is not None]))
    there = lookup.withColumnRenamed(key, "lookup_key").withColumn("found", F.lit(True)).hint("merge")
    joined = events.where(~stay).join(there, F.col(on) == F.col("lookup_key"), "left").drop("lookup_key")
    return lookup_small(events.where(stay), few, on, key, only).unionByName(joined)


def lookup_left(
    events: DataFrame,
    lookup: DataFrame,
    on: str,
    key: str,
    *,
    small: bool,
    only: Column | None = None,
    spread: list[str] | None = None,
    hot: list[tuple[object, int]] | None = None,
    laid_out: bool = False,
) -> DataFrame:
    """Each event once, with the columns of the lookup row under its key and ``found``.

    ``lookup`` has one row per key. A null key finds the row with the null key.
    ``found`` is null for events without a row. Events outside ``only`` look
    nothing up. ``small`` says that the size of ``lookup`` was checked and it
    may be sent to every executor, ``laid_out`` that it lies in buckets by ``key``.
    """
    only = F.lit(True) if only is None else only
    if small:
        return lookup_small(events, lookup, on, key, only)
    if laid_out:
        return lookup_laid_out(events, lookup, on, key, only, hot or [])
    return lookup_large(events, lookup, on, key, only, spread or events.columns, hot or [])
