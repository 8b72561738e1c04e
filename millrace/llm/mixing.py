"""Mixing of sources to target weights by capped water-filling.

A source's target grows with its weight until it reaches the most epochs allowed; what it
cannot take is shared again among the others, until no target is above its cap. A target
is met by whole repetitions of every document, then documents in a seeded order, and a
part of one more.

Null text has no words; sources are ordered by code point, null last. Sources
without words get and take nothing. Rows repeated with one id tie and share the last
part evenly. An empty table gives an empty table. ``mix_documents`` ignores other columns,
``repeat_documents`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.common import broadcast_if_small, word_count, words_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MAX_EPOCHS = 2
SEED = "mix-0"
SLICE_DIGITS = 3  # hexadecimal: a source's documents are ordered in 4,096 slices
BROADCAST_SOURCES = 100_000


def _source_key(source: Column) -> Column:
    """Never null, so that null is a source like any other."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _order(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}-"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def water_fill(sources: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source_key``, ``source_size`` and ``target`` from sizes by source. Each round is one small aggregate."""
    spark = sources.sparkSession
    schema = T.StructType([*sources.select("source_key", "source_size").schema, T.StructField("weight", T.LongType())])
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).select("source_key", "source_size").rdd.zipWithIndex()
    weighted = written(
        spark.createDataFrame(ordered.map(lambda x: Row(*x[0], weights[x[1] % len(weights)])), schema), "mix-sources"
    )
    cap = F.col("source_size") * max_epochs
    rest = total = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    clamped, n_clamped, weight = F.lit(False), -1, 0
    while True:
        held = weighted.agg(
            F.sum(F.when(clamped, cap)).alias("caps"), F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("weight"), F.count_if(clamped).alias("n")
        ).first()
        rest, weight = total - (held["caps"] or 0), held["weight"] or 0
        if held["n"] == n_clamped or not weight:
            break
        n_clamped, clamped = held["n"], clamped | (F.lit(float(rest)) * F.col("weight") / weight > cap)
    open_target = F.lit(float(rest)) * F.col("weight") / weight if weight else F.lit(0.0)
    return weighted.select("source_key", "source_size", F.when(clamped, cap.cast("double")).otherwise(F.least(open_target, cap.cast("double"))).alias("target"))


def plan_mix(sizes: DataFrame) -> DataFrame:
    """One row per source: its target, whole repetitions, and where its seeded order is cut.

    ``sizes``: source, source_key, doc_id, size, place. Sums by slice find the slice in which
    the cut lies; only that slice is put in order, so no task holds a whole source.
    """
    by_slice = sizes.groupBy("source_key", "source", F.substring("place", 1, SLICE_DIGITS).alias("slice")).agg(F.sum("size").alias("size"))
    by_slice = written(by_slice, "mix-slices")
    sources = by_slice.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(sources)
    want = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) DIV source_size")).otherwise(F.lit(0).cast("long"))
    targets = written(targets.withColumn("whole", whole).withColumn("rest", want - F.col("whole") * F.col("source_size")), "mix-targets")
    before = F.sum("size").over(Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_slice.withColumn("start", F.coalesce(before, F.lit(0))).join(targets.select("source_key", "rest"), "source_key")
    cut_slice = starts.where("start < rest AND rest <= start + size").select("source_key", "slice", "start", "rest")
    inside = sizes.withColumn("slice", F.substring("place", 1, SLICE_DIGITS)).join(broadcast_if_small(cut_slice, BROADCAST_SOURCES), ["source_key", "slice"])
    tied = inside.groupBy("source_key", "place", "start", "rest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("ties"))
    before = F.sum("size").over(Window.partitionBy("source_key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    cuts = tied.withColumn("begin", F.col("start") + F.coalesce(before, F.lit(0))).where("begin < rest AND rest <= begin + size")
    cuts = cuts.select("source_key", F.col("place").alias("cut"), F.expr("(rest - begin) DIV ties").alias("part"))
    return written(targets.join(cuts, "source_key", "left").drop("rest"), "mix-plan")


def _taken(size: Column, place: Column) -> Column:
    """Words beyond the whole repetitions."""
    return F.when(place < F.col("cut"), size).when(place == F.col("cut"), F.least(size, F.col("part"))).otherwise(F.lit(0).cast("long"))


def _sizes(docs: DataFrame) -> DataFrame:
    columns = {"source_key": _source_key(F.col("source")), "size": word_count(F.col("text")), "place": _order(F.col("doc_id"))}
    return written(docs.select("doc_id", "source", *(c.alias(n) for n, c in columns.items())), "mix-sizes")


def mix_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` for each document."""
    sizes = _sizes(docs)
    planned = sizes.join(broadcast_if_small(plan_mix(sizes), BROADCAST_SOURCES), "source_key")
    taken = F.col("whole") * F.col("size") + _taken(F.col("size"), F.col("place"))
    return planned.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, the last part of a source cut after its words."""
    plan = broadcast_if_small(plan_mix(_sizes(docs)), BROADCAST_SOURCES).select(F.struct("*").alias("mix_plan"))
    keep = F.struct(*(docs[c] for c in docs.columns)).alias("mix_doc")
    joined = docs.select(keep).join(plan, _source_key(F.col("mix_doc.source")) == F.col("mix_plan.source_key"))
    size, place = word_count(F.col("mix_doc.text")), _order(F.col("mix_doc.doc_id"))
    part = F.when(place < F.col("mix_plan.cut"), size).when(place == F.col("mix_plan.cut"), F.least(size, F.col("mix_plan.part"))).otherwise(F.lit(0).cast("long"))
    whole = F.array_repeat(F.lit(None).cast("long"), F.col("mix_plan.whole").cast("int"))
    takes = F.concat(whole, F.when(part >= size, F.array_repeat(F.lit(None).cast("long"), F.when(part > 0, 1).otherwise(0))).when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = joined.select("mix_doc", F.explode(takes).alias("mix_words"))
    cut = F.array_join(F.slice(words_of(F.col("mix_doc.text")), F.lit(1), F.col("mix_words").cast("int")), " ")
    text = F.when(F.col("mix_words").isNull(), F.col("mix_doc.text")).otherwise(cut)
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(f"mix_doc.`{c}`").alias(c) for c in docs.columns))
