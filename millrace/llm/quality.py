"""Quality rules with thresholds learned from each language and source.

A few fixed rules reject hopeless texts. All others are adaptive: per language and
source a mergeable quantile sketch describes each metric, and a document far above
its own group's quartiles, as measured by the group's own spread, is rejected, but never for a single symbol, line or stutter. Sketches of small groups are merged into those of
their language, and of small languages into one of everything, without another pass.

Null text counts as empty, and empty texts fail the fixed rules. Null languages and sources
are groups like any other. Ties and repeated rows get equal verdicts. An empty
table gives an empty table. Other columns are ignored by ``quality_metrics``
and kept by ``reject_low_quality``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD_CLASS, broadcast_if_small, words_of, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

# Each metric with what it is a share of: a single occurrence never fails a document.
METRICS = {
    "symbol_ratio": "word_chars",
    "upper_ratio": "word_chars",
    "repeat_ratio": "n_words",
    "dup_line_ratio": "n_lines",
    "stutter_ratio": "n_words",
    "word_length": None,
}
SPREAD = 3.0  # spreads above the third quartile
TAILS = (0.9, 0.99)  # the spread is that between the quartiles or, in ratios that are mostly zero, from them to the first of these that differs
SKETCH_K = 1024  # rank error below 0.3 %
MIN_GROUP = 200  # smaller groups use their language's sketch
ROUND = 3  # decimals of a threshold, which is rounded up: keeps the sketch's noise out of it
BROADCAST_GROUPS = 20_000


def _chained(hashes: Column, step: int) -> Column:
    """The hash at each place with the one ``step`` places later."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(step + 1), F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _repeated_places(placed: Column) -> Column:
    """Places, in order, of windows that occur more than once; ``placed``: sorted structs of window and place."""
    next_one = F.slice(placed, F.lit(2), F.size(placed))
    none = F.array().cast("array<int>")
    equal = lambda a, b: F.when(a["v"] == b["v"], F.array(a["i"], b["i"])).otherwise(none)
    return F.sort_array(F.array_distinct(F.flatten(F.zip_with(placed, next_one, equal))))


def _covered(places: Column) -> Column:
    """Words within the windows that begin at ``places``."""
    next_one = F.slice(places, F.lit(2), F.size(places))
    steps = F.zip_with(places, next_one, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once.

    Columns on columns would do the same, but the optimizer's constraints double with each of them when the
    result is joined and filtered.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _word_counts(raw: Column) -> Column:
    """Counts that need the words: how many, their characters, repeated windows, words equal to the one before."""

    def repeats(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        covered = _let(placed, lambda p: _let(_repeated_places(p), _covered))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0))

    def counted(word: Column) -> Column:
        last = F.greatest(F.size(word) - (WINDOW - 1), F.lit(0))
        windows = _let(_chained(word, 1), lambda two: _let(_chained(two, 2), lambda four: F.slice(_chained(four, 4), F.lit(1), last)))
        same = F.filter(F.zip_with(word, F.slice(word, F.lit(2), F.size(word)), lambda a, b: a == b), lambda equal: equal)
        return F.struct(
            F.size(word).cast("long").alias("n_words"),
            F.length(F.array_join(raw, "")).cast("long").alias("word_chars"),
            _let(windows, repeats).cast("long").alias("n_repeat_words"),
            F.size(same).cast("long").alias("n_stutters"),
        )

    return _let(F.transform(raw, lambda w: F.xxhash64(w)), counted)


def with_metrics(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and a struct ``name`` of counts and metrics of ``text``, without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_CLASS))
    counts = F.struct(
        _let(words_of(F.col("text")), _word_counts).alias("of_words"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("of_lines"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )

    def judged(c: Column) -> Column:
        words, of_lines = c["of_words"], c["of_lines"]
        per = lambda over, under: F.when(under > 0, over / under).otherwise(0.0)
        return F.struct(
            words["n_words"].alias("n_words"),
            words["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            of_lines["n_dup_lines"].alias("n_dup_lines"),
            words["n_repeat_words"].alias("n_repeat_words"),
            ((words["n_words"] < MIN_WORDS) | (100 * words["n_repeat_words"] > MAX_REPEATED_PERCENT * words["n_words"])).alias("base_failed"),
            per(c["n_symbols"], words["word_chars"]).alias("symbol_ratio"),
            per(c["n_upper"], words["word_chars"]).alias("upper_ratio"),
            per(words["n_repeat_words"], words["n_words"]).alias("repeat_ratio"),
            per(of_lines["n_dup_lines"], of_lines["n_lines"]).alias("dup_line_ratio"),
            per(words["n_stutters"], words["n_words"]).alias("stutter_ratio"),
            per(words["word_chars"], words["n_words"]).alias("word_length"),
            of_lines["n_lines"].alias("n_lines"),
        )

    return docs.withColumn(name, _let(counts, judged))


def quality_metrics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and every count and metric of each document."""
    measured = with_metrics(docs.select("doc_id", "lang", "source", "text"), "m")
    return measured.select("doc_id", "lang", "source", "m.*")


def learn_thresholds(metrics: DataFrame) -> DataFrame:
    """``lang``, ``source`` and a limit ``max_<metric>`` for each, from sketches of what passes the fixed rules.

    Sketches are built where the rows are and merged; nothing but them is shuffled.
    """
    rows = metrics.where(~F.col("base_failed"))
    sketches = written(
        rows.groupBy("lang", "source").agg(
            F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(F.col(m), F.lit(SKETCH_K)).alias(m) for m in METRICS)
        ),
        "quality-sketches",
    )

    def merged(*by: str) -> DataFrame:
        return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(F.col(m)).alias(m) for m in METRICS))

    def limits(frame: DataFrame) -> Column:
        quartile = lambda m, q: F.kll_sketch_get_quantile_double(F.col(m), F.lit(q))
        between = lambda m, a, b: quartile(m, b) - quartile(m, a)
        spans = lambda m: [between(m, 0.25, 0.75), *(between(m, 0.75, tail) for tail in TAILS)]
        spread = lambda m: F.coalesce(*(F.when(span > 0, span) for span in spans(m)), F.lit(0.0))
        limit = lambda m: quartile(m, 0.75) + SPREAD * spread(m)
        return F.struct(*((F.ceil(limit(m) * 10**ROUND) / 10**ROUND).alias(f"max_{m}") for m in METRICS))

    own = sketches.select("lang", "source", F.when(F.col("n") >= MIN_GROUP, limits(sketches)).alias("own"))
    by_lang = merged("lang")
    by_lang = by_lang.select(F.col("lang").alias("l"), F.when(F.col("n") >= MIN_GROUP, limits(by_lang)).alias("by_lang"))
    overall = merged().where(F.col("n").isNotNull())
    whole = overall.select(limits(overall).alias("limits")).first()  # one row
    whole = F.struct(*(F.lit(v).alias(k) for k, v in whole["limits"].asDict().items())) if whole else F.lit(None)
    chosen = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")))
    chosen = chosen.select("lang", "source", F.coalesce("own", "by_lang", whole).alias("limits"))
    return written(chosen.select("lang", "source", "limits.*"), "quality-thresholds")


def _judged(frame: DataFrame, thresholds: DataFrame, metrics: str) -> tuple[DataFrame, Column]:
    """``frame`` with its group's thresholds, and whether a row passes."""
    renamed = thresholds.select(
        F.struct("lang", "source").alias(f"{metrics}_group"), F.struct(*(f"max_{m}" for m in METRICS)).alias(f"{metrics}_max")
    )
    group = F.struct(frame["lang"], frame["source"])
    joined = frame.join(broadcast_if_small(renamed, BROADCAST_GROUPS), group.eqNullSafe(F.col(f"{metrics}_group")), "left")
    # one sum over both sides of the join: a condition on the metrics alone would be moved below it and measure texts twice
    failures = F.col(f"{metrics}.base_failed").cast("int")
    for m, of in METRICS.items():
        once = F.col(f"{metrics}.{m}") * F.col(f"{metrics}.{of}") < 1.5 if of else F.lit(False)
        failures += F.coalesce((F.col(f"{metrics}.{m}") > F.col(f"{metrics}_max.max_{m}")) & ~once, F.lit(False)).cast("int")
    return joined.drop(f"{metrics}_group"), failures == 0


def judge_quality(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts and metrics, ``base_failed`` and ``kept`` for each document."""
    metrics = written(quality_metrics(docs), "quality-metrics")
    thresholds = learn_thresholds(metrics)
    rows = metrics.select("doc_id", "lang", "source", F.struct(*metrics.columns[3:]).alias("m"))
    joined, passed = _judged(rows, thresholds, "m")
    return joined.select("doc_id", "m.*", passed.alias("kept"))


def reject_low_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Texts are measured twice rather than shuffled."""
    thresholds = learn_thresholds(written(quality_metrics(docs), "quality-metrics"))
    name = "q_" + "_".join(docs.columns)[:40]  # clashes with no column
    name = next(f"{name}{i}" for i in range(10_000) if not any(c.startswith(f"{name}{i}") for c in docs.columns))
    joined, passed = _judged(with_metrics(docs, name), thresholds, name)
    return joined.where(passed).select(*docs.columns)
