"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of ``edges`` (a, b: long).

    Each round hands every node the smallest label of its neighbours and of its own label's node; the
    second halves long chains. Labels are written each round, so a lost executor costs one round.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL")
    both = written(both.distinct(), "component-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "component-labels")
    while True:
        given = labels.select(F.col("node").alias("a"), "component")
        offered = both.join(given, "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("offered"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("jumped"))
        best = F.least("component", F.coalesce("jumped", "component"), F.coalesce("offered", "component"))
        found = labels.join(jump, "component", "left").join(offered, "node", "left")
        found = written(found.select("node", best.alias("component"), (best < F.col("component")).alias("moved")), "component-labels")
        labels = found.select("node", "component")
        if not found.where("moved").limit(1).count():
            return labels


def merge_links(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (node, component) after new ``links`` (a, b).

    Links are first drawn between components, where most fall together or within one.
    """
    named = lambda side: components.select(F.col("node").alias(side), F.col("component").alias(f"own_{side}"))
    drawn = links.select("a", "b").join(named("a"), "a", "left").join(named("b"), "b", "left")
    drawn = written(drawn.select("a", "b", *(F.coalesce(f"own_{x}", x).alias(f"own_{x}") for x in "ab")), "component-links")
    edges = drawn.select(F.least("own_a", "own_b").alias("a"), F.greatest("own_a", "own_b").alias("b")).where("a <> b").distinct()
    merged = connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    known = components.union(drawn.select("a", "own_a")).union(drawn.select("b", "own_b")).distinct()
    found = known.join(merged, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
    return written(found, "components")
