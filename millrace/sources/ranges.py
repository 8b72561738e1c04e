"""Offset ranges of a topic: what a run has still to do."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = ["topic", "partition", "offset"]


class Span(NamedTuple):
    """The offsets of a partition that hold messages, both ends included."""

    topic: str
    partition: int
    first: int
    last: int
    messages: int


class Slice(NamedTuple):
    """Offsets of a partition from ``first`` up to, but without, ``stop``."""

    topic: str
    partition: int
    first: int
    stop: int


def offset_spans(topic: DataFrame) -> list[Span]:
    """A span for each partition of the topic; only the three columns of the place are read."""
    placed = topic.where("topic IS NOT NULL AND partition IS NOT NULL AND offset IS NOT NULL")
    found = placed.groupBy("topic", "partition").agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.count(F.lit(1)).alias("messages"))
    return sorted(Span(*row) for row in found.select(*Span._fields).collect())


def range_name(spans: list[Span]) -> str:
    """The same for the same offsets."""
    return hashlib.sha256(json.dumps(spans).encode()).hexdigest()[:32]


def plan_ranges(spans: list[Span], batch_rows: int) -> list[list[Slice]]:
    """Batches of about ``batch_rows`` messages, each with an equal share of every partition's offsets."""
    batches = max(1, -(-sum(span.messages for span in spans) // batch_rows))
    plan: list[list[Slice]] = [[] for _ in range(batches)]
    for span in spans:
        bounds = [span.first + (span.last + 1 - span.first) * i // batches for i in range(batches + 1)]
        for slices, first, stop in zip(plan, bounds, bounds[1:]):
            if stop > first:
                slices.append(Slice(span.topic, span.partition, first, stop))
    return plan


def within(slices: list[Slice], others: bool = False) -> Column:
    """Whether a message lies in the slices or, with ``others``, has no place in the topic. The scan skips by it."""
    topic, partition, offset = map(F.col, PLACE)
    tests = [(topic == s.topic) & (partition == s.partition) & (offset >= s.first) & (offset < s.stop) for s in slices]
    if others:
        tests.append(topic.isNull() | partition.isNull() | offset.isNull())
    return reduce(Column.__or__, tests, F.lit(False))


def kafka_offsets(slices: list[Slice]) -> dict[str, str]:
    """The options that make the Kafka source read the slices alone."""
    first: dict[str, dict[str, int]] = {}
    stop: dict[str, dict[str, int]] = {}
    for s in slices:
        first.setdefault(s.topic, {})[str(s.partition)] = s.first
        stop.setdefault(s.topic, {})[str(s.partition)] = s.stop
    return {"startingOffsets": json.dumps(first), "endingOffsets": json.dumps(stop)}
