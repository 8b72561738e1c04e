"""The sink: batches of records and quarantine, each visible as a whole from the moment it is committed.

Every batch belongs to an owner, a stream or a backfill run, which has a folder of its own:

    <sink>/owner=<owner>/attempt=<batch>.<n>/outcome=...    records and quarantine of one attempt at a batch
    <sink>/owner=<owner>/_commits/<batch>.<n>.claim         taken by its writer alone, before it writes
    <sink>/owner=<owner>/_commits/<batch>.<n>               its marker, with what became of the batch's messages
    <sink>/owner=<owner>/_commits/compact.<n>               attempts that stand for all batches below a number
    <sink>/owner=<owner>/_plan                              the offset ranges of a backfill run, by batch

An attempt that has no marker is not there for readers. A batch that runs again, or at the same time elsewhere, writes a folder of
its own, and of those with a marker the one claimed last counts; folders that nothing names any more stay for readers that began before, until ``vacuum_sink``.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.decode import transactions
from millrace.operators.enrich import enriched, quarantined
from millrace.schemas import CLASSIFIED, ENRICHED_OUTCOME, ERROR
from millrace.sinks.files import delete_path, file_names, modified, publish_first, publish_text, read_text

# What became of the messages of a batch: received = enriched + skipped + empty + error.
# Enriched ones without a user are also ``unknown``, errors for half a user also ``user_incomplete``.
COUNTED = ("received", "enriched", "skipped", "empty", "error", "unknown", "user_incomplete")
STREAM = "stream"
_COMMITS = "_commits"
_COMPACT = "compact"
_ATTEMPT = re.compile(r"(\d{20})\.(\d{4,})(\.claim)?")
_OWNER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*")

_OWNED = [T.StructField("owner", T.StringType()), T.StructField("batch_id", T.LongType())]
_STORED = T.StructType([*CLASSIFIED.fields, *_OWNED, T.StructField("attempt", T.StringType())])
_COUNTS = T.StructType([*_OWNED, *[T.StructField(name, T.LongType()) for name in COUNTED]])


class Closed(ValueError):
    """The batch was compacted with others and cannot run again."""


@dataclass(frozen=True)
class Owned:
    """What an owner has committed: compacted attempts, then the newest one at every batch from ``below`` on."""

    owner: str
    below: int
    compacted: list[str]
    attempts: dict[int, int]
    claimed: dict[int, int]

    def name(self, batch_id: int) -> str:
        return f"{batch_id:020d}.{self.attempts[batch_id]:04d}"

    def names(self) -> list[str]:
        return [*self.compacted, *map(self.name, sorted(self.attempts))]


# -- commits --------------------------------------------------------------------------------------


def check_owner(owner: str) -> str:
    if not _OWNER.fullmatch(owner):
        raise ValueError(f"an owner's name has letters, digits, points and dashes: {owner!r}")
    return owner


def owners(spark: SparkSession, sink: str) -> list[str]:
    return [name.removeprefix("owner=") for name in file_names(spark, sink) if name.startswith("owner=")]


def owner_folder(sink: str, owner: str) -> str:
    return f"{sink}/owner={check_owner(owner)}"


def _compactions(names: list[str]) -> list[int]:
    return sorted(int(name.split(".")[1]) for name in names if name.startswith(f"{_COMPACT}."))


def committed(spark: SparkSession, sink: str, owner: str) -> Owned:
    """What readers see of an owner. Only names are read, but for the newest compaction's."""
    commits = f"{owner_folder(sink, owner)}/{_COMMITS}"
    names = file_names(spark, commits)
    compactions = _compactions(names)
    about = json.loads(read_text(spark, f"{commits}/{_COMPACT}.{compactions[-1]:06d}")) if compactions else {"below": 0, "attempts": []}
    attempts: dict[int, int] = {}
    claimed: dict[int, int] = {}
    for found in filter(None, map(_ATTEMPT.fullmatch, names)):
        batch_id, attempt, held = int(found[1]), int(found[2]), claimed if found[3] else attempts
        if batch_id >= about["below"]:
            held[batch_id] = max(attempt, held.get(batch_id, 0))
    return Owned(owner, about["below"], about["attempts"], attempts, claimed)


def _claim(spark: SparkSession, sink: str, owner: str, batch_id: int) -> str:
    """The name of a new attempt, which no other writer has."""
    now = committed(spark, sink, owner)
    if batch_id < now.below:
        raise Closed(f"batch {batch_id} of {owner} was compacted")
    attempt = max(now.claimed.get(batch_id, 0), now.attempts.get(batch_id, 0)) + 1
    while not publish_first(spark, f"{owner_folder(sink, owner)}/{_COMMITS}", f"{batch_id:020d}.{attempt:04d}.claim", b""):
        attempt += 1
    return f"{batch_id:020d}.{attempt:04d}"


def write_batch(classified: DataFrame, sink: str, owner: str, batch_id: int) -> str:
    """Writes a batch's records and errors as a new attempt, which nobody sees yet; returns its name."""
    name = _claim(classified.sparkSession, sink, owner, batch_id)
    (
        classified.where(F.col("outcome").isin(ENRICHED_OUTCOME, ERROR))
        .select(*CLASSIFIED.names, F.lit(batch_id).cast("long").alias("batch_id"))
        .write.partitionBy("outcome")
        .parquet(f"{owner_folder(sink, owner)}/attempt={name}")
    )
    return name


def commit_batch(spark: SparkSession, sink: str, owner: str, attempt: str, counts: dict[str, int]) -> None:
    """Shows an attempt to readers, with its counts."""
    row = {"owner": owner, "batch_id": int(attempt.split(".")[0]), **{name: counts[name] for name in COUNTED}}
    publish_text(spark, f"{owner_folder(sink, owner)}/{_COMMITS}", attempt, json.dumps(row))


# -- reading --------------------------------------------------------------------------------------


def _load(spark: SparkSession, sink: str, attempts: list[tuple[str, str]]) -> DataFrame:
    """The rows of (owner, attempt)."""
    paths = [f"{owner_folder(sink, owner)}/attempt={name}" for owner, name in attempts]
    if not paths:
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).option("basePath", sink).parquet(*paths)


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    """Every committed record and error, with the owner and the batch."""
    return _load(spark, sink, [(owner, name) for owner in owners(spark, sink) for name in committed(spark, sink, owner).names()])


def read_enriched(spark: SparkSession, sink: str) -> DataFrame:
    return enriched(read_sink(spark, sink))


def read_quarantine(spark: SparkSession, sink: str) -> DataFrame:
    return quarantined(read_sink(spark, sink))


def read_batch(spark: SparkSession, sink: str, batch_id: int, owner: str = STREAM) -> DataFrame:
    """One batch; of the others not even the folders are listed, but for those it was compacted with."""
    now = committed(spark, sink, owner)
    if batch_id < now.below:
        return _load(spark, sink, [(owner, name) for name in now.compacted]).where(F.col("batch_id") == batch_id)
    return _load(spark, sink, [(owner, now.name(batch_id))] if batch_id in now.attempts else [])


def read_counts(spark: SparkSession, sink: str, owner: str | None = None) -> DataFrame:
    """``owner``, ``batch_id`` and the counts of every batch of the sink, or of one owner."""
    paths = []
    for name in [owner] if owner else owners(spark, sink):
        home, now = owner_folder(sink, name), committed(spark, sink, name)
        paths += [f"{home}/{_COMMITS}/{now.name(batch)}" for batch in sorted(now.attempts)]
        paths += [f"{home}/_counts/{compacted}" for compacted in now.compacted]
    return spark.read.schema(_COUNTS).json(paths) if paths else spark.createDataFrame([], _COUNTS)


# -- upkeep ---------------------------------------------------------------------------------------


def compact_sink(spark: SparkSession, sink: str, file_rows: int = 10_000_000) -> int:
    """Merges the closed batches of every owner into files of about ``file_rows`` rows; returns how many were merged.

    A stream may still repeat its newest batch, which stays apart. Readers see the batches before or after, never both or
    none; what was merged stays on disk until ``vacuum_sink``. Earlier compactions are kept as they are.
    """
    merged = 0
    for owner in owners(spark, sink):
        now = committed(spark, sink, owner)
        closed = sorted(now.attempts)[:-1]
        if len(closed) < 2:
            continue
        home = owner_folder(sink, owner)
        number = (_compactions(file_names(spark, f"{home}/{_COMMITS}")) or [0])[-1] + 1
        name = f"{_COMPACT}.{number:06d}"
        counts = spark.read.schema(_COUNTS).json([f"{home}/{_COMMITS}/{now.name(batch)}" for batch in closed])
        counts.coalesce(1).write.mode("overwrite").json(f"{home}/_counts/{name}")
        kept = counts.agg(F.sum("enriched").alias(ENRICHED_OUTCOME), F.sum("error").alias(ERROR)).first()
        rows = _load(spark, sink, [(owner, now.name(batch)) for batch in closed]).drop("owner", "attempt")
        for outcome in (ENRICHED_OUTCOME, ERROR):
            # one folder a write and dealt by hash: a task that writes to several folders or deals in turn sorts all of its rows before
            held = rows.where(F.col("outcome") == outcome).drop("outcome")
            held = held.repartition(max(1, -(-kept[outcome] // file_rows)), F.xxhash64(*held.columns))
            held.write.mode("overwrite").parquet(f"{home}/attempt={name}/outcome={outcome}")
        about = {"below": closed[-1] + 1, "attempts": [*now.compacted, name]}
        publish_text(spark, f"{home}/{_COMMITS}", name, json.dumps(about))
        merged += len(closed)
    return merged


def vacuum_sink(spark: SparkSession, sink: str, older_than: float = 86_400.0) -> int:
    """Deletes what no reader finds any more and was last changed so many seconds ago; returns how many attempts went.

    The time must exceed that of the longest reader and of the longest batch: a batch's folder is not named before its commit.
    """
    gone, last = 0, time.time() - older_than
    for owner in owners(spark, sink):
        home, now = owner_folder(sink, owner), committed(spark, sink, owner)
        live, markers = set(now.names()), file_names(spark, f"{home}/{_COMMITS}")
        held = {name.removeprefix("attempt=") for name in file_names(spark, home) if name.startswith("attempt=")}
        for name in sorted(held - live):
            if modified(spark, f"{home}/attempt={name}") <= last:
                delete_path(spark, f"{home}/attempt={name}")
                held.discard(name)
                gone += 1
        newest = f"{_COMPACT}.{max(_compactions(markers), default=0):06d}"
        open_ = live | held | {newest}
        for name in markers:  # after the folder; claims stay as long as their batch is open, so that no number is given twice
            batch = name.endswith(".claim") and int(name.split(".")[0]) >= now.below
            if not batch and name not in open_:
                delete_path(spark, f"{home}/{_COMMITS}/{name}")
    return gone


def materialise_raw(decoded: DataFrame, path: str) -> None:
    """Appends the decoded transactions."""
    transactions(decoded).write.mode("append").parquet(path)


def clear_owner(spark: SparkSession, sink: str, owner: str, checkpoint: str) -> None:
    """Drops an owner's batches together with the stream's position; what others wrote stays.

    The position goes first: batches without one are refused by ``run_stream``,
    so a clearing cut short cannot mix old records with replayed ones.
    """
    delete_path(spark, checkpoint)
    delete_path(spark, owner_folder(sink, owner))
