"""What became of each run of a stream, kept beside the counts of its batches.

Spark's own progress is bounded and ends with the session; a run's row stays, with the failure that ended it.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from millrace.sinks.files import delete_path, file_names, publish_text
from millrace.sinks.records import owner_folder, owners

log = logging.getLogger(__name__)

_RUNS = "_runs"
RUNS = (
    "run_id string, owner string, started string, last_batch long, input_rows long, rows_per_second double,"
    " lag long, ended boolean, failure string"
)


@dataclass
class _Run:
    """A run as it goes; ``rows_per_second`` and ``lag`` (offsets not read yet, where the source tells) are the newest."""

    run_id: str
    owner: str
    started: str
    last_batch: int | None = None
    input_rows: int = 0
    rows_per_second: float | None = None
    lag: int | None = None
    ended: bool = False
    failure: str | None = None


@dataclass
class _Watched:
    sink: str
    owner: str
    release: Callable[[], None]
    run: _Run | None = None
    written: list[str] = field(default_factory=list)


class RunLog(StreamingQueryListener):
    """Writes a row per run of the streams it was told of, anew after every batch, and releases what they hold."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.by_name: dict[str, _Watched] = {}
        self.by_run: dict[str, _Watched] = {}

    def watch(self, name: str, sink: str, owner: str, release: Callable[[], None]) -> None:
        self.by_name[name] = _Watched(sink, owner, release)

    def onQueryStarted(self, event) -> None:
        watched = self.by_name.get(event.name)
        if watched:
            watched.run = _Run(str(event.runId), watched.owner, event.timestamp)
            self.by_run[str(event.runId)] = watched
            self._write(watched)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        watched = self.by_run.get(str(progress.runId))
        if watched:
            run = watched.run
            run.last_batch, run.input_rows = progress.batchId, run.input_rows + max(progress.numInputRows, 0)
            run.rows_per_second = _number(progress.processedRowsPerSecond) or run.rows_per_second
            behind = [source.metrics["maxOffsetsBehindLatest"] for source in progress.sources if "maxOffsetsBehindLatest" in (source.metrics or {})]
            run.lag = sum(map(int, behind)) if behind else None
            self._write(watched)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        watched = self.by_run.pop(str(event.runId), None)
        if watched:
            self.by_name = {name: other for name, other in self.by_name.items() if other is not watched}
            watched.run.ended, watched.run.failure = True, event.exception
            self._write(watched)
            watched.release()

    def _write(self, watched: _Watched) -> None:
        """A new file, then the former ones go; a log that cannot be written does not end the stream."""
        folder = f"{owner_folder(watched.sink, watched.owner)}/{_RUNS}"
        name = f"{watched.run.run_id}.{len(watched.written):08d}"
        try:
            publish_text(self.spark, folder, name, json.dumps(asdict(watched.run)))
            if watched.written:
                delete_path(self.spark, f"{folder}/{watched.written[-1]}")
            watched.written.append(name)
        except Exception:
            log.exception("run %s was not logged", watched.run.run_id)


def _number(value: float) -> float | None:
    return value if value is not None and 0 < value < float("inf") else None


_LOGS: dict[str, RunLog] = {}


def run_log(spark: SparkSession) -> RunLog:
    """The session's listener, one an application."""
    application = spark.sparkContext.applicationId
    if application not in _LOGS:
        _LOGS[application] = RunLog(spark)
        spark.streams.addListener(_LOGS[application])
    return _LOGS[application]


def read_runs(spark: SparkSession, sink: str) -> DataFrame:
    """``RUNS``: a row for each run of the sink's streams, as far as they came."""
    newest = {}
    for owner in owners(spark, sink):
        folder = f"{owner_folder(sink, owner)}/{_RUNS}"
        newest |= {name.split(".")[0]: f"{folder}/{name}" for name in file_names(spark, folder)}  # names are sorted
    return spark.read.schema(RUNS).json(list(newest.values())) if newest else spark.createDataFrame([], RUNS)
