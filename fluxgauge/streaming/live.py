"""Samples with time from the progress of running streams: rows, batch times, and the lag behind the source."""

from __future__ import annotations

import datetime
import json
import threading

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import (
    QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener, StreamingQueryProgress)

from fluxgauge import schemas
from fluxgauge.streaming.tables import BatchTable

# Names of the samples. Rows are what a batch added; the others are values at its end.
ROWS = "stream.rows.read"           # a batch function that scans its batch twice reads each row twice
BATCH_TIME = "stream.batch.ms"      # from the batch's trigger to its commit: how long its rows were not yet visible
LAG = "stream.consumer.lag"

Sample = tuple[str, dict[str, str], datetime.datetime, float]


def _offsets(text: str | None) -> dict[tuple[str, str], int]:
    """Offsets of a source by topic and partition; a source with one number has neither. Other forms have no lag."""
    try:
        found = json.loads(text or "null")
    except ValueError:  # some sources print a text that is no JSON, or "None"
        return {}
    if isinstance(found, int):
        return {("", ""): found}
    if not isinstance(found, dict):
        return {}
    if set(found) == {"logOffset"}:
        return {("", ""): found["logOffset"]}
    return {(topic, part): offset for topic, parts in found.items() if isinstance(parts, dict)
            for part, offset in parts.items() if isinstance(offset, int)}


def samples(progress: StreamingQueryProgress) -> list[Sample]:
    """The samples of one finished batch, all at the moment it was committed."""
    stream = {"stream": progress.name or str(progress.id)}
    took = progress.durationMs.get("triggerExecution", 0)
    begun = datetime.datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00"))
    ts = begun + datetime.timedelta(milliseconds=took)
    out = [(ROWS, stream, ts, float(progress.numInputRows)), (BATCH_TIME, stream, ts, float(took))]
    for number, source in enumerate(progress.sources):
        done, latest = _offsets(source.endOffset), _offsets(source.latestOffset)
        for (topic, part), offset in latest.items():
            if (topic, part) in done:
                labels = stream | {"source": str(number), "topic": topic, "partition": part}
                out.append((LAG, labels, ts, float(max(0, offset - done[topic, part]))))
    return out


class LiveMetrics(StreamingQueryListener):
    """Writes each batch's samples to a table of its stream, in a folder named by the batch id, so that a repeated batch
    replaces its samples. Streams are told apart by their name (``streams``); others are not recorded. Progress without
    rows is no batch. An error of a write is raised by ``settled``.
    """

    def __init__(self, spark: SparkSession, path: str, streams: list[str]):
        self._spark = spark
        self.tables = {name: BatchTable(f"{path}/{name}", schemas.METRIC_SAMPLE) for name in streams}
        self._ended: dict[str, threading.Event] = {}
        self._errors: list[Exception] = []
        self._lock = threading.Lock()

    def _event(self, run_id) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self._event(event.runId)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        progress = event.progress
        if progress.name not in self.tables or not progress.numInputRows:
            return
        try:
            rows = self._spark.createDataFrame(samples(progress), schemas.METRIC_SAMPLE)
            self.tables[progress.name].write(rows, progress.batchId)
        except Exception as error:  # a listener can't fail its stream; whoever waits for it is told
            self._errors.append(error)

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self._event(event.runId).set()

    def settled(self, run_id, timeout: float = 60) -> None:
        """Wait until all progress of an ended run has been recorded."""
        if not self._event(run_id).wait(timeout):
            raise TimeoutError(f"no end of run {run_id} was reported within {timeout} seconds")
        if self._errors:
            raise self._errors[0]
