"""Replay of the fallback table and reprocessing of dead letters as jobs that may be ended at any point.

A run has four steps, each one table folder named by the run, complete or not there at all:

1. intent: the events it is going to publish;
2. published: which of them the sink took;
3. settled: delete files of the fallback table, or nothing where the ``published`` table is itself the ledger;
4. commit: the counts and the reply text.

The next call goes on with a run that has an intent and no commit. If the run was ended while publishing, the events go
out again with the same ids and the same run number, so a sink that keeps one folder per run replaces it, and a topic
receives repeats that the read model absorbs. No step reads a row that a later step removes.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge import schemas
from fluxgauge.functions import outcome
from fluxgauge.operators import dead_letter, events, fallback
from fluxgauge.sources.writers import finished, folder_names
from fluxgauge.streaming.deletes import DeletableTable
from fluxgauge.streaming.tables import BatchTable

# Receives topic records with their ``eventId`` and the run; returns the ids (``eventId``) that it refused, or None.
Publisher = Callable[[DataFrame, int], DataFrame | None]

COMMIT = "succeeded BIGINT, failed BIGINT, message STRING"


@dataclass(frozen=True)
class Summary:
    """One run's result; ``run`` is None if nothing was tried."""

    run: int | None
    succeeded: int
    failed: int
    message: str


@dataclass
class RepublishJob(ABC):
    """The four steps; subclasses say what is published and what happens to what was taken."""

    root: str
    publish: Publisher

    name = "republish"
    identity = ""              # columns that tell the source's rows apart
    done, nothing = "", ""     # reply texts

    def _table(self, step: str, schema: str) -> BatchTable:
        return BatchTable(f"{self.root}/{self.name}-{step}", schema)

    @property
    def intents(self) -> BatchTable:
        return self._table("intent", f"{self.identity}, {schemas.EVENT}")

    @property
    def outcomes(self) -> BatchTable:
        return self._table("published", f"{self.identity}, eventId STRING, published BOOLEAN")

    @property
    def commits(self) -> BatchTable:
        return self._table("commit", COMMIT)

    @abstractmethod
    def open_rows(self, spark: SparkSession) -> DataFrame:
        """The identity columns and the event of every row that is still to be published, in order."""

    def settle(self, taken: DataFrame, run: int) -> None:
        """What follows for the rows that were published; must be safe to repeat."""

    def ready(self) -> bool:
        return True

    def _message(self, count: Column) -> Column:
        return outcome.count_message(count, self.done, self.nothing)

    def _has(self, spark: SparkSession, table: BatchTable, run: int) -> bool:
        return finished(spark, f"{table.path}/batch_id={run}")

    def _next_run(self, spark: SparkSession) -> tuple[int, bool]:
        """The run to make, and whether its intent is already there."""
        intents = [r for r in folder_names(spark, self.intents.path, "batch_id") if self._has(spark, self.intents, r)][-1:]
        if not intents:
            return 0, False
        last = intents[0]
        return (last + 1, False) if self._has(spark, self.commits, last) else (last, True)

    def _publish(self, spark: SparkSession, run: int) -> None:
        intent = self.intents.read_batch(spark, run)
        records = events.topic_records(intent, F.col("recordedAt"), keep=("eventId",))
        try:
            refused = self.publish(records, run)
        except Exception:  # the sink decides what fails; then no event of the run counts as published
            verdict = intent.withColumn("published", F.lit(False))
        else:
            verdict = intent.withColumn("published", F.lit(True))
            if refused is not None:
                no = refused.select("eventId", F.lit(True).alias("no")).distinct()
                verdict = intent.join(no, "eventId", "left").withColumn("published", F.col("no").isNull())
        columns = [c.split()[0] for c in self.outcomes.schema.split(", ")]
        self.outcomes.write(verdict.select(*columns), run)

    def run(self, spark: SparkSession) -> Summary:
        """Finish the open run, or make a new one with all rows that are there; a run without rows leaves no trace."""
        if not self.ready():
            return self._empty(spark)
        run, open_ = self._next_run(spark)
        if not open_:
            self.intents.write(self.open_rows(spark), run)
            if self.intents.read_batch(spark, run).isEmpty():
                self.intents.remove(spark, run)
                return self._empty(spark)
        if not self._has(spark, self.outcomes, run):
            self._publish(spark, run)
        result = self.outcomes.read_batch(spark, run)
        self.settle(result.where("published"), run)
        self.commits.write(result.agg(
            F.count_if("published").alias("succeeded"), F.count_if(~F.col("published")).alias("failed")).withColumn(
            "message", self._message(F.col("succeeded"))), run)
        return Summary(run, *self.commits.read_batch(spark, run).first())

    def _empty(self, spark: SparkSession) -> Summary:
        return Summary(None, 0, 0, spark.range(1).select(self._message(F.lit(0))).first()[0])

    def history(self, spark: SparkSession) -> DataFrame:
        """Every committed run with its counts and reply text; the tallies of a longer time are sums over it."""
        return self.commits.read(spark, numbered="run")


@dataclass
class ReplayJob(RepublishJob):
    """Publish the fallback table's events, oldest first, and delete those that the sink took.

    ``table`` is a deletable table of fallback rows with the key event_id; ``healthy`` is the gate: while it is false, no
    row is read. A row whose event is refused, or a run whose publishing fails, stays in the table for the next run.
    """

    table: DeletableTable
    healthy: Callable[[], bool] = lambda: True

    name = "replay"
    identity = "of_batch BIGINT, event_id STRING"
    done, nothing = outcome.REPLAYED, outcome.NOTHING_TO_REPLAY

    def ready(self) -> bool:
        return self.healthy()

    def open_rows(self, spark: SparkSession) -> DataFrame:
        rows = fallback.oldest_first(self.table.read(spark))
        event = fallback.replay(rows.withColumn("of_batch", F.col("batch_id")), True, "of_batch", "event_id")
        return event.withColumn("measurement", F.col("measurement").cast(schemas.WIRE_DECIMAL))

    def settle(self, taken: DataFrame, run: int) -> None:
        self.table.delete(taken.withColumnRenamed("of_batch", "batch_id"), run)


@dataclass
class ReprocessJob(RepublishJob):
    """Publish the events of all dead letters that no earlier run published.

    Dead letters are never removed from ``letters``; the runs' outcome tables are the ledger, by the record's partition
    and offset. Records that cannot be decoded are left out; refused ones are counted and tried again by the next run.
    """

    letters: Callable[[SparkSession], DataFrame]

    name = "reprocess"
    identity = "partition INT, offset BIGINT"
    done, nothing = outcome.REPROCESSED, outcome.NOTHING_TO_REPROCESS

    def ledger(self, spark: SparkSession) -> DataFrame:
        """partition and offset of every dead letter that was published again."""
        return self.outcomes.read(spark).where("published").select("partition", "offset")

    def open_rows(self, spark: SparkSession) -> DataFrame:
        listed = dead_letter.messages(self.letters(spark)).select("partition", "offset", "event.*")
        return dead_letter.in_topic_order(listed.join(self.ledger(spark), ["partition", "offset"], "left_anti"))
