"""Replay and reprocessing: whole results wherever a run is ended, and untouched folders stay untouched."""

import os

import pytest
from pyspark.sql import functions as F

from fluxgauge import schemas
from fluxgauge.functions import codec
from fluxgauge.session import scratch
from fluxgauge.sources import writers
from fluxgauge.streaming import jobs
from fluxgauge.streaming.deletes import DeletableTable
from fluxgauge.streaming.tables import BatchTable


class Ended(Exception):
    """The driver was lost."""


def rows(spark, first, n):
    return spark.range(first, first + n).select(
        F.concat(F.lit("e"), "id").alias("event_id"), (F.col("id") % 3).alias("device_id"),
        (F.col("id") / 2).cast("decimal(10,2)").alias("measurement"),
        F.timestamp_seconds(F.col("id") * 60).alias("date"), F.timestamp_seconds(F.col("id") * 60 + 5).alias("failed_at"))


def fallback_table(spark, root):
    table = DeletableTable(f"{root}/fallback", schemas.FALLBACK, "event_id")
    for batch in range(3):
        table.write(rows(spark, batch * 10, 10), batch)
    return table


class Sink:
    """Keeps one folder per run, like the file sink, and refuses the ids it is told to."""

    def __init__(self, root):
        self.table = BatchTable(f"{root}/topic", "eventId STRING, value BINARY")
        self.refuses, self.down = (), False

    def publish(self, records, run):
        if self.down:
            raise ConnectionError("topic is not reachable")
        self.table.write(records.where(~F.col("eventId").isin(*self.refuses)).select("eventId", "value"), run)
        return records.where(F.col("eventId").isin(*self.refuses)).select("eventId")


def ids(df, column="event_id"):
    return sorted(r[0] for r in df.select(column).collect())


def stamps(folder):
    local = folder.removeprefix("file:")
    return {f: os.stat(f"{local}/{f}").st_mtime_ns for f in sorted(os.listdir(local))}


def break_after(monkeypatch, step):
    """End the run just before or after one of its steps."""
    if step == "intent":
        monkeypatch.setattr(jobs.RepublishJob, "_publish", lambda *a: (_ for _ in ()).throw(Ended()))
    elif step == "publishing":
        write = BatchTable.write
        monkeypatch.setattr(BatchTable, "write", lambda self, df, batch_id: (_ for _ in ()).throw(Ended())
                            if self.path.endswith("-published") else write(self, df, batch_id))
    elif step == "published":
        monkeypatch.setattr(jobs.ReplayJob, "settle", lambda *a: (_ for _ in ()).throw(Ended()))
        monkeypatch.setattr(jobs.ReprocessJob, "settle", lambda *a: (_ for _ in ()).throw(Ended()))
    elif step == "settled":
        write = BatchTable.write
        monkeypatch.setattr(BatchTable, "write", lambda self, df, batch_id: (_ for _ in ()).throw(Ended())
                            if self.path.endswith("-commit") else write(self, df, batch_id))


STEPS = ("intent", "publishing", "published", "settled")


@pytest.mark.parametrize("step", STEPS)
def test_replay_goes_on_where_it_was_ended(spark, step):
    root = scratch(spark, "replay")
    table, sink = fallback_table(spark, root), Sink(root)
    sink.refuses = ("e3", "e14")
    job = jobs.ReplayJob(root, sink.publish, table)
    with pytest.MonkeyPatch.context() as patch, pytest.raises(Ended):
        break_after(patch, step)
        job.run(spark)
    late = rows(spark, 100, 2)
    table.write(late, 3)  # arrives while the run is open; it belongs to the next one
    first = job.run(spark)
    assert (first.run, first.succeeded, first.failed) == (0, 28, 2)
    assert ids(table.read(spark)) == ["e100", "e101", "e14", "e3"]
    sink.refuses = ("none",)
    second = job.run(spark)
    assert (second.run, second.succeeded, second.failed, second.message) == (1, 4, 0, "Successfully replayed 4 events")
    assert table.read(spark).count() == 0
    third = job.run(spark)
    assert (third.run, third.succeeded, third.message) == (None, 0, "No fallback events to replay")
    assert ids(sink.table.read(spark), "eventId") == sorted([f"e{i}" for i in range(30)] + ["e100", "e101"])  # each once
    assert [tuple(r) for r in job.history(spark).orderBy("run").select("run", "succeeded", "failed").collect()] == [(0, 28, 2), (1, 4, 0)]


def test_replay_waits_for_a_healthy_sink_and_keeps_all_when_it_fails(spark):
    root = scratch(spark, "gate")
    table, sink, gate = fallback_table(spark, root), Sink(root), {"healthy": False}
    job = jobs.ReplayJob(root, sink.publish, table, lambda: gate["healthy"])
    assert job.run(spark).run is None and not os.path.exists(f"{root}/replay-intent")
    gate["healthy"], sink.down = True, True
    failed = job.run(spark)
    assert (failed.succeeded, failed.failed) == (0, 30) and table.read(spark).count() == 30
    sink.down, sink.refuses = False, ("none",)
    assert job.run(spark).succeeded == 30 and table.read(spark).count() == 0


def test_events_go_out_oldest_first_with_the_time_of_failure(spark):
    root = scratch(spark, "order")
    seen = []

    def publish(records, run):
        seen.extend(codec.decode_events(records).select("event.*").collect())

    jobs.ReplayJob(root, publish, fallback_table(spark, root)).run(spark)
    assert [r.eventId for r in seen] == [f"e{i}" for i in range(30)]
    assert all((r.recordedAt - r.date).total_seconds() == 5 for r in seen)


@pytest.mark.parametrize("step", STEPS)
def test_reprocessing_goes_on_where_it_was_ended(spark, step):
    root = scratch(spark, "reprocess")
    events = rows(spark, 0, 12).select(
        "event_id", codec.encode_event(
            F.col("event_id").alias("eventId"), F.col("device_id").alias("deviceId"), F.col("measurement"), F.col("date"),
            F.col("failed_at").alias("recordedAt")).alias("json"))
    letters = events.select(
        F.lit(None).cast("binary").alias("key"),
        F.when(F.col("event_id") == "e11", F.lit("#")).otherwise(F.col("json")).cast("binary").alias("value"), F.lit("dlq").alias("topic"),
        F.lit(0).alias("partition"), F.substring("event_id", 2, 9).cast("bigint").alias("offset"), F.current_timestamp().alias("timestamp"),
        F.expr("cast(array() as array<struct<key:string,value:binary>>)").alias("headers"))
    again = letters.where("offset = 4").withColumn("partition", F.lit(1))  # the same event, dead-lettered once more
    sink = Sink(root)
    sink.refuses = ("e2",)
    job = jobs.ReprocessJob(root, sink.publish, lambda s: letters.unionByName(again))
    with pytest.MonkeyPatch.context() as patch:
        break_after(patch, step)
        with pytest.raises(Ended):
            job.run(spark)
    first = job.run(spark)
    assert (first.succeeded, first.failed) == (11, 1)
    sink.refuses = ("none",)
    second = job.run(spark)
    assert (second.succeeded, second.failed, second.message) == (1, 0, "Successfully reprocessed 1 messages from DLQ")
    assert job.run(spark).run is None and job.ledger(spark).count() == 12
    assert ids(sink.table.read(spark), "eventId") == sorted([f"e{i}" for i in range(11)] + ["e4"])


def test_rewrite_touches_only_folders_that_lost_rows(spark):
    root = scratch(spark, "rewrite")
    table = fallback_table(spark, root)
    table.delete(table.read(spark).where(F.col("event_id").isin("e3", "e14")), 0)
    table.delete(table.read(spark).where(F.col("event_id").isin("e15")), 1)
    left = ids(table.read(spark))
    assert len(left) == 27
    before = stamps(f"{root}/fallback/batch_id=2")
    assert table.rewrite(spark) == [0, 1]
    assert ids(table.read(spark)) == left and stamps(f"{root}/fallback/batch_id=2") == before
    assert writers.written_batches(spark, f"{root}/fallback-deletes") == []
    opened = table.read(spark).inputFiles()
    assert not any("fallback/batch_id=0" in f or "fallback/batch_id=1" in f for f in opened)
    assert table.rewrite(spark) == []
    table.delete(table.read(spark).where(F.col("event_id").isin("e0", "e25")), 2)
    assert table.rewrite(spark) == [0, 2] and len(ids(table.read(spark))) == 25


def test_rewrite_that_ends_half_way_changes_nothing(spark, monkeypatch):
    root = scratch(spark, "half")
    table = fallback_table(spark, root)
    table.delete(table.read(spark).where(F.col("event_id").isin("e3", "e14", "e25")), 0)
    left, calls = ids(table.read(spark)), []

    def write(df, folder, partition_by=()):
        calls.append(folder)
        if len(calls) == 2:
            raise Ended()
        writers.write_folder(df, folder, partition_by)

    with monkeypatch.context() as patch, pytest.raises(Ended):
        patch.setattr("fluxgauge.streaming.deletes.write_folder", write)
        table.rewrite(spark)
    assert ids(table.read(spark)) == left
    assert table.rewrite(spark) == [1, 2] and ids(table.read(spark)) == left  # folder 0 was done
    table.write(rows(spark, 0, 10), 0)  # its batch is repeated by a restarted stream
    assert ids(table.read(spark)) == left
