"""Readers, writers, the load generator and the shared folder."""

import pytest
from pyspark.sql import functions as F

from fluxgauge import schemas
from fluxgauge.operators import traces
from fluxgauge.session import scratch, shared_dir
from fluxgauge.sources import generator, readers, views, writers


def write_text(spark, lines, path):
    spark.createDataFrame([(line,) for line in lines], "value STRING").write.text(path)


def test_json_requests(spark):
    path = scratch(spark, "json")
    write_text(spark, ['{"deviceId": 1, "measurement": 25.5, "date": "2025-01-31T10:00:00Z"}', "not json",
                       '{"measurement": 1}'], path)
    rows = {r.body[:4]: r.request for r in readers.json_requests(spark, path).collect()}
    assert rows["not "] is None
    assert rows['{"de'].deviceId == 1 and str(rows['{"de'].date) == "2025-01-31 10:00:00"
    assert rows['{"me'].deviceId is None and rows['{"me'].measurement == 1


def test_log_lines(spark):
    path = scratch(spark, "log")
    write_text(spark, [
        "2025-01-31 10:00:00.123  INFO [telemetry-service,abc123def456,789ghi012jkl] handler : Saved, done",
        "2025-01-31 10:00:01.000 ERROR [telemetry-service,,] handler : no trace",
        "a line of another form"], path)
    rows = {r.message: r for r in traces.parse_log(readers.log_lines(spark, path)).collect()}
    saved = rows["handler : Saved, done"]
    assert (saved.level, saved.application, saved.trace_id, saved.span_id, str(saved.logged_at)) == (
        "INFO", "telemetry-service", "abc123def456", "789ghi012jkl", "2025-01-31 10:00:00.123000")
    assert (rows["handler : no trace"].trace_id, rows["handler : no trace"].span_id) == (None, None)
    assert rows[None].level is None


def test_topic_files_round_trip(spark):
    path = scratch(spark, "topic")
    records = views.dead_letter_records(views.readings(spark, "/root/testdata/sf0.001"))
    writers.write_batch(records, path, 0)
    assert readers.topic_files(spark, f"{path}/batch_id=0").count() == records.count()


def test_batches_replace_themselves_and_prune(spark):
    path = scratch(spark, "batches")
    for batch_id, rows in ((0, 3), (1, 5), (1, 2)):
        writers.write_batch(spark.range(rows), path, batch_id)
    assert writers.read_batches(spark, path, "id BIGINT").count() == 5
    assert writers.read_batches(spark, path, "id BIGINT", before=1).count() == 3
    assert writers.read_batches(spark, f"{path}-missing", "id BIGINT", before=0).count() == 0
    opened = writers.read_batches(spark, path, "id BIGINT", before=1).inputFiles()
    assert opened and all("/batch_id=0/" in f for f in opened)


def test_generator_is_repeatable_and_bounded(spark):
    first, again = generator.readings(spark, 200), generator.readings(spark, 200)
    assert sorted(first.collect()) == sorted(again.collect())
    row = first.agg(F.min("device_id").alias("d0"), F.max("device_id").alias("d1"),
                    F.min("measurement").alias("m0"), F.max("measurement").alias("m1")).first()
    assert 1 <= row.d0 and row.d1 <= 10 and 10 <= row.m0 and row.m1 <= 59


def test_schemas_parse(spark):
    for name in ("REQUEST", "TELEMETRY", "PROJECTION", "FALLBACK", "EVENT", "TOPIC_RECORD", "DEVICE_RESPONSE", "REJECT",
                 "METRIC_SAMPLE", "SPAN", "OUTCOME"):
        assert spark.createDataFrame([], getattr(schemas, name)).columns


class Session:
    """A session's two facts that the shared folder depends on."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"{master}-application"})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder)})


def test_shared_folder_comes_from_the_session():
    assert shared_dir(Session("yarn", "s3a://bucket/checkpoints/")) == "s3a://bucket/checkpoints"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("yarn"))
    assert shared_dir(Session("local[2]"))
