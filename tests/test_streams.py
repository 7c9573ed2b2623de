"""Streams in several batches: equal to batch results, safe to repeat, nothing lost."""

import datetime
import random
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import compare
from fluxgauge import schemas
from fluxgauge.functions import headers, ids, outcome
from fluxgauge.operators import dedup, events, fallback, metrics, projection, series, validate
from fluxgauge.plans import catalog
from fluxgauge.plans import streams as plans
from fluxgauge.session import scratch
from fluxgauge.sources import readers, writers
from fluxgauge.streaming import bloom, delivery, flows, live, stateful
from fluxgauge.streaming.tables import AuditTable, BatchTable, ProjectionTable

READING = "device_id BIGINT, measurement DECIMAL(38,9), date TIMESTAMP, arrival_seq BIGINT"


def now():
    return F.lit("2025-02-01 00:00:00").cast("timestamp")


def arrivals(spark, rows=120, seed=1):
    """Readings with repeats, disorder, a busy device, missing fields and future dates."""
    rng = random.Random(seed)
    data = [
        (seq, None if rng.random() < 0.03 else (0 if rng.random() < 0.5 else rng.randrange(5)), rng.randrange(4000),
         "2026-01-01 00:00:00" if rng.random() < 0.03 else f"2025-01-{rng.randrange(1, 15):02d} {rng.randrange(4):02d}:00:00")
        for seq in range(rows)
    ]
    return spark.createDataFrame(data, "arrival_seq BIGINT, device_id BIGINT, m BIGINT, d STRING").select(
        "device_id", (F.col("m") / 100).cast("decimal(38,9)").alias("measurement"),
        F.col("d").cast("timestamp").alias("date"), "arrival_seq")


def in_files(df, path, files, column="arrival_seq"):
    """Write rows as consecutive files, oldest first."""
    rows = df.agg(F.max(column)).first()[0] + 1
    for i in range(files):
        part = df.where((F.col(column) >= rows * i // files) & (F.col(column) < rows * (i + 1) // files))
        part.coalesce(1).write.mode("append").parquet(path)


def plain(df, *columns):
    return sorted(tuple(str(v) for v in row) for row in df.select(*columns).collect())


def write_side(spark, root, publish=None):
    topic = BatchTable(f"{root}/topic", schemas.TOPIC_RECORD)
    return flows.WriteSide(root, publish or topic.write, now=now), topic


def run(spark, root, process, schema, source):
    stream = readers.file_stream(spark, source, schema, files_per_trigger=1)
    flows.run_once(stream, process, f"{root}/checkpoint")


def test_arriving_events_are_dealt_evenly(spark, tmp_path):
    """A table in order of time has an arriving share in few of its files."""
    spark.range(8000).selectExpr(
        "id AS event_id", "CAST(timestamp_seconds(id) AS TIMESTAMP_NTZ) AS ts", "id % 9 AS user_id", "'click' AS event_type",
        "CAST(1 AS DOUBLE) AS value", "'{}' AS props").repartitionByRange(4, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        next(plans._arriving(spark, str(tmp_path), f"{tmp_path}/input"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = [r["count"] for r in spark.read.parquet(f"{tmp_path}/input").groupBy(F.input_file_name()).count().collect()]
    assert sum(rows) > 1000 and max(rows) < sum(rows) * 0.6


def test_write_side_equals_batch(spark):
    root = scratch(spark, "write")
    df = arrivals(spark)
    in_files(df, f"{root}/in", 4)
    side, topic = write_side(spark, root)
    batches = []

    def process(batch, batch_id):
        batches.append(batch_id)
        side.process(batch, batch_id)

    run(spark, root, process, READING, f"{root}/in")
    assert batches == [0, 1, 2, 3]

    checked = validate.classify(df, now())
    expected = dedup.first_arrivals(validate.valid(checked))
    columns = ("device_id", "date", "measurement", "arrival_seq")
    assert plain(side.audit.read(spark), *columns) == plain(expected, *columns)
    assert plain(side.rejects.read(spark), "arrival_seq", "status", "message") == plain(
        validate.rejects(checked, now()), "arrival_seq", "status", "message")
    assert topic.read(spark).count() == expected.count()
    counted = {r.metric: r.n for r in side.counters.read(spark).groupBy("metric").agg(F.sum("value").alias("n")).collect()}
    assert counted["telemetry.received.total"] == df.dropna().count()
    assert counted["telemetry.duplicates.total"] == validate.valid(checked).count() - expected.count()


def test_repeated_batch_keeps_nothing_twice(spark):
    root = scratch(spark, "repeat")
    df = arrivals(spark, 60)
    side, topic = write_side(spark, root)
    first, second = df.where("arrival_seq < 30"), df.where("arrival_seq >= 30")
    side.process(first, 0)
    side.process(second, 1)
    before = plain(side.audit.read(spark), "arrival_seq")
    side.process(second, 1)
    assert plain(side.audit.read(spark), "arrival_seq") == before
    assert topic.read(spark).count() == len(before)


def test_duplicate_check_opens_only_days_that_may_hold_a_pair(spark):
    root = scratch(spark, "days")
    side, _ = write_side(spark, root)
    first = arrivals(spark, 80)
    side.process(first, 0)
    stored = side.audit.read(spark)
    known = stored.where("date < '2025-01-03'").select("device_id", "date", F.to_date("date").alias("day"))
    days = {str(r.day) for r in known.collect()}
    assert days and side.audit.may_hold(spark, known, 1) == {(0, 0): [f"/day={d}" for d in sorted(days)]}
    assert {str(r.date)[:10] for r in side.audit.possible(spark, known, 1).collect()} == days
    unknown = spark.createDataFrame([(7, "1970-01-01 05:00:00")], "device_id BIGINT, date STRING").select(
        "device_id", F.col("date").cast("timestamp").alias("date"), F.lit("1970-01-01").cast("date").alias("day"))
    assert side.audit.may_hold(spark, unknown, 1) == {}


def test_bloom_filters_miss_nothing_and_find_little_in_vain(spark):
    keys = spark.range(30_000).select(
        F.date_add(F.lit("2025-01-01").cast("date"), F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 20).cast("int"))).alias("day"),
        F.xxhash64("id").alias("hash"), "id")
    even = keys.where("id % 2 = 0")
    entries = bloom.filters(even).withColumn("of", F.lit(1))
    assert entries.groupBy("day").count().agg(F.max("count")).first()[0] > 1 and entries.agg(F.max(F.size("bits"))).first()[0] <= 2 * bloom.KEYS // bloom.PER_WORD
    assert sorted(r.day for r in bloom.hits(even, entries, ["of"]).collect()) == sorted(r.day for r in even.select("day").distinct().collect())
    single = keys.where("id % 2 = 1").select("day", "hash", "id")
    alone = sum(bloom.hits(single.where(F.col("id") == i).select("day", "hash"), entries, ["of"]).count() for i in range(1, 16, 2))
    assert alone <= 1  # eight keys that are not there


def test_merged_segments_keep_all_rows_and_bound_what_is_opened(spark):
    root = scratch(spark, "merge")
    table = AuditTable(f"{root}/audit", fan=3)
    counts = []
    for batch in range(20):
        table.merge(spark, batch)
        rows = spark.range(4).select(
            "id", (F.lit(batch * 4) + F.col("id")).alias("arrival_seq"), F.lit(1).cast("decimal(10,2)").alias("measurement"),
            F.timestamp_seconds(F.lit(batch * 4) + F.col("id") + F.lit(1_700_000_000)).alias("date"), now().alias("recorded_at")).withColumnRenamed("id", "device_id")
        table.append(rows.select("device_id", "measurement", "date", "recorded_at", "arrival_seq"), batch)
        counts.append(len(table.segments(spark)))
    assert max(counts) <= 3 * 3 and counts[18:] == [3, 4]
    assert sorted(r.arrival_seq for r in table.read(spark).collect()) == list(range(80))
    old = table.read(spark).where("arrival_seq = 2").select("device_id", "date", F.to_date("date").alias("day"))
    assert [s for s in table.may_hold(spark, old, 20) if s[0]] == [(2, 8)]  # of the merged segments only the one that has it
    assert table.possible(spark, old, 20).where("arrival_seq = 2").count() == 1
    assert len(writers.folder_names(spark, f"{root}/audit", "batch_id")) <= 3  # merged folders are gone


def test_merge_that_ends_half_way_changes_nothing(spark, monkeypatch):
    root = scratch(spark, "half")
    table = AuditTable(f"{root}/audit", fan=2)
    side, _ = write_side(spark, root)
    side.audit = table
    df = arrivals(spark, 60)
    side.process(df.where("arrival_seq < 30"), 0)
    side.process(df.where("arrival_seq >= 30"), 1)
    before = plain(table.read(spark), "arrival_seq")
    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(AuditTable, "_describe", lambda *a: (_ for _ in ()).throw(RuntimeError("ended")))
        table.merge(spark, 2)
    assert plain(table.read(spark), "arrival_seq") == before and table.segments(spark) == [(0, 0), (0, 1)]
    side.process(df, 2)  # all repeats
    assert plain(table.read(spark), "arrival_seq") == before and (1, 1) in table.segments(spark)
    side.process(df, 2)  # the batch is repeated
    assert plain(table.read(spark), "arrival_seq") == before


def test_failed_batch_is_repeated_after_restart(spark):
    root = scratch(spark, "restart")
    df = arrivals(spark, 60)
    in_files(df, f"{root}/in", 3)
    side, topic = write_side(spark, root)
    failures = [1]

    def process(batch, batch_id):
        side.process(batch, batch_id)
        if batch_id in failures:
            failures.remove(batch_id)
            raise RuntimeError("executor lost")

    with pytest.raises(Exception, match="executor lost"):
        run(spark, root, process, READING, f"{root}/in")
    run(spark, root, process, READING, f"{root}/in")
    expected = dedup.first_arrivals(validate.valid(validate.classify(df, now())))
    assert plain(side.audit.read(spark), "arrival_seq") == plain(expected, "arrival_seq")
    assert topic.read(spark).count() == expected.count()


def test_unreachable_topic_falls_back_and_replays(spark):
    root = scratch(spark, "fallback")
    df = arrivals(spark, 80)
    in_files(df, f"{root}/in", 2)
    topic = BatchTable(f"{root}/topic", schemas.TOPIC_RECORD)

    def publish(records, batch_id):
        if batch_id == 1:
            raise ConnectionError("topic is not reachable")
        topic.write(records, batch_id)

    side, _ = write_side(spark, root, publish)
    run(spark, root, side.process, READING, f"{root}/in")
    accepted, kept = side.audit.read(spark), side.fallback.read(spark)
    assert kept.count() > 0
    assert topic.read(spark).count() + kept.count() == accepted.count()

    again = events.topic_records(fallback.replay(kept, True), F.col("recordedAt"))
    topic.write(again, 2)
    assert topic.read(spark).count() == accepted.count()
    assert fallback.remaining(kept, kept).count() == 0


def test_failing_fallback_fails_the_batch(spark):
    def broken(rows, batch_id):
        raise OSError("down")

    with pytest.raises(OSError):
        delivery.with_fallback(broken, broken)(None, None, 0)


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def sink(rows, batch_id):
        calls.append(batch_id)
        if len(calls) < 4:
            raise OSError("busy")

    delivery.with_retries(sink, None, 7, waits.append)
    assert (waits, calls) == ([1.0, 2.0, 4.0], [7] * 4)
    calls.clear()
    with pytest.raises(OSError):
        delivery.with_retries(lambda rows, batch_id: (_ for _ in ()).throw(OSError()), None, 0, waits.append)
    assert len(delivery.delays()) == outcome.MAX_RETRIES


def topic_of(spark, df):
    good = df.dropna().withColumn("measurement", F.col("measurement").cast("decimal(10,2)"))
    records = events.topic_records(
        events.envelope(good, now(), keep=("arrival_seq",)), now(), keep=("arrival_seq",))
    broken = F.when(F.col("arrival_seq") % 10 == 3, F.encode(F.lit("{"), "UTF-8")).otherwise(F.col("value"))
    return records.select("key", broken.alias("value"), "topic", "partition", F.col("arrival_seq").alias("offset"), "timestamp", "headers")


@pytest.mark.parametrize("full_every", [1, 2, 50])
def test_read_side_equals_batch(spark, full_every):
    root = scratch(spark, "read")
    df = arrivals(spark, 100, seed=full_every)
    in_files(topic_of(spark, df), f"{root}/in", 5, "offset")
    side = flows.ReadSide(root, now=now, wait=lambda s: None)
    side.projection = ProjectionTable(f"{root}/projection", full_every)
    run(spark, root, side.process, schemas.TOPIC_RECORD, f"{root}/in")

    good = df.dropna().where("arrival_seq % 10 <> 3").withColumn("measurement", F.col("measurement").cast("decimal(10,2)"))
    assert plain(side.projection.current(spark), "device_id", "latest_measurement", "latest_date") == plain(
        projection.latest(good), "device_id", "latest_measurement", "latest_date")
    flags = side.flags.read(spark).withColumn("arrival_seq", ids.arrival_offset(F.col("arrival_seq")))  # partitions go first
    assert plain(flags, "arrival_seq", "out_of_order") == plain(
        projection.with_out_of_order(good), "arrival_seq", "out_of_order")
    dead = df.dropna().where("arrival_seq % 10 = 3").count()
    assert side.dead_letters.read(spark).count() == dead
    counted = {r.metric: r.n for r in side.counters.read(spark).groupBy("metric").agg(F.sum("value").alias("n")).collect()}
    assert counted["telemetry.dlq.sent.total"] == dead
    assert counted["telemetry.out_of_order.total"] == projection.with_out_of_order(good).where("out_of_order").count()


def test_batch_is_repeated_when_the_tables_fail(spark):
    """No record is to blame, so none is a dead letter; the repeated batch gives the state of the whole stream."""
    root = scratch(spark, "outage")
    df = arrivals(spark, 40)
    waits, attempts, down = [], [], [True]
    side = flows.ReadSide(root, now=now, wait=waits.append)
    fold = side.fold

    def failing(batch, batch_id):
        attempts.append(batch_id)
        if batch_id == 0 and down[0]:
            raise OSError("store is down")
        fold(batch, batch_id)

    side.fold = failing
    records = topic_of(spark, df)
    part = lambda batch_id: records.where(F.col("offset") % 3 == batch_id)
    with pytest.raises(OSError):
        side.process(part(0), 0)
    assert attempts == [0, 0, 0, 0] and waits == [1.0, 2.0, 4.0]
    down[0] = False
    for batch_id in range(3):
        side.process(part(batch_id), batch_id)
    whole = flows.ReadSide(scratch(spark, "whole"), now=now, wait=waits.append)
    whole.process(records, 0)
    assert plain(side.projection.current(spark), "device_id", "latest_date") == plain(
        whole.projection.current(spark), "device_id", "latest_date")
    assert side.dead_letters.read(spark).count() == whole.dead_letters.read(spark).count()


def test_incomplete_events_are_dead_letters(spark):
    root = scratch(spark, "incomplete")
    values = ['{"eventId":"a","measurement":1.5,"date":"2025-01-31T10:00:00Z"}',
              '{"eventId":"b","deviceId":1,"measurement":1234567890123.5,"date":"2025-01-31T10:00:00Z"}',
              '{"eventId":"c","deviceId":1,"measurement":1.5}', '{"eventId":"d","deviceId":1,"date":"2025-01-31T10:00:00Z"}',
              '{"eventId":"e","deviceId":1,"measurement":1.5,"date":"2025-01-31"}', 'x',
              '{"eventId":"f","deviceId":7,"measurement":2.5,"date":"2025-01-31T10:00:00Z"}']
    records = spark.createDataFrame(list(enumerate(values)), "offset long, text string").select(
        F.lit(None).cast("binary").alias("key"), F.col("text").cast("binary").alias("value"), F.lit("t").alias("topic"),
        F.lit(0).alias("partition"), "offset", F.timestamp_micros(F.lit(0)).alias("timestamp"),
        F.array().cast("array<struct<key:string,value:binary>>").alias("headers"))
    side = flows.ReadSide(root, now=now)
    side.process(records, 0)
    assert [r.device_id for r in side.projection.current(spark).collect()] == [7]
    assert side.dead_letters.read(spark).count() == 6


@pytest.mark.parametrize("full_every", [1, 2, 3])
def test_no_state_is_lost_whichever_batches_are_missing(spark, full_every):
    batch = lambda b: spark.createDataFrame([(b % 3, float(b), b), (10 + b, float(b), b)], "device_id long, v double, d long").select(
        "device_id", F.col("v").cast("decimal(10,2)").alias("latest_measurement"), F.timestamp_seconds(F.col("d")).alias("latest_date"))
    for missing in ({0}, {2}, {0, 1, 2, 3}, {3, 4}):
        table = ProjectionTable(f"{scratch(spark, 'gaps')}/projection", full_every)
        assert table.current(spark).count() == 0
        there = [b for b in range(5) if b not in missing]
        for b in there:
            table.write(batch(b), b, F.current_timestamp())
        want = {b % 3: float(b) for b in there} | {10 + b: float(b) for b in there}
        assert {r.device_id: float(r.latest_measurement) for r in table.current(spark).collect()} == want


def memory_rows(spark, stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", scratch(spark, name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_stateful_forms(spark):
    root = scratch(spark, "stateful")
    df = arrivals(spark, 60).dropna()
    in_files(df, f"{root}/in", 1)
    source = readers.file_stream(spark, f"{root}/in", READING)
    pairs = df.select("device_id", "date").distinct().count()
    assert memory_rows(spark, stateful.dedup_all_history(source), "every_pair", "append").count() == pairs
    assert memory_rows(spark, stateful.dedup_within(source, "400 days"), "recent_pairs", "append").count() == pairs
    latest = memory_rows(spark, stateful.latest(source), "latest_state", "complete")
    assert plain(latest, "device_id", "latest_measurement", "latest_date") == plain(
        projection.latest(df), "device_id", "latest_measurement", "latest_date")


def test_equal_offsets_of_two_partitions_do_not_meet(spark):
    df = spark.createDataFrame([(0, 5), (1, 5), (1, 6), (None, 7), (32767, (1 << 48) - 1)], "partition INT, offset BIGINT")
    numbered = df.withColumn("arrival", ids.arrival(F.col("partition"), F.col("offset")))
    rows = numbered.withColumn("back", ids.arrival_offset(F.col("arrival"))).collect()
    assert len({r.arrival for r in rows}) == len(rows) and all(r.back == r.offset for r in rows)
    assert rows[1].arrival < rows[2].arrival and rows[3].arrival == 7 and rows[4].arrival == (1 << 63) - 1
    for partition, offset in ((1 << 15, 0), (0, 1 << 48), (0, -1)):
        bad = spark.createDataFrame([(partition, offset)], "partition INT, offset BIGINT")
        with pytest.raises(Exception, match="out of range"):
            bad.select(ids.arrival(F.col("partition"), F.col("offset"))).collect()


def published(spark, records):
    """(partition, offset, producer, batch, device, day) as topic records."""
    df = spark.createDataFrame(records, "partition INT, offset BIGINT, producer STRING, batch BIGINT, device BIGINT, day INT")
    rows = df.withColumns({"deviceId": F.col("device"), "measurement": F.lit(1).cast("decimal(10,2)"),
                           "date": F.make_timestamp(F.lit(2025), F.lit(1), F.col("day"), F.lit(0), F.lit(0), F.lit(0))})
    named = events.envelope(rows.withColumnRenamed("device", "device_id"), F.col("date"), keep=("partition", "offset", "producer", "batch"))
    made = events.topic_records(named, F.col("recordedAt"), keep=("offset", "producer", "batch"))
    sent = headers.header(headers.PRODUCER_BATCH, F.concat_ws(":", "producer", F.col("batch").cast("string")))
    parts = named.select("offset", "producer", "batch", F.col("partition").alias("part"))
    return (made.drop("partition").join(parts, ["offset", "producer", "batch"])
            .withColumn("headers", F.when(F.col("producer") == "", F.col("headers")).otherwise(F.array(sent)))
            .select("key", "value", "topic", F.col("part").alias("partition"), "offset", "timestamp", "headers"))


def test_batch_published_again_changes_no_counter(spark):
    side = flows.ReadSide(scratch(spark, "again"), now=now, wait=lambda s: None)

    def counted():
        return {r.metric: r.n for r in side.counters.read(spark).groupBy("metric").agg(F.sum("value").alias("n")).collect()}

    first = published(spark, [(0, 0, "a:1", 3, 1, 9), (0, 1, "a:1", 3, 2, 5), (1, 2, "a:1", 3, 3, 5)])
    side.fold(first, 0)
    # the rest of batch 3 with a repeat, batch 4, a straggler of batch 3, and another producer's batch 0
    side.fold(published(spark, [(0, 3, "a:1", 3, 2, 5), (0, 4, "a:1", 3, 1, 4), (0, 5, "a:1", 4, 1, 3), (0, 6, "b", 0, 1, 9)]), 1)
    before = counted()
    assert before["telemetry.events.repeated.total"] == 1 and before["telemetry.out_of_order.total"] == 2
    # batch 3 again, whose partition 0 is closed and partition 1 is open; a repeated stream batch counts once
    again = published(spark, [(0, 7, "a:1", 3, 1, 4), (0, 8, "a:1", 3, 1, 9), (1, 9, "a:1", 3, 3, 5), (0, 10, "a:1", 4, 1, 3)])
    for _ in range(2):
        side.fold(again, 2)
    after = counted()
    assert after["telemetry.out_of_order.total"] == 2 and after["telemetry.events.repeated.total"] == 5
    # without a batch number a record always passes
    side.fold(published(spark, [(0, 11, "", 0, 1, 4)]), 3)
    assert counted()["telemetry.out_of_order.total"] == 3
    kept = sorted((r.partition, r.producer, r.producer_batch) for r in side.published.read_batch(
        spark, side.published.last_before(spark, 3)).collect())
    assert kept == [(0, "a:1", 4), (0, "b", 0), (1, "a:1", 3)]
    assert len(writers.folder_names(spark, side.published.path, "batch_id")) <= 2


@pytest.mark.parametrize("name", ["stream_republished", "stream_out_of_order", "stream_dlq_split"])
def test_offsets_of_many_events_fit(spark, tmp_path, name):
    """Arrival numbers of 36 million events, with gaps of ten million, are beyond 2^48."""
    at = [36_000_000 + i for i in range(300)]
    pq.write_table(pa.table({
        "event_id": at, "ts": [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=7 * i - i * i % 90) for i in range(300)],
        "user_id": [i % 4 for i in at], "event_type": [("click", "error", "view", "signup", "view")[i % 5] for i in at],
        "value": [i % 13 / 4 for i in at], "props": ['{"k": 1}'] * 300}), f"{tmp_path}/events.parquet")
    assert compare.difference(spark, compare.connect(tmp_path), catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path)) == ""


def test_offsets_are_arrival_numbers_without_gaps(spark):
    number = plans.views.arrival_seq(F.col("id"))
    for first in (0, 36_000_000, 10**11):
        rows = spark.range(first, first + 1000).select(number.alias("n"), plans.views.offset(number).alias("at")).collect()
        assert [r["n"] for r in sorted(rows, key=lambda r: r["at"])] == sorted(r["n"] for r in rows)
        assert 0 <= min(r["at"] for r in rows) and max(r["at"] for r in rows) < 1 << 47 and len({r["at"] for r in rows}) == 1000
        back = spark.createDataFrame([(r["n"], r["at"]) for r in rows], "n long, at long").select("n", plans.views.arrival_at(F.col("at")).alias("b"))
        assert all(r["n"] == r["b"] for r in back.collect())


def test_progress_becomes_samples_with_lag():
    source = {"description": "Kafka", "startOffset": '{"t":{"0":1,"1":1}}', "endOffset": '{"t":{"0":5,"1":7}}',
              "latestOffset": '{"t":{"0":9,"1":7,"2":4}}', "numInputRows": 10, "inputRowsPerSecond": 1.0, "processedRowsPerSecond": 1.0}
    plain_text = source | {"endOffset": "FileOffset", "latestOffset": "None"}
    one_number = source | {"endOffset": '{"logOffset":3}', "latestOffset": '{"logOffset":8}'}
    progress = SimpleNamespace(
        name="s", id="i", numInputRows=10, timestamp="2025-01-01T00:00:00.250Z", durationMs={"triggerExecution": 750},
        sources=[SimpleNamespace(**s) for s in (source, plain_text, one_number)])
    found = live.samples(progress)
    assert {str(ts) for _, _, ts, _ in found} == {"2025-01-01 00:00:01+00:00"}
    assert [(m, v) for m, _, _, v in found] == [
        (live.ROWS, 10.0), (live.BATCH_TIME, 750.0), (live.LAG, 4.0), (live.LAG, 0.0), (live.LAG, 5.0)]
    assert found[2][1] == {"stream": "s", "source": "0", "topic": "t", "partition": "0"}


def test_live_samples_follow_a_stream_and_rates_read_them(spark):
    root = scratch(spark, "live")
    in_files(arrivals(spark, 60), f"{root}/in", 3)
    side, _ = write_side(spark, root)
    watched = live.LiveMetrics(spark, f"{root}/live", ["w"])
    spark.streams.addListener(watched)
    try:
        stream = readers.file_stream(spark, f"{root}/in", READING, files_per_trigger=1)
        running = flows.start(stream, flows.WriteSide(root, side.publish).process, f"{root}/checkpoint", available_now=True, name="w")
        running.awaitTermination()
        watched.settled(running.runId)
    finally:
        spark.streams.removeListener(watched)
    rows = watched.tables["w"].read(spark).where(F.col("metric") == live.ROWS)
    assert [r.value % 20 for r in rows.collect()] == [0, 0, 0]  # every scan of a batch of 20 counts
    waited = watched.tables["w"].read(spark).where(F.col("metric") == live.BATCH_TIME)
    assert waited.count() == waited.where("value > 0").count() == 3
    grown = metrics.cumulative(side.counters.read(spark), ["metric"], "ts", "value")
    received = [r.value for r in grown.where("metric = 'telemetry.received.total'").orderBy("ts").collect()]
    assert len(received) == 3 and received == sorted(received)
    rates = series.counter_rate(grown, ["metric"], 3600).where("metric = 'telemetry.received.total'").collect()
    assert len(rates) == 2 and max(r.increase for r in rates) == received[-1] - received[0]  # the first sample has none before it
