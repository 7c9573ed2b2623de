"""The published cases, one test each; rows are in arrival order."""

import datetime
import itertools
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fluxgauge import schemas
from fluxgauge.functions import codec, headers, ids, outcome
from fluxgauge.operators import dead_letter, dedup, events, fallback, metrics, projection, series, validate

def as_of():
    return F.lit("2025-02-01 00:00:00").cast("timestamp")
READING = "arrival_seq BIGINT, device_id BIGINT, measurement DECIMAL(38,9), date STRING"


def readings(spark, *rows):
    data = [(i, d, None if m is None else Decimal(str(m)), t) for i, (d, m, t) in enumerate(rows)]
    return spark.createDataFrame(data, READING).withColumn("date", F.col("date").cast("timestamp"))


def at(clock):
    return f"2025-01-31 {clock}"


def accepted(df):
    return dedup.first_arrivals(validate.valid(validate.classify(df, as_of())))


def latest_of(df):
    return {r.device_id: (float(r.latest_measurement), str(r.latest_date)[11:]) for r in projection.latest(df).collect()}


def outcome_of(df):
    """Device to (accepted, out of order) counts."""
    flagged = projection.with_out_of_order(accepted(df), block_width=2)
    return flagged.count(), flagged.where("out_of_order").count()


def test_published_sequence(spark):
    df = readings(spark, (1, 10, at("13:00:00")), (2, 8, at("13:00:01")), (1, 12, at("13:00:05")),
                  (2, 19, at("13:00:06")), (2, 10, at("13:00:11")))
    assert latest_of(accepted(df)) == {1: (12.0, "13:00:05"), 2: (10.0, "13:00:11")}


def test_in_order_device(spark):
    df = readings(spark, (200, 20, at("10:00:00")), (200, 22.5, at("10:05:00")), (200, 25, at("10:10:00")))
    assert accepted(df).count() == 3
    assert latest_of(accepted(df)) == {200: (25.0, "10:10:00")}


def test_three_devices(spark):
    df = readings(spark, (300, 18.5, at("11:00:00")), (301, 22, at("11:05:00")), (302, 26.5, at("11:10:00")))
    assert set(latest_of(accepted(df))) == {300, 301, 302}


def test_out_of_order(spark):
    df = readings(spark, (600, 20, at("10:00:00")), (600, 22.5, at("10:05:00")), (600, 21, at("10:02:00")))
    assert outcome_of(df) == (3, 1)
    assert latest_of(accepted(df)) == {600: (22.5, "10:05:00")}


def test_newer_first(spark):
    df = readings(spark, (100, 30, at("14:00:00")), (100, 28, at("13:55:00")))
    assert latest_of(accepted(df)) == {100: (30.0, "14:00:00")}


def test_exact_duplicate(spark):
    df = readings(spark, (500, 28.5, at("14:30:00")), (500, 28.5, at("14:30:00")))
    assert accepted(df).count() == 1
    assert dedup.repeats(df).count() == 1


def test_same_key_other_measurement_keeps_first(spark):
    df = readings(spark, (1, 25.5, at("10:00:00")), (1, 30, at("10:00:00")))
    assert [float(r.measurement) for r in accepted(df).collect()] == [25.5]
    assert latest_of(accepted(df)) == {1: (25.5, "10:00:00")}
    assert {r.device_id: float(r.latest_measurement) for r in projection.latest_accepted(df).collect()} == {1: 25.5}


def test_same_date_other_device_and_other_date(spark):
    df = readings(spark, (1, 25.5, at("10:00:00")), (2, 30, at("10:00:00")), (1, 30, at("10:01:00")))
    assert accepted(df).count() == 3


@pytest.mark.parametrize("row,domain,edge", [
    ((None, 25.5, at("10:00:00")), "deviceId is required", "deviceId: deviceId is required"),
    ((1, None, at("10:00:00")), "measurement is required", "measurement: measurement is required"),
    ((1, 25, None), "date is required", "date: date is required"),
    ((None, None, None), "deviceId is required", "deviceId: deviceId is required"),
    ((1, 25, "2099-12-31 23:59:59"), "date cannot be in the future", "date cannot be in the future"),
])
def test_rejects(spark, row, domain, edge):
    df = readings(spark, row)
    assert validate.with_domain_reason(df, as_of()).first().reason == domain
    rejected = validate.rejects(validate.classify(df, as_of()), as_of()).first()
    assert (rejected.status, rejected.message) == (400, edge)
    assert accepted(df).count() == 0


def test_date_equal_to_now_is_accepted(spark):
    assert accepted(readings(spark, (1, 25, "2025-02-01 00:00:00"))).count() == 1


def stored(spark, *rows):
    return spark.createDataFrame(
        [(d, None if m is None else Decimal(str(m)), t, "2025-01-01 00:00:00") for d, m, t in rows],
        "device_id BIGINT, latest_measurement DECIMAL(10,2), latest_date STRING, updated_at STRING",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("latest_date", "updated_at")})


def merged(spark, old, df):
    rows = projection.merge(old, df.withColumn("measurement", codec.table_decimal(F.col("measurement"))), as_of()).collect()
    return {r.device_id: (float(r.latest_measurement), str(r.latest_date)[11:], str(r.updated_at)[:10]) for r in rows}


def test_projection_without_date_is_updated(spark):
    df = readings(spark, (1, 25.5, at("10:00:00")))
    assert merged(spark, stored(spark, (1, None, None)), df) == {1: (25.5, "10:00:00", "2025-02-01")}
    assert not projection.against_projection(df, stored(spark, (1, None, None))).first().stale


def test_equal_date_overwrites_projection(spark):
    df = readings(spark, (1, 21, at("10:00:00")))
    old = stored(spark, (1, 20, at("10:00:00")))
    assert merged(spark, old, df) == {1: (21.0, "10:00:00", "2025-02-01")}
    assert not projection.with_out_of_order(df, old).first().out_of_order
    assert not projection.against_projection(df, old).first().stale


def test_older_event_leaves_projection(spark):
    df = readings(spark, (1, 21, at("09:00:00")))
    old = stored(spark, (1, 20, at("10:00:00")), (2, 5, at("08:00:00")))
    assert merged(spark, old, df) == {1: (20.0, "10:00:00", "2025-01-01"), 2: (5.0, "08:00:00", "2025-01-01")}
    assert projection.with_out_of_order(df, old).first().out_of_order
    assert projection.against_projection(df, old).first().stale


def test_empty_projection_and_mapping(spark):
    assert projection.device_response(stored(spark).where("false")).count() == 0
    row = projection.device_response(stored(spark, (42, 22.3, at("10:30:00")))).first()
    assert (row.deviceId, row.measurement, str(row.date)) == (42, Decimal("22.30"), at("10:30:00"))


def fallback_table(spark):
    return spark.createDataFrame(
        [("b", 1, Decimal("2.00"), at("10:01:00"), at("11:01:00")), ("a", 1, Decimal("1.00"), at("10:00:00"), at("11:00:00"))],
        "event_id STRING, device_id BIGINT, measurement DECIMAL(10,2), date STRING, failed_at STRING",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("date", "failed_at")})


def test_fallback_replay(spark):
    table = fallback_table(spark)
    assert [r.event_id for r in fallback.oldest_first(table).collect()] == ["a", "b"]
    assert [r.event_id for r in fallback.newest_first(table).collect()] == ["b", "a"]
    assert [str(r.recordedAt)[11:] for r in fallback.replay(fallback.oldest_first(table), True).collect()] == ["11:00:00", "11:01:00"]
    assert fallback.remaining(table, table).count() == 0
    done = fallback.replay_summary(table.withColumn("published", F.lit(True)), True).first()
    assert (done.replayed_count, done.message) == (2, "Successfully replayed 2 events")
    assert fallback.replay(table, False).count() == 0
    skipped = fallback.replay_summary(table.withColumn("published", F.lit(True)), False).first()
    assert (skipped.replayed_count, skipped.message) == (0, "No fallback events to replay")


def record(spark, pairs, value=b"{}"):
    return spark.createDataFrame(
        [(b"1", value, "t", 0, 1, datetime.datetime(2025, 1, 1), [(k, v) for k, v in pairs])], schemas.TOPIC_RECORD)


@pytest.mark.parametrize("pairs,count,message", [
    ([("retry-count", b"1"), ("retry-count", b"3")], 3, "Unknown error"),
    ([("retry-count", b"x"), ("exception-message", b"no")], 0, "no"),
    ([("retry-count", None), ("exception-message", None)], 0, "Unknown error"),
    ([], 0, "Unknown error"),
])
def test_headers(spark, pairs, count, message):
    row = record(spark, pairs).select(
        headers.retry_count(F.col("headers")).alias("n"), headers.error_message(F.col("headers")).alias("m")).first()
    assert (row.n, row.m) == (count, message)


def test_dead_letter_route_keeps_key_and_value(spark):
    good, bad = dead_letter.route(record(spark, [("a", b"b")]), F.lit("cannot store"))
    row = bad.first()
    assert good.count() == 0
    assert (bytes(row.key), bytes(row.value), row.topic) == (b"1", b"{}", "telemetry.recorded.dlq")
    assert [h.key for h in row.headers] == ["a"] + ["retry-count", "exception-message"] * 3
    listed = bad.select(headers.retry_count(F.col("headers")).alias("n")).first()
    assert listed.n == 3


def test_reprocess_ledger_makes_runs_idempotent(spark):
    reading = readings(spark, (1, 20, at("10:00:00")), (2, 21, at("10:00:00")))
    records = events.topic_records(events.envelope(reading, as_of()), as_of()).withColumn("offset", F.lit(1))
    listed = dead_letter.messages(records)
    first = dead_letter.reprocess(listed, listed.select("event.eventId").where("false"))
    assert first.count() == 2
    assert dead_letter.reprocess(listed, first).count() == 0
    assert dead_letter.reprocess(listed).count() == 2
    empty = dead_letter.reprocess_summary(dead_letter.reprocess(listed, first)).first()
    assert (empty.reprocessed_count, empty.message) == (0, "No messages to reprocess in DLQ")


def test_trace_ids(spark):
    rows = spark.createDataFrame(
        [("48485a3953bb6124",), ("463ac35c9f6413ad48485a3953bb6124",), ("abcdef0123",), ("ffffffffffffffff",), ("48485a3953bb612g",), (None,)],
        "t STRING").select(ids.trace_id_low(F.col("t")).alias("lo"), ids.span_id_value(F.col("t")).alias("span")).collect()
    low = Decimal("5208512171318403364")
    assert [r.lo for r in rows] == [low, low, None, Decimal(2**64 - 1), None, None]
    assert [r.span for r in rows] == [low, None, None, Decimal(2**64 - 1), None, None]


def test_retry_schedule(spark):
    due = dead_letter.retry_schedule(
        spark.createDataFrame([(9, "2025-01-01 00:00:00")], "retries INT, t STRING"), F.col("retries"), F.col("t").cast("timestamp"))
    rows = due.orderBy("attempt").collect()
    assert [(r.delay_ms, r.elapsed_ms) for r in rows] == [(1000, 1000), (2000, 3000), (4000, 7000)]
    assert str(rows[-1].due_at) == "2025-01-01 00:00:07"


def test_retry_schedule_numbers_what_the_header_says(spark):
    due = dead_letter.retry_schedule(
        spark.createDataFrame([(9, "2025-01-01 00:00:00")], "retries INT, t STRING"), F.col("retries"), F.col("t").cast("timestamp"),
        max_retries=None)
    rows = due.orderBy("attempt").collect()
    assert [r.delay_ms for r in rows] == [1000 * 2**n for n in range(9)]
    assert rows[-1].elapsed_ms == 511_000


def test_counters(spark):
    df = readings(
        spark, (600, 20, at("10:00:00")), (600, 22.5, at("10:05:00")), (600, 21, at("10:02:00")),
        (500, 28.5, at("14:30:00")), (500, 28.5, at("14:30:00")), (1, 1, "2099-01-01 00:00:00"), (None, 1, at("10:00:00")))
    checked = validate.classify(df, as_of())
    first = dedup.first_arrivals(validate.valid(checked), copies="copies")
    assert checked.agg(metrics.received(checked).alias("n")).first().n == 6
    assert first.agg(F.sum(F.col("copies") - 1).alias("n")).first().n == 1
    assert projection.with_out_of_order(first).where("out_of_order").count() == 1
    row = metrics.counters(spark.createDataFrame([(6,)], "n BIGINT"), {metrics.RECEIVED: "n"}).first()
    assert (row.metric, row.labels, row.value) == ("telemetry.received.total", {"type": "temperature"}, 6)


def test_histogram_quantile(spark):
    inf = float("inf")
    buckets = spark.createDataFrame(
        [("a", le, float(n)) for le, n in ((0.1, 10), (0.25, 30), (0.5, 60), (1.0, 90), (inf, 100))], "s STRING, le DOUBLE, count DOUBLE")
    got = {r.quantile: r.value for r in series.histogram_quantile(buckets, ["s"], (0.5, 0.95, 0.99)).collect()}
    assert got[0.5] == pytest.approx(0.4166667)
    assert (got[0.95], got[0.99]) == (1.0, 1.0)


def counter_samples(spark, values, every=10):
    return spark.createDataFrame([("a", i * every, float(v)) for i, v in enumerate(values)], "s STRING, t BIGINT, value DOUBLE").select(
        "s", F.timestamp_seconds("t").alias("ts"), "value")


def test_counter_reset(spark):
    rates = series.counter_rate(counter_samples(spark, [0, 10, 25, 3, 9]), ["s"], 60).orderBy("ts").collect()
    assert [r.increase for r in rates] == [10, 25, 28, 34]


def test_extrapolated_rate(spark):
    """Samples every 10 s at 10..60 in a 60 s window: 50 seen over 50 s become 60 over 60 s."""
    steps = series.counter_rate_at_steps(counter_samples(spark, range(0, 100, 1)), ["s"], 60, 60, extrapolate=True)
    by_step = {int(r.step.timestamp()): r.increase for r in steps.collect()}
    assert by_step[120] == pytest.approx(6.0)
    trailing = series.counter_rate(counter_samples(spark, range(0, 100, 1)), ["s"], 60, extrapolate=True).collect()
    assert {round(r.increase, 6) for r in trailing if r.ts.timestamp() >= 100} == {6.0}


@pytest.mark.parametrize("text,stored_text", [
    ("25.555", "25.56"), ("-25.555", "-25.56"), ("99999999.99", "99999999.99"), ("123456789.00", None), ("99999999.995", None)])
def test_decimal(spark, text, stored_text):
    df = readings(spark, (1, text, at("10:00:00")))
    row = validate.with_stored_measurement(df).first()
    assert row.stored == (Decimal(stored_text) if stored_text else None)
    assert row.overflow == (stored_text is None)
    rejected = validate.rejects(validate.classify(df, as_of()), as_of()).collect()
    assert [(r.status, r.message) for r in rejected] == ([] if stored_text else [(500, "Internal server error")])


@pytest.mark.parametrize("date,expected", [
    ('"2025-01-31T10:00:00Z"', "2025-01-31 10:00:00"), ("1738317600.123456789", "2025-01-31 10:00:00.123456"),
    ("1738317600", "2025-01-31 10:00:00"), ('"2025-01-31T12:00:00+02:00"', "2025-01-31 10:00:00"), ('"bad"', None)])
def test_date_wire_forms(spark, date, expected):
    body = f'{{"deviceId": 1, "measurement": "21.5", "date": {date}}}'
    row = codec.decode_requests(spark.createDataFrame([(body,)], "body STRING")).first().request
    if expected is None:
        assert row is None
    else:
        assert (row.deviceId, row.measurement, str(row.date)) == (1, Decimal("21.5"), expected)


def test_undecodable_bodies_are_rejected(spark):
    df = codec.decode_requests(spark.createDataFrame([("{",), ('{"deviceId": "x"}',), ("{}",)], "body STRING"))
    flat = df.select("body", F.col("request").isNotNull().alias("ok"), F.col("request.deviceId").alias("device_id"),
                     F.col("request.measurement").alias("measurement"), F.col("request.date").alias("date"))
    rows = validate.rejects(validate.classify(flat, as_of(), F.col("ok")), as_of()).collect()
    assert {(r.body, r.status, r.message) for r in rows} == {
        ("{", 500, "Internal server error"), ('{"deviceId": "x"}', 500, "Internal server error"),
        ("{}", 400, "deviceId: deviceId is required")}


def test_event_json_round_trip(spark):
    event = events.envelope(readings(spark, (7, "21.123456789", at("10:00:00.123456"))), as_of())
    text = events.topic_records(event, as_of()).first()
    parsed = json.loads(bytes(text.value))
    assert bytes(text.key) == b"7"
    assert parsed["deviceId"] == 7 and parsed["date"] == "2025-01-31T10:00:00.123456Z"
    again = codec.decode_events(events.topic_records(event, as_of())).select("event.*").first()
    assert again.asDict() == event.first().asDict()


def test_status_table(spark):
    kinds = ["validation", "duplicate", "kafka_unavailable", "database_unavailable", "error", "other"]
    rows = spark.createDataFrame([(k,) for k in kinds], "k STRING").select(
        outcome.status_of(F.col("k")).alias("s"), outcome.message_of(F.col("k"), F.lit("why")).alias("m")).collect()
    assert [(r.s, r.m) for r in rows] == [
        (400, "why"), (200, "Already processed"), (503, "Service temporarily unavailable"),
        (503, "Service temporarily unavailable"), (500, "Internal server error"), (500, "Internal server error")]


def test_breaker_states(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (9,)], "s INT").select(outcome.breaker_state(F.col("s")).alias("n")).collect()
    assert [r.n for r in rows] == ["CLOSED", "HALF_OPEN", "OPEN", None]


def fold(rows):
    """The service's own loop: accept, then keep the latest."""
    seen, latest, late = set(), {}, 0
    for device, value, day in rows:
        if (device, day) in seen:
            continue
        seen.add((device, day))
        if device in latest and latest[device][1] > day:
            late += 1
        else:
            latest[device] = (value, day)
    return len(seen), late, latest


@pytest.mark.parametrize("seed", range(4))
def test_random_arrivals_equal_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), rng.randrange(100), rng.randrange(28) + 1) for _ in range(150)]
    df = readings(spark, *[(d, v, f"2025-01-{day:02d} 00:00:00") for d, v, day in rows])
    count, late, latest = fold(rows)
    assert outcome_of(df) == (count, late)
    expected = {d: (float(v), day) for d, (v, day) in latest.items()}
    for folded in (projection.latest(accepted(df)), projection.latest_accepted(df)):
        assert {r.device_id: (float(r.latest_measurement), r.latest_date.day) for r in folded.collect()} == expected


def test_dedup_is_idempotent_and_latest_ignores_order(spark):
    rows = [(1, 10, at("10:00:00")), (1, 11, at("10:05:00")), (1, 12, at("10:02:00"))]
    expected = None
    for order in itertools.permutations(rows):
        df = accepted(readings(spark, *order))
        assert sorted(dedup.first_arrivals(df).collect()) == sorted(df.select(*dedup.first_arrivals(df).columns).collect())
        result = latest_of(df)
        assert expected in (None, result)
        expected = result
