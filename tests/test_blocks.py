"""Block-wise windows against a plain fold, with one key holding most of the rows."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxgauge.operators import alerts, blocks, metrics, projection, series

WIDTHS = [1, 3, 7, 1 << 24]


def history(seed, rows=400, devices=4):
    """(seq, device, day, value); device 0 owns more than half of the rows."""
    rng = random.Random(seed)
    return [
        (seq, 0 if rng.random() < 0.5 else rng.randrange(devices), rng.randrange(60), rng.randrange(1000))
        for seq in rng.sample(range(-rows, 3 * rows), rows)
    ]


def frame(spark, data):
    return spark.createDataFrame(data, "seq BIGINT, device BIGINT, day BIGINT, value BIGINT")


def by_device(data):
    groups = {}
    for row in sorted(data):
        groups.setdefault(row[1], []).append(row)
    return groups


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_fold(spark, width, inclusive):
    data = history(1)
    got = blocks.running(
        frame(spark, data), ["device"], [F.col("seq")], blocks.block_of(F.col("seq"), width),
        {"top": ("max", F.col("day")), "low": ("min", F.col("day")), "total": ("sum", F.col("value"))}, inclusive)
    expected = set()
    for rows in by_device(data).values():
        for i, row in enumerate(rows):
            seen = rows[: i + 1] if inclusive else rows[:i]
            expected.add((*row, max((r[2] for r in seen), default=None), min((r[2] for r in seen), default=None),
                          sum(r[3] for r in seen) if seen else None))
    assert {tuple(r) for r in got.collect()} == expected


def test_running_starts_from_seed(spark):
    data = [(1, 1, 5, 0), (2, 1, 3, 0), (3, 2, 9, 0)]
    seed = spark.createDataFrame([(1, 4), (9, 9)], "device BIGINT, top BIGINT")
    got = blocks.running(frame(spark, data), ["device"], [F.col("seq")], blocks.block_of(F.col("seq"), 2),
                         {"top": ("max", F.col("day"))}, inclusive=False, seed=seed)
    assert {(r.seq, r.top) for r in got.collect()} == {(1, 4), (2, 5), (3, None)}


@pytest.mark.parametrize("width", WIDTHS)
def test_previous_equals_lag(spark, width):
    data = history(2)
    got = blocks.previous(frame(spark, data), ["device"], F.col("seq"), blocks.block_of(F.col("seq"), width), ["day", "value"])
    expected = set()
    for rows in by_device(data).values():
        for before, row in zip([None, *rows], rows):
            expected.add((*row, before and before[2], before and before[3]))
    assert {tuple(r) for r in got.collect()} == {(*e[:4], e[4], e[5]) for e in expected}


def test_previous_keeps_null_values(spark):
    data = [(1, 1, 5, 0), (2, 1, None, 0), (3, 1, 7, 0)]
    got = blocks.previous(frame(spark, data), ["device"], F.col("seq"), blocks.block_of(F.col("seq"), 100), ["day"])
    assert {(r.seq, r.previous_day) for r in got.collect()} == {(1, None), (2, 5), (3, None)}


@pytest.mark.parametrize("width", [1, 4, 1 << 24])
def test_out_of_order_and_history_equal_fold(spark, width):
    rng = random.Random(3)
    data = [(seq, 0 if rng.random() < 0.6 else rng.randrange(3), rng.randrange(50), seq % 97) for seq in range(300)]
    events = frame(spark, data).select(
        F.col("seq").alias("arrival_seq"), F.col("device").alias("device_id"),
        F.timestamp_seconds(F.col("day") * 60).alias("date"), F.col("value").cast("decimal(10,2)").alias("measurement"))
    flagged = projection.with_out_of_order(events, block_width=width)
    flags = {r.arrival_seq: r.out_of_order for r in flagged.collect()}
    repeated = events.unionByName(events.withColumn("arrival_seq", F.col("arrival_seq") + 1))
    again = projection.with_out_of_order(events, block_width=width, arrivals=repeated)
    assert flags == {r.arrival_seq: r.out_of_order for r in again.collect()}
    states = {r.arrival_seq: (int(r.latest_measurement), int(r.latest_date.timestamp()) // 60)
              for r in projection.history(events, width).withColumn(
                  "latest_date", F.col("latest_date")).collect()}
    stored = {}
    for seq, device, day, value in data:
        late = device in stored and stored[device][1] > day
        if not late:
            stored[device] = (value, day)
        assert flags[seq] == late
        assert states[seq] == stored[device]


@pytest.mark.parametrize("order_width,block_rows", [(1, 1), (5, 3), (1 << 24, 1 << 24), (40, 10)])
def test_failure_rate_equals_fold(spark, order_width, block_rows):
    data = history(4)
    calls = frame(spark, data).withColumn("failed", F.col("value") % 3 == 0)
    got = metrics.failure_rate(calls, ["device"], "seq", "failed", order_width=order_width, block_rows=block_rows)
    expected = set()
    for rows in by_device(data).values():
        for i in range(9, len(rows)):
            rate = sum(r[3] % 3 == 0 for r in rows[i - 9 : i + 1]) * 10.0
            expected.add((rows[i][0], rows[i][1], i + 1, rate, rate >= 50))
    assert {(r.seq, r.device, r.call_no, r.failure_rate_pct, r.over_threshold) for r in got.collect()} == expected


def test_failure_rate_needs_a_full_window(spark):
    """Five good calls, then five bad ones: 50 % at the tenth, nothing before."""
    calls = frame(spark, [(i, 1, 0, 0) for i in range(1, 11)]).withColumn("failed", F.col("seq") > 5)
    rows = metrics.failure_rate(calls, ["device"], "seq", "failed").collect()
    assert [(r.call_no, r.failure_rate_pct, r.over_threshold) for r in rows] == [(10, 50.0, True)]


@pytest.mark.parametrize("width", [1, 6, 1 << 24])
def test_transitions_equal_fold(spark, width):
    data = history(5)
    observed = frame(spark, data).select(
        "seq", "device", F.timestamp_seconds("seq").alias("ts"), (F.col("value") % 3).cast("int").alias("state"))
    got = {(r.device, r.seq, r.from_state, r.to_state, r.seconds_in_state)
           for r in alerts.transitions(observed, ["device"], "seq", "ts", "state", width).collect()}
    expected = set()
    for device, rows in by_device(data).items():
        changes = [(a[3] % 3, b) for a, b in zip(rows, rows[1:]) if a[3] % 3 != b[3] % 3]
        for i, (before, row) in enumerate(changes):
            after = changes[i + 1][1][0] - row[0] if i + 1 < len(changes) else None
            expected.add((device, row[0], before, row[3] % 3, after))
    assert got == expected


@pytest.mark.parametrize("step,block_steps", [(1, 7), (1, 1), (5, 16), (5, 1 << 14)])
def test_sustained_equals_fold(spark, step, block_steps):
    """Runs of steps that are all there and all active, by a plain loop."""
    rng = random.Random(6)
    data = [(t * step, device, 0, int(rng.random() < 0.93)) for device in range(2) for t in range(-200, 300) if rng.random() < 0.97]
    checks = frame(spark, data).select("device", F.timestamp_seconds("seq").alias("ts"), "value")
    got = {(r.device, int(r.active_from.timestamp()), int(r.active_until.timestamp()), r.evaluations,
            int(r.fired_at.timestamp()))
           for r in alerts.sustained(checks, ["device"], "ts", F.col("value") == 1, 20, step, block_steps).collect()}
    expected = set()
    for device, rows in by_device(data).items():
        active = {row[0] for row in rows if row[3] == 1}
        for start in active:
            if start - step not in active:
                end = start
                while end + step in active:
                    end += step
                if end - start >= 20:
                    expected.add((device, start, end, (end - start) // step + 1, start + 20))
    assert got == expected and got


def test_silence_ends_a_stretch(spark):
    """Two active samples two days apart, carried five minutes each, don't hold for ten minutes; ten in a row do."""
    def fired(times):
        samples = frame(spark, [(t, 1, 0, 1) for t in times]).select(
            "device", F.timestamp_seconds("seq").alias("ts"), F.col("value").cast("double").alias("value"))
        steps = series.at_steps(samples, ["device"], F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(400_000)), 30)
        return alerts.sustained(steps, ["device"], "step", F.col("value") == 1, 600).collect()

    assert fired([60, 60 + 2 * 86_400]) == []
    one, = fired(range(0, 600, 60))
    assert (int(one.active_from.timestamp()), int(one.active_until.timestamp()), one.evaluations) == (0, 810, 28)


def test_hold_of_each_rule(spark):
    checks = frame(spark, [(30 * i, rule, 0, 1) for i in range(5) for rule in (60, 120, 180)])
    got = alerts.sustained(checks.withColumn("ts", F.timestamp_seconds("seq")), ["device"], "ts", F.lit(True), F.col("device"))
    assert {(r.device, int(r.fired_at.timestamp())) for r in got.collect()} == {(60, 60), (120, 120)}


def samples_of(spark, data):
    return frame(spark, data).select("device", F.timestamp_seconds("seq").alias("ts"), F.col("value").cast("double").alias("value"))


def increase(window):
    return sum(b if b < a else b - a for a, b in zip(window, window[1:]))


@pytest.mark.parametrize("rows", [1, 3, 50, 1 << 20])
def test_cuts_hold_no_more_than_their_rows(spark, rows):
    data = history(11)
    placed = blocks.in_cuts(frame(spark, data), ["device"], "seq", blocks.cuts(frame(spark, data), ["device"], "seq", rows, 1), 1)
    sizes = placed.groupBy("device", "_cut").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")) \
        .orderBy("device", "a").collect()
    assert sum(r.n for r in sizes) == len(data) and max(r.n for r in sizes) <= rows
    assert all(x.b < y.a for x, y in zip(sizes, sizes[1:]) if x.device == y.device)


@pytest.mark.parametrize("rows", [1, 10, 60, 1 << 20])
def test_counter_rate_equals_fold(spark, rows):
    data = history(7)
    got = {(r.device, int(r.ts.timestamp())): r.increase
           for r in series.counter_rate(samples_of(spark, data), ["device"], 60, block_rows=rows).collect()}
    expected = {}
    for device, rows in by_device(data).items():
        for row in rows:
            window = [r[3] for r in rows if row[0] - 60 < r[0] <= row[0]]
            if len(window) >= 2:
                expected[device, row[0]] = increase(window)
    assert got == expected


@pytest.mark.parametrize("step,seconds", [(60, 60), (30, 90), (100, 40), (15, 300), (7, 5)])
def test_counter_rate_at_steps_equals_fold(spark, step, seconds):
    data = history(8)
    got = {(r.device, int(r.step.timestamp())): r.increase
           for r in series.counter_rate_at_steps(samples_of(spark, data), ["device"], step, seconds).collect()}
    expected = {}
    for device, rows in by_device(data).items():
        for at in range(-1200, 3000):
            if at % step == 0:
                window = [r[3] for r in rows if at - seconds < r[0] <= at]
                if len(window) >= 2:
                    expected[device, at] = increase(window)
    assert got == expected


def test_rates_of_series_without_labels(spark):
    samples = spark.createDataFrame([(None, 0, 1.0), (None, 10, 4.0), ("a", 0, 2.0), ("a", 10, 1.0)], "l STRING, t BIGINT, value DOUBLE") \
        .select("l", F.timestamp_seconds("t").alias("ts"), "value")
    assert {(r.l, r.increase) for r in series.counter_rate(samples, ["l"], 60).collect()} == {(None, 3.0), ("a", 1.0)}
    assert series.counter_rate(samples.where("l = 'a'").drop("l"), [], 60).first().increase == 1.0
    assert series.counter_rate(samples.limit(0), ["l"], 60).count() == 0


def vector(spark, rows):
    return spark.createDataFrame(rows, "labels MAP<STRING, STRING>, s BIGINT, value DOUBLE").select(
        F.array_sort(F.map_entries("labels")).alias("labels"), F.timestamp_seconds("s").alias("step"), "value")


def test_vectors_match_by_labels(spark):
    left = vector(spark, [({"job": "a", "kind": "dup"}, 0, 1.0), ({"kind": "dup", "job": "b"}, 0, 3.0), ({"job": "a"}, 30, 5.0)])
    right = vector(spark, [({"job": "a"}, 0, 4.0), ({"job": "b"}, 0, 0.0), ({"job": "a"}, 30, 10.0), ({"job": "c"}, 0, 1.0)])

    def found(**how):
        rows = series.matched_ratio(left, right, **how).collect()
        return {(tuple((e.key, e.value) for e in r.labels), int(r.step.timestamp()), r.ratio) for r in rows}

    assert found() == {((("job", "a"),), 30, 0.5)}
    both = {((("job", "a"),), 0, 0.25), ((("job", "b"),), 0, None), ((("job", "a"),), 30, 0.5)}
    assert found(on=["job"]) == both
    assert found(ignoring=("kind",)) == both
    with pytest.raises(Exception, match="several series match"):
        series.matched_ratio(left, right, on=["kind"]).collect()


def test_rate_vector_keeps_labels(spark):
    samples = spark.createDataFrame(
        [("up", {"job": job, "n": "1"}, t, float(t * k)) for job, k in (("a", 1), ("b", 2)) for t in range(0, 61, 10)]
        + [("down", {"job": "a"}, 10, 5.0)], "metric STRING, labels MAP<STRING, STRING>, t BIGINT, value DOUBLE",
    ).withColumn("ts", F.timestamp_seconds("t"))
    rows = series.rate_vector(samples, "up", 30, 60, job="b").collect()
    assert {(int(r.step.timestamp()), r.value) for r in rows} == {(30, 1.0), (60, 100 / 60), (90, 40 / 60)}
    assert all([(e.key, e.value) for e in r.labels] == [("job", "b"), ("n", "1")] for r in rows)


@pytest.mark.parametrize("step,staleness", [(60, 60), (15, 300), (100, 30)])
def test_step_lookup_equals_fold(spark, step, staleness):
    data = history(9)
    start, end = 37, 37 + 20 * step
    got = {(r.device, int(r.step.timestamp())): (r.value, int(r.sample_ts.timestamp()))
           for r in series.at_steps(samples_of(spark, data), ["device"], F.timestamp_seconds(F.lit(start)),
                                    F.timestamp_seconds(F.lit(end)), step, staleness).collect()}
    expected = {}
    for device, rows in by_device(data).items():
        for at in range(start, end + 1, step):
            fitting = [r for r in rows if at - staleness < r[0] <= at]
            if fitting:
                expected[device, at] = (fitting[-1][3], fitting[-1][0])
    assert got == expected


def test_step_lookup_spreads_over_steps_after_its_last_shuffle(spark):
    steps = series.at_steps(samples_of(spark, history(9)), ["device"], F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(9000)), 60, 3600)
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Generate explode" not in plan[plan.index("Exchange"):]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(0, 5000), min_size=1, max_size=60), bucket=st.sampled_from([1.0, 7.0, 10_000.0]))
def test_timer_quantiles_equal_interpolation(spark, values, bucket):
    import numpy

    df = spark.createDataFrame([("t", v) for v in values], "metric STRING, v BIGINT")
    row = metrics.timer(df, ["metric"], "v", (0.5, 0.95, 0.99), bucket).first()
    assert (row["count"], row["total"], row["max"]) == (len(values), sum(values), max(values))
    for q, name in ((50, "p50"), (95, "p95"), (99, "p99")):
        assert row[name] == pytest.approx(numpy.percentile(values, q))


@pytest.mark.parametrize("block_seconds", [5, 86_400])
def test_lag_over_time_equals_fold(spark, block_seconds):
    data = history(10)
    rows = frame(spark, data)
    produced = rows.select("device", F.timestamp_seconds("seq").alias("ts"))
    consumed = rows.select("device", F.timestamp_seconds(F.col("seq") + F.col("day")).alias("ts"))
    got = {(r.device, int(r.ts.timestamp())): r.lag
           for r in metrics.lag_over_time(produced, consumed, ["device"], "ts", block_seconds).collect()}
    for device, group in by_device(data).items():
        for moment in {r[0] for r in group} | {r[0] + r[2] for r in group}:
            assert got.pop((device, moment)) == sum(r[0] <= moment for r in group) - sum(r[0] + r[2] <= moment for r in group)
    assert not got


def test_cumulative_counters_only_grow(spark):
    added = frame(spark, [(t, 1, 0, n) for t, n in ((0, 3), (60, 4), (60, 1), (200_000, 2))]).select(
        F.lit("received").alias("metric"), F.timestamp_seconds("seq").alias("ts"), "value")
    grown = metrics.cumulative(added, ["metric"], "ts", "value").orderBy("ts").collect()
    assert [r.value for r in grown] == [3.0, 8.0, 10.0]


def test_breaker_status(spark):
    calls = frame(spark, [(i, 1, 0, 0) for i in range(20)] + [(i, 2, 0, 0) for i in range(100, 104)]).select(
        "device", "seq", ((F.col("seq") >= 14) & (F.col("seq") < 100)).alias("failed"), (F.col("seq") % 3).alias("state"))
    got = {r.device: (r.state, r.buffered_calls, r.failed_calls, r.failure_rate_pct)
           for r in metrics.breaker_status(calls, ["device"], "seq", "failed", "state").collect()}
    assert got == {1: (1, 10, 6, 60.0), 2: (1, 4, 0, -1.0)}
