"""Span trees and the no-loss check against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxgauge.operators import dead_letter, traces


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "event_id BIGINT")


@pytest.mark.parametrize("buckets", [1, 8, 1 << 16])
@pytest.mark.parametrize("faulty", [False, True])
def test_no_loss_check_equals_counting(spark, buckets, faulty):
    rng = random.Random(1)
    accepted = list(range(300)) + [None]
    places = [[], [], []]
    for event in accepted:
        for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3]) if faulty else 1):
            rng.choice(places).append(event)
    if faulty:
        places[0] += [1000, 1001, 1001]
    kept = Counter(event for place in places for event in place)
    expected = {(e, "lost", 0) for e in accepted if not kept[e]}
    expected |= {(e, "kept_twice", kept[e]) for e in accepted if kept[e] > 1}
    expected |= {(e, "unknown", n) for e, n in kept.items() if e not in accepted}
    sets = [ids(spark, accepted), *[ids(spark, p) for p in places]]
    assert {(r.event_id, r.fault, r.places) for r in dead_letter.faults(*sets, buckets=buckets).collect()} == expected
    row = dead_letter.reconcile(*sets, buckets=buckets).first()
    assert (row.accepted, row.published, row.fallback, row.dead_letter) == (len(accepted), *map(len, places))
    assert (row.lost, row.kept_twice, row.unknown) == tuple(
        sum(f[1] == kind for f in expected) for kind in ("lost", "kept_twice", "unknown"))


def test_no_loss_check_of_nothing(spark):
    row = dead_letter.reconcile(*[ids(spark, [])] * 4).first()
    assert tuple(row) == (0,) * 7


def span_rows(seed):
    """Random trees, with orphans, a cycle, and equal span ids in several traces."""
    rng = random.Random(seed)
    rows = []
    for trace in range(12):
        for span in range(1, rng.randrange(2, 25)):
            parent = rng.randrange(1, span) if span > 1 else None
            rows.append((trace, span, 99 if rng.random() < 0.05 else parent, float(rng.randrange(50))))
    return rows + [(50, 1, 2, 1.0), (50, 2, 1, 1.0), (50, 3, 1, 1.0), (50, 4, None, 9.0), (51, 1, 1, 1.0)]


def spans_of(spark, rows):
    return spark.createDataFrame(rows, "t BIGINT, s BIGINT, p BIGINT, duration_ms DOUBLE").select(
        *[F.col(a).cast("string").alias(b) for a, b in (("t", "trace_id"), ("s", "span_id"), ("p", "parent_id"))], "duration_ms")


def climb(rows):
    """(depth, root, path) per span; None for spans that no root is above."""
    spans, found = {(t, s): (p, ms) for t, s, p, ms in rows}, {}
    for t, s in spans:
        depth, total, at, seen = 0, spans[t, s][1], s, {s}
        while (t, spans[t, at][0]) in spans:
            at = spans[t, at][0]
            if at in seen:
                break
            seen.add(at)
            depth, total = depth + 1, total + spans[t, at][1]
        else:
            found[t, s] = (depth, at, total)
            continue
        found[t, s] = (None, None, None)
    return found


def test_span_tree_equals_climbing(spark):
    rows = span_rows(2)
    got = {(int(r.trace_id), int(r.span_id)): (r.depth, r.root_id and int(r.root_id), r.path_ms)
           for r in traces.tree(spans_of(spark, rows)).collect()}
    assert got == climb(rows)


def test_critical_paths_equal_climbing(spark):
    rows = span_rows(3)
    expected = {}
    for (t, s), (depth, root, total) in climb(rows).items():
        if depth is not None:
            best = expected.get(t)
            if best is None or (-total, str(s)) < (-best[2], best[0]):
                expected[t] = (str(s), str(root), total, depth + 1)
    got = {int(r.trace_id): (r.leaf_id, r.root_id, r.critical_ms, r.spans)
           for r in traces.critical_paths(traces.tree(spans_of(spark, rows))).collect()}
    assert got == expected


def test_a_long_chain(spark):
    """Ten thousand spans, each below the one before: fourteen rounds."""
    chain = spark.range(1, 10_001).select(
        F.lit("t").alias("trace_id"), F.col("id").cast("string").alias("span_id"),
        F.when(F.col("id") > 1, (F.col("id") - 1).cast("string")).alias("parent_id"), F.lit(1.0).alias("duration_ms"))
    one = traces.critical_paths(traces.tree(chain)).first()
    assert (one.leaf_id, one.root_id, one.critical_ms, one.spans) == ("10000", "1", 10_000.0, 10_000)


def test_no_spans(spark):
    assert traces.tree(spans_of(spark, [(1, 1, None, 1.0)]).limit(0)).count() == 0
