"""Properties of the physical plans that decide how the queries scale."""

import re

import pytest

import compare
from fluxgauge.plans import catalog

BATCH = sorted(name for name in catalog.QUERIES if not name.startswith("stream_"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(catalog.QUERIES[name](spark, compare.SF_DIR)) for name in BATCH}


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_pairing_of_everything(plans, name):
    assert not re.search("Python|MapInArrow|Cartesian|NestedLoop", plans[name])


@pytest.mark.parametrize("name,columns", [
    ("devices_list", {"event_id", "ts", "user_id", "value"}),
    ("uniq_violations", {"ts", "user_id"}),
    ("rolling_failure_rate", {"event_id", "user_id", "event_type"}),
    ("trace_missing_consumer", {"o_orderkey", "o_orderdate", "l_orderkey"}),
])
def test_scans_read_only_needed_columns(plans, name, columns):
    read = {field.split(":")[0] for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plans[name]) for field in schema.split(",")}
    assert read == columns


def test_latest_shuffles_devices_only(plans):
    """One exchange, behind a partial aggregation."""
    plan = plans["devices_list"]
    assert plan.count("Exchange hashpartitioning") == 1
    assert re.search(r"Exchange hashpartitioning\(user_id|Exchange hashpartitioning\(device_id", plan)
    assert "partial_max_by" in plan.split("Exchange")[1]


@pytest.mark.parametrize("name", ["devices_list", "latest_per_device", "device_lookup", "devices_recent", "latest_from_audit", "projection_merge"])
def test_latest_does_not_sort_its_input(plans, name):
    assert "SortAggregate" not in plans[name]


def test_acceptance_combines_copies_before_the_shuffle(plans):
    plan = plans["dedup_accept"]
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in plan
    assert "partial_min_by" in plan.split("Exchange")[1]


def test_recent_readings_are_limited_before_the_shuffle(plans):
    assert "WindowGroupLimit" in plans["device_recent_k"].split("Exchange")[1]


def test_filters_reach_the_scan(plans):
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(ts|PushedFilters: \[.*ts", plans["prom_instant"])
    assert re.search(r"PushedFilters: \[.*EqualTo\(user_id,42\)", plans["device_lookup"])


@pytest.mark.parametrize("name", ["out_of_order_flag", "projection_history", "rolling_failure_rate", "state_transitions"])
def test_histories_are_sorted_block_by_block(plans, name):
    """Windows over rows are partitioned by key and block; only block summaries by key alone."""
    for spec in re.findall(r"windowspecdefinition\(([^()]*(?:\([^()]*\)[^()]*)*)", plans[name]):
        assert "_block" in spec


@pytest.mark.parametrize("name", ["dlq_first_n", "devices_recent", "trace_slowest_k"])
def test_top_k_does_not_sort_everything(plans, name):
    assert "TakeOrderedAndProject" in plans[name]
