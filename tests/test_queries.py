"""Every query against its SQL, row by row."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import compare
from fluxgauge.operators import metrics
from fluxgauge.plans import catalog


@pytest.fixture(scope="module")
def con():
    return compare.connect()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare.difference(spark, con, contract.queries()[name], contract.oracle_sql()[name]) == ""


def test_no_query_lacks_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_rank_check_tells_a_wrong_quantile(spark):
    values = spark.range(10_000).selectExpr("id % 3 as state", "double(id) as v").unionByName(
        spark.range(20_000).selectExpr("0 as state", "double(7) as v"))  # one value holds most of a key
    sketches = metrics.timer_sketches(values.withColumn("part", F.pmod(F.hash("v"), F.lit(9))), ["state", "part"], "v")
    approx = metrics.timer_approx(sketches, ["state"], (0.5, 0.99))
    exact = values.groupBy("state").agg(F.count("*"), F.sum("v"), F.max("v"))
    assert sorted(approx.select("state", "count", "total", "max").collect()) == sorted(exact.collect())
    checked = metrics.rank_errors(values, approx, ["state"], "v", (0.5, 0.99))
    assert {(r["state"], r["quantile"]) for r in checked.where("within_bound").collect()} == {
        (s, q) for s in range(3) for q in (0.5, 0.99)}
    shifted = approx.withColumn("p99", F.col("p99") * 0.95)
    wrong = metrics.rank_errors(values, shifted, ["state"], "v", (0.5, 0.99)).where("not within_bound").collect()
    assert {(r["state"], r["quantile"]) for r in wrong} == {(1, 0.99), (2, 0.99)} | (
        {(0, 0.99)} if any(r["state"] == 0 for r in wrong) else set())
    assert metrics.timer_sketches(values.withColumn("v", F.lit(None).cast("double")), ["state"], "v").count() == 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["deviceId", "measurement", "date"]
    assert df.count() > 0


def test_known_counts(spark):
    """Counts both engines agreed on before any operator was written."""
    q = contract.queries()
    assert q["dedup_accept"](spark, compare.SF_DIR).count() == 9567
    assert q["dedup_rejects"](spark, compare.SF_DIR).count() == 433
    assert q["out_of_order_flag"](spark, compare.SF_DIR).where("out_of_order").count() == 1674
    devices = q["devices_list"](spark, compare.SF_DIR).selectExpr("count(*) n", "round(sum(measurement), 2) s").first()
    assert (devices.n, devices.s) == (150, 6742.59)
    failures = q["rolling_failure_rate"](spark, compare.SF_DIR).selectExpr(
        "count(*) n", "count_if(over_threshold) hot").first()
    assert (failures.n, failures.hot) == (8650, 294)
