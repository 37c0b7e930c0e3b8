"""Plans and skew: what must hold when one key has a third of all rows."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from parcelyard.operators.changes import number_rows
from parcelyard.operators.keyed import drop_keys, keep_keys, match
from parcelyard.operators.prefixes import file_prefix_matches, join_with_prefix, last_tracking_per_prefix
from parcelyard.operators.ranks import ranked
from parcelyard.trial.registry import all_queries

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()
SCALARS = {
    "chg_employee_insert", "last_tracking_per_prefix", "file_prefix_matches", "file_prefix_first",
}


@contextmanager
def settings(spark, **values):
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _hot(spark, rows=300_000):
    hot = F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("P"), "id"))
    return spark.range(rows).select(
        F.concat(F.lit("t"), F.lit("")).alias("tenant_id"),
        F.col("id").alias("item_id"),
        hot.alias("tracking_number"),
        F.when(F.col("id") % 3 != 0, F.col("id") % 50).cast("string").alias("box_id"),
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_have_no_cross_join_window_or_python(spark, name):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = _plan(QUERIES[name](spark, SF))
    banned = "CartesianProduct|BroadcastNestedLoopJoin|Window|EvalPython|InPandas|CollectLimit"
    assert re.findall(banned, plan) == []
    # Gathering in one task is only for single-row scalars: the top of the staff ids,
    # and the lengths of prefixes in use.
    if name not in SCALARS:
        assert "SinglePartition" not in plan


@pytest.mark.parametrize("how", ["keep", "drop"])
def test_hot_key_is_split(spark, how):
    items = _hot(spark)
    keys = spark.range(200_000).select(
        F.lit("t").alias("tenant_id"),
        F.when(F.col("id") == 0, "HOT").otherwise(F.concat(F.lit("P"), "id")).alias(
            "tracking_number"
        ),
    )
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__shuffle__partitions="8",
        spark__sql__files__maxPartitionBytes="1MB",
    ):
        act = keep_keys if how == "keep" else drop_keys
        out = act(items.repartition(16), keys, "tracking_number")
        n = len(out.collect())
        assert "skew=true" in _plan(out)
    in_list = 100_000 + sum(1 for i in range(1, 200_000) if i % 3)
    assert n == (in_list if how == "keep" else 300_000 - in_list)


def test_null_keys_are_spread(spark):
    gone = spark.range(10).select(
        F.lit("t").alias("tenant_id"), F.col("id").cast("string").alias("box_id"),
        F.col("id").alias("gone_seq"),
    )
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__enabled="false",
        spark__sql__shuffle__partitions="32",
    ):
        out = match(_hot(spark), gone.distinct(), "box_id", how="left", spread_by="item_id")
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 300_000
        assert max(r["count"] for r in sizes) < 40_000
        assert out.filter("gone_seq IS NOT NULL").count() == 40_000


def test_numbers_of_a_hot_tenant(spark):
    base = spark.createDataFrame([("t", 41), ("u", 7)], "tenant_id string, slip_id bigint")
    rows = spark.range(100, 1100).select(
        F.when(F.col("id") < 1000, "t").otherwise("v").alias("tenant_id"),
        F.col("id").alias("seq"),
    )
    out = number_rows(base, rows, "slip_id").groupBy("tenant_id").agg(
        F.min("slip_id"), F.max("slip_id"), F.count_distinct("slip_id")
    )
    assert sorted(tuple(r) for r in out.collect()) == [("t", 42, 941, 900), ("v", 1, 100, 100)]


def test_numbered_rows_of_a_hot_tenant_are_dealt_evenly(spark):
    n = 20_000
    base = spark.createDataFrame([("t", 41)], "tenant_id string, slip_id bigint")
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 > 0, "t").otherwise("v").alias("tenant_id"), F.col("id").alias("seq")
    )
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="16",
                  spark__sql__adaptive__coalescePartitions__enabled="false"):
        out = number_rows(base, rows.repartition(4), "slip_id")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 5
    assert out.filter("tenant_id = 't' AND slip_id <> seq + 41").count() == 0
    assert out.filter("tenant_id = 'v' AND slip_id <> seq + 1").count() == 0


def test_object_keys_are_taken_once(spark):
    """Not a second time, and of all addresses, in a filter below the join."""
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = _plan(QUERIES["asset_purge_packages"](spark, SF))
    assert plan.count("Evaluator(null,HOST") == 2  # of packages and of items


def test_ranks_of_a_hot_group(spark):
    """Two thirds of the rows in one group, half of these all equal: no task has most of them."""
    n = 60_000
    hot = F.when(F.col("id") % 3 > 0, "HOT").when(F.col("id") % 3000 == 0, None).otherwise(
        F.concat(F.lit("G"), F.col("id") % 7)
    )
    rows = spark.range(n).select(hot.alias("g"), F.when(F.col("id") % 3 > 1, F.col("id")).alias("x"))
    with settings(spark, spark__sql__shuffle__partitions="16",
                  spark__sql__adaptive__coalescePartitions__enabled="false"):
        out = ranked(rows.repartition(8), ["g"], ["x"], total="of").cache()
        counts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) >= 12 and max(counts) < n / 6
    groups: dict = {}
    for r in out.collect():
        groups.setdefault(r["g"], []).append((r["pos"], r["x"], r["of"]))
    assert {k: len(v) for k, v in groups.items()}["HOT"] == 40_000 and None in groups
    for found in groups.values():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        assert {f[2] for f in found} == {len(found)}
        values = [f[1] for f in found]
        assert values == sorted(values, key=lambda v: (v is not None, v or 0))
    assert ranked(rows.limit(0), ["g"], ["x"]).collect() == []


def test_scans_read_only_what_is_needed(spark):
    plan = _plan(QUERIES["customer_open_package_counts"](spark, SF))
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    lineitem = [r for r in reads if "l_orderkey" in r]
    assert [sorted(c.split(":")[0] for c in r.split(",")) for r in lineitem] == [
        ["l_linestatus", "l_orderkey", "l_quantity"]
    ]
    plan = _plan(QUERIES["pending_appointments"](spark, SF))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "GreaterThan(ts," in pushed


def test_prefix_of_a_third_of_all_rows(spark):
    n = 90_000
    packages = spark.range(n).selectExpr(
        "'t' AS tenant_id",
        "CASE WHEN id % 3 = 0 THEN 'HOT-' ELSE concat('P', id, '-') END || id AS tracking_number",
    )
    types = spark.createDataFrame([("t", "HOT"), ("t", "P1"), ("t", "HO_-")], "tenant_id string, type string")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        out = last_tracking_per_prefix(packages, types)
        assert "sequence(0" not in _plan(out)
        got = {r["type"]: r["tracking_number"] for r in out.collect()}
    top = max((i for i in range(n) if i % 3 and str(i).startswith("1")))
    assert got == {"HOT": f"HOT-{n - 3}", "P1": f"P{top}-{top}", "HO_-": f"HOT-{n - 3}"}


def test_cuts_are_never_sent_to_the_tasks(spark):
    """Estimates do not count the cuts of a text, here fewer bytes than those of the prefixes."""
    names = spark.range(10).selectExpr("'t' AS tenant_id", "id || '_' || id AS file_name")
    asked = spark.range(30_000).selectExpr("'t' AS tenant_id", "id || '_' AS photo_name")
    out = file_prefix_matches(names, asked)
    assert "BuildLeft" not in _plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [("t", f"{i}_", f"{i}_{i}") for i in range(10)]
    kinds = asked.withColumn("type", F.lit("k"))
    wide = join_with_prefix(names, "file_name", kinds, "photo_name")
    assert "BuildLeft" not in _plan(wide)
    assert sorted(tuple(r) for r in wide.select("file_name", "type").collect()) == [
        (f"{i}_{i}", "k") for i in range(10)
    ]


@pytest.mark.parametrize(
    "name, most",
    # With the views of the test tables, whose change set for item_delete is a join.
    [("chg_package_delete_customers", 10), ("chg_item_delete_customers", 16),
     ("chg_box_delete_customers", 16), ("subbox_nested", 8), ("chg_customer_edit", 8), ("chg_package_edit", 8)],
)
def test_shuffles_do_not_grow(spark, name, most):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = _plan(QUERIES[name](spark, SF))
    assert len(re.findall("(?<!Reused)Exchange (?:hash|Single)", plan)) <= most

