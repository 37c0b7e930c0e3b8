"""Logs of mixed kinds: levels of jobs end where requests one after another end."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from parcelyard.operators.changes import update_by_key
from parcelyard.plans import schedule
from parcelyard.plans.kinds import KINDS
from parcelyard.plans.runs import apply_runs
from parcelyard.plans.schedule import Kind, Touch, cut_levels
from parcelyard.sources.checkpoints import settle
from parcelyard.streaming.feed import LOG
from rows import pairs, tables
from test_scale import settings


def _log(spark, rows):
    return spark.createDataFrame([(t, s, k, json.dumps(b)) for t, s, k, b in rows], LOG)


def _levels(spark, rows, kinds=KINDS):
    """Per level the sorted (tenant, seq, kind) of its requests."""
    used = {k: kinds[k] for k in {r[2] for r in rows}}
    return [sorted(map(tuple, level.collect())) for level in schedule.levels(_log(spark, rows), used)]


def test_two_kinds_that_alternate_are_two_jobs(spark):
    rows = []
    for n in range(60):
        rows.append(("t", 2 * n, "customer_warehouse", {"customer_id": f"c{n % 7}", "warehouse": "w"}))
        rows.append(("t", 2 * n + 1, "box_priority", {"box_id": f"b{n % 5}", "priority": n}))
    jobs = list(cut_levels(_log(spark, rows), KINDS))
    assert [(job, sent.count()) for job, sent in jobs] == [
        (KINDS["box_priority"].job, 60), (KINDS["customer_warehouse"].job, 60)]
    # Other parts of the same rows do not clash either, and different rows never do.
    same = [("t", n, ["customer_warehouse", "customer_address"][n % 2], {"customer_id": "c"}) for n in range(20)]
    assert len(_levels(spark, same)) == 1
    apart = [("t", n, ["slip_delete", "address_delete", "customer_insert"][n % 3],
              {"slip_id": n, "address_id": n, "customer_id": f"c{n}"}) for n in range(30)]
    assert len(_levels(spark, apart)) == 1


def test_levels_follow_clashes(spark):
    rows = [
        ("t", 1, "box_priority", {"box_id": "a", "priority": 1}),
        ("t", 2, "box_delete", {"box_id": "a", "customer_id": "c"}),
        ("t", 3, "box_priority", {"box_id": "a", "priority": 2}),
        ("t", 4, "box_priority", {"box_id": "b", "priority": 3}),
        ("u", 5, "box_priority", {"box_id": "a", "priority": 4}),
        ("t", 6, "item_delete", {"item_id": "1", "customer_id": "c"}),
        ("t", 7, "box_delete", {"box_id": "b", "customer_id": "c"}),
    ]
    assert _levels(spark, rows) == [
        [("t", 1, "box_priority"), ("t", 4, "box_priority"), ("u", 5, "box_priority")],
        [("t", 2, "box_delete")],
        [("t", 3, "box_priority"), ("t", 6, "item_delete")],
        [("t", 7, "box_delete")],
    ]


def test_renames_of_one_row_come_one_after_another(spark):
    edit = lambda s, a, b: ("t", s, "customer_edit", {"old_id": a, "customer_id": b, "note": str(s)})
    rows = [edit(1, "a", "b"), edit(2, "b", "c"), edit(3, "c", "c"), edit(4, "x", "y"), edit(5, "a", "a")]
    assert [[r[1] for r in level] for level in _levels(spark, rows)] == [[1, 4], [2, 5], [3]]
    base = tables(spark, customers=[{"customer_id": c} for c in "ax"])
    out = apply_runs(base, cut_levels(_log(spark, rows), KINDS), settle)["customers"]
    assert pairs(out, "customer_id", "note") == [("c", "3"), ("y", "4")]


def test_kinds_that_tell_nothing_keep_the_order(spark):
    job = lambda t, c: {"box": update_by_key(t["box"], c, "box_id", ["note"])}
    kinds = {"a": Kind(job, "box_id string, note string"), "b": KINDS["box_priority"],
             "c": Kind(job, "box_id string, note string", [Touch("box", "box_id", "note")])}
    rows = [("t", n, "abcacb"[n], {"box_id": str(n)}) for n in range(6)]
    assert [[r[1] for r in level] for level in _levels(spark, rows, kinds)] == [[0], [1, 2], [3], [4, 5]]


def _random_request(r, seq):
    customer, package, item, box = f"c{r.randrange(3)}", f"p{r.randrange(4)}", r.randrange(6), f"b{r.randrange(3)}"
    return r.choice([
        ("customer_insert", {"customer_id": r.choice([customer, "n"]), "note": str(seq), "customer_date": "2024-01-01T00:00:00"}),
        ("customer_edit", {"old_id": customer, "customer_id": r.choice([customer, customer, "n", "m"]), "note": str(seq)}),
        ("customer_warehouse", {"customer_id": r.choice([customer, "n", "m"]), "warehouse": str(seq)}),
        ("customer_delete", {"customer_id": r.choice([customer, "n"])}),
        ("package_insert", {"tracking_number": r.choice([package, "q"]), "customer_id": customer, "Date_create": "2024-01-01T00:00:00"}),
        ("package_edit", {"old_id": package, "tracking_number": r.choice([package, package, "q"]), "customer_id": customer}),
        ("package_delete", {"tracking_number": package, "customer_id": r.choice([customer, None])}),
        ("item_edit", {"item_id": item, "item_name": "n", "item_type": str(seq)}),
        ("item_delete", {"item_id": item, "customer_id": r.choice([customer, None])}),
        ("box_edit", {"box_id": box, "box_status": r.choice(["Packed", "Paid"]), "has_bprice": r.random() < 0.5,
                      "bprice": seq, "customer_id": customer, "has_customer_id": True}),
        ("box_priority", {"box_id": box, "priority": seq}),
        ("box_delete", {"box_id": box, "customer_id": customer}),
        ("slip_insert", {"box_id": box, "details": str(seq)}),
        ("slip_delete", {"slip_id": r.randrange(3)}),
    ])


def test_random_logs_equal_one_by_one(spark):
    """Each random log is a tenant; one by one means the n-th requests of all tenants at a time."""
    cases, length = 30, 5
    start = {n: [] for n in ("customers", "packages", "items", "box", "slip")}
    rows = []
    for n in range(cases):
        r, t = random.Random(n), {"tenant_id": f"t{n:02}"}
        start["customers"] += [{**t, "customer_id": f"c{k}", "status": r.choice([None, "Warehouse", "Unpaid"]), "packages": k} for k in range(3)]
        start["packages"] += [{**t, "tracking_number": f"p{k}", "customer_id": r.choice([None, "c0", "c1", "c2"])} for k in range(4)]
        start["items"] += [{**t, "item_id": k, "tracking_number": f"p{r.randrange(4)}", "item_status": r.choice([0, 1]),
                            "box_id": r.choice([None, "b0", "b1"])} for k in range(6)]
        start["box"] += [{**t, "box_id": f"b{k}", "customer_id": f"c{r.randrange(3)}", "box_status": r.choice(["Packed", "Paid"])} for k in range(3)]
        start["slip"] += [{**t, "slip_id": k, "box_id": "b0"} for k in range(3)]
        rows += [(t["tenant_id"], s, *_random_request(r, s)) for s in range(r.randrange(3, length + 1))]
    base = tables(spark, **start)
    log = settle(_log(spark, rows))

    def one_by_one():
        for s in range(length):
            for name in sorted({k for _, seq, k, _ in rows if seq == s}):
                sent = log.filter((F.col("seq") == s) & (F.col("kind") == name))
                yield KINDS[name].job, schedule._requests(sent, KINDS[name], name)

    runs = list(cut_levels(log, KINDS))
    got, expected = apply_runs(base, runs, settle), apply_runs(base, one_by_one(), settle)
    for name in sorted(expected):
        # Numbers of new rows may have other gaps.
        columns = [c for c in expected[name].columns if c != "slip_id"]
        assert pairs(got[name], *columns) == pairs(expected[name], *columns), name
    assert len(runs) < sum(1 for _ in one_by_one())


def test_hot_resources_are_split(spark):
    """Two thirds of a log hold one row; the join of holders to the log splits it."""
    n = 40_000
    body = F.format_string('{"box_id": "%s", "priority": 1}', F.when(F.col("id") % 3 > 0, "HOT").otherwise(F.col("id").cast("string")))
    log = spark.range(n).select(F.lit("t").alias("tenant_id"), F.col("id").alias("seq"),
                                F.lit("box_priority").alias("kind"), body.alias("body"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        found = list(schedule.levels(log, {"box_priority": KINDS["box_priority"]}))
        assert len(found) == 1 and found[0].count() == n
        rows = schedule.accesses(log, {"box_priority": KINDS["box_priority"]})
        plan = schedule._waiting(rows)._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_requests_announce_themselves_only_where_a_kind_holds_a_whole_table(spark):
    rows = [("t", 1, "box_priority", {"box_id": "a"}), ("t", 2, "box_priority", {}),
            ("t", 3, "slip_delete", {"slip_id": 7})]

    def held(kinds):
        used = {k: KINDS[k] for k in kinds}
        return pairs(schedule.accesses(_log(spark, rows), used), "seq", "resource", "mode")

    assert held(["box_priority", "slip_delete"]) == [
        (1, "box.:a", "S"), (1, "box.priority:a", "W"), (2, "*", "IS"), (3, "slip.:7", "W")]
    # Who changes the whole table meets those who hold one of its rows.
    assert (3, "slip.", "IX") in held(["box_priority", "slip_delete", "slip_insert"])
    rows.append(("t", 4, "slip_insert", {}))
    assert [[r[1] for r in level] for level in _levels(spark, rows)] == [[1, 2, 3], [4]]


def test_every_kind_reads_its_requests(spark):
    """The fields and touches of all kinds plan and run on an empty body."""
    base = tables(spark)
    rows = [("t", n, name, {}) for n, name in enumerate(sorted(KINDS))]
    out = apply_runs(base, cut_levels(_log(spark, rows), KINDS), settle)
    assert out["logedit"].count() == 1 and out["box"].columns == base["box"].columns


def test_an_unknown_kind_is_refused(spark):
    with pytest.raises(ValueError, match="unknown kinds"):
        list(cut_levels(_log(spark, [("t", 1, "?", {})]), KINDS))
    assert list(cut_levels(spark.createDataFrame([], LOG), KINDS)) == []
