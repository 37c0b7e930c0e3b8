"""Files, logs, snapshots and the change feed."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelyard.operators.changes import update_by_key
from parcelyard.operators.joins import rows_of_employees
from parcelyard.plans import boxes, packages
from parcelyard.plans.kinds import KINDS
from parcelyard.plans.schedule import cut_levels
from parcelyard.sources import checkpoints, documents, settings
from parcelyard.sources.tables import (
    append_log,
    hash_predicates,
    read_table,
    read_tables,
    write_tables,
)
from parcelyard.streaming import feed
from parcelyard.streaming.feed import (
    LOG,
    Kind,
    follow_changes,
    follow_log,
    read_listing,
    read_snapshot,
    snapshot,
    start,
    versions_in_use,
)
from rows import pairs, table, tables

PRICE = [
    {"id": 1, "region": "Laos", "tiers": [{"id": 1, "quantity": "1.25", "price": "120"},
                                          {"id": 2, "quantity": "x", "price": ""}],
     "additional": [{"id": 1, "range": "35-60", "rate": "9"},
                    {"id": 2, "range": "over 3", "rate": "1.5"}]},
    {"id": 2, "region": "โตเกียว", "tiers": [], "additional": []},
]
WAREHOUSE = {
    "shelves": [{"id": 1, "name": "Z9"}],
    "productCategories": [{"id": 4, "category": "dry", "product": "rice"}],
    "boxSizes": [{"id": 1, "name": "S", "width": "10", "length": "11", "height": "?"},
                 {"id": 2, "name": "M", "width": 20, "length": 21.5, "height": 22}],
}


def _write(root, tenant, kind, body):
    folder = root / tenant
    folder.mkdir(exist_ok=True)
    text = body if isinstance(body, str) else json.dumps(body, ensure_ascii=False, indent=2)
    (folder / f"{kind}.json").write_text(text, encoding="utf-8")


def test_settings_files(spark, tmp_path):
    _write(tmp_path, "a co", "price", PRICE)
    _write(tmp_path, "บี", "price", "{}")
    _write(tmp_path, "a co", "promotion", [
        {"id": 1, "name": "n", "discount": "315"}, {"id": 2, "name": "p", "discount": " 12.5%"}])
    _write(tmp_path, "a co", "warehouse", WAREHOUSE)
    _write(tmp_path, "a co", "dropdown", {"channels": ["x", "y"], "levels": []})
    _write(tmp_path, "a co", "company_info", {"companyName": "A", "taxId": "1"})
    root = str(tmp_path)
    price = settings.read_settings(spark, root, "price")
    assert pairs(price, "tenant_id") == [("a co",), ("บี",)]
    assert settings.read_settings(spark, root, "no_such_kind").count() == 0
    assert pairs(settings.price_tiers(price), "tenant_id", "tier_id", "quantity", "price") == [
        ("a co", 1, 1.25, 120.0), ("a co", 2, None, None)]
    assert pairs(settings.price_additional(price), "range", "range_low", "range_high", "rate") == [
        ("35-60", 35.0, 60.0, 9.0), ("over 3", None, None, 1.5)]
    promotion = settings.promotions(settings.read_settings(spark, root, "promotion"))
    assert pairs(promotion, "promotion_id", "amount", "percent") == [
        (1, 315.0, None), (2, None, 12.5)]
    files = settings.read_settings(spark, root, "warehouse")
    assert pairs(settings.warehouse_shelves(files), "shelf_id", "name") == [(1, "Z9")]
    assert pairs(settings.warehouse_categories(files), "category", "product") == [("dry", "rice")]
    assert pairs(settings.warehouse_box_sizes(files), "width", "length", "height") == [
        (10.0, 11.0, None), (20.0, 21.5, 22.0)]
    lists = settings.dropdown_values(settings.read_settings(spark, root, "dropdown"))
    assert pairs(lists, "list", "pos", "value") == [("channels", 0, "x"), ("channels", 1, "y")]
    info = settings.company_info(settings.read_settings(spark, root, "company_info"))
    assert pairs(info, "companyName", "taxId", "photo") == [("A", "1", None)]


def test_settings_are_replaced_per_tenant(spark, tmp_path):
    path = str(tmp_path / "dropdown")
    old = spark.createDataFrame([("a", "A"), ("b", "B\nB")], "tenant_id string, body string")
    settings.write_settings(old, path)
    employee = spark.createDataFrame(
        [("1", "db", "a"), ("2", "db", "c")],
        "emp_id string, emp_database string, company_name string")
    names = "array<struct<name:string>>"
    sent = spark.createDataFrame(
        [(2, "1", [("y",), ("x",), ("y",)], [], [("l",)]), (1, "1", [("late",)], [], []),
         (1, "2", [("z",)], [], []), (9, "77", [("lost",)], [], [])],
        f"seq bigint, emp_id string, channels {names}, categories {names}, levels {names}")
    current = settings.read_stored_settings(spark, path)
    new = settings.replace_settings(current, settings.dropdown_body(sent), employee)
    stored = dict(pairs(new, "tenant_id", "body"))
    assert stored["b"] == "B\nB"
    assert json.loads(stored["a"]) == {"channels": ["y", "x"], "categories": [], "levels": ["l"]}
    assert set(stored) == {"a", "b", "c"}
    one = spark.createDataFrame([("a", stored["a"])], "tenant_id string, body string")
    settings.write_settings(one, path)
    assert pairs(settings.read_stored_settings(spark, path), "tenant_id", "body") == [
        ("a", stored["a"]), ("b", "B\nB")]
    form = spark.createDataFrame(
        [(1, "1", '{"emp_id":"1","shelves":[{"id":1,"name":"s"}]}')],
        "seq bigint, emp_id string, body string")
    body = settings.warehouse_body(form).first().body
    assert json.loads(body) == {"shelves": [{"id": 1, "name": "s"}]}


def test_a_warehouse_form_is_kept_whole(spark):
    sent = {
        "shelves": [{"id": 1, "name": "a", "floor": 3}], "boxSizes": [{"width": 30, "length": "30", "height": 1.5}],
        "note": "kept \u00e9 \"so\"", "n": None, "yes": True, "deep": {"emp_id": 4, "l": [[], {}, [1, "1", 1e300]]},
        "big": 12345678901234567890123, "minus": -7, "": "no name",
    }
    bodies = [json.dumps({**sent, "emp_id": "7"}), "[1, {\"emp_id\": 2}]", "{}", "not json", None]
    form = spark.createDataFrame([(n, "1", b) for n, b in enumerate(bodies)], "seq bigint, emp_id string, body string")
    got = {r.seq: json.loads(r.body) for r in settings.warehouse_body(form).collect()}
    assert got == {0: sent, 1: [1, {"emp_id": 2}], 2: {}}
    kinds = lambda x: [type(v) for v in x["boxSizes"][0].values()]
    assert sorted(map(str, kinds(got[0]))) == sorted(map(str, kinds(sent)))


def test_documents(spark, tmp_path):
    text = "สวัสดี\nโลก"
    (tmp_path / "JP 1+1_%_2024.txt").write_text(text, encoding="utf-8")
    rows = documents.documents_scan(documents.read_documents(spark, str(tmp_path)))
    assert pairs(rows, "file_name", "value", "n_chars", "n_bytes") == [
        ("JP 1+1_%_2024.txt", text, 10, len(text.encode()))]


def test_tables_round_trip(spark, tmp_path):
    root = str(tmp_path)
    rows = [{"tenant_id": t, "customer_id": c, "packages": 1,
             "customer_date": dt.datetime(2024, 1, 1)} for t in "xy" for c in "ab"]
    t = {"customers": table(spark, "customers", rows), "employee": table(
        spark, "employee", [{"emp_id": "1", "emp_date": dt.date(2024, 1, 1)}])}
    write_tables(t, root)
    back = read_tables(spark, root, t)
    for name in t:
        assert back[name].schema == t[name].schema
        assert pairs(back[name], *t[name].columns) == pairs(t[name], *t[name].columns)
    plan = back["customers"].filter("tenant_id = 'x'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan


def test_log(spark, tmp_path):
    root = str(tmp_path / "store")
    one = table(spark, "logedit", [{"Detail": "d", "type": "t", "emp_id": "1"}])
    append_log(one, root)
    append_log(one, root)
    assert read_table(spark, root, "logedit").count() == 2
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"tenant_id":"t","Detail":"n","type":"x","emp_id":"2"}\n')
    root = str(tmp_path / "streamed")
    for _ in range(2):
        query = follow_log(spark, str(inbox), root, str(tmp_path / "progress"))
        assert query.awaitTermination(120)
    assert pairs(read_table(spark, root, "logedit"), "tenant_id", "Detail") == [("t", "n")]


def test_change_feed(spark, tmp_path):
    root, inbox = str(tmp_path / "store"), tmp_path / "inbox"
    inbox.mkdir()
    t = tables(
        spark, box=[{"box_id": "a", "priority": 1}, {"box_id": "b", "priority": 2}],
        slip=[{"slip_id": 1, "box_id": "a"}], packages=[{"tracking_number": "P", "photo_url": "https://x.amazonaws.com/p"}],
    )
    start({n: t[n] for n in ("box", "slip", "packages", "items", "customers")}, root)
    kinds = {
        "priority": Kind(boxes.box_priority, "box_id string, priority int"),
        "slip": Kind(boxes.slip_delete, "slip_id bigint"),
        "package": Kind(packages.package_delete, "customer_id string, tracking_number string"),
    }

    def run():
        query = follow_changes(spark, kinds, str(inbox), root, str(tmp_path / "progress"))
        assert query.awaitTermination(240)

    def send(name, *rows):
        text = "\n".join(
            json.dumps({"tenant_id": tenant, "seq": seq, "kind": kind, "body": json.dumps(body)})
            for tenant, seq, kind, body in rows
        )
        (inbox / name).write_text(text + "\n")

    def state(version):
        rows = read_snapshot(spark, root, version)
        return pairs(rows["box"], "box_id", "priority"), rows["slip"].count()

    # Two kinds interleave, out of order, and another tenant has runs of its own.
    send("1.json", ("t", 4, "priority", {"box_id": "a", "priority": 7}),
         ("t", 1, "priority", {"box_id": "a", "priority": 5}), ("t", 2, "slip", {"slip_id": 1}),
         ("t", 3, "priority", {"box_id": "a", "priority": 9}), ("u", 1, "slip", {"slip_id": 1}))
    run()
    assert state(1) == ([("a", 7), ("b", 2)], 0)
    held = lambda v: versions_in_use(read_listing(spark, root, v))
    assert held(1) == {"box": [0, 1], "slip": [0, 1], "packages": [0], "items": [0], "customers": [0]}
    assert sorted(p.name for p in (tmp_path / "store" / "v=000000000001").iterdir()) == ["box", "slip"]
    send("2.json", ("t", 5, "priority", {"box_id": "b", "priority": None}),
         ("t", 6, "package", {"tracking_number": "P"}))
    run()
    run()
    assert state(2) == ([("a", 7), ("b", None)], 0)
    assert held(2)["slip"] == [0, 1] and held(2)["box"] == [0, 1, 2]
    assert read_snapshot(spark, root, 2, ["packages"])["packages"].count() == 0
    assert pairs(spark.read.parquet(f"{snapshot(root, 2)}/assets"), "object_key") == [("p",)]
    assert state(0) == ([("a", 1), ("b", 2)], 1)
    unknown = spark.createDataFrame([("t", 1, "?", "{}")], LOG)
    with pytest.raises(ValueError, match="unknown kinds"):
        list(cut_levels(unknown, kinds))


def test_a_batch_writes_its_tenants_only(spark, tmp_path, monkeypatch):
    """One tenant of many, then all rows of another; a table in many versions is written whole."""
    monkeypatch.setattr(feed, "MAX_VERSIONS", 3)
    root, names = str(tmp_path), [f"t{n}" for n in range(12)]
    rows = [{"tenant_id": t, "box_id": b, "priority": 0} for t in names for b in "ab"]
    slips = [{"tenant_id": t, "slip_id": 1} for t in names]
    start({"box": table(spark, "box", rows), "slip": table(spark, "slip", slips)}, root)
    kinds = {"box_priority": KINDS["box_priority"], "slip_delete": KINDS["slip_delete"]}
    expected = {(t, b): 0 for t in names for b in "ab"}

    def folders(version, name):
        path = tmp_path / snapshot("", version).strip("/") / name
        return sorted(p.name.partition("=")[2] for p in path.glob("tenant_id=*"))

    def apply(version, *sent):
        log = [(t, n, "box_priority", json.dumps({"box_id": b, "priority": p})) for n, (t, b, p) in enumerate(sent)]
        feed.apply_batch(spark, kinds, spark.createDataFrame(log, LOG), root, version)
        expected.update({(t, b): p for t, b, p in sent})
        got = read_snapshot(spark, root, version + 1)
        assert pairs(got["box"], "tenant_id", "box_id", "priority") == sorted((*k, v) for k, v in expected.items())

    apply(0, ("t3", "a", 5))
    assert folders(1, "box") == ["t3"] and folders(1, "slip") == []
    apply(1, ("t4", "b", 6), ("t3", "b", 7))
    assert folders(2, "box") == ["t3", "t4"]
    apply(2, ("t5", "b", 8))
    assert versions_in_use(read_listing(spark, root, 3))["box"] == [0, 2, 3]
    apply(3, ("t6", "a", 9))
    assert folders(4, "box") == sorted(names)
    assert versions_in_use(read_listing(spark, root, 4)) == {"box": [4], "slip": [0]}
    gone = [("t7", 1, "slip_delete", json.dumps({"slip_id": 1})), (None, 2, "slip_delete", json.dumps({"slip_id": 1}))]
    feed.apply_batch(spark, kinds, spark.createDataFrame(gone, LOG), root, 4)
    assert folders(5, "slip") == []
    left = read_snapshot(spark, root, 5, ["slip"])["slip"]
    assert pairs(left, "tenant_id") == sorted((t,) for t in names if t != "t7")


def test_reports_read_the_asking_tenant_only(spark, tmp_path):
    """Other tenants' files are broken, so reading one would fail."""
    rows = [{"tenant_id": t, "box_id": f"{t}{n}"} for t in ("a", "b", "c") for n in range(3)]
    write_tables({"box": table(spark, "box", rows)}, str(tmp_path))
    for t in "bc":
        for file in (tmp_path / "box" / f"tenant_id={t}").glob("*.parquet"):
            file.write_bytes(b"broken")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    staff = table(spark, "employee", [
        {"emp_id": "1", "emp_database": "a"}, {"emp_id": "2", "emp_database": "b"}, {"emp_id": "3", "emp_database": ""}])
    asked = spark.createDataFrame([("1",), ("3",), ("9",)], "emp_id string")
    report = rows_of_employees(read_table(spark, str(tmp_path), "box"), asked, staff)
    assert "dynamicpruning" in report._jdf.queryExecution().executedPlan().toString()
    assert pairs(report, "box_id") == [("a0",), ("a1",), ("a2",)]


def test_predicates_of_text_keys(spark):
    """No database may be started here, so the conditions are tried on a view."""
    assert hash_predicates("a`b", 2) == [
        "MOD(CRC32(`a``b`), 2) = 0 OR `a``b` IS NULL", "MOD(CRC32(`a``b`), 2) = 1"]
    rows = spark.range(1000).selectExpr("nullif(concat('k', id), 'k7') AS customer_id")
    parts = [rows.filter(p).count() for p in hash_predicates("customer_id", 4)]
    assert sum(parts) == 1000 and min(parts) > 150


def test_settled_keys(spark):
    keys = table(spark, "box", [{"box_id": "a"}]).select("tenant_id", "box_id")
    stored = checkpoints.settle(keys)
    assert pairs(stored, "box_id") == [("a",)]
    folder = checkpoints.ensure_checkpoint_dir(spark)
    assert folder in spark.sparkContext.getCheckpointDir()
    assert spark.conf.get("spark.checkpoint.dir") in folder


def test_update_folds_per_column(spark):
    base = table(spark, "box", [{"box_id": "a", "note": "n", "priority": 1}, {"box_id": "b"}])
    changes = spark.createDataFrame(
        [("t", 1, "a", "x", True, 5, True), ("t", 2, "a", None, None, 9, True),
         ("t", 3, "a", "late", False, None, False), ("u", 9, "a", "other", True, 0, True)],
        "tenant_id string, seq bigint, box_id string, note string, n boolean, "
        "priority int, p boolean")
    out = update_by_key(base, changes, "box_id", optional={"note": "n", "priority": "p"})
    assert pairs(out, "box_id", "note", "priority") == [("a", "x", 9), ("b", None, None)]
    assert out.schema == base.schema.__class__(
        [T.StructField(f.name, f.dataType, True) for f in base.schema.fields])
    assert out.filter(F.col("note") == "x").count() == 1
