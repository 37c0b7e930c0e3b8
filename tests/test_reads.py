"""Edge rows of the read operators."""

import datetime as dt

from pyspark.sql import functions as F

from parcelyard.functions.text import (
    base_name,
    box_identifier,
    object_key,
    safe_file_name,
    with_picture_extension,
)
from parcelyard.functions.values import greatest_or_null, leading_unsigned
from parcelyard.functions.collation import any_case, exact_case
from parcelyard.operators import aggregates, joins, lookups, nesting, prefixes
from rows import pairs, requests, table, tables


def _packing(spark):
    return tables(
        spark,
        customers=[
            {"customer_id": "none", "customer_date": dt.datetime(2024, 1, 1)},
            {"customer_id": "done", "customer_date": dt.datetime(2024, 1, 3)},
            {"customer_id": "some", "customer_date": dt.datetime(2024, 1, 2)},
            {"customer_id": "undated"},
        ],
        packages=[
            {"tracking_number": "P1", "customer_id": "done"},
            {"tracking_number": "P2", "customer_id": "some"},
            {"tracking_number": "P3", "customer_id": "some"},
            {"tracking_number": "P4", "customer_id": "some"},
            {"tracking_number": "P5", "customer_id": "some"},
            {"tracking_number": "P6"},
            {"tenant_id": "u", "tracking_number": "P7", "customer_id": "none"},
        ],
        items=[
            {"item_id": 1, "tracking_number": "P1", "item_status": 1},
            {"item_id": 2, "tracking_number": "P2", "item_status": 1},
            {"item_id": 3, "tracking_number": "P2", "item_status": None},
            {"item_id": 4, "tracking_number": "P3", "item_status": None},
            {"item_id": 5, "tracking_number": "P4", "item_status": 0},
            {"item_id": 6, "tracking_number": "P4", "item_status": 1},
            {"item_id": 7, "tracking_number": "P6", "item_status": 0},
        ],
    )


def test_open_package_counts(spark):
    t = _packing(spark)
    args = t["customers"], t["packages"], t["items"]
    counts = aggregates.customer_open_package_counts(*args)
    # P1 and P2 are fully packed: a NULL status beside a boxed one is ignored.
    assert [(r.customer_id, r.package_count) for r in counts.collect()] == [
        ("done", 0), ("some", 3), ("none", 0), ("undated", 0),
    ]
    kept = aggregates.customers_with_open_packages(*args)
    assert [(r.customer_id, r.package_count) for r in kept.collect()] == [
        ("some", 3), ("none", 0), ("undated", 0),
    ]
    assert pairs(joins.fully_packed_packages(t["items"]), "tracking_number") == [("P1",), ("P2",)]


def test_package_progress(spark):
    t = _packing(spark)
    rows = aggregates.package_item_progress(t["packages"], t["items"])
    assert pairs(rows, "tracking_number", "sum0", "sum1") == [
        ("P1", 0, 1), ("P2", 0, 1), ("P3", 0, 0), ("P4", 1, 1), ("P5", 0, 0), ("P6", 1, 0),
        ("P7", 0, 0),
    ]
    unclaimed = aggregates.package_item_progress(t["packages"], t["items"], unclaimed=True)
    assert pairs(unclaimed, "tracking_number", "sum0") == [("P6", 1)]
    keys = requests(spark, "customer_id string", [("done",), ("done",)])
    mine = aggregates.package_item_progress(t["packages"], t["items"], keys)
    assert pairs(mine, "tracking_number") == [("P1",)]


def test_keys_keep_tenants_apart(spark):
    t = _packing(spark)
    keys = spark.createDataFrame([("u", "done"), ("t", "none")], "tenant_id string, customer_id string")
    assert pairs(lookups.customers_by_key(t["customers"], keys), "customer_id") == [("none",)]
    owners = joins.customer_by_tracking(t["customers"], t["packages"])
    assert ("P7",) not in pairs(owners, "tracking_number")
    assert pairs(aggregates.open_item_count(t["packages"], t["items"]), "customer_id", "open_items") == [
        ("some", 1)
    ]


def _boxed(spark):
    return tables(
        spark,
        items=[
            {"item_id": 1, "box_id": "B", "quantity": 10, "weight": 5},
            {"item_id": 2, "box_id": "B", "quantity": 0, "weight": 5},
            {"item_id": 3, "box_id": "B", "weight": 5},
            {"item_id": 4, "box_id": "B", "quantity": 2, "weight": 4},
            {"item_id": 5, "box_id": "B", "quantity": 6, "weight": 3},
            {"item_id": 6, "quantity": 6, "weight": 3},
        ],
        subbox=[
            {"subbox_id": 1, "box_id": "B", "weight": 2, "width": 10, "b_long": 10, "height": 10},
            {"subbox_id": 2, "box_id": "B", "weight": 1, "width": 30, "b_long": 25, "height": 10},
            {"subbox_id": 3, "box_id": "B", "width": 30, "b_long": 25, "height": 10},
            {"subbox_id": 4, "box_id": "B", "weight": 1, "b_long": 25, "height": 10},
            {"subbox_id": 5, "box_id": "B", "weight": 1, "width": 25, "height": 10},
            {"subbox_id": 6, "box_id": "C", "weight": 1, "width": 25, "b_long": 10},
        ],
        subbox_item=[
            {"subbox_id": 1, "item_id": 1, "sub_quantity": 4},
            {"subbox_id": 2, "item_id": 1, "sub_quantity": 3},
            {"subbox_id": 6, "item_id": 1, "sub_quantity": 1},
            {"subbox_id": 1, "item_id": 2, "sub_quantity": 3},
            {"subbox_id": 1, "item_id": 4, "sub_quantity": 5},
            {"subbox_id": 1, "item_id": 5, "sub_quantity": 6},
            {"subbox_id": 2, "item_id": 99, "sub_quantity": 1},
        ],
    )


def test_remaining_items(spark):
    t = _boxed(spark)
    rows = aggregates.remaining_box_items(t["items"], t["subbox"], t["subbox_item"])
    # Item 1 counts only the sub-boxes of its own box; 5 is used up; 3 has no quantity.
    assert pairs(rows, "item_id", "remaining_quantity", "adjusted_weight") == [
        (1, 3.0, 1.5), (2, -3.0, None), (4, -3.0, -6.0),
    ]


def test_volumetric_weight(spark):
    t = _boxed(spark)
    rows = nesting.subbox_volumetric(t["subbox"])
    assert pairs(rows, "subbox_id", "volumetricWeight") == [
        (1, 2.0), (2, 1.5), (3, None), (4, None), (5, None), (6, None),
    ]


def test_nested_subboxes(spark):
    t = _boxed(spark)
    whole = nesting.subbox_nested(t["subbox"], t["subbox_item"], t["items"]).collect()
    assert sorted(r["item"].subbox_item_id for r in whole if r.subbox_id == 1) == [1, 2, 4, 5]
    assert [r["item"] for r in whole if r.subbox_id == 3] == [None]
    (lost,) = [r["item"] for r in whole if r.subbox_id == 2 and r["item"].subbox_item_id == 99]
    assert (lost.item_id, lost.adjusted_weight) == (None, None)
    boxes = requests(spark, "box_id string", [("C",)])
    only = nesting.subbox_nested(t["subbox"], t["subbox_item"], t["items"], boxes)
    assert pairs(only, "subbox_id") == [(6,)]


def test_a_large_subbox_has_the_same_shape(spark):
    n = 100_000
    subbox = table(spark, "subbox", [{"subbox_id": 1}, {"subbox_id": 2}, {"subbox_id": 3}])
    ids = spark.range(n).selectExpr("'t' AS tenant_id", "id AS item_id")
    few = table(spark, "subbox_item", [{"subbox_id": 2, "item_id": 7, "sub_quantity": 1}])
    many = ids.selectExpr("tenant_id", "1L AS subbox_id", "item_id", "1D AS sub_quantity")
    items = ids.selectExpr(
        "*", *[f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}"
               for f in table(spark, "items", []).schema if f.name not in ids.columns]
    )
    small = nesting.subbox_nested(subbox, few, items)
    large = nesting.subbox_nested(subbox, few.unionByName(many), items)
    assert large.columns == small.columns
    counts = {r.subbox_id: (r["count(1)"], r["count(DISTINCT item.item_id)"]) for r in
              large.groupBy("subbox_id").agg(F.count("*").alias("count(1)"),
                                             F.count_distinct("item.item_id").alias("count(DISTINCT item.item_id)")).collect()}
    assert counts == {1: (n, n), 2: (1, 1), 3: (1, 0)}


def test_box_board(spark):
    box = table(
        spark,
        "box",
        [
            {"box_id": "a", "box_status": "Packed", "priority": 2},
            {"box_id": "b", "box_status": "Packed"},
            {"box_id": "d", "box_status": "Packed", "priority": 1},
            {"box_id": "c", "box_status": "Packed", "priority": 1},
            {"box_id": "e", "box_status": "Ordered", "priority": 9},
            {"box_id": "f", "box_status": "Documented", "priority": 1},
            {"box_id": "g", "box_status": "Lost"},
            {"box_id": "h"},
        ],
    )
    rows = nesting.box_board(box).collect()
    assert sorted((r.box_status, r.board, r.pos, r.box_id) for r in rows) == [
        ("Documented", 2, 1, "f"), ("Ordered", 1, 1, "e"),
        ("Packed", 1, 1, "b"), ("Packed", 1, 2, "c"), ("Packed", 1, 3, "d"), ("Packed", 1, 4, "a"),
    ]
    assert nesting.box_board(table(spark, "box", [])).collect() == []


def test_pending_appointments(spark):
    appointment = table(
        spark,
        "appointment",
        [
            {"appoint_id": 1, "status": "Pending", "start_date": dt.datetime(2024, 1, 14)},
            {"appoint_id": 2, "status": "Pending", "start_date": dt.datetime(2024, 1, 14, 0, 0, 1)},
            {"appoint_id": 3, "status": "Done", "start_date": dt.datetime(2024, 2, 1)},
            {"appoint_id": 4, "status": "Pending"},
            {"appoint_id": 5, "status": "Pending", "start_date": dt.datetime(2024, 2, 1)},
        ],
    )
    rows = lookups.pending_appointments(appointment, dt.date(2024, 1, 15))
    assert pairs(rows, "appoint_id", "formatted_start_date") == [
        (2, "2024-01-14"), (5, "2024-02-01"),
    ]


def test_last_tracking(spark):
    numbers = [
        "TH-9", "TH-10", "TH-010", "TH-x7", "T100", "JP-", "JP--3", "50%off-1", "50xoff-2", "th-99",
    ]
    packages = table(spark, "packages", [{"tracking_number": n} for n in numbers])
    types = requests(
        spark, "type string", [("TH",), ("T",), ("JP",), ("50%",), (r"50\%",), ("_H",), ("none",),
         (r"T\H",), ("TH-9\\",), (r"J\\P",)]
    )
    rows = prefixes.last_tracking_per_prefix(packages, types)
    assert dict(pairs(rows, "type", "tracking_number")) == {
        "TH": "TH-10",
        "T": "TH-10",
        "JP": "JP--3",
        "50%": "50xoff-2",
        r"50\%": "50%off-1",
        "_H": "TH-10",
        r"T\H": "TH-10",
    }
    # Without a '-' the whole text is read, so T100 counts 0.
    folded = prefixes.last_tracking_per_prefix(packages, types, ignore_case=True)
    assert dict(pairs(folded, "type", "tracking_number"))["TH"] == "th-99"
    other = packages.withColumn("tenant_id", F.lit("u")).withColumn(
        "tracking_number", F.concat("tracking_number", F.lit("9"))
    )
    both = packages.unionByName(other)
    for text in ("TH", r"T\H"):
        one = prefixes.last_tracking(both, "t", text)
        assert pairs(one, "tenant_id", "tracking_number") == [("t", "TH-10")]


def test_leading_unsigned(spark):
    texts = {
        "12a": 12, "a12": 0, "": 0, " 7": 7, "007": 7, "+5": 5, "-1": 2**64 - 1,
        "18446744073709551615": 2**64 - 1, "99999999999999999999": 2**64 - 1,
        "123456789012345678901234567890123456789012": 2**64 - 1, "3.9": 3, "-0": 0,
    }
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.n for r in df.select("t", leading_unsigned(F.col("t")).alias("n")).collect()}
    assert {k: None if v is None else int(v) for k, v in got.items()} == {**texts, None: None}


def test_greatest_is_null_with_a_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "a double, b double")
    out = df.select(greatest_or_null(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in out] == [2.0, None]


def test_object_keys(spark):
    urls = {
        "https://y.s3.ap.amazonaws.com/a/b.webp": "a/b.webp",
        "https://y.s3.AMAZONAWS.com/a b.webp?x=1#f": "a%20b.webp",
        "https://y.s3.amazonaws.com/รูป.webp": "%E0%B8%A3%E0%B8%B9%E0%B8%9B.webp",
        'https://y.s3.amazonaws.com/a"<{b}>`': "a%22%3C%7Bb%7D%3E%60",
        "https://y.s3.amazonaws.com/a[1]|^50%/%41%zz": "a[1]|^50%/%41%zz",
        "https://y.s3.amazonaws.com\\d\\e": "d/e",
        "https://y.s3.amazonaws.com/a/../b.webp": "b.webp",
        "https://y.s3.amazonaws.com/../a/./b/%2E%2e/c/..": "a/",
        "https://y.s3.amazonaws.com/a..b/.c/...": "a..b/.c/...",
        "https://y.s3.amazonaws.com/a\tb\nc.webp": "abc.webp",
        "\x01 https://y.s3.amazonaws.com/a\x1f": "a",
        "https://y.s3.amazonaws.com/": None,
        "https://y.s3.amazonaws.com": None,
        "https://amazonaws.com/a": None,
        "https://amazonaws.com.evil.org/a": None,
        "img/a.webp": None,
        "http://[bad/a": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = {r.u: r.k for r in df.select("u", object_key(F.col("u")).alias("k")).collect()}
    assert got == urls


def test_names(spark):
    def one(col):
        return spark.range(1).select(col).first()[0]

    assert one(safe_file_name(F.lit('a:b<c>d|e?f*g"h/i'))) == "a_b_c_d_e_f_g_h/i"
    assert one(with_picture_extension(F.lit("a.b.png"))) == "a.b.webp"
    assert one(with_picture_extension(F.lit("dir.x/name"))) == "dir.x/name"
    for given, base in {
        "x/y.tar.gz": "y.tar", ".hidden": ".hidden", "plain": "plain", "dot.": "dot", "d/": "d",
    }.items():
        assert one(base_name(F.lit(given))) == base
    at = F.lit("2024-03-04 05:06:07").cast("timestamp_ntz")
    assert one(box_identifier(F.lit("JP-1"), at)) == "JP-1_2024-03-04T05:06:07"


def test_file_prefixes(spark):
    listing = requests(spark, "file_name string", [("ab1",), ("ab2",), ("b",), ("a",)])
    keys = requests(spark, "photo_name string", [("a",), ("ab",), ("b",), ("zz",), (None,), ("ab2",)])
    assert pairs(prefixes.file_prefix_matches(listing, keys), "photo_name", "file_name") == [
        ("a", "a"), ("a", "ab1"), ("a", "ab2"), ("ab", "ab1"), ("ab", "ab2"), ("ab2", "ab2"),
        ("b", "b"),
    ]
    first = prefixes.file_prefix_matches(listing, keys, "first")
    assert pairs(first, "photo_name", "file_name") == [
        ("a", "a"), ("ab", "ab1"), ("ab2", "ab2"), ("b", "b"),
    ]
    exact = prefixes.file_prefix_matches(listing, keys, "exact")
    assert pairs(exact, "file_name") == [("a",), ("ab2",), ("b",)]
    everything = requests(spark, "photo_name string", [("",)])
    assert prefixes.file_prefix_matches(listing, everything).count() == 4


def test_staff(spark):
    employee = spark.createDataFrame(
        [
            ("1", "acme", "acme", "owner", "x"), ("2", "joe", "acme", "staff", "x"),
            ("3", None, "acme", None, "x"), ("4", "zoe", "other", "staff", "x"),
        ],
        "emp_id string, username string, company_name string, role string, password string",
    )
    callers = spark.createDataFrame([("1",), ("2",), ("9",)], "emp_id string")
    staff = joins.company_staff(employee, callers)
    assert pairs(staff, "emp_id") == [("2",)] and "password" not in staff.columns
    assert pairs(lookups.company_owner_accounts(employee), "emp_id") == [("1",)]
    assert "password" not in lookups.employee_by_key(employee, callers).columns


def test_keys_of_any_case(spark):
    stored = table(spark, "customers", [{"customer_id": "Ab"}, {"customer_id": "AB"}, {"customer_id": "c"}])
    asked = table(spark, "customers", [{"customer_id": "aB"}, {"customer_id": "C"}, {"customer_id": None}])
    found = exact_case(lookups.customers_by_key(any_case(stored), any_case(asked)))
    assert pairs(found, "customer_id") == [("AB",), ("Ab",), ("c",)]
    assert found.dtypes == stored.dtypes
    assert lookups.customers_by_key(stored, asked).collect() == []
    assert exact_case(any_case(stored)).distinct().count() == 3
    assert any_case(stored).select("customer_id").distinct().count() == 2
