"""Edge rows of the change jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelyard.plans import assets, boxes, customers, office, packages
from parcelyard.plans.runs import apply_runs
from parcelyard.sources.checkpoints import ensure_checkpoint_dir as checkpoint_dir
from parcelyard.sources.checkpoints import settle
from rows import pairs, requests, tables


def test_customer_insert_refuses_stored_and_repeated_ids(spark):
    t = tables(spark, customers=[{"customer_id": "a", "note": "old"}])
    new = requests(
        spark,
        "seq bigint, customer_id string, contact string, type string, level string, note string",
        [(1, "a", "x", "x", "x", "new"), (3, "b", "x", "x", "x", "late"),
         (2, "b", "x", "x", "x", "early")],
    )
    out = customers.customer_insert(t, new)["customers"]
    assert pairs(out, "customer_id", "note", "packages") == [("a", "old", None), ("b", "early", 0)]


_EDIT = "seq bigint, old_id string, customer_id string, contact string, type string, level string, note string"


def test_customer_rename(spark):
    t = tables(spark, customers=[{"customer_id": "a", "city": "c"}, {"customer_id": "b"}])
    edits = requests(
        spark, _EDIT,
        [(1, "a", "a", "x", None, None, "1"), (2, "a", "z", "x", None, None, "2"),
         (3, "q", "q", "x", None, None, "3")],
    )
    out = customers.customer_edit(t, edits)["customers"]
    assert pairs(out, "customer_id", "note", "city") == [("b", None, None), ("z", "2", "c")]


@pytest.mark.parametrize(
    "steps",
    [
        [("a", "z"), ("z", "y")],  # chain
        [("a", "z"), ("a", "y")],  # second rename
        [("a", "z"), ("a", "a")],  # addressed by the old key afterwards
    ],
)
def test_customer_rename_chain_is_refused(spark, steps):
    t = tables(spark, customers=[{"customer_id": "a"}])
    edits = requests(
        spark, _EDIT, [(n, old, new, "", "", "", "") for n, (old, new) in enumerate(steps)]
    )
    with pytest.raises(Exception, match="renamed"):
        customers.customer_edit(t, edits)["customers"].collect()


def test_customer_address_presence(spark):
    t = tables(
        spark,
        customers=[{"customer_id": c, "doc_type": "d", "doc_url": "u", "country": "x"} for c in "abcd"],
    )
    columns = (
        "seq bigint, customer_id string, emp_id string, country string, has_country boolean, "
        "doc_type string, has_doc_type boolean, doc_url string, has_doc_url boolean, "
        "customer_name string, address string, city string, state string, zipcode string, "
        "phone string"
    )
    rest = (None,) * 6
    changes = requests(
        spark, columns,
        [
            (1, "a", "1", None, True, None, True, None, True, *rest),  # nulls are values
            (1, "b", "1", None, False, "n", True, "n", None, *rest),  # half a document
            (1, "c", "1", "L", True, "n", True, "n", True, *rest),
            (2, "c", "1", None, False, None, False, None, False, *rest),  # country falls back
            (1, "d", "", "L", True, "n", True, "n", True, *rest),  # nobody's request
        ],
    )
    out = customers.customer_address(t, changes)["customers"]
    assert pairs(out, "customer_id", "country", "doc_type", "doc_url") == [
        ("a", None, None, None), ("b", "Thailand", "d", "u"), ("c", "Thailand", "n", "n"),
        ("d", "x", "d", "u"),
    ]


def _household(spark):
    return tables(
        spark,
        customers=[{"customer_id": "a"}, {"customer_id": "b"}],
        packages=[
            {"tracking_number": "P1", "customer_id": "a",
             "photo_url": "https://y.s3.amazonaws.com/p1"},
            {"tracking_number": "P2", "customer_id": "b",
             "photo_url": "https://y.s3.amazonaws.com/p2"},
            {"tracking_number": "P3"},
        ],
        items=[
            {"item_id": 1, "tracking_number": "P1", "item_status": 1, "box_id": "A",
             "photo_url": "https://y.s3.amazonaws.com/i1"},
            {"item_id": 2, "tracking_number": "P2", "item_status": 0,
             "photo_url": "https://y.s3.amazonaws.com/i2"},
            {"item_id": 3, "tracking_number": "P3", "item_status": 0},
            {"item_id": 4, "item_status": 0},
            {"item_id": 5, "tracking_number": "P2", "item_status": 1, "box_id": "B"},
        ],
        box=[
            {"box_id": "A", "customer_id": "a", "box_status": "Packed"},
            {"box_id": "B", "customer_id": "b", "box_status": "Packed"},
            {"box_id": "N", "box_status": "Packed"},
        ],
        subbox=[{"subbox_id": 1, "box_id": "A"}, {"subbox_id": 2, "box_id": "B"}, {"subbox_id": 3}],
        subbox_item=[{"subbox_id": 1, "item_id": 1}, {"subbox_id": 2, "item_id": 5}],
        slip=[{"slip_id": 1, "box_id": "A"}, {"slip_id": 2, "box_id": "B"}, {"slip_id": 3}],
        appointment=[{"appoint_id": 1, "customer_id": "a"}, {"appoint_id": 2}],
        addresses=[{"address_id": 1, "customer_id": "a"}, {"address_id": 2, "customer_id": "b"}],
    )


@pytest.mark.parametrize("keep", [None, settle])
def test_customer_delete_cascade(spark, keep):
    t = _household(spark)
    gone = requests(spark, "customer_id string", [("a",), ("a",), (None,), ("",)])
    out = customers.customer_delete(t, gone, keep) if keep else customers.customer_delete(t, gone)
    left = {
        "customers": [("b",)], "packages": [("P2",), ("P3",)], "box": [("B",), ("N",)],
        "items": [(2,), (3,), (4,), (5,)], "subbox": [(2,), (3,)], "slip": [(2,), (3,)],
        "appointment": [(2,)], "addresses": [(2,)], "subbox_item": [(2,)],
    }
    key = {
        "customers": "customer_id", "packages": "tracking_number", "box": "box_id",
        "items": "item_id", "subbox": "subbox_id", "slip": "slip_id",
        "appointment": "appoint_id", "addresses": "address_id", "subbox_item": "subbox_id",
    }
    assert {n: pairs(out[n], key[n]) for n in left} == left
    again = customers.customer_delete({**t, **out}, gone)
    assert {n: pairs(again[n], key[n]) for n in left} == left


def test_purge_manifests(spark):
    t = _household(spark)
    a = requests(spark, "customer_id string", [("a",)])
    rows = assets.purge_for_customers(t["packages"], t["items"], a)
    assert pairs(rows, "kind", "ref", "object_key") == [
        ("item", "1", "i1"), ("package", "P1", "p1"),
    ]
    p = requests(spark, "tracking_number string", [("P2",), ("P3",)])
    rows = assets.purge_for_packages(t["packages"], t["items"], p)
    assert pairs(rows, "object_key") == [("i2",), ("p2",)]
    i = requests(spark, "item_id bigint", [(1,), (3,)])
    assert pairs(assets.purge_for_items(t["items"], i), "object_key") == [("i1",)]


def test_package_insert_and_edit(spark):
    t = tables(spark, packages=[{"tracking_number": "P", "customer_id": "a", "packages_cost": 5}])
    new = requests(
        spark,
        "seq bigint, tracking_number string, customer_id string, packages_cost double, "
        "has_packages_cost boolean, photo_url string, emp_id string",
        [(1, "Q", "MISSINGITEMS", 2.0, True, None, None), (2, "R", "", 2.0, None, None, None),
         (3, "P", "b", 2.0, True, None, None)],
    )
    out = packages.package_insert(t, new)["packages"]
    assert pairs(out, "tracking_number", "customer_id", F.col("packages_cost").cast("int")) == [
        ("P", "a", 5), ("Q", None, 2), ("R", "", None),
    ]
    edit = requests(
        spark,
        "seq bigint, old_id string, tracking_number string, customer_id string, photo_url string",
        [(1, "P", "P9", "", "u"), (1, "Q", "Q", "MISSINGITEMS", None)],
    )
    moved = packages.package_edit({"packages": out}, edit)["packages"]
    assert pairs(moved, "tracking_number", "customer_id", "photo_url") == [
        ("P9", None, "u"), ("Q", None, None), ("R", "", None),
    ]


def test_items_insert_numbers_and_defaults(spark):
    t = tables(
        spark,
        customers=[{"customer_id": c, "status": s} for c, s in
                   [("a", None), ("b", "Unpaid"), ("c", None), ("d", None)]],
        items=[{"item_id": 7, "tracking_number": "P"}],
    )
    columns = (
        "seq bigint, customer_id string, tracking_number string, emp_id string, "
        "items array<struct<name:string,mainCategory:string,subCategory:string,"
        "quantity:double,weight:double,photo_url:string>>"
    )
    good = ("x", "m", None, None, None, None)
    sent = requests(
        spark, columns,
        [
            (10, "a", "P", "1", [good, ("", "m", "", 1.0, 1.0, ""), ("y", "m", "s", 2.0, 3.0, "p")]),
            (11, "b", "P", "1", [good]),
            (12, "c", "P", "1", [("n", None, None, None, None, None)]),  # nothing usable
            (13, "d", "", "1", [good]),  # no tracking number
            (14, "d", "P", "1", None),
        ],
    )
    out = packages.items_insert(t, sent)
    new = [r for r in out["items"].orderBy("item_id").collect() if r.item_id > 7]
    assert len({r.item_id for r in new}) == 3
    assert [(r.item_name, r.item_subtype, r.quantity, r.weight, r.item_status) for r in new] == [
        ("x", "", 0.0, 0.0, 0), ("y", "s", 2.0, 3.0, 0), ("x", "", 0.0, 0.0, 0),
    ]
    assert pairs(out["customers"], "customer_id", "status") == [
        ("a", "Warehouse"), ("b", "Unpaid"), ("c", None), ("d", None),
    ]


def test_subbox_insert(spark):
    t = tables(spark, subbox=[{"subbox_id": 4}])
    columns = (
        "seq bigint, box_id string, weight double, width double, b_long double, height double, "
        "img_url string, emp_id string, "
        "items array<struct<item_id:bigint,selectedQuantity:double,remaining_quantity:double>>"
    )
    size = (1.0, 1.0, 1.0, 1.0, None, None)
    out = boxes.subbox_insert(
        t,
        requests(
            spark, columns,
            [(5, "A", *size, [(1, 0.0, 9.0), (2, 3.0, 9.0), (3, None, 9.0)]), (7, "A", *size, [])],
        ),
    )
    assert pairs(out["subbox"], "subbox_id", "box_id") == [(4, None), (5, "A"), (7, "A")]
    assert pairs(out["subbox_item"], "subbox_id", "item_id", "sub_quantity") == [
        (5, 1, 9.0), (5, 2, 3.0), (5, 3, None),
    ]


def test_subbox_tracking_arrays(spark):
    t = tables(spark, subbox=[{"subbox_id": n, "subbox_tracking": "old"} for n in (1, 2, 3)])
    sent = requests(
        spark,
        "seq bigint, subbox_id array<bigint>, subbox_tracking array<string>, "
        "subbox_cost array<double>",
        [(1, [1, 2, 1], ["a", "b"], [1.0, 2.0, 3.0, 4.0]), (0, [2], ["early"], [0.0]),
         (3, [], ["x"], [1.0])],
    )
    out = boxes.subbox_tracking(t, sent)["subbox"]
    assert pairs(out, "subbox_id", "subbox_tracking", F.col("subbox_cost").cast("int")) == [
        (1, None, 3), (2, "b", 2), (3, "old", None),
    ]


def test_box_insert_from_nested_submissions(spark):
    t = tables(
        spark,
        customers=[{"customer_id": "a", "packages": 1}, {"customer_id": "b"}],
        items=[{"item_id": n, "item_status": 0} for n in (1, 2, 3, 4)],
        box=[{"box_id": "b_2024-01-01T00:00:00"}],
    )
    at = dt.datetime(2024, 1, 1)
    sent = requests(
        spark,
        "seq bigint, sender string, recipients bigint, note string, submitted_at timestamp_ntz, "
        "packages array<struct<items:array<struct<item_id:bigint>>>>",
        [
            (1, "a", 1, "n", at, [([(1,), (2,)],), ([],)]),
            (2, "a", 1, "same second", at, [([(3,)],)]),
            (3, "b", 1, "stored", at, [([(4,)],)]),
            (4, "a", 1, "later", at + dt.timedelta(seconds=5), []),
        ],
    )
    out = boxes.box_insert(t, sent, boxes.submission_contents(sent))
    assert pairs(out["box"], "box_id", "box_status") == [
        ("a_2024-01-01T00:00:00", "Ordered"), ("a_2024-01-01T00:00:05", "Ordered"),
        ("b_2024-01-01T00:00:00", None),
    ]
    assert pairs(out["items"], "item_id", "box_id", "item_status") == [
        (1, "a_2024-01-01T00:00:00", 1), (2, "a_2024-01-01T00:00:00", 1), (3, None, 0),
        (4, None, 0),
    ]
    assert pairs(out["customers"], "customer_id", "packages") == [("a", 3), ("b", None)]


_BOX_EDIT = (
    "seq bigint, box_id string, box_status string, bprice double, has_bprice boolean, "
    "discount double, has_discount boolean, customer_id string, has_customer_id boolean, "
    "document string, expires_at timestamp_ntz, has_expires_at boolean"
)


def test_box_edit_branches(spark):
    names = "abcdefgh"
    t = tables(
        spark,
        customers=[{"customer_id": c, "status": "old"} for c in names],
        packages=[{"tracking_number": "P" + c, "customer_id": c} for c in "bdf"],
        items=[{"item_id": n, "tracking_number": "P" + c, "item_status": 0}
               for n, c in enumerate("bd")] + [{"item_id": 9, "tracking_number": "Pf", "item_status": 1}],
        box=[{"box_id": c, "box_status": "Ordered", "document": "doc", "bprice": 1} for c in names],
    )
    at = dt.datetime(2024, 1, 1)
    none = (None, None)
    sent = requests(
        spark, _BOX_EDIT,
        [
            (1, "a", "Packed", 9.0, True, *none, "a", True, None, None, None),
            (2, "a", "Lost", None, None, 3.0, True, "a", True, "x", at, True),  # discount only
            (3, "b", "Process", None, True, 3.0, True, "b", True, "new", at, True),
            (4, "c", "Process", *none, *none, "c", True, None, None, True),
            (5, "d", "Paid", *none, *none, "d", True, None, None, None),
            (6, "e", "Documented", *none, *none, "e", None, None, at, True),  # status only
            (7, "f", "Paid", *none, *none, "f", True, None, None, None),
            (8, "g", "Paid", *none, *none, "g", True, None, None, None),
            (9, "g", None, *none, *none, "g", True, None, None, None),  # not 'Paid': unpaid
            (10, "h", "Packed", 2.0, True, *none, None, None, "d2", None, None),
        ],
    )
    out = boxes.box_edit(t, sent)
    got = {r.box_id: r for r in out["box"].collect()}
    assert (got["a"].box_status, got["a"].discount, got["a"].document) == ("Packed", 3, None)
    assert got["a"].expires_at is None
    assert (got["b"].box_status, got["b"].bprice, got["b"].discount) == ("Process", None, None)
    assert (got["b"].document, got["b"].expires_at) == ("new", at)
    assert (got["c"].box_status, got["c"].document, got["c"].bprice) == ("Process", "doc", 1)
    assert (got["e"].box_status, got["e"].expires_at) == ("Documented", at)
    assert got["g"].box_status is None
    assert pairs(out["customers"], "customer_id", "status") == [
        ("a", "Unpaid"), ("b", "Warehouse"), ("c", "Unpaid"), ("d", "Warehouse"), ("e", "old"),
        ("f", None), ("g", "Unpaid"), ("h", "old"),
    ]


def test_slip_and_address_changes(spark):
    t = tables(spark, slip=[{"slip_id": 3}], addresses=[{"address_id": 2, "email": "e"}])
    new = requests(
        spark, "seq bigint, box_id string, slip_img string, price double, details string, "
        "emp_id string", [(9, "B", "i", 1.5, None, None)],
    )
    assert pairs(boxes.slip_insert(t, new)["slip"], "slip_id", "box_id") == [(3, None), (4, "B")]
    edit = requests(
        spark, "seq bigint, address_id bigint, recipient_name string, phone string, "
        "address string, city string, state string, country string, zipcode string",
        [(1, 2, "n", None, None, None, None, None, None)],
    )
    out = customers.address_edit(t, edit)["addresses"]
    assert pairs(out, "address_id", "recipient_name", "email") == [(2, "n", "e")]


def test_appointments(spark):
    t = tables(spark, appointment=[{"appoint_id": 1, "note": "n", "status": "Pending"}])
    new = requests(
        spark, "seq bigint, title string, pickupdate string, pickupTime string, note string",
        [(1, "a", "2024-12-31", "23:45", None), (2, "b", "2024-13-01", "10:00", None)],
    )
    out = office.appointment_insert(t, new)["appointment"]
    row = out.filter("appoint_id = 2").first()
    assert (row.title, row.customer_id, row.status) == ("a", "a", "Pending")
    assert row.end_date == dt.datetime(2025, 1, 1, 0, 15)
    assert out.count() == 2
    edit = requests(
        spark, "seq bigint, appoint_id bigint, status string, has_status boolean, note string, "
        "address_pickup string, phone_pickup string, name_pickup string, position string, "
        "vehicle string",
        [(1, 1, None, True, "x", *(None,) * 5), (2, 1, "Lost", False, "y", *(None,) * 5)],
    )
    out = office.appointment_edit(t, edit)["appointment"]
    assert pairs(out, "status", "note") == [(None, "y")]


def test_employees(spark):
    t = {
        "employee": spark.createDataFrame(
            [("1", "acme", "n", "acme", "db", "owner", "e", None),
             ("9", "joe", "n", "acme", "db", "staff", "e", None),
             ("3", "zoe", "n", "acme", "db", None, "e", None)],
            "emp_id string, username string, emp_name string, company_name string, "
            "emp_database string, role string, eimg string, emp_date date",
        )
    }
    new = spark.createDataFrame(
        [(4, "9", "new", "n", "staff", "pw"), (6, "77", "ghost", "n", "staff", "pw")],
        "seq bigint, emp_id string, username string, emp_name string, role string, "
        "password string",
    )
    out = office.employee_insert(t, new)["employee"]
    row = out.filter("username = 'new'").first()
    assert (row.emp_id, row.company_name, row.emp_database, row.eimg) == ("10", "acme", "db", None)
    assert out.count() == 4 and "password" not in out.columns
    gone = spark.createDataFrame([("1",), ("9",), ("3",)], "emp_id string")
    assert pairs(office.employee_delete(t, gone)["employee"], "emp_id") == [("1",), ("3",)]


@pytest.mark.parametrize("store", [False, True])
def test_runs_of_different_kinds(spark, store):
    t = tables(
        spark,
        customers=[{"customer_id": "a", "status": "Unpaid", "packages": 0}],
        packages=[{"tracking_number": "P", "customer_id": "a"}],
        items=[{"item_id": 1, "tracking_number": "P", "item_status": 0}],
    )
    sent = requests(
        spark, "seq bigint, sender string, recipients bigint, note string, "
        "submitted_at timestamp_ntz", [(1, "a", 1, None, dt.datetime(2024, 1, 1))],
    )
    contents = requests(spark, "seq bigint, item_id bigint", [(1, 1)])
    box_id = "a_2024-01-01T00:00:00"
    gone = requests(spark, "seq bigint, customer_id string, box_id string", [(2, "a", box_id)])
    item = requests(spark, "seq bigint, customer_id string, item_id bigint", [(3, "a", 1)])

    def add(state, submissions):
        return boxes.box_insert(state, submissions, contents)

    def keep(rows):
        checkpoint_dir(spark)
        return rows.checkpoint()

    runs = [(add, sent), (boxes.box_delete, gone), (packages.item_delete, item)]
    first = apply_runs(t, runs[:2], keep if store else None)
    assert pairs(first["customers"], "status", "packages") == [("Warehouse", 0)]
    assert pairs(first["items"], "item_status", "box_id") == [(0, None)]
    last = apply_runs(t, runs, keep if store else None)
    assert pairs(last["customers"], "status") == [(None,)]
    assert last["items"].count() == 0 and last["box"].count() == 0
