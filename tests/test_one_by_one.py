"""A batch must end in the state that its requests reach one after another.

Every random case is a tenant of its own, so one Spark run checks all of them and
also that tenants never mix.
"""

import random

from parcelyard.plans import boxes, customers, packages
from rows import pairs, table

CASES = 150


def _world(seed):
    r = random.Random(seed)
    customers = {f"c{n}": {"status": r.choice([None, "Warehouse", "Unpaid"]), "packages": n}
                 for n in range(3)}
    owner = {f"p{n}": r.choice([None, "c0", "c1", "c2"]) for n in range(5)}
    box = {f"b{n}": {"customer_id": r.choice([None, "c0", "c1", "c2"]),
                     "box_status": r.choice(["Packed", "Packed", "Paid", None])}
           for n in range(4)}
    items = {
        n: {"tracking_number": r.choice([*owner, None]), "item_status": r.choice([0, 1, 1, None]),
            "box_id": r.choice([*box, None])}
        for n in range(8)
    }
    return r, customers, owner, items, box


def _load(spark, worlds):
    def rows(part):
        return [{"tenant_id": str(t), **row} for t, w in enumerate(worlds) for row in part(w)]

    return {
        "customers": table(spark, "customers", rows(
            lambda w: [{"customer_id": c, **v} for c, v in w[1].items()])),
        "packages": table(spark, "packages", rows(
            lambda w: [{"tracking_number": p, "customer_id": c} for p, c in w[2].items()])),
        "items": table(spark, "items", rows(
            lambda w: [{"item_id": i, **v} for i, v in w[3].items()])),
        "box": table(spark, "box", rows(
            lambda w: [{"box_id": b, **v} for b, v in w[4].items()])),
        "subbox": table(spark, "subbox", []),
        "subbox_item": table(spark, "subbox_item", []),
    }


def _has_open(world, customer):
    _, _, owner, items, _ = world
    return any(
        i["item_status"] == 0 and i["tracking_number"] is not None
        and owner.get(i["tracking_number"]) == customer
        for i in items.values()
    )


def _clear(world, customer):
    if customer and customer in world[1] and not _has_open(world, customer):
        if world[1][customer]["status"] not in (None, "Unpaid"):
            world[1][customer]["status"] = None


def _expected(worlds, part):
    out = [(str(t), *row) for t, w in enumerate(worlds) for row in part(w)]
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def _customers(worlds):
    return _expected(worlds, lambda w: [(c, v["status"]) for c, v in w[1].items()])


def _requests(spark, columns, logs):
    rows = [(str(t), *row) for t, log in enumerate(logs) for row in log]
    return spark.createDataFrame(rows, f"tenant_id string, {columns}")


def test_item_delete(spark):
    worlds = [_world(n) for n in range(CASES)]
    tables = _load(spark, worlds)
    logs = []
    for w in worlds:
        r = w[0]
        log = [(s, r.choice(["c0", "c1", "c2", "zz", "", None]), r.randrange(9))
               for s in range(r.randrange(1, 9))]
        logs.append(log)
        for _, customer, item in log:
            w[3].pop(item, None)
            _clear(w, customer)
    sent = _requests(spark, "seq bigint, customer_id string, item_id bigint", logs)
    out = packages.item_delete(tables, sent)
    assert pairs(out["customers"], "tenant_id", "customer_id", "status") == _customers(worlds)
    assert pairs(out["items"], "tenant_id", "item_id") == _expected(
        worlds, lambda w: [(i,) for i in w[3]]
    )


def test_package_delete(spark):
    worlds = [_world(1000 + n) for n in range(CASES)]
    tables = _load(spark, worlds)
    logs = []
    for w in worlds:
        r = w[0]
        log = [(s, r.choice(["c0", "c1", "c2", "", None]), r.choice(["p0", "p1", "p2", "p3", "p9"]))
               for s in range(r.randrange(1, 6))]
        logs.append(log)
        for _, customer, package in log:
            for item in [i for i, v in w[3].items() if v["tracking_number"] == package]:
                del w[3][item]
            w[2].pop(package, None)
            _clear(w, customer)
    sent = _requests(spark, "seq bigint, customer_id string, tracking_number string", logs)
    out = packages.package_delete(tables, sent)
    assert pairs(out["customers"], "tenant_id", "customer_id", "status") == _customers(worlds)
    assert pairs(out["items"], "tenant_id", "item_id") == _expected(
        worlds, lambda w: [(i,) for i in w[3]]
    )
    assert pairs(out["packages"], "tenant_id", "tracking_number") == _expected(
        worlds, lambda w: [(p,) for p in w[2]]
    )


def test_box_delete(spark):
    worlds = [_world(2000 + n) for n in range(CASES)]
    tables = _load(spark, worlds)
    logs = []
    for w in worlds:
        r = w[0]
        log = [(s, r.choice(["c0", "c1", "c2"]), r.choice(["b0", "b1", "b2", "b3", "b9"]))
               for s in range(r.randrange(1, 5))]
        logs.append(log)
        for _, customer, box in log:
            for v in w[3].values():
                if v["box_id"] == box:
                    v["item_status"], v["box_id"] = 0, None
            w[4].pop(box, None)
            w[1][customer]["packages"] -= 1
            packed = any(b["customer_id"] == customer and b["box_status"] == "Packed"
                         for b in w[4].values())
            if not packed:
                w[1][customer]["status"] = "Warehouse" if _has_open(w, customer) else None
    sent = _requests(spark, "seq bigint, customer_id string, box_id string", logs)
    out = boxes.box_delete(tables, sent)
    assert pairs(out["customers"], "tenant_id", "customer_id", "status", "packages") == _expected(
        worlds, lambda w: [(c, v["status"], v["packages"]) for c, v in w[1].items()]
    )
    assert pairs(out["items"], "tenant_id", "item_id", "item_status", "box_id") == _expected(
        worlds, lambda w: [(i, v["item_status"], v["box_id"]) for i, v in w[3].items()]
    )
    assert pairs(out["box"], "tenant_id", "box_id") == _expected(
        worlds, lambda w: [(b,) for b in w[4]]
    )


def test_box_edit(spark):
    missing = object()
    worlds = [_world(3000 + n) for n in range(CASES)]
    tables = _load(spark, worlds)
    logs = []
    for w in worlds:
        r = w[0]
        for b in w[4].values():
            b.update(bprice=None, discount=None, document=None)
        log = []
        for s in range(r.randrange(1, 6)):
            box = r.choice(["b0", "b1", "b2", "b3", "b9"])
            status = r.choice(["Packed", "Paid", "Process", None])
            price = r.choice([missing, missing, None, float(s)])
            discount = r.choice([missing, missing, None, float(s)])
            customer = r.choice([missing, None, "c0", "c1", "c2"])
            document = r.choice([None, f"d{s}"])
            log.append((
                s, box, status, None if price is missing else price, price is not missing,
                None if discount is missing else discount, discount is not missing,
                None if customer is missing else customer, customer is not missing, document,
                None, False,
            ))
            row = w[4].get(box, {})
            unpaid = None
            if price is not missing:
                row.update(box_status=status, bprice=price, document=document)
                unpaid = status == "Packed"
            elif discount is not missing:
                row.update(discount=discount)
            else:
                row.update(box_status=status)
                if customer is not missing:
                    unpaid = status != "Paid"
            if unpaid is not None and customer in w[1]:
                w[1][customer]["status"] = (
                    "Unpaid" if unpaid else "Warehouse" if _has_open(w, customer) else None
                )
        logs.append(log)
    sent = _requests(
        spark,
        "seq bigint, box_id string, box_status string, bprice double, has_bprice boolean, "
        "discount double, has_discount boolean, customer_id string, has_customer_id boolean, "
        "document string, expires_at timestamp_ntz, has_expires_at boolean",
        logs,
    )
    out = boxes.box_edit(tables, sent)
    assert pairs(out["customers"], "tenant_id", "customer_id", "status") == _customers(worlds)
    got = out["box"].selectExpr(
        "tenant_id", "box_id", "box_status", "CAST(bprice AS DOUBLE) AS bprice",
        "CAST(discount AS DOUBLE) AS discount", "document",
    )
    assert pairs(got, *got.columns) == _expected(
        worlds,
        lambda w: [(b, v["box_status"], v["bprice"], v["discount"], v["document"])
                   for b, v in w[4].items()],
    )


def test_subbox_items(spark):
    added, edited, add_logs, edit_logs, base = [], [], [], [], []
    for n in range(CASES):
        r = random.Random(4000 + n)
        start = {(s, i): r.choice([None, 0.0, 2.0, 5.0])
                 for s in range(2) for i in range(3) if r.random() < 0.6}
        base += [{"tenant_id": str(n), "subbox_id": s, "item_id": i, "sub_quantity": q}
                 for (s, i), q in start.items()]
        state, log = dict(start), []
        for _ in range(r.randrange(1, 5)):
            subbox = r.randrange(2)
            entries = [(r.randrange(3), r.choice([0.0, 1.0, 4.0, None]), r.choice([None, 3.0]))
                       for _ in range(r.randrange(1, 4))]
            log.append((subbox, entries))
            for item, quantity, rest in entries:
                q = rest if quantity == 0 else quantity
                key = subbox, item
                if key not in state:
                    state[key] = q
                else:
                    state[key] = None if None in (state[key], q) else state[key] + q
        added.append(state)
        add_logs.append(log)
        state, log = dict(start), []
        for seq in range(r.randrange(1, 5)):
            subbox = r.randrange(2)
            entries = {r.randrange(3): r.choice([0.0, 7.0, None, float(seq + 1)]) for _ in range(2)}
            log.append((seq, subbox, entries))
            for item, q in entries.items():
                if (subbox, item) in state:
                    if q == 0:
                        del state[(subbox, item)]
                    else:
                        state[(subbox, item)] = q
        edited.append(state)
        edit_logs.append(log)
    tables = {"subbox_item": table(spark, "subbox_item", base)}

    def want(states):
        return _expected(states, lambda s: [(*k, q) for k, q in s.items()])

    columns = "tenant_id", "subbox_id", "item_id", "sub_quantity"
    sent = _requests(
        spark, "subbox_id bigint, "
        "items array<struct<item_id:bigint,quantity:double,remaining_quantity:double>>", add_logs)
    assert pairs(boxes.subbox_item_add(tables, sent)["subbox_item"], *columns) == want(added)
    sent = _requests(spark, "seq bigint, subbox_id bigint, items map<bigint,double>", edit_logs)
    assert pairs(boxes.subbox_item_edit(tables, sent)["subbox_item"], *columns) == want(edited)


def test_customer_edit_with_renames(spark):
    """Renames onto stored, claimed and free names; what a batch must refuse to guess is left out."""
    worlds, logs = [], []
    for n in range(4 * CASES):
        r = random.Random(5000 + n)
        state = {f"c{k}": None for k in range(4)}
        start, log = dict(state), []
        moved, given, freed = set(), set(), set()
        for seq in range(r.randrange(1, 9)):
            old = r.choice(["c0", "c1", "c2", "c3", "x", "y"])
            new = r.choice([old, old, "c0", "c1", "x", "y", "z"])
            # Not guessed: a row addressed after its rename, and a stored name that was freed.
            if old in moved | given or (new != old and old in start and new in start and new in freed):
                continue
            log.append((seq, old, new, f"n{seq}"))
            if new != old and old in start and new not in start:
                freed.add(old)
            if old not in state or (new != old and new in state):
                continue
            if new != old:
                moved.add(old)
                given.add(new)
                del state[old]
            state[new] = f"n{seq}"
        # An edit of a name that a later request gives away is not guessed either.
        if any(old in given for _, old, new, _ in log):
            log, state = [], dict(start)
        worlds.append((r, state))
        logs.append(log)
    base = table(spark, "customers", [
        {"tenant_id": str(t), "customer_id": f"c{k}"} for t in range(len(worlds)) for k in range(4)])
    sent = spark.createDataFrame(
        [(str(t), *row, None, None, None) for t, log in enumerate(logs) for row in log],
        "tenant_id string, seq bigint, old_id string, customer_id string, note string, "
        "contact string, type string, level string")
    out = customers.customer_edit({"customers": base}, sent)["customers"]
    assert pairs(out, "tenant_id", "customer_id", "note") == _expected(
        worlds, lambda w: list(w[1].items()))
    assert sum(len(log) > 3 for log in logs) > 100
