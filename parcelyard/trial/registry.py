"""Every operator and job wired to the driver's test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.functions.collation import any_case, exact_case
from parcelyard.operators import aggregates, joins, lookups, nesting, prefixes
from parcelyard.plans import assets, boxes, customers, office, packages
from parcelyard.plans.kinds import KINDS
from parcelyard.plans.runs import apply_runs
from parcelyard.plans.schedule import cut_levels
from parcelyard.sources import documents, settings
from parcelyard.sources.checkpoints import settle
from parcelyard.trial.tables import TABLES, Tables, raw, tenant_of

AS_OF = dt.date(2024, 1, 15)
INSERTED_AT = "TIMESTAMP_NTZ '2024-03-01 12:00:00'"

Query = Callable[[SparkSession, str], DataFrame]


# Requests and settings bodies with nested values, built from whole test tables.


def _item_requests(t: Tables) -> DataFrame:
    return raw(t.spark, t.sf_dir, "orders").selectExpr(
        f"{tenant_of('o_orderkey')} AS tenant_id",
        "o_orderkey AS seq",
        "CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_custkey AS STRING) "
        "WHEN '2-HIGH' THEN '' END AS customer_id",
        "'TH-' || CAST(o_orderkey AS STRING) AS tracking_number",
        "'7' AS emp_id",
        """array(
            named_struct('item_id', 'N' || CAST(o_orderkey AS STRING) || '-1',
                'name', o_orderstatus, 'mainCategory', o_orderpriority,
                'subCategory', CAST(NULL AS STRING), 'quantity', CAST(NULL AS DOUBLE),
                'weight', o_totalprice, 'photo_url', CAST(NULL AS STRING)),
            named_struct('item_id', 'N' || CAST(o_orderkey AS STRING) || '-2',
                'name', '', 'mainCategory', 'food',
                'subCategory', 'dry', 'quantity', 1D, 'weight', 1D, 'photo_url', 'p'),
            named_struct('item_id', 'N' || CAST(o_orderkey AS STRING) || '-3',
                'name', 'fish', 'mainCategory', CASE WHEN o_orderstatus <> 'F' THEN 'food' END,
                'subCategory', 'dry', 'quantity', 3D, 'weight', CAST(NULL AS DOUBLE),
                'photo_url', 'p')
        ) AS items""",
    )


def _subbox_requests(t: Tables) -> DataFrame:
    return raw(t.spark, t.sf_dir, "orders").selectExpr(
        f"{tenant_of('o_orderkey')} AS tenant_id",
        "o_orderkey AS seq",
        "CAST(o_custkey AS STRING) AS box_id",
        "o_totalprice AS weight",
        "10D AS width",
        "20D AS b_long",
        "30D AS height",
        "o_orderstatus AS img_url",
        "'3' AS emp_id",
        """array(
            named_struct('item_id', 'A' || CAST(o_orderkey AS STRING),
                'selectedQuantity', CASE WHEN o_orderstatus = 'F' THEN 0D ELSE 4D END,
                'remaining_quantity', 9D),
            named_struct('item_id', CASE WHEN o_orderpriority = '5-LOW' THEN 'A' ELSE 'B' END
                    || CAST(o_orderkey AS STRING),
                'selectedQuantity', CASE WHEN o_orderstatus = 'P' THEN 2D END,
                'remaining_quantity', 5D)
        ) AS items""",
    )


def _tracking_requests(t: Tables) -> DataFrame:
    return raw(t.spark, t.sf_dir, "events").selectExpr(
        f"{tenant_of('event_id')} AS tenant_id",
        "event_id AS seq",
        "array(user_id * 10 + 1, user_id * 10 + 2, user_id * 10 + 1) AS subbox_id",
        "array(event_type, props) AS subbox_tracking",
        "array(value, CASE WHEN event_type = 'view' THEN NULL ELSE value + 1 END, value) "
        "AS subbox_cost",
    )


def _added_items(t: Tables) -> DataFrame:
    allocated = t["subbox_item"]
    more = allocated.selectExpr(
        "tenant_id",
        "subbox_id",
        """array(
            named_struct('item_id', item_id, 'quantity', 0D,
                'remaining_quantity', CASE WHEN sub_quantity <> 3 THEN sub_quantity END),
            named_struct('item_id', item_id, 'quantity', 2D, 'remaining_quantity', 0D),
            named_struct('item_id', item_id || '-new', 'quantity', sub_quantity,
                'remaining_quantity', 7D)
        ) AS items""",
    )
    return more


def _edited_items(t: Tables) -> DataFrame:
    return t["subbox_item"].selectExpr(
        "tenant_id",
        "subbox_id",
        """explode(array(
            named_struct('seq', 1, 'items', map(item_id,
                CASE WHEN sub_quantity > 20 THEN 0D ELSE 8D END, 'x' || item_id, 0D, '', 1D)),
            named_struct('seq', 2, 'items', map(item_id,
                CASE WHEN sub_quantity < 5 THEN CAST(NULL AS DOUBLE) ELSE sub_quantity + 1 END))
        )) AS r""",
    ).selectExpr("tenant_id", "subbox_id", "r.seq", "r.items")


def _price_files(t: Tables) -> DataFrame:
    return raw(t.spark, t.sf_dir, "part").selectExpr(
        "'t' || CAST(p_partkey AS STRING) AS tenant_id",
        """to_json(array(
            named_struct('id', p_partkey, 'region', p_name,
                'tiers', array(
                    named_struct('id', 1, 'price', CAST(p_retailprice AS STRING),
                        'quantity', '0.5'),
                    named_struct('id', 2, 'price', p_type,
                        'quantity', CAST(p_size AS STRING))),
                'additional', array(
                    named_struct('id', 1, 'range', CAST(p_size AS STRING) || '-' ||
                        CAST(p_size + 10 AS STRING), 'rate', '250'),
                    named_struct('id', 2, 'range', p_brand, 'rate', CAST(p_size AS STRING)))),
            named_struct('id', p_partkey + 1, 'region', p_brand, 'tiers', array(),
                'additional', array())
        )) AS body""",
    )


def _promotion_files(t: Tables) -> DataFrame:
    return raw(t.spark, t.sf_dir, "part").selectExpr(
        "'t' || CAST(p_partkey AS STRING) AS tenant_id",
        """to_json(array(
            named_struct('id', 1, 'name', p_name, 'discount', CAST(p_size AS STRING) || '%'),
            named_struct('id', 2, 'name', p_type, 'discount', CAST(p_size AS STRING)),
            named_struct('id', 3, 'name', p_brand, 'discount', p_type)
        )) AS body""",
    )


def _warehouse_files(t: Tables) -> DataFrame:
    return raw(t.spark, t.sf_dir, "part").selectExpr(
        "'t' || CAST(p_partkey AS STRING) AS tenant_id",
        """to_json(named_struct(
            'shelves', array(named_struct('id', 1, 'name', p_brand),
                named_struct('id', 2, 'name', p_type)),
            'productCategories', array(named_struct('id', p_size, 'category', p_type,
                'product', p_name)),
            'boxSizes', array(named_struct('id', 1, 'name', p_name, 'width', p_size,
                'length', CAST(p_size + 1 AS STRING), 'height', p_type))
        )) AS body""",
    )


def _dropdown_files(t: Tables) -> DataFrame:
    return raw(t.spark, t.sf_dir, "customer").selectExpr(
        "'t' || CAST(c_custkey AS STRING) AS tenant_id",
        """to_json(named_struct('channels', array(c_mktsegment, c_name),
            'categories', array(c_mktsegment), 'levels', CAST(array() AS array<string>)
        )) AS body""",
    )


def _company_files(t: Tables) -> DataFrame:
    return raw(t.spark, t.sf_dir, "supplier").selectExpr(
        "'t' || CAST(s_suppkey AS STRING) AS tenant_id",
        """to_json(named_struct('companyId', CAST(s_suppkey AS STRING), 'companyName', s_name,
            'taxId', 'x' || CAST(s_nationkey AS STRING), 'address', 'line\\nbreak',
            'phone', '02', 'email', s_name || '@example.com',
            'photo', CASE WHEN s_acctbal > 0 THEN 'logo.png' END)) AS body""",
    )


def _stored_settings(t: Tables) -> DataFrame:
    customer = raw(t.spark, t.sf_dir, "customer")
    region = raw(t.spark, t.sf_dir, "region")
    own = customer.selectExpr("c_name AS tenant_id", "c_mktsegment AS body")
    return own.unionByName(region.selectExpr("r_name AS tenant_id", "'old' AS body"))


def _settings_forms(t: Tables) -> DataFrame:
    return raw(t.spark, t.sf_dir, "customer").selectExpr(
        "c_custkey AS seq",
        "CAST(c_nationkey AS STRING) AS emp_id",
        """'{"companyName":"' || c_name || '"}' AS body""",
    )


def _warehouse_forms(t: Tables) -> DataFrame:
    return raw(t.spark, t.sf_dir, "customer").selectExpr(
        "c_custkey AS seq",
        "CAST(c_nationkey AS STRING) AS emp_id",
        """to_json(named_struct('emp_id', CAST(c_nationkey AS STRING),
            'shelves', array(named_struct('id', c_custkey, 'name', c_name, 'floor', c_nationkey)),
            'note', c_name, 'boxSizes', array(named_struct('width', c_custkey * 2, 'length', c_mktsegment)),
            'limits', named_struct('emp_id', c_custkey, 'open', c_acctbal > 0))) AS body""",
    )


def _warehouse_fields(files: DataFrame) -> DataFrame:
    """Fields of stored forms as they stand in the body, also those of no known layout."""
    paths = {
        "shelf": "$.shelves[0].name",
        "floor": "$.shelves[0].floor",
        "note": "$.note",
        "width": "$.boxSizes[0].width",
        "length": "$.boxSizes[0].length",
        "limit_by": "$.limits.emp_id",
        "is_open": "$.limits.open",
        "sender": "$.emp_id",
    }
    fields = [F.get_json_object("body", path).alias(name) for name, path in paths.items()]
    return files.select("tenant_id", *fields)


def _dropdown_forms(t: Tables) -> DataFrame:
    return raw(t.spark, t.sf_dir, "customer").selectExpr(
        "c_custkey AS seq",
        "CAST(c_nationkey AS STRING) AS emp_id",
        """array(named_struct('name', c_name), named_struct('name', c_mktsegment),
            named_struct('name', c_name)) AS channels""",
        "array(named_struct('name', c_mktsegment), named_struct('name', c_mktsegment)) "
        "AS categories",
        "array(named_struct('name', CAST(c_nationkey AS STRING))) AS levels",
    )


def _staff_of_tenants(t: Tables) -> DataFrame:
    """Staff whose database is one of the test tables' tenants, those of Africa all of one."""
    return t["employee"].selectExpr(
        "emp_id", "CASE WHEN company_name = 'AFRICA' THEN 'east' ELSE 'none' END AS emp_database", "company_name"
    )


def _mixed_log(t: Tables) -> DataFrame:
    """Every event as a request of one of five kinds, in the order of the events."""
    user, body = "CAST(user_id AS STRING)", {
        "customer_warehouse": "'customer_id', {user}, 'warehouse', props",
        "customer_edit": "'old_id', {user}, 'customer_id', {user}, 'contact', props, 'type', event_type, "
        "'note', CASE WHEN value < 20 THEN props END",
        "box_priority": "'box_id', {user}, 'priority', CAST(day(ts) AS INT)",
        "slip_delete": "'slip_id', event_id",
        "customer_insert": "'customer_id', 'E' || CAST(event_id AS STRING), 'contact', props, "
        "'customer_date', CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ)",
    }
    kinds = dict(zip(("view", "click", "purchase", "error", "signup"), body))
    kind = " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in kinds.items())
    sent = " ".join(
        f"WHEN '{e}' THEN to_json(named_struct({body[k].format(user=user)}))" for e, k in kinds.items()
    )
    return raw(t.spark, t.sf_dir, "events").selectExpr(
        f"{tenant_of('event_id')} AS tenant_id",
        "event_id AS seq",
        f"CASE event_type {kind} END AS kind",
        f"CASE event_type {sent} END AS body",
    ).filter("kind IS NOT NULL")


def _after_mixed_log(t: Tables) -> dict[str, DataFrame]:
    touched = {name: t[name] for name in ("customers", "box", "slip")}
    return apply_runs(touched, cut_levels(_mixed_log(t), KINDS), settle)


def _nested_rows(t: Tables) -> DataFrame:
    nested = nesting.subbox_nested(t["subbox"], t["subbox_item"], t["items"])
    return nested.selectExpr(
        "tenant_id",
        "subbox_id",
        "volumetricWeight",
        "item.subbox_item_id",
        "item.item_id",
        "item.sub_quantity",
        "item.adjusted_weight",
    )


def _operator_queries() -> dict[str, Callable[[Tables], DataFrame]]:
    q: dict[str, Callable[[Tables], DataFrame]] = {}
    for name in TABLES:
        q[f"scan_table_{name}"] = lambda t, name=name: t[name]
    q |= {
        "config_price": lambda t: settings.price_tiers(_price_files(t)),
        "config_price_additional": lambda t: settings.price_additional(_price_files(t)),
        "config_promotion": lambda t: settings.promotions(_promotion_files(t)),
        "config_warehouse": lambda t: settings.warehouse_shelves(_warehouse_files(t)),
        "config_warehouse_categories": lambda t: settings.warehouse_categories(
            _warehouse_files(t)
        ),
        "config_warehouse_box_sizes": lambda t: settings.warehouse_box_sizes(
            _warehouse_files(t)
        ),
        "config_dropdown": lambda t: settings.dropdown_values(_dropdown_files(t)),
        "config_company_info": lambda t: settings.company_info(_company_files(t)),
        "config_write": lambda t: settings.replace_settings(
            _stored_settings(t), _settings_forms(t), t["employee"]
        ),
        "config_write_warehouse": lambda t: settings.warehouse_shelves(
            settings.replace_settings(
                _warehouse_files(t), settings.warehouse_body(_warehouse_forms(t)), t["employee"]
            )
        ),
        "mixed_log_customers": lambda t: _after_mixed_log(t)["customers"],
        "mixed_log_box": lambda t: _after_mixed_log(t)["box"],
        "config_write_fields": lambda t: _warehouse_fields(
            settings.replace_settings(
                _warehouse_files(t), settings.warehouse_body(_warehouse_forms(t)), t["employee"]
            )
        ),
        "documents_scan": lambda t: documents.documents_scan(t["text_files"]),
        "log_append": lambda t: office.log_append(t, t["req_log"])["logedit"],
        "customers_by_key": lambda t: lookups.customers_by_key(t["customers"], t["appointment"]),
        "addresses_by_key": lambda t: lookups.addresses_by_key(t["addresses"], t["box"]),
        "addresses_of_customer": lambda t: lookups.addresses_of_customer(
            t["addresses"], t["box"]
        ),
        "unclaimed_packages": lambda t: lookups.unclaimed_packages(t["packages"]),
        "open_items_of_package": lambda t: lookups.open_items_of_package(
            t["items"], lookups.unclaimed_packages(t["packages"])
        ),
        "subbox_by_key": lambda t: lookups.subbox_by_key(t["subbox"], t["subbox_item"]),
        "box_by_key": lambda t: lookups.box_by_key(t["box"], t["slip"]),
        "items_of_box": lambda t: lookups.items_of_box(t["items"], t["slip"]),
        "slips_of_box": lambda t: lookups.slips_of_box(t["slip"], t["box"]),
        "subboxes_of_box": lambda t: lookups.subboxes_of_box(t["subbox"], t["slip"]),
        "pending_appointments": lambda t: lookups.pending_appointments(t["appointment"], AS_OF),
        "company_owner_accounts": lambda t: lookups.company_owner_accounts(t["employee"]),
        "employee_by_key": lambda t: lookups.employee_by_key(t["employee"], t["uploads"]),
        "customer_by_tracking": lambda t: joins.customer_by_tracking(
            t["customers"], t["packages"]
        ),
        "company_staff": lambda t: joins.company_staff(t["employee"], t["uploads"]),
        "fully_packed_packages": lambda t: joins.fully_packed_packages(t["items"]),
        "packages_not_fully_packed": lambda t: joins.packages_not_fully_packed(
            t["packages"], t["items"]
        ),
        "customers_with_open_items": lambda t: joins.customers_with_open_items(
            t["packages"], t["items"]
        ),
        "rows_of_employees": lambda t: joins.rows_of_employees(
            t["packages"], t["req_employee_edit"], _staff_of_tenants(t)
        ),
        "tenant_of_employee": lambda t: joins.tenant_of_employee(
            t["req_employee_edit"].select("seq", "emp_id"), t["employee"]
        ),
        "customer_open_package_counts": lambda t: aggregates.customer_open_package_counts(
            t["customers"], t["packages"], t["items"]
        ),
        "customers_with_open_packages": lambda t: aggregates.customers_with_open_packages(
            t["customers"], t["packages"], t["items"]
        ),
        "customers_by_date": lambda t: aggregates.customers_by_date(t["customers"]),
        "package_item_progress": lambda t: aggregates.package_item_progress(
            t["packages"], t["items"]
        ),
        "package_item_progress_unclaimed": lambda t: aggregates.package_item_progress(
            t["packages"], t["items"], unclaimed=True
        ),
        "remaining_box_items": lambda t: aggregates.remaining_box_items(
            t["items"], t["subbox"], t["subbox_item"]
        ),
        "open_item_count": lambda t: aggregates.open_item_count(t["packages"], t["items"]),
        "subbox_volumetric": lambda t: nesting.subbox_volumetric(t["subbox"]),
        "subbox_item_weights": lambda t: nesting.subbox_item_weights(
            t["subbox_item"], t["items"]
        ),
        "subbox_nested": _nested_rows,
        "box_board": lambda t: nesting.box_board(t["box"]),
        "last_tracking_per_prefix": lambda t: prefixes.last_tracking_per_prefix(
            t["packages"], t["types"]
        ),
        "asset_purge_manifest": lambda t: assets.purge_for_customers(
            t["packages"], t["items"], t["req_customer_delete"]
        ),
        "asset_purge_packages": lambda t: assets.purge_for_packages(
            t["packages"], t["items"], t["req_package_delete"]
        ),
        "asset_purge_items": lambda t: assets.purge_for_items(t["items"], t["req_item_delete"]),
        "asset_keys": lambda t: assets.asset_keys(t["uploads"], t["employee"]),
        "document_names": lambda t: assets.document_names(t["page_files"]),
        "file_prefix_matches": lambda t: prefixes.file_prefix_matches(
            t["stored_files"], t["photo_names"]
        ),
        "file_prefix_first": lambda t: prefixes.file_prefix_matches(
            t["stored_files"], t["photo_names"], "first"
        ),
        "file_exact_matches": lambda t: prefixes.file_prefix_matches(
            t["stored_files"], t["photo_names"], "exact"
        ),
    }
    return q


def _turned(rows: DataFrame, *columns: str) -> DataFrame:
    """Keys in another case than the stored ones."""
    return rows.withColumns({c: F.when(F.length(c) % 2 == 0, F.lower(c)).otherwise(F.upper(c)) for c in columns})


def _any_case_queries() -> dict[str, Callable[[Tables], DataFrame]]:
    """Lookups and joins by text keys, without regard to case."""

    def run(job: Callable[..., DataFrame], *inputs: Callable[[Tables], DataFrame]):
        return lambda t: exact_case(job(*[any_case(make(t)) for make in inputs]))

    def new(name: str, prefix: str, column: str) -> Callable[[Tables], DataFrame]:
        """A table whose numeric keys get letters, so that case matters."""
        return lambda t: t[name].withColumn(column, F.concat(F.lit(prefix), column))

    customers_ = new("customers", "Cust", "customer_id")
    packages_ = new("packages", "Cust", "customer_id")
    box_ = new("box", "Box", "box_id")
    slips = new("slip", "Box", "box_id")
    named = lambda t: _turned(new("appointment", "Cust", "customer_id")(t), "customer_id")
    return {
        "customers_by_key_any_case": run(lookups.customers_by_key, customers_, named),
        "addresses_of_customer_any_case": run(
            lookups.addresses_of_customer, new("addresses", "Cust", "customer_id"), named
        ),
        "box_by_key_any_case": run(lookups.box_by_key, box_, lambda t: _turned(slips(t), "box_id")),
        "slips_of_box_any_case": run(lookups.slips_of_box, slips, lambda t: _turned(box_(t), "box_id")),
        "open_items_of_package_any_case": run(
            lookups.open_items_of_package,
            lambda t: t["items"],
            lambda t: _turned(lookups.unclaimed_packages(t["packages"]), "tracking_number"),
        ),
        "customer_by_tracking_any_case": run(
            joins.customer_by_tracking, customers_, lambda t: _turned(packages_(t), "customer_id")
        ),
        "company_staff_any_case": run(
            joins.company_staff, lambda t: _turned(t["employee"], "company_name"), lambda t: t["req_employee_edit"]
        ),
        "customer_open_package_counts_any_case": run(
            aggregates.customer_open_package_counts,
            customers_,
            lambda t: _turned(packages_(t), "customer_id", "tracking_number"),
            lambda t: t["items"],
        ),
    }


# Name of the job, how to run it, and the tables it changes, main table first.
_JOBS: list[tuple[str, Callable[[Tables], dict[str, DataFrame]], list[str]]] = [
    ("customer_insert", lambda t: customers.customer_insert(t, t["req_customer_insert"], F.expr(INSERTED_AT)),
     ["customers"]),
    ("customer_edit", lambda t: customers.customer_edit(t, t["req_customer_edit"]),
     ["customers"]),
    ("customer_warehouse", lambda t: customers.customer_warehouse(t, t["req_customer_event"]),
     ["customers"]),
    ("customer_address", lambda t: customers.customer_address(t, t["req_customer_event"]),
     ["customers"]),
    ("customer_delete", lambda t: customers.customer_delete(t, t["req_customer_delete"]),
     ["customers", "subbox_item", "subbox", "slip", "items", "packages", "box",
      "appointment", "addresses", "assets"]),
    ("address_insert", lambda t: customers.address_insert(t, t["req_address_insert"]),
     ["addresses"]),
    ("address_edit", lambda t: customers.address_edit(t, t["req_address_edit"]), ["addresses"]),
    ("address_delete", lambda t: customers.address_delete(t, t["req_address_delete"]),
     ["addresses"]),
    ("package_insert", lambda t: packages.package_insert(t, t["req_package_insert"], F.expr(INSERTED_AT)),
     ["packages"]),
    ("package_edit", lambda t: packages.package_edit(t, t["req_package_edit"]), ["packages"]),
    ("package_delete", lambda t: packages.package_delete(t, t["req_package_delete"]),
     ["packages", "items", "customers", "assets"]),
    ("items_insert", lambda t: packages.items_insert(t, _item_requests(t)),
     ["items", "customers"]),
    ("item_edit", lambda t: packages.item_edit(t, t["req_item_edit"]), ["items"]),
    ("item_delete", lambda t: packages.item_delete(t, t["req_item_delete"]),
     ["items", "customers", "assets"]),
    ("subbox_insert", lambda t: boxes.subbox_insert(t, _subbox_requests(t)),
     ["subbox", "subbox_item"]),
    ("subbox_edit", lambda t: boxes.subbox_edit(t, t["req_subbox_event"]), ["subbox"]),
    ("subbox_tracking", lambda t: boxes.subbox_tracking(t, _tracking_requests(t)), ["subbox"]),
    ("subbox_delete", lambda t: boxes.subbox_delete(t, t["req_subbox_delete"]),
     ["subbox", "subbox_item"]),
    ("subbox_item_add", lambda t: boxes.subbox_item_add(t, _added_items(t)), ["subbox_item"]),
    ("subbox_item_edit", lambda t: boxes.subbox_item_edit(t, _edited_items(t)),
     ["subbox_item"]),
    ("box_insert", lambda t: boxes.box_insert(t, t["req_box_insert"], t["req_box_contents"]),
     ["box", "items", "customers"]),
    ("box_edit", lambda t: boxes.box_edit(t, t["req_box_edit"]), ["box", "customers"]),
    ("box_priority", lambda t: boxes.box_priority(t, t["req_box_priority"]), ["box"]),
    ("box_delete", lambda t: boxes.box_delete(t, t["req_box_delete"]),
     ["box", "items", "subbox_item", "subbox", "customers"]),
    ("slip_insert", lambda t: boxes.slip_insert(t, t["req_slip_insert"]), ["slip"]),
    ("slip_delete", lambda t: boxes.slip_delete(t, t["req_slip_delete"]), ["slip"]),
    ("appointment_insert",
     lambda t: office.appointment_insert(t, t["req_appointment_insert"]), ["appointment"]),
    ("appointment_edit", lambda t: office.appointment_edit(t, t["req_appointment_edit"]),
     ["appointment"]),
    ("employee_insert", lambda t: office.employee_insert(t, t["req_employee_insert"]),
     ["employee"]),
    ("employee_edit", lambda t: office.employee_edit(t, t["req_employee_edit"]), ["employee"]),
    ("employee_delete", lambda t: office.employee_delete(t, t["req_employee_delete"]),
     ["employee"]),
]


def _job_queries() -> dict[str, Callable[[Tables], DataFrame]]:
    q: dict[str, Callable[[Tables], DataFrame]] = {}
    for job, run, changed in _JOBS:
        for n, table in enumerate(changed):
            name = f"chg_{job}" if n == 0 else f"chg_{job}_{table}"
            q[name] = lambda t, run=run, table=table: run(t)[table]
    q["chg_dropdown"] = lambda t: settings.dropdown_values(
        settings.replace_settings(
            _dropdown_files(t), settings.dropdown_body(_dropdown_forms(t)), t["employee"]
        )
    )
    return q


def all_queries() -> dict[str, Query]:
    plans = {**_operator_queries(), **_any_case_queries(), **_job_queries()}
    return {
        name: (lambda spark, sf_dir, plan=plan: plan(Tables(spark, sf_dir)))
        for name, plan in plans.items()
    }
