"""Warehouse tables as views over the test tables.

``{name}`` is a test table, ``{ntz}`` the engine's word for a zoneless timestamp and
``{both}`` its expression that repeats a row for each tenant (``{each}(a, b))`` does so
for any values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TRACKING = (
    "CASE {key} % 3 WHEN 0 THEN 'TH-' WHEN 1 THEN 'JP-' ELSE 'US-' END "
    "|| CAST({key} AS STRING)"
)
_ITEM = (
    "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' "
    "|| CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' "
    "|| CAST(CAST(l_shipdate AS DATE) AS STRING) || '-' "
    "|| CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)"
)


def _tracking(key: str) -> str:
    return _TRACKING.replace("{key}", key)


def tenant_of(key: str) -> str:
    """Two tenants share the rows of orders and events; their ids overlap."""
    return f"CASE WHEN {key} % 2 = 0 THEN 'east' ELSE 'west' END"


TABLES: dict[str, str] = {
    "customers": """
        SELECT {both} AS tenant_id, CAST(c_custkey AS STRING) AS customer_id,
               c_name AS customer_name, 'Line' AS contact, c_mktsegment AS type,
               CASE WHEN c_acctbal < 0 THEN 'Classic' WHEN c_acctbal < 5000 THEN 'Silver'
                    ELSE 'Gold' END AS level,
               c_name || ' note' AS note,
               CASE WHEN c_acctbal < 2000 THEN NULL WHEN c_acctbal < 6000 THEN 'Warehouse'
                    ELSE 'Unpaid' END AS status,
               'shelf ' || CAST(c_nationkey AS STRING) AS warehouse,
               c_nationkey AS packages,
               {ntz} '2024-01-01 00:00:00' + INTERVAL '1' DAY * c_nationkey AS customer_date,
               'street ' || CAST(c_custkey AS STRING) AS address,
               'city ' || CAST(c_nationkey AS STRING) AS city,
               'state' AS state, 'Thailand' AS country,
               '10' || CAST(c_nationkey AS STRING) AS zipcode,
               '02-' || CAST(c_custkey AS STRING) AS phone,
               'passport' AS doc_type, 'doc-' || CAST(c_custkey AS STRING) AS doc_url
        FROM {customer}""",
    "addresses": """
        SELECT {both} AS tenant_id, c_custkey AS address_id,
               CAST(c_custkey AS STRING) AS customer_id, c_name AS recipient_name,
               '02-' || CAST(c_custkey AS STRING) AS phone,
               'street ' || CAST(c_custkey AS STRING) AS address,
               'city ' || CAST(c_nationkey AS STRING) AS city, 'state' AS state,
               'Thailand' AS country, '10' || CAST(c_nationkey AS STRING) AS zipcode,
               c_name || '@example.com' AS email
        FROM {customer}""",
    "packages": f"""
        SELECT {tenant_of('o_orderkey')} AS tenant_id, {_tracking('o_orderkey')} AS tracking_number,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                    ELSE CAST(o_custkey AS STRING) END AS customer_id,
               o_totalprice AS packages_cost,
               CASE o_orderpriority
                    WHEN '1-URGENT' THEN 'https://yard.s3.ap.amazonaws.com/main/public/package/'
                         || CAST(o_orderkey AS STRING) || '.webp'
                    WHEN '2-HIGH' THEN 'https://YARD.s3.amazonaws.com/main/box '
                         || CAST(o_orderkey AS STRING) || '.webp'
                    WHEN '3-MEDIUM' THEN 'https://img.example.com/'
                         || CAST(o_orderkey AS STRING) || '.webp'
                    WHEN '4-NOT SPECIFIED' THEN 'no address' ELSE NULL END AS photo_url,
               CAST(month(o_orderdate) AS STRING) AS emp_id, o_orderdate AS Date_create
        FROM {{orders}}""",
    "items": f"""
        SELECT {tenant_of('l_orderkey')} AS tenant_id, {_ITEM} AS item_id,
               {_tracking('l_orderkey')} AS tracking_number,
               'part ' || CAST(l_partkey AS STRING) AS item_name, l_returnflag AS item_type,
               '' AS item_subtype, l_quantity - 1 AS quantity,
               CAST(l_partkey AS DOUBLE) AS weight, 'packer' AS packer_id,
               CASE l_returnflag
                    WHEN 'A' THEN 'https://yard.s3.amazonaws.com/main/public/item/'
                         || CAST(l_orderkey AS STRING) || '.webp'
                    WHEN 'N' THEN 'https://img.example.com/' || CAST(l_orderkey AS STRING)
                    ELSE NULL END AS photo_url,
               CAST(month(l_shipdate) AS STRING) AS emp_id,
               CASE WHEN l_quantity = 50 THEN NULL WHEN l_linestatus = 'F' THEN 1
                    ELSE 0 END AS item_status,
               CASE WHEN l_linestatus = 'F' THEN CAST(l_suppkey AS STRING) END AS box_id
        FROM {{lineitem}}""",
    "box": """
        SELECT {both} AS tenant_id, CAST(s_suppkey AS STRING) AS box_id,
               CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS STRING) AS customer_id,
               s_suppkey AS address_id, s_name AS note,
               CASE WHEN s_nationkey < 5 THEN 'Ordered' WHEN s_nationkey < 10 THEN 'Process'
                    WHEN s_nationkey < 15 THEN 'Packed' WHEN s_nationkey < 20 THEN 'Paid'
                    ELSE 'Documented' END AS box_status,
               CASE WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END AS priority,
               s_acctbal AS bprice, CAST(0 AS DOUBLE) AS discount, 'none' AS document,
               {ntz} '2024-06-01 00:00:00' AS expires_at
        FROM {supplier}""",
    "subbox": f"""
        SELECT DISTINCT {tenant_of('l_orderkey')} AS tenant_id, l_suppkey * 10 + l_linenumber AS subbox_id,
               CAST(l_suppkey AS STRING) AS box_id, CAST(2.5 * l_linenumber AS DOUBLE) AS weight,
               CASE WHEN l_linenumber = 7 THEN NULL
                    ELSE CAST(10 * l_linenumber AS DOUBLE) END AS width,
               CAST(25 AS DOUBLE) AS b_long, CAST(30 AS DOUBLE) AS height,
               'img' AS img_url, '1' AS emp_id, 'none' AS subbox_tracking,
               CAST(0 AS DOUBLE) AS subbox_cost
        FROM {{lineitem}} WHERE l_linestatus = 'F'""",
    "subbox_item": f"""
        SELECT {tenant_of('l_orderkey')} AS tenant_id, l_suppkey * 10 + l_linenumber AS subbox_id,
               {_ITEM} || CASE WHEN l_tax = 0.08 THEN '-x' ELSE '' END AS item_id,
               CASE WHEN l_returnflag = 'A' THEN l_quantity - 1
                    ELSE CAST(floor(l_quantity / 2) AS DOUBLE) END AS sub_quantity
        FROM {{lineitem}} WHERE l_linestatus = 'F' AND l_returnflag <> 'N'""",
    "slip": f"""
        SELECT {tenant_of('event_id')} AS tenant_id, event_id AS slip_id, CAST(user_id AS STRING) AS box_id,
               'slip ' || CAST(event_id AS STRING) AS slip_img, value AS price,
               props AS details, CAST(day(ts) AS STRING) AS emp_id
        FROM {{events}}""",
    "appointment": f"""
        SELECT {tenant_of('event_id')} AS tenant_id, event_id AS appoint_id, CAST(user_id AS STRING) AS title,
               ts AS start_date, ts + INTERVAL '30' MINUTE AS end_date, props AS note,
               CAST(user_id AS STRING) AS customer_id, 'street' AS address_pickup,
               '02' AS phone_pickup, 'name ' || CAST(user_id AS STRING) AS name_pickup,
               'gate' AS position, event_type AS vehicle,
               CASE WHEN event_type = 'purchase' THEN 'Pending' ELSE 'Done' END AS status
        FROM {{events}}""",
    "employee": """
        SELECT CAST(n_nationkey AS STRING) AS emp_id,
               CASE WHEN n_nationkey < 5 THEN r_name ELSE n_name END AS username,
               n_name AS emp_name, r_name AS company_name,
               lower(r_name) || '_db' AS emp_database,
               CASE WHEN n_nationkey < 5 THEN 'owner' WHEN n_nationkey < 23 THEN 'staff'
                    ELSE NULL END AS role,
               'none' AS eimg, '2024-01-01' AS emp_date
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "logedit": f"""
        SELECT {tenant_of('event_id')} AS tenant_id, props AS Detail, event_type AS type,
               CAST(user_id AS STRING) AS emp_id
        FROM {{events}}""",
}

# Change requests and other inputs: every row of a test table is one request.
_EXTRA: dict[str, str] = {
    "req_customer_insert": f"""
        SELECT {tenant_of('s_nationkey')} AS tenant_id, s_suppkey AS seq,
               'N' || CAST(s_suppkey AS STRING) AS customer_id, s_name AS contact,
               'shop' AS type, 'Gold' AS level, s_name AS note,
               CASE WHEN s_nationkey < 12 THEN {{ntz}} '2024-02-01 08:00:00'
                   + INTERVAL '1' DAY * s_nationkey END AS customer_date
        FROM {{supplier}}
        UNION ALL
        SELECT {tenant_of('o_orderkey')}, 1000000 + o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'N' ELSE '' END
               || CAST(o_custkey AS STRING), o_orderpriority, 'order', 'Silver', o_orderstatus, NULL
        FROM {{orders}}""",
    "req_customer_edit": f"""
        SELECT {tenant_of('s_nationkey')} AS tenant_id, s_suppkey AS seq, CAST(s_suppkey AS STRING) AS old_id,
               CASE WHEN s_acctbal < 3000 THEN 'R' || CAST(s_suppkey AS STRING)
                    WHEN s_acctbal < 5000 THEN CAST(s_suppkey + 1 AS STRING)
                    WHEN s_acctbal < 7000 THEN 'S' || CAST(s_nationkey AS STRING)
                    ELSE CAST(s_suppkey AS STRING) END AS customer_id, s_name AS contact,
               'edited' AS type, 'Gold' AS level,
               CASE WHEN s_nationkey < 10 THEN s_name END AS note
        FROM {{supplier}}""",
    "req_customer_event": f"""
        SELECT {tenant_of('event_id')} AS tenant_id, event_id AS seq, CAST(user_id AS STRING) AS customer_id,
               event_type AS warehouse, CAST(day(ts) AS STRING) AS emp_id,
               props AS customer_name, event_type AS address, props AS city,
               'state' AS state, CASE WHEN event_type = 'view' THEN 'Laos' END AS country,
               event_type IN ('view', 'error') AS has_country,
               props AS zipcode, CAST(event_id AS STRING) AS phone,
               event_type AS doc_type, event_type IN ('click', 'signup') AS has_doc_type,
               CASE WHEN event_type = 'click' THEN props END AS doc_url,
               event_type IN ('click', 'view') AS has_doc_url
        FROM {{events}}""",
    "req_customer_delete": f"""
        SELECT {tenant_of('c_nationkey')} AS tenant_id, c_custkey AS seq, CAST(c_custkey AS STRING) AS customer_id
        FROM {{customer}} WHERE c_acctbal < 0""",
    "req_address_insert": f"""
        SELECT {tenant_of('o_orderkey')} AS tenant_id, o_orderkey AS seq, CAST(o_custkey AS STRING) AS customer_id,
               o_orderpriority AS recipient_name, '1' AS phone, o_orderstatus AS address,
               'c' AS city, 's' AS state, 'Laos' AS country, 'z' AS zipcode, 'e' AS email
        FROM {{orders}}""",
    "req_address_edit": f"""
        SELECT {tenant_of('event_id')} AS tenant_id, event_id AS seq, user_id AS address_id,
               event_type AS recipient_name, props AS phone, 'a' AS address, 'c' AS city,
               's' AS state, CASE WHEN event_type = 'view' THEN 'Laos' END AS country,
               'z' AS zipcode
        FROM {{events}}""",
    "req_address_delete": f"""
        SELECT {tenant_of('c_nationkey')} AS tenant_id, c_custkey AS address_id FROM {{customer}}
        WHERE c_acctbal < 0""",
    "req_package_insert": f"""
        SELECT {tenant_of('event_id')} AS tenant_id, event_id AS seq,
               CASE WHEN event_type = 'view' THEN 'TH-' ELSE 'EV-' END
               || CAST(event_id AS STRING) AS tracking_number,
               CASE WHEN event_type = 'error' THEN 'MISSINGITEMS'
                    ELSE CAST(user_id AS STRING) END AS customer_id,
               value AS packages_cost, event_type = 'purchase' AS has_packages_cost,
               props AS photo_url, CAST(day(ts) AS STRING) AS emp_id,
               CASE WHEN event_type <> 'click' THEN ts END AS Date_create
        FROM {{events}}""",
    "req_package_edit": f"""
        SELECT {tenant_of('o_orderkey')} AS tenant_id, o_orderkey AS seq, {_tracking('o_orderkey')} AS old_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'RE' || {_tracking('o_orderkey')}
                    WHEN o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P'
                    THEN {_tracking('(o_orderkey + 2)')}
                    WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P'
                    THEN 'ONE-' || CAST(o_custkey AS STRING)
                    ELSE {_tracking('o_orderkey')} END AS tracking_number,
               CASE o_orderstatus WHEN 'F' THEN '' WHEN 'P' THEN 'MISSINGITEMS'
                    ELSE CAST(o_custkey AS STRING) END AS customer_id,
               o_orderpriority AS photo_url
        FROM {{orders}}""",
    "req_package_delete": f"""
        SELECT {tenant_of('o_orderkey')} AS tenant_id, o_orderkey AS seq,
               {_tracking('o_orderkey')} AS tracking_number,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL
                    ELSE CAST(o_custkey AS STRING) END AS customer_id
        FROM {{orders}} WHERE o_orderstatus <> 'P'""",
    "req_item_edit": f"""
        SELECT {tenant_of('l_orderkey')} AS tenant_id, l_orderkey AS seq, {_ITEM} AS item_id,
               CASE WHEN l_discount = 0 THEN '' ELSE 'edited' END AS item_name,
               l_linestatus AS item_type, l_returnflag AS item_subtype,
               l_extendedprice AS quantity, l_discount AS weight,
               CASE WHEN l_tax = 0 THEN NULL ELSE 'photo' END AS photo_url
        FROM {{lineitem}} WHERE l_returnflag = 'R'""",
    "req_item_delete": f"""
        SELECT {tenant_of('l_orderkey')} AS tenant_id, l_orderkey * 100 + l_linenumber AS seq, {_ITEM} AS item_id,
               CASE WHEN l_tax = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS customer_id
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'R' OR o_orderstatus <> 'P'""",
    "req_subbox_event": f"""
        SELECT {tenant_of('event_id')} AS tenant_id, event_id AS seq,
               user_id * 10 + 1 + CASE WHEN value < 20 THEN 1 ELSE 0 END AS subbox_id,
               value AS weight, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS width,
               value AS b_long, value AS height, props AS img_url
        FROM {{events}}""",
    "req_subbox_delete": f"""
        SELECT DISTINCT {tenant_of('l_orderkey')} AS tenant_id, l_suppkey * 10 + l_linenumber AS subbox_id
        FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey WHERE s_acctbal < 2000""",
    "req_box_insert": f"""
        SELECT {tenant_of('o_orderkey')} AS tenant_id, o_orderkey AS seq, CAST(o_custkey AS STRING) AS sender,
               o_orderkey AS recipients, o_orderpriority AS note, o_orderdate AS submitted_at
        FROM {{orders}}""",
    "req_box_contents": f"""
        SELECT {tenant_of('l_orderkey')} AS tenant_id, l_orderkey AS seq, {_ITEM} AS item_id
        FROM {{lineitem}} WHERE l_linestatus = 'O'""",
    "req_box_edit": f"""
        SELECT {tenant_of('event_id')} AS tenant_id, event_id AS seq, CAST(user_id AS STRING) AS box_id,
               CASE WHEN value < 5 THEN 'Packed' WHEN value < 15 THEN 'Paid'
                    WHEN value < 30 THEN 'Process' ELSE 'Documented' END AS box_status,
               value AS bprice, event_type = 'purchase' AS has_bprice,
               value AS discount, event_type IN ('click', 'purchase') AS has_discount,
               CASE WHEN value < 1 THEN NULL ELSE CAST(user_id + 1 AS STRING) END AS customer_id,
               event_type IN ('view', 'click', 'purchase') AS has_customer_id,
               CASE WHEN value > 20 THEN props END AS document,
               CASE WHEN value > 8 THEN ts END AS expires_at,
               event_type = 'error' OR value > 25 AS has_expires_at
        FROM {{events}}""",
    "req_box_priority": f"""
        SELECT {tenant_of('event_id')} AS tenant_id, event_id AS seq, CAST(user_id AS STRING) AS box_id,
               CASE WHEN event_type = 'error' THEN NULL ELSE CAST(day(ts) AS INT) END AS priority
        FROM {{events}}""",
    "req_box_delete": f"""
        SELECT {tenant_of('s_nationkey')} AS tenant_id, s_suppkey AS seq, CAST(s_suppkey AS STRING) AS box_id,
               CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS STRING) AS customer_id
        FROM {{supplier}} WHERE s_acctbal < 6000""",
    "req_slip_insert": f"""
        SELECT {tenant_of('o_orderkey')} AS tenant_id, o_orderkey AS seq, CAST(o_custkey AS STRING) AS box_id,
               o_orderstatus AS slip_img, o_totalprice AS price, o_orderpriority AS details,
               CAST(month(o_orderdate) AS STRING) AS emp_id
        FROM {{orders}}""",
    "req_slip_delete": f"""
        SELECT {tenant_of('event_id')} AS tenant_id, event_id AS slip_id FROM {{events}}
        WHERE event_type = 'error'""",
    "req_appointment_insert": f"""
        SELECT {tenant_of('o_orderkey')} AS tenant_id, o_orderkey AS seq, CAST(o_custkey AS STRING) AS title,
               CAST(CAST(o_orderdate AS DATE) AS STRING) AS pickupdate,
               CASE WHEN o_orderstatus = 'F' THEN '23:45' ELSE '09:30' END AS pickupTime,
               o_orderpriority AS note, 'street' AS address_pickup, '02' AS phone_pickup,
               'name' AS name_pickup, 'gate' AS position, 'car' AS vehicle
        FROM {{orders}}""",
    "req_appointment_edit": f"""
        SELECT {tenant_of('event_id')} AS tenant_id, event_id * 2 AS seq, event_id AS appoint_id,
               CASE WHEN value > 10 THEN 'Done' END AS status,
               event_type IN ('click', 'view') AS has_status,
               'n' AS note, 'a' AS address_pickup, 'p' AS phone_pickup, 'm' AS name_pickup,
               'q' AS position, 'v' AS vehicle
        FROM {{events}}
        UNION ALL
        SELECT {tenant_of('event_id')}, event_id * 2 + 1, event_id, 'Pending',
               event_type IN ('view', 'error'), props, CASE WHEN value > 10 THEN 'b' END,
               'p', 'm', 'q', event_type
        FROM {{events}}""",
    "req_employee_insert": """
        SELECT c_custkey AS seq, CAST(c_nationkey AS STRING) AS emp_id, c_name AS username,
               c_name || ' name' AS emp_name, c_mktsegment AS role, '2024-02-02' AS emp_date
        FROM {customer}""",
    "req_employee_edit": """
        SELECT c_custkey AS seq, CAST(c_nationkey AS STRING) AS emp_id, c_name AS username,
               c_name || ' name' AS emp_name, c_mktsegment AS role
        FROM {customer}""",
    "req_employee_delete": """
        SELECT CAST(c_nationkey AS STRING) AS emp_id FROM {customer} WHERE c_acctbal < 0""",
    "req_log": f"""
        SELECT {tenant_of('conv_id')} AS tenant_id, text AS Detail, role AS type,
               CAST(conv_id AS STRING) AS emp_id
        FROM {{conversations}}""",
    "uploads": """
        SELECT event_id AS upload_id, CAST(day(ts) - 1 AS STRING) AS emp_id,
               CASE event_type WHEN 'view' THEN 'package' WHEN 'click' THEN 'item'
                    WHEN 'error' THEN 'item' ELSE 'verify' END AS kind,
               CASE event_type WHEN 'view' THEN 'tmp/photo.' || CAST(user_id AS STRING) || '.jpg'
                    WHEN 'click' THEN '.hidden' WHEN 'error' THEN 'plain'
                    ELSE 'a.b.png' END AS original_name,
               CASE WHEN event_type = 'error' THEN NULL WHEN value < 5 THEN 'noext'
                    ELSE 'item ' || CAST(user_id AS STRING) || '.v1.png' END AS file_name,
               event_id * 1000 AS at_ms
        FROM {events}""",
    "stored_files": f"""
        SELECT {tenant_of('event_id')} AS tenant_id, CAST(user_id AS STRING) || '_' || CAST(event_id AS STRING)
               || '.webp' AS file_name
        FROM {{events}}""",
    "photo_names": f"""
        SELECT {{both}} AS tenant_id, CAST(c_custkey AS STRING) || '_' AS photo_name
        FROM {{customer}}
        UNION ALL
        SELECT {tenant_of('event_id')}, CAST(user_id AS STRING) || '_' || CAST(event_id AS STRING) || '.webp'
        FROM {{events}} WHERE event_type = 'click'""",
    "page_files": "SELECT page_id, url AS file_name FROM {pages}",
    "text_files": """
        SELECT source || '_' || CAST(doc_id AS STRING) || '.txt' AS file_name, text AS value
        FROM {documents}""",
    "types": f"""
        SELECT DISTINCT {tenant_of('o_orderkey')} AS tenant_id,
               {{each}}(left({_tracking('o_orderkey')}, 2), left({_tracking('o_orderkey')}, 1),
                   '_' || substring({_tracking('o_orderkey')}, 2, 2),
                   left({_tracking('o_orderkey')}, 1) || '%-', o_orderpriority,
                   left({_tracking('o_orderkey')}, 1) || chr(92)
                       || substring({_tracking('o_orderkey')}, 2, 2))) AS type
        FROM {{orders}}""",
}

VIEWS: dict[str, str] = {**TABLES, **_EXTRA}

SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace("{ntz}", "TIMESTAMP_NTZ")
    text = text.replace("{both}", "{each}('east', 'west'))").replace("{each}", "explode(array")
    used = {s: raw(spark, sf_dir, s) for s in SOURCES if "{" + s + "}" in text}
    return spark.sql(text, **used)


def duckdb_view(name: str) -> str:
    text = VIEWS[name].replace("{ntz}", "TIMESTAMP")
    text = text.replace("{both}", "{each}('east', 'west'))")
    text = text.replace("{each}", "unnest(list_value")
    for source in SOURCES:
        text = text.replace("{" + source + "}", source)
    return text


class Tables(dict):
    """Warehouse tables and requests, each planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = view(self.spark, self.sf_dir, name)
        return self[name]
