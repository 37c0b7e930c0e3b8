"""DuckDB SQL for every registered query.

Only the table and request views are shared with Spark. Sub-queries, windows and
per-column scans here stand against joins and folds over there.
"""

from __future__ import annotations

import re

from parcelyard.trial.tables import TABLES, VIEWS, duckdb_view, tenant_of

_NAMES = sorted(VIEWS, key=len, reverse=True)


def _with_views(body: str) -> str:
    """Put the views a body names before it; a leading comma continues their list."""
    used = [n for n in _NAMES if re.search(rf"\b{n}\b", body)]
    if not used:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({duckdb_view(n)})" for n in used) + "\n" + body


def _scope(request: str) -> str:
    """The employee directory is shared by all tenants."""
    return "" if "employee" in request else "tenant_id, "


def _same(request: str, left: str, right: str) -> str:
    return "" if "employee" in request else f"{left}.tenant_id = {right}.tenant_id AND "


def _last(request: str, key: str, condition: str = "TRUE") -> str:
    return (
        f"(SELECT * FROM {request} WHERE {condition} "
        f"QUALIFY row_number() OVER (PARTITION BY {_scope(request)}{key} ORDER BY seq DESC) = 1)"
    )


def _update(
    table: str, request: str, key: str, columns: str, request_key: str = "",
    condition: str = "TRUE",
) -> str:
    """Every column written by the last request of the key."""
    request_key = request_key or key
    new = ", ".join(
        f"CASE WHEN f.{request_key} IS NOT NULL THEN f.{c} ELSE b.{c} END AS {c}"
        for c in columns.split()
    )
    return (
        f"SELECT b.* REPLACE ({new}) FROM {table} b "
        f"LEFT JOIN {_last(request, request_key, condition)} f "
        f"ON {_same(request, 'b', 'f')}b.{key} = f.{request_key}"
    )


def _renamed(table: str, request: str, key: str) -> str:
    """The requests that keep their key, or take one that no row and no earlier request has."""
    return f""", arrivals AS (
            SELECT r.*, EXISTS (SELECT 1 FROM {table} b
                WHERE b.tenant_id = r.tenant_id AND b.{key} = r.{key}) AS taken,
                EXISTS (SELECT 1 FROM {table} b
                WHERE b.tenant_id = r.tenant_id AND b.{key} = r.old_id) AS stored
            FROM {request} r),
        allowed AS (
            SELECT * FROM arrivals WHERE {key} = old_id
            UNION ALL
            (SELECT * FROM arrivals WHERE {key} <> old_id AND stored AND NOT taken
             QUALIFY rank() OVER (PARTITION BY tenant_id, {key} ORDER BY seq) = 1)) """


# The rule by counting: a package is packed if it has a known status and no known
# status other than 1; every other package is open.
_OPEN_PACKAGES = """, statuses AS (
            SELECT tenant_id, tracking_number, count(item_status) AS known,
                count(*) FILTER (WHERE item_status <> 1) AS others
            FROM items GROUP BY tenant_id, tracking_number),
        packed AS (SELECT tenant_id, tracking_number FROM statuses WHERE known > 0 AND others = 0),
        open_packages AS (SELECT * FROM packages p WHERE 0 = (SELECT count(*) FROM packed k
            WHERE k.tenant_id = p.tenant_id AND k.tracking_number = p.tracking_number))"""
_NUMBER = (
    "CAST('0' || regexp_extract(tracking_number, CASE WHEN contains(tracking_number, '-') "
    "THEN '^[^-]*-([0-9]*)' ELSE '^([0-9]*)' END, 1) AS HUGEINT)"
)


def _object_key(url: str) -> str:
    return (
        f"nullif(regexp_extract(replace({url}, ' ', '%20'), "
        r"'^https?://[^/]*\.amazonaws\.com/(.*)$', 1), '')"
    )


_CLOSED_BOXES = (
    "SELECT (tenant_id, box_id) FROM box WHERE (tenant_id, customer_id) IN (SELECT (tenant_id, customer_id) FROM req_customer_delete)"
)
_CLOSED_PACKAGES = (
    "SELECT (tenant_id, tracking_number) FROM packages "
    "WHERE (tenant_id, customer_id) IN (SELECT (tenant_id, customer_id) FROM req_customer_delete)"
)
_GONE_BOXES = "SELECT (tenant_id, box_id) FROM req_box_delete"

_PART = "'t' || CAST(p_partkey AS VARCHAR)"

_NUMBERED = (
    "(SELECT coalesce(max({id}), 0) FROM {table} b WHERE b.tenant_id = r.tenant_id) + 1 + seq "
    "- (SELECT min(seq) FROM {request} q WHERE q.tenant_id = r.tenant_id)"
)


def _numbered(key: str, table: str, request: str) -> str:
    return _NUMBERED.format(id=key, table=table, request=request)


def _purge(kind: str, identity: str, table: str, condition: str) -> str:
    return (
        f"SELECT tenant_id, '{kind}' AS kind, {identity} AS ref, "
        f"{_object_key('photo_url')} AS object_key FROM {table} "
        f"WHERE {_object_key('photo_url')} IS NOT NULL AND {condition}"
    )


_OPERATORS: dict[str, str] = {
    "config_price": f"""
        SELECT {_PART} AS tenant_id, p_partkey AS region_id, p_name AS region,
               CAST(1 AS BIGINT) AS tier_id, CAST(0.5 AS DOUBLE) AS quantity,
               p_retailprice AS price FROM part
        UNION ALL
        SELECT {_PART}, p_partkey, p_name, 2, CAST(p_size AS DOUBLE), NULL FROM part""",
    "config_price_additional": f"""
        SELECT {_PART} AS tenant_id, p_partkey AS region_id, p_name AS region,
               CAST(1 AS BIGINT) AS additional_id,
               CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 10 AS VARCHAR) AS range,
               CAST(p_size AS DOUBLE) AS range_low, CAST(p_size + 10 AS DOUBLE) AS range_high,
               CAST(250 AS DOUBLE) AS rate FROM part
        UNION ALL
        SELECT {_PART}, p_partkey, p_name, 2, p_brand, NULL, NULL, CAST(p_size AS DOUBLE)
        FROM part""",
    "config_promotion": f"""
        SELECT {_PART} AS tenant_id, CAST(1 AS BIGINT) AS promotion_id, p_name AS name,
               CAST(p_size AS VARCHAR) || '%' AS discount, CAST(NULL AS DOUBLE) AS amount,
               CAST(p_size AS DOUBLE) AS percent FROM part
        UNION ALL
        SELECT {_PART}, 2, p_type, CAST(p_size AS VARCHAR), CAST(p_size AS DOUBLE), NULL
        FROM part
        UNION ALL
        SELECT {_PART}, 3, p_brand, p_type, NULL, NULL FROM part""",
    "config_warehouse": f"""
        SELECT {_PART} AS tenant_id, CAST(1 AS BIGINT) AS shelf_id, p_brand AS name FROM part
        UNION ALL SELECT {_PART}, 2, p_type FROM part""",
    "config_warehouse_categories": f"""
        SELECT {_PART} AS tenant_id, CAST(p_size AS BIGINT) AS category_id,
               p_type AS category, p_name AS product FROM part""",
    "config_warehouse_box_sizes": f"""
        SELECT {_PART} AS tenant_id, CAST(1 AS BIGINT) AS size_id, p_name AS name,
               CAST(p_size AS DOUBLE) AS width, CAST(p_size + 1 AS DOUBLE) AS length,
               CAST(NULL AS DOUBLE) AS height FROM part""",
    "config_dropdown": """
        SELECT 't' || CAST(c_custkey AS VARCHAR) AS tenant_id, 'channels' AS list,
               CAST(0 AS INTEGER) AS pos, c_mktsegment AS value FROM customer
        UNION ALL SELECT 't' || CAST(c_custkey AS VARCHAR), 'channels', 1, c_name FROM customer
        UNION ALL SELECT 't' || CAST(c_custkey AS VARCHAR), 'categories', 0, c_mktsegment
        FROM customer""",
    "config_company_info": """
        SELECT 't' || CAST(s_suppkey AS VARCHAR) AS tenant_id,
               CAST(s_suppkey AS VARCHAR) AS companyId, s_name AS companyName,
               'x' || CAST(s_nationkey AS VARCHAR) AS taxId,
               'line' || chr(10) || 'break' AS address, '02' AS phone,
               s_name || '@example.com' AS email,
               CASE WHEN s_acctbal > 0 THEN 'logo.png' END AS photo FROM supplier""",
    "config_write": """
        SELECT tenant_id, body FROM (
            SELECT c_name AS tenant_id, c_mktsegment AS body FROM customer
            UNION ALL SELECT r_name, 'old' FROM region) old
        WHERE tenant_id NOT IN (SELECT company_name FROM employee
            WHERE emp_id IN (SELECT emp_id FROM req_employee_edit))
        UNION ALL
        SELECT company_name, '{"companyName":"' || username || '"}' FROM (
            SELECT r.username, r.seq, e.company_name
            FROM req_employee_edit r JOIN employee e ON r.emp_id = e.emp_id)
        QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY seq DESC) = 1""",
    "config_write_warehouse": f"""
        SELECT {_PART} AS tenant_id, CAST(1 AS BIGINT) AS shelf_id, p_brand AS name FROM part
        UNION ALL SELECT {_PART}, 2, p_type FROM part
        UNION ALL
        SELECT company_name, seq, username FROM (
            SELECT r.username, r.seq, e.company_name
            FROM req_employee_edit r JOIN employee e ON r.emp_id = e.emp_id)
        QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY seq DESC) = 1""",
    "config_write_fields": f"""
        SELECT {_PART} AS tenant_id, p_brand AS shelf, NULL AS floor, NULL AS note,
            CAST(p_size AS VARCHAR) AS width, CAST(p_size + 1 AS VARCHAR) AS length,
            NULL AS limit_by, NULL AS is_open, CAST(NULL AS VARCHAR) AS sender
        FROM part
        UNION ALL
        SELECT company_name, c_name, CAST(c_nationkey AS VARCHAR), c_name,
            CAST(c_custkey * 2 AS VARCHAR), c_mktsegment, CAST(c_custkey AS VARCHAR), CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END, NULL
        FROM (
            SELECT c.*, e.company_name
            FROM customer c JOIN employee e ON e.emp_id = CAST(c.c_nationkey AS VARCHAR))
        QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY c_custkey DESC) = 1""",
    "mixed_log_customers": """
        SELECT c.tenant_id, c.customer_id, customer_name,
            CASE WHEN edits > 0 THEN e.props ELSE contact END AS contact,
            CASE WHEN edits > 0 THEN 'click' ELSE type END AS type,
            CASE WHEN edits > 0 THEN NULL ELSE level END AS level,
            CASE WHEN edits > 0 THEN CASE WHEN e.value < 20 THEN e.props END ELSE note END AS note,
            status, CASE WHEN views > 0 THEN l.place ELSE warehouse END AS warehouse, packages, customer_date,
            address, city, state, country, zipcode, phone, doc_type, doc_url
        FROM customers c LEFT JOIN (
            SELECT CASE WHEN event_id % 2 = 0 THEN 'east' ELSE 'west' END AS tenant_id,
                CAST(user_id AS VARCHAR) AS customer_id,
                arg_max(props, event_id) FILTER (event_type = 'view') AS place,
                count(*) FILTER (event_type = 'view') AS views,
                count(*) FILTER (event_type = 'click') AS edits,
                max(event_id) FILTER (event_type = 'click') AS edited
            FROM events GROUP BY ALL
        ) l ON l.tenant_id = c.tenant_id AND l.customer_id = c.customer_id
        LEFT JOIN events e ON e.event_id = l.edited
        UNION ALL
        SELECT CASE WHEN event_id % 2 = 0 THEN 'east' ELSE 'west' END, 'E' || CAST(event_id AS VARCHAR),
            NULL, props, NULL, NULL, NULL, NULL, NULL, 0, date_trunc('second', ts), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM events WHERE event_type = 'signup'""",
    "mixed_log_box": """
        SELECT b.* REPLACE (CASE WHEN n > 0 THEN CAST(p AS INTEGER) ELSE priority END AS priority)
        FROM box b LEFT JOIN (
            SELECT CASE WHEN event_id % 2 = 0 THEN 'east' ELSE 'west' END AS tenant_id,
                CAST(user_id AS VARCHAR) AS box_id, count(*) AS n, arg_max(day(ts), event_id) AS p
            FROM events WHERE event_type = 'purchase' GROUP BY ALL
        ) l ON l.tenant_id = b.tenant_id AND l.box_id = b.box_id""",
    "documents_scan": """
        SELECT file_name, value, CAST(length(value) AS INTEGER) AS n_chars,
               CAST(strlen(value) AS INTEGER) AS n_bytes FROM text_files""",
    "log_append": "SELECT * FROM logedit UNION ALL SELECT * FROM req_log",
    "customers_by_key": """
        SELECT * FROM customers WHERE (tenant_id, customer_id) IN (SELECT (tenant_id, customer_id) FROM appointment)""",
    "addresses_by_key": """
        SELECT * FROM addresses WHERE (tenant_id, address_id) IN (SELECT (tenant_id, address_id) FROM box)""",
    "addresses_of_customer": """
        SELECT * FROM addresses WHERE (tenant_id, customer_id) IN (SELECT (tenant_id, customer_id) FROM box)""",
    "unclaimed_packages": "SELECT * FROM packages WHERE customer_id IS NULL",
    "open_items_of_package": """
        SELECT * FROM items WHERE item_status = 0 AND (tenant_id, tracking_number) IN
            (SELECT (tenant_id, tracking_number) FROM packages WHERE customer_id IS NULL)""",
    "subbox_by_key": """
        SELECT * FROM subbox WHERE (tenant_id, subbox_id) IN (SELECT (tenant_id, subbox_id) FROM subbox_item)""",
    "box_by_key": "SELECT * FROM box WHERE (tenant_id, box_id) IN (SELECT (tenant_id, box_id) FROM slip)",
    "items_of_box": "SELECT * FROM items WHERE (tenant_id, box_id) IN (SELECT (tenant_id, box_id) FROM slip)",
    "slips_of_box": "SELECT * FROM slip WHERE (tenant_id, box_id) IN (SELECT (tenant_id, box_id) FROM box)",
    "subboxes_of_box": "SELECT * FROM subbox WHERE (tenant_id, box_id) IN (SELECT (tenant_id, box_id) FROM slip)",
    "pending_appointments": """
        SELECT *, strftime(start_date, '%Y-%m-%d') AS formatted_start_date FROM appointment
        WHERE status = 'Pending' AND start_date > DATE '2024-01-15' - INTERVAL 1 DAY""",
    "company_owner_accounts": "SELECT * FROM employee WHERE company_name = username",
    "employee_by_key": "SELECT * FROM employee WHERE emp_id IN (SELECT emp_id FROM uploads)",
    "customers_by_key_any_case": """
        SELECT c.* REPLACE ('Cust' || customer_id AS customer_id) FROM customers c
        WHERE (tenant_id, customer_id) IN (SELECT (tenant_id, customer_id) FROM appointment)""",
    "addresses_of_customer_any_case": """
        SELECT a.* REPLACE ('Cust' || customer_id AS customer_id) FROM addresses a
        WHERE (tenant_id, customer_id) IN (SELECT (tenant_id, customer_id) FROM appointment)""",
    "box_by_key_any_case": """
        SELECT b.* REPLACE ('Box' || box_id AS box_id) FROM box b
        WHERE (tenant_id, box_id) IN (SELECT (tenant_id, box_id) FROM slip)""",
    "slips_of_box_any_case": """
        SELECT s.* REPLACE ('Box' || box_id AS box_id) FROM slip s
        WHERE (tenant_id, box_id) IN (SELECT (tenant_id, box_id) FROM box)""",
    "open_items_of_package_any_case": """
        SELECT * FROM items WHERE item_status = 0 AND (tenant_id, tracking_number) IN
            (SELECT (tenant_id, tracking_number) FROM packages WHERE customer_id IS NULL)""",
    "customer_by_tracking_any_case": """
        SELECT c.tenant_id, p.tracking_number,
            CASE WHEN length(p.customer_id) % 2 = 0 THEN lower('Cust' || p.customer_id)
                ELSE upper('Cust' || p.customer_id) END AS customer_id, c.contact, c.type, c.level, c.note
        FROM customers c INNER JOIN packages p
        ON c.tenant_id = p.tenant_id AND c.customer_id = p.customer_id""",
    "company_staff_any_case": """
        SELECT e.* REPLACE (CASE WHEN length(company_name) % 2 = 0 THEN lower(company_name)
            ELSE upper(company_name) END AS company_name)
        FROM employee e WHERE lower(username) != lower(company_name) AND company_name IN
            (SELECT company_name FROM employee WHERE emp_id IN (SELECT emp_id FROM req_employee_edit))""",
    "customer_open_package_counts_any_case": f"""
        {_OPEN_PACKAGES}
        SELECT c.* REPLACE ('Cust' || customer_id AS customer_id),
            (SELECT count(*) FROM open_packages o WHERE o.tenant_id = c.tenant_id
            AND o.customer_id = c.customer_id) AS package_count
        FROM customers c""",
    "customer_by_tracking": """
        SELECT c.tenant_id, p.tracking_number, c.customer_id, c.contact, c.type, c.level, c.note
        FROM customers c INNER JOIN packages p
        ON c.tenant_id = p.tenant_id AND c.customer_id = p.customer_id""",
    "company_staff": """
        SELECT * FROM employee WHERE username != company_name AND company_name IN
            (SELECT company_name FROM employee WHERE emp_id IN (SELECT emp_id FROM uploads))""",
    "fully_packed_packages": _OPEN_PACKAGES + " SELECT * FROM packed",
    "packages_not_fully_packed": _OPEN_PACKAGES + " SELECT * FROM open_packages",
    "customers_with_open_items": """
        SELECT DISTINCT tenant_id, customer_id FROM packages WHERE customer_id IS NOT NULL
        AND (tenant_id, tracking_number) IN (SELECT (tenant_id, tracking_number) FROM items WHERE item_status = 0)""",
    "rows_of_employees": """
        SELECT * FROM packages WHERE tenant_id IN (
            SELECT CASE WHEN company_name = 'AFRICA' THEN 'east' ELSE 'none' END FROM employee
            WHERE emp_id IN (SELECT emp_id FROM req_employee_edit))""",
    "tenant_of_employee": """
        SELECT r.seq, r.emp_id, e.emp_database AS tenant_id, e.company_name
        FROM req_employee_edit r JOIN employee e ON r.emp_id = e.emp_id""",
    "customer_open_package_counts": f"""
        {_OPEN_PACKAGES}
        SELECT c.*, (SELECT count(*) FROM open_packages o WHERE o.tenant_id = c.tenant_id
            AND o.customer_id = c.customer_id) AS package_count
        FROM customers c""",
    "customers_with_open_packages": f"""
        {_OPEN_PACKAGES}
        SELECT * FROM (SELECT c.*, (SELECT count(*) FROM open_packages o
                WHERE o.tenant_id = c.tenant_id AND o.customer_id = c.customer_id) AS package_count
            FROM customers c) r
        WHERE package_count > 0 OR NOT EXISTS (SELECT 1 FROM packages p
            WHERE p.tenant_id = r.tenant_id AND p.customer_id = r.customer_id)""",
    "customers_by_date": "SELECT * FROM customers",
    "package_item_progress": """
        SELECT p.*, p.Date_create AS received_date,
               (SELECT COUNT(*) FROM items i WHERE i.tenant_id = p.tenant_id
                AND i.tracking_number = p.tracking_number
                AND i.item_status = 0) AS sum0,
               (SELECT COUNT(*) FROM items i WHERE i.tenant_id = p.tenant_id
                AND i.tracking_number = p.tracking_number
                AND i.item_status = 1) AS sum1
        FROM packages p""",
    "remaining_box_items": """
        , rest AS (SELECT i.*, i.quantity - coalesce((SELECT sum(a.sub_quantity) FROM subbox_item a
                WHERE a.tenant_id = i.tenant_id AND a.item_id = i.item_id AND a.subbox_id IN
                (SELECT b.subbox_id FROM subbox b
                 WHERE b.tenant_id = i.tenant_id AND b.box_id = i.box_id)), 0) AS remaining_quantity
            FROM items i WHERE i.box_id IS NOT NULL)
        SELECT *, weight * remaining_quantity / nullif(quantity, 0) AS adjusted_weight
        FROM rest WHERE remaining_quantity <> 0""",
    "open_item_count": """
        SELECT p.tenant_id, p.customer_id, COUNT(*) AS open_items
        FROM items i JOIN packages p
        ON i.tenant_id = p.tenant_id AND i.tracking_number = p.tracking_number
        WHERE i.item_status = 0 AND p.customer_id IS NOT NULL GROUP BY ALL""",
    "subbox_volumetric": """
        SELECT *, CASE WHEN weight IS NULL OR width IS NULL OR b_long IS NULL OR height IS NULL
            THEN NULL ELSE round(greatest(weight, width * b_long * height / 5000), 2) END
            AS "volumetricWeight" FROM subbox""",
    "subbox_item_weights": """
        SELECT s.tenant_id, s.item_id AS subbox_item_id, s.subbox_id, s.sub_quantity,
               i.* EXCLUDE (tenant_id),
               i.weight * s.sub_quantity / nullif(i.quantity, 0) AS adjusted_weight
        FROM subbox_item s LEFT JOIN items i
        ON s.tenant_id = i.tenant_id AND s.item_id = i.item_id""",
    "subbox_nested": """
        SELECT b.tenant_id, b.subbox_id,
               CASE WHEN b.weight IS NULL OR width IS NULL OR b_long IS NULL OR height IS NULL
               THEN NULL ELSE round(greatest(b.weight, width * b_long * height / 5000), 2) END
               AS "volumetricWeight",
               s.item_id AS subbox_item_id, i.item_id, s.sub_quantity,
               i.weight * s.sub_quantity / nullif(i.quantity, 0) AS adjusted_weight
        FROM subbox b LEFT JOIN subbox_item s
        ON b.tenant_id = s.tenant_id AND b.subbox_id = s.subbox_id
        LEFT JOIN items i ON s.tenant_id = i.tenant_id AND s.item_id = i.item_id""",
    "box_board": """
        SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id, box_status
            ORDER BY priority NULLS FIRST, box_id) AS BIGINT) AS pos
        FROM (
            SELECT *, CAST(1 AS INTEGER) AS board FROM box
            WHERE box_status IN ('Ordered', 'Process', 'Packed')
            UNION ALL
            SELECT *, 2 FROM box WHERE box_status IN ('Paid', 'Documented'))""",
    "last_tracking_per_prefix": f"""
        SELECT t.tenant_id, t.type, p.tracking_number
        FROM types t JOIN packages p ON p.tenant_id = t.tenant_id
            AND p.tracking_number LIKE replace(t.type, chr(92), '') || '%'
        QUALIFY row_number() OVER (PARTITION BY t.tenant_id, t.type
            ORDER BY {_NUMBER.replace('tracking_number', 'p.tracking_number')} DESC,
            p.tracking_number DESC) = 1""",
    "asset_purge_manifest": _purge(
        "package", "tracking_number", "packages", f"(tenant_id, tracking_number) IN ({_CLOSED_PACKAGES})"
    )
    + " UNION ALL "
    + _purge("item", "item_id", "items", f"(tenant_id, tracking_number) IN ({_CLOSED_PACKAGES})"),
    "asset_purge_packages": _purge(
        "package", "tracking_number", "packages",
        "(tenant_id, tracking_number) IN (SELECT (tenant_id, tracking_number) FROM req_package_delete)",
    )
    + " UNION ALL "
    + _purge(
        "item", "item_id", "items",
        "(tenant_id, tracking_number) IN (SELECT (tenant_id, tracking_number) FROM req_package_delete)",
    ),
    "asset_purge_items": _purge(
        "item", "item_id", "items", "(tenant_id, item_id) IN (SELECT (tenant_id, item_id) FROM req_item_delete)"
    ),
    "asset_keys": r"""
        SELECT e.emp_database AS tenant_id, u.upload_id, u.kind, e.emp_database || CASE
            WHEN u.kind = 'package' THEN '/public/package/' || u.base || '_'
                || CAST(u.at_ms AS VARCHAR) || '.webp'
            WHEN u.kind = 'item' AND u.file_name <> '' THEN '/public/item/'
                || regexp_replace(u.file_name, '\.[^/.]+$', '.webp')
            WHEN u.kind = 'item' THEN '/public/item/' || u.base || '_'
                || CAST(u.at_ms AS VARCHAR) || '.webp'
            ELSE '/uploads/' || u.base || '.webp' END AS object_key
        FROM (SELECT *, regexp_replace(regexp_extract(original_name, '[^/]*$'),
            '(.)\.[^.]*$', '\1') AS base FROM uploads) u
        JOIN employee e ON u.emp_id = e.emp_id""",
    "document_names": r"""
        SELECT page_id, file_name, replace(replace(replace(replace(replace(replace(replace(
            file_name, ':', '_'), '<', '_'), '>', '_'), '|', '_'), '?', '_'), '*', '_'), '"', '_')
            AS stored_name FROM page_files""",
    "file_prefix_matches": """
        SELECT k.tenant_id, k.photo_name, f.file_name
        FROM photo_names k JOIN stored_files f ON f.tenant_id = k.tenant_id
            AND starts_with(f.file_name, k.photo_name)""",
    "file_prefix_first": """
        SELECT k.tenant_id, k.photo_name, min(f.file_name) AS file_name
        FROM photo_names k JOIN stored_files f ON f.tenant_id = k.tenant_id
            AND starts_with(f.file_name, k.photo_name)
        GROUP BY ALL""",
    "file_exact_matches": """
        SELECT k.tenant_id, k.photo_name, f.file_name
        FROM photo_names k JOIN stored_files f ON f.tenant_id = k.tenant_id
            AND f.file_name = k.photo_name""",
}
_OPERATORS["package_item_progress_unclaimed"] = (
    _OPERATORS["package_item_progress"] + " WHERE p.customer_id IS NULL"
)
for _table in TABLES:
    _OPERATORS[f"scan_table_{_table}"] = f"SELECT * FROM {_table}"

_POSTAL = "address city state country zipcode phone"


def _clear_when_done(request: str, item_key: str) -> str:
    """Status after deletions, seen by each customer's last request."""
    return f"""
        , asked AS (SELECT tenant_id, customer_id, max(seq) AS last_seq FROM {request}
            WHERE customer_id <> '' GROUP BY tenant_id, customer_id),
        gone AS (SELECT tenant_id, {item_key}, min(seq) AS gone_seq FROM {request}
            GROUP BY tenant_id, {item_key}),
        holding AS (SELECT DISTINCT a.tenant_id, a.customer_id FROM asked a
            JOIN packages p ON (p.tenant_id, p.customer_id) = (a.tenant_id, a.customer_id)
            JOIN items i ON (i.tenant_id, i.tracking_number) = (p.tenant_id, p.tracking_number)
            LEFT JOIN gone g ON (g.tenant_id, g.{item_key}) = (i.tenant_id, i.{item_key})
            WHERE i.item_status = 0 AND (g.gone_seq IS NULL OR g.gone_seq > a.last_seq))
        SELECT c.* REPLACE (CASE WHEN c.status <> 'Unpaid'
            AND (tenant_id, customer_id) IN (SELECT (tenant_id, customer_id) FROM asked)
            AND (tenant_id, customer_id) NOT IN (SELECT (tenant_id, customer_id) FROM holding)
            THEN NULL ELSE c.status END AS status)
        FROM customers c"""


_OPEN_ITEM = (
    "EXISTS (SELECT 1 FROM items i JOIN packages p ON i.tenant_id = p.tenant_id "
    "AND i.tracking_number = p.tracking_number WHERE i.item_status = 0 "
    "AND p.tenant_id = c.tenant_id AND p.customer_id = c.customer_id)"
)

_ITEM_ENTRIES = f"""(
    SELECT {tenant_of('o_orderkey')} AS tenant_id, 'N' || CAST(o_orderkey AS VARCHAR) || '-1' AS item_id,
           'TH-' || CAST(o_orderkey AS VARCHAR) AS tracking_number,
           o_orderstatus AS item_name, o_orderpriority AS item_type, '' AS item_subtype,
           CAST(0 AS DOUBLE) AS quantity, o_totalprice AS weight, NULL AS packer_id,
           NULL AS photo_url, '7' AS emp_id, 0 AS item_status, NULL AS box_id
    FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL
    SELECT {tenant_of('o_orderkey')}, 'N' || CAST(o_orderkey AS VARCHAR) || '-3',
           'TH-' || CAST(o_orderkey AS VARCHAR), 'fish', 'food', 'dry', 3, 0, NULL,
           'p', '7', 0, NULL
    FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F')"""

# The names are settled in an inner select: DuckDB 2.0.0 loses the matches of the
# joins below when the window reads the alias of the same select.
_NEW_BOXES = """(
    SELECT * FROM (
        SELECT r.*, sender || '_' || strftime(submitted_at, '%Y-%m-%dT%H:%M:%S') AS box_id
        FROM req_box_insert r) named
    WHERE (tenant_id, box_id) NOT IN (SELECT (tenant_id, box_id) FROM box)
    QUALIFY row_number() OVER (PARTITION BY tenant_id, box_id ORDER BY seq) = 1)"""

_LAST_EMPLOYEE = """(
    SELECT CAST((SELECT max(CAST(emp_id AS BIGINT)) FROM employee) + 1 + r.seq
           - (SELECT min(seq) FROM req_employee_insert) AS VARCHAR) AS emp_id,
           r.username, r.emp_name, a.company_name, a.emp_database, r.role, NULL AS eimg,
           r.emp_date
    FROM req_employee_insert r JOIN employee a ON a.emp_id = r.emp_id)"""


def _latest_present(request: str, key: str, column: str, condition: str) -> str:
    return (
        f"LEFT JOIN {_last(request, key, condition)} {column}_f "
        f"ON {_same(request, 'b', column + '_f')}b.{key} = {column}_f.{key}"
    )


def _update_present(table: str, request: str, key: str, columns: dict[str, str]) -> str:
    """Each column written by the last request that carries it."""
    new = ", ".join(
        f"CASE WHEN {c}_f.{key} IS NOT NULL THEN {c}_f.{c} ELSE b.{c} END AS {c}"
        for c in columns
    )
    joins = " ".join(_latest_present(request, key, c, cond) for c, cond in columns.items())
    return f"SELECT b.* REPLACE ({new}) FROM {table} b {joins}"


_JOBS: dict[str, str] = {
    "chg_customer_insert": """
        SELECT * FROM customers UNION ALL BY NAME
        SELECT tenant_id, customer_id, contact, type, level, note, 0 AS packages,
               coalesce(customer_date, TIMESTAMP '2024-03-01 12:00:00') AS customer_date
        FROM req_customer_insert WHERE (tenant_id, customer_id) NOT IN (SELECT (tenant_id, customer_id) FROM customers)
        QUALIFY row_number() OVER (PARTITION BY tenant_id, customer_id ORDER BY seq) = 1""",
    "chg_customer_edit": _renamed("customers", "req_customer_edit", "customer_id")
    + _update("customers", "allowed", "customer_id", "customer_id contact type level note", "old_id"),
    "chg_customer_warehouse": _update(
        "customers", "req_customer_event", "customer_id", "warehouse"
    ),
    "chg_customer_address": f"""
        SELECT b.* REPLACE (
            {", ".join(
                f"CASE WHEN f.customer_id IS NOT NULL THEN f.{c} ELSE b.{c} END AS {c}"
                for c in "customer_name address city state zipcode phone".split())},
            CASE WHEN f.customer_id IS NULL THEN b.country WHEN f.has_country THEN f.country
                 ELSE 'Thailand' END AS country,
            CASE WHEN d.customer_id IS NOT NULL THEN d.doc_type ELSE b.doc_type END AS doc_type,
            CASE WHEN d.customer_id IS NOT NULL THEN d.doc_url ELSE b.doc_url END AS doc_url)
        FROM customers b
        LEFT JOIN {_last("req_customer_event", "customer_id")} f
            ON b.tenant_id = f.tenant_id AND b.customer_id = f.customer_id
        LEFT JOIN {_last("req_customer_event", "customer_id", "has_doc_type AND has_doc_url")} d
            ON b.tenant_id = d.tenant_id AND b.customer_id = d.customer_id""",
    "chg_customer_delete": """
        SELECT * FROM customers WHERE (tenant_id, customer_id) NOT IN
            (SELECT (tenant_id, customer_id) FROM req_customer_delete)""",
    "chg_customer_delete_subbox_item": f"""
        SELECT * FROM subbox_item WHERE (tenant_id, subbox_id) NOT IN
            (SELECT (tenant_id, subbox_id) FROM subbox WHERE (tenant_id, box_id) IN ({_CLOSED_BOXES}))""",
    "chg_customer_delete_subbox": f"""
        SELECT * FROM subbox WHERE ((tenant_id, box_id) IN ({_CLOSED_BOXES})) IS NOT TRUE""",
    "chg_customer_delete_slip": f"""
        SELECT * FROM slip WHERE ((tenant_id, box_id) IN ({_CLOSED_BOXES})) IS NOT TRUE""",
    "chg_customer_delete_items": f"""
        SELECT * FROM items WHERE ((tenant_id, tracking_number) IN ({_CLOSED_PACKAGES})) IS NOT TRUE""",
    "chg_customer_delete_packages": """
        SELECT * FROM packages WHERE ((tenant_id, customer_id) IN
            (SELECT (tenant_id, customer_id) FROM req_customer_delete)) IS NOT TRUE""",
    "chg_customer_delete_box": """
        SELECT * FROM box WHERE ((tenant_id, customer_id) IN
            (SELECT (tenant_id, customer_id) FROM req_customer_delete)) IS NOT TRUE""",
    "chg_customer_delete_appointment": """
        SELECT * FROM appointment WHERE ((tenant_id, customer_id) IN
            (SELECT (tenant_id, customer_id) FROM req_customer_delete)) IS NOT TRUE""",
    "chg_customer_delete_addresses": """
        SELECT * FROM addresses WHERE ((tenant_id, customer_id) IN
            (SELECT (tenant_id, customer_id) FROM req_customer_delete)) IS NOT TRUE""",
    "chg_address_insert": f"""
        SELECT * FROM addresses UNION ALL BY NAME
        SELECT r.* EXCLUDE (seq),
               {_numbered('address_id', 'addresses', 'req_address_insert')} AS address_id
        FROM req_address_insert r""",
    "chg_address_edit": _update(
        "addresses", "req_address_edit", "address_id", "recipient_name " + _POSTAL
    ),
    "chg_address_delete": """
        SELECT * FROM addresses WHERE (tenant_id, address_id) NOT IN
            (SELECT (tenant_id, address_id) FROM req_address_delete)""",
    "chg_package_insert": """
        SELECT * FROM packages UNION ALL BY NAME
        SELECT tenant_id, tracking_number,
               CASE WHEN customer_id = 'MISSINGITEMS' THEN NULL ELSE customer_id END
               AS customer_id,
               CASE WHEN has_packages_cost THEN packages_cost END AS packages_cost,
               photo_url, emp_id,
               CASE WHEN Date_create IS NULL THEN TIMESTAMP '2024-03-01 12:00:00'
                    ELSE Date_create END AS Date_create
        FROM req_package_insert
        WHERE (tenant_id, tracking_number) NOT IN (SELECT (tenant_id, tracking_number) FROM packages)""",
    "chg_package_edit": _renamed("packages", "req_package_edit", "tracking_number") + """
        SELECT b.* REPLACE (
            CASE WHEN r.old_id IS NOT NULL THEN r.tracking_number ELSE b.tracking_number END
                AS tracking_number,
            CASE WHEN r.old_id IS NULL THEN b.customer_id
                 WHEN r.customer_id IN ('MISSINGITEMS', '') THEN NULL ELSE r.customer_id END
                AS customer_id,
            CASE WHEN r.old_id IS NOT NULL THEN r.photo_url ELSE b.photo_url END AS photo_url)
        FROM packages b LEFT JOIN allowed r
        ON b.tenant_id = r.tenant_id AND b.tracking_number = r.old_id""",
    "chg_package_delete": """
        SELECT * FROM packages WHERE (tenant_id, tracking_number) NOT IN
            (SELECT (tenant_id, tracking_number) FROM req_package_delete)""",
    "chg_package_delete_items": """
        SELECT * FROM items WHERE (tenant_id, tracking_number) NOT IN
            (SELECT (tenant_id, tracking_number) FROM req_package_delete)""",
    "chg_package_delete_customers": _clear_when_done("req_package_delete", "tracking_number"),
    "chg_items_insert": f"SELECT * FROM items UNION ALL BY NAME SELECT * FROM {_ITEM_ENTRIES}",
    "chg_items_insert_customers": f"""
        SELECT c.* REPLACE (CASE WHEN c.status IS NULL AND (c.tenant_id, c.customer_id) IN (
            SELECT ({tenant_of('o_orderkey')}, CAST(o_custkey AS VARCHAR)) FROM orders
            WHERE o_orderpriority = '1-URGENT')
            THEN 'Warehouse' ELSE c.status END AS status)
        FROM customers c""",
    "chg_item_edit": _update(
        "items", "req_item_edit", "item_id",
        "item_name item_type item_subtype quantity weight photo_url",
        condition="item_name <> '' AND item_type <> ''",
    ),
    "chg_item_delete": """
        SELECT * FROM items WHERE (tenant_id, item_id) NOT IN (SELECT (tenant_id, item_id) FROM req_item_delete)""",
    "chg_item_delete_customers": _clear_when_done("req_item_delete", "item_id"),
    "chg_subbox_insert": f"""
        SELECT * FROM subbox UNION ALL BY NAME
        SELECT o.tenant_id, (SELECT max(subbox_id) FROM subbox b WHERE b.tenant_id = o.tenant_id)
               + 1 + o_orderkey - (SELECT min(seq) FROM req_box_insert r
               WHERE r.tenant_id = o.tenant_id) AS subbox_id,
               CAST(o_custkey AS VARCHAR) AS box_id, o_totalprice AS weight,
               CAST(10 AS DOUBLE) AS width, CAST(20 AS DOUBLE) AS b_long,
               CAST(30 AS DOUBLE) AS height, o_orderstatus AS img_url, '3' AS emp_id
        FROM (SELECT {tenant_of('o_orderkey')} AS tenant_id, * FROM orders) o""",
    "chg_subbox_insert_subbox_item": f"""
        SELECT * FROM subbox_item UNION ALL BY NAME
        SELECT o.tenant_id, (SELECT max(subbox_id) FROM subbox b WHERE b.tenant_id = o.tenant_id)
               + 1 + o_orderkey - (SELECT min(seq) FROM req_box_insert r
               WHERE r.tenant_id = o.tenant_id) AS subbox_id,
               part || CAST(o_orderkey AS VARCHAR) AS item_id,
               CAST(CASE WHEN part = 'A' THEN CASE WHEN o_orderstatus = 'F' THEN 9 ELSE 4 END
                    WHEN o_orderstatus = 'P' THEN 2 END AS DOUBLE) AS sub_quantity
        FROM (SELECT {tenant_of('o_orderkey')} AS tenant_id, * FROM orders) o,
             (VALUES ('A'), ('B')) parts(part)
        WHERE o_orderpriority <> '5-LOW'""",
    "chg_subbox_edit": _update(
        "subbox", "req_subbox_event", "subbox_id", "weight width b_long height img_url"
    ),
    "chg_subbox_tracking": f"""
        , entries AS (
            SELECT {tenant_of('event_id')} AS tenant_id, user_id * 10 + 1 AS subbox_id,
                   event_id AS seq, 0 AS pos,
                   event_type AS subbox_tracking, value AS subbox_cost FROM events
            UNION ALL SELECT {tenant_of('event_id')}, user_id * 10 + 2, event_id, 1, props,
                   CASE WHEN event_type = 'view' THEN NULL ELSE value + 1 END FROM events
            UNION ALL SELECT {tenant_of('event_id')}, user_id * 10 + 1, event_id, 2, NULL, value FROM events),
        latest AS (SELECT * FROM entries
            QUALIFY row_number() OVER (PARTITION BY tenant_id, subbox_id
                ORDER BY seq DESC, pos DESC) = 1)
        SELECT b.* REPLACE (
            CASE WHEN f.subbox_id IS NOT NULL THEN f.subbox_tracking ELSE b.subbox_tracking END
                AS subbox_tracking,
            CASE WHEN f.subbox_id IS NOT NULL THEN f.subbox_cost ELSE b.subbox_cost END
                AS subbox_cost)
        FROM subbox b LEFT JOIN latest f
        ON b.tenant_id = f.tenant_id AND b.subbox_id = f.subbox_id""",
    "chg_subbox_delete": """
        SELECT * FROM subbox WHERE (tenant_id, subbox_id) NOT IN (SELECT (tenant_id, subbox_id) FROM req_subbox_delete)""",
    "chg_subbox_delete_subbox_item": """
        SELECT * FROM subbox_item WHERE (tenant_id, subbox_id) NOT IN
            (SELECT (tenant_id, subbox_id) FROM req_subbox_delete)""",
    "chg_subbox_item_add": """
        SELECT tenant_id, subbox_id, item_id,
               CASE WHEN sub_quantity = 3 THEN NULL ELSE sub_quantity + sub_quantity + 2 END
               AS sub_quantity FROM subbox_item
        UNION ALL
        SELECT tenant_id, subbox_id, item_id || '-new',
               CASE WHEN sub_quantity = 0 THEN 7 ELSE sub_quantity END FROM subbox_item""",
    "chg_subbox_item_edit": """
        SELECT tenant_id, subbox_id, item_id,
               CASE WHEN sub_quantity < 5 THEN NULL ELSE sub_quantity + 1 END AS sub_quantity
        FROM subbox_item WHERE sub_quantity <= 20""",
    "chg_box_insert": f"""
        SELECT * FROM box UNION ALL BY NAME
        SELECT tenant_id, box_id, sender AS customer_id, recipients AS address_id, note,
               'Ordered' AS box_status FROM {_NEW_BOXES}""",
    "chg_box_insert_items": f"""
        SELECT i.* REPLACE (
            CASE WHEN n.box_id IS NOT NULL THEN n.box_id ELSE i.box_id END AS box_id,
            CASE WHEN n.box_id IS NOT NULL THEN 1 ELSE i.item_status END AS item_status)
        FROM items i LEFT JOIN (
            SELECT k.tenant_id, k.item_id, b.box_id FROM req_box_contents k JOIN {_NEW_BOXES} b
            ON k.tenant_id = b.tenant_id AND k.seq = b.seq) n
            ON i.tenant_id = n.tenant_id AND i.item_id = n.item_id""",
    "chg_box_insert_customers": f"""
        SELECT c.* REPLACE (CAST(c.packages + (SELECT COUNT(*) FROM {_NEW_BOXES} b
            WHERE b.tenant_id = c.tenant_id AND b.sender = c.customer_id) AS INTEGER) AS packages)
        FROM customers c""",
    "chg_box_edit": _update_present(
        "box", "req_box_edit", "box_id",
        {
            "box_status": "has_bprice OR NOT has_discount",
            "bprice": "has_bprice",
            "document": "has_bprice",
            "discount": "has_discount AND NOT has_bprice",
            "expires_at": "has_expires_at AND (has_bprice OR NOT has_discount)",
        },
    ),
    "chg_box_edit_customers": f"""
        SELECT c.* REPLACE (CASE
            WHEN f.customer_id IS NULL THEN c.status
            WHEN f.has_bprice AND f.box_status = 'Packed' THEN 'Unpaid'
            WHEN NOT f.has_bprice AND f.box_status IS DISTINCT FROM 'Paid' THEN 'Unpaid'
            WHEN {_OPEN_ITEM} THEN 'Warehouse' ELSE NULL END AS status)
        FROM customers c LEFT JOIN {_last(
            "req_box_edit", "customer_id",
            "customer_id IS NOT NULL AND (has_bprice OR (NOT has_discount AND has_customer_id))",
        )} f ON c.tenant_id = f.tenant_id AND c.customer_id = f.customer_id""",
    "chg_box_priority": _update("box", "req_box_priority", "box_id", "priority"),
    "chg_box_delete": f"SELECT * FROM box WHERE (tenant_id, box_id) NOT IN ({_GONE_BOXES})",
    "chg_box_delete_items": f"""
        SELECT * REPLACE (
            CASE WHEN (tenant_id, box_id) IN ({_GONE_BOXES}) THEN 0 ELSE item_status END AS item_status,
            CASE WHEN (tenant_id, box_id) IN ({_GONE_BOXES}) THEN NULL ELSE box_id END AS box_id)
        FROM items""",
    "chg_box_delete_subbox_item": f"""
        SELECT * FROM subbox_item WHERE (tenant_id, subbox_id) NOT IN
            (SELECT (tenant_id, subbox_id) FROM subbox WHERE (tenant_id, box_id) IN ({_GONE_BOXES}))""",
    "chg_box_delete_subbox": f"""
        SELECT * FROM subbox WHERE ((tenant_id, box_id) IN ({_GONE_BOXES})) IS NOT TRUE""",
    "chg_box_delete_customers": """
        , asked AS (SELECT tenant_id, customer_id, max(seq) AS last_seq, COUNT(*) AS times
            FROM req_box_delete GROUP BY tenant_id, customer_id),
        gone AS (SELECT tenant_id, box_id, min(seq) AS gone_seq FROM req_box_delete
            GROUP BY tenant_id, box_id)
        SELECT c.* REPLACE (
            CAST(c.packages - coalesce(a.times, 0) AS INTEGER) AS packages,
            CASE WHEN a.customer_id IS NULL THEN c.status
                 WHEN EXISTS (SELECT 1 FROM box b LEFT JOIN gone g
                    ON b.tenant_id = g.tenant_id AND b.box_id = g.box_id
                    WHERE b.tenant_id = c.tenant_id AND b.customer_id = c.customer_id AND b.box_status = 'Packed'
                    AND (g.gone_seq IS NULL OR g.gone_seq > a.last_seq)) THEN c.status
                 WHEN EXISTS (SELECT 1 FROM items i
                    JOIN packages p ON p.tenant_id = i.tenant_id
                    AND p.tracking_number = i.tracking_number
                    LEFT JOIN gone g ON g.tenant_id = i.tenant_id AND g.box_id = i.box_id
                    WHERE p.tenant_id = c.tenant_id AND p.customer_id = c.customer_id
                    AND (i.item_status = 0 OR g.gone_seq <= a.last_seq)) THEN 'Warehouse'
                 ELSE NULL END AS status)
        FROM customers c LEFT JOIN asked a
        ON a.tenant_id = c.tenant_id AND a.customer_id = c.customer_id""",
    "chg_slip_insert": f"""
        SELECT * FROM slip UNION ALL BY NAME
        SELECT r.* EXCLUDE (seq), {_numbered('slip_id', 'slip', 'req_slip_insert')} AS slip_id
        FROM req_slip_insert r""",
    "chg_slip_delete": """
        SELECT * FROM slip WHERE (tenant_id, slip_id) NOT IN (SELECT (tenant_id, slip_id) FROM req_slip_delete)""",
    "chg_appointment_insert": f"""
        SELECT * FROM appointment UNION ALL BY NAME
        SELECT r.* EXCLUDE (seq, pickupdate, "pickupTime"), title AS customer_id,
               CAST(pickupdate || ' ' || "pickupTime" || ':00' AS TIMESTAMP) AS start_date,
               CAST(pickupdate || ' ' || "pickupTime" || ':00' AS TIMESTAMP)
               + INTERVAL 30 MINUTE AS end_date, 'Pending' AS status,
               {_numbered('appoint_id', 'appointment', 'req_appointment_insert')} AS appoint_id
        FROM req_appointment_insert r""",
    "chg_appointment_edit": _update_present(
        "appointment", "req_appointment_edit", "appoint_id",
        {
            "status": "has_status",
            **{
                c: "NOT has_status"
                for c in (
                    "note", "address_pickup", "phone_pickup", "name_pickup", "position",
                    "vehicle",
                )
            },
        },
    ),
    "chg_employee_insert": f"""
        SELECT * FROM employee UNION ALL BY NAME SELECT * FROM {_LAST_EMPLOYEE}""",
    "chg_employee_edit": _update(
        "employee", "req_employee_edit", "emp_id", "username emp_name role"
    ),
    "chg_employee_delete": """
        SELECT * FROM employee WHERE (emp_id IN (SELECT emp_id FROM req_employee_delete)
            AND role != 'owner') IS NOT TRUE""",
    "chg_dropdown": """
        , sent AS (SELECT e.company_name, r.* FROM (
                SELECT c_custkey AS seq, CAST(c_nationkey AS VARCHAR) AS emp_id, c_name,
                       c_mktsegment FROM customer) r JOIN employee e ON r.emp_id = e.emp_id
            QUALIFY row_number() OVER (PARTITION BY e.company_name ORDER BY r.seq DESC) = 1)
        SELECT 't' || CAST(c_custkey AS VARCHAR) AS tenant_id, 'channels' AS list,
               CAST(0 AS INTEGER) AS pos, c_mktsegment AS value FROM customer
        UNION ALL SELECT 't' || CAST(c_custkey AS VARCHAR), 'channels', 1, c_name FROM customer
        UNION ALL SELECT 't' || CAST(c_custkey AS VARCHAR), 'categories', 0, c_mktsegment
        FROM customer
        UNION ALL SELECT company_name, 'channels', 0, c_name FROM sent
        UNION ALL SELECT company_name, 'channels', 1, c_mktsegment FROM sent
        UNION ALL SELECT company_name, 'categories', 0, c_mktsegment FROM sent
        UNION ALL SELECT company_name, 'levels', 0, emp_id FROM sent""",
}


def all_oracles() -> dict[str, str]:
    bodies = {**_OPERATORS, **_JOBS}
    # The photos a delete lists are those of the manifest on its own.
    for job, manifest in (("customer", "manifest"), ("package", "packages"), ("item", "items")):
        bodies[f"chg_{job}_delete_assets"] = bodies[f"asset_purge_{manifest}"]
    return {name: _with_views(body.strip()) for name, body in bodies.items()}
