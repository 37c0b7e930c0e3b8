"""Joins between the tables, and the tenant directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.operators.keyed import distinct_keys, keep_keys, on
from parcelyard.operators.lookups import without_secrets
from parcelyard.schemas import ITEM_BOXED, ITEM_OPEN, TENANT
from parcelyard.sources.checkpoints import settle

# Names of tenants that may be sent to every task: some ten bytes each.
MAX_SENT_TENANTS = 100_000


def customer_by_tracking(
    customers: DataFrame, packages: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    """The customer behind each claimed tracking number."""
    owned = keep_keys(
        packages.select(TENANT, "tracking_number", "customer_id").dropna(subset=["customer_id"]),
        keys,
        "tracking_number",
        one_each=True,
    )
    who = customers.select(TENANT, "customer_id", "contact", "type", "level", "note")
    return owned.join(who, on("customer_id")).select(
        TENANT, "tracking_number", "customer_id", "contact", "type", "level", "note"
    )


def company_staff(employee: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """Staff of the callers' companies, the company accounts left out.

    Each employee comes once; a caller finds the colleagues by ``company_name``.
    """
    directory = without_secrets(employee)
    staff = directory.filter(F.col("username") != F.col("company_name"))
    if callers is None:
        return staff
    asking = callers.select("emp_id").distinct()
    companies = directory.join(asking, "emp_id", "left_semi").select("company_name").distinct()
    return staff.join(companies, "company_name", "left_semi").select(*directory.columns)


def fully_packed_packages(items: DataFrame) -> DataFrame:
    """Tracking numbers all of whose known item statuses are boxed."""
    boxed = F.col("item_status") == ITEM_BOXED
    return (
        items.filter(F.col("tracking_number").isNotNull())
        .groupBy(*on("tracking_number"))
        .agg(F.bool_and(boxed).alias("_packed"))
        .filter("_packed")
        .select(*on("tracking_number"))
    )


def packages_not_fully_packed(packages: DataFrame, items: DataFrame) -> DataFrame:
    packed = fully_packed_packages(items)
    return packages.join(packed, on("tracking_number"), "left_anti").select(*packages.columns)


def customers_with_open_items(
    packages: DataFrame, items: DataFrame, only: DataFrame | None = None
) -> DataFrame:
    """Customers owning a package with an open item, once each."""
    owned = packages.select(TENANT, "tracking_number", "customer_id").filter(
        F.col("customer_id").isNotNull()
    )
    open_items = items.filter(F.col("item_status") == ITEM_OPEN)
    if only is None:
        holding = keep_keys(owned, open_items, "tracking_number", one_each=True)
    else:
        # Few packages: they may go to the items, which then need no shuffle.
        asked = keep_keys(owned, only, "customer_id")
        holding = asked.join(open_items.select(*on("tracking_number")), on("tracking_number"))
    return distinct_keys(holding, "customer_id")


def tenant_of_employee(requests: DataFrame, employee: DataFrame) -> DataFrame:
    """Add the database and company an employee works in; unknown employees drop out."""
    directory = employee.select(
        "emp_id", F.col("emp_database").alias(TENANT), F.col("company_name")
    )
    return requests.join(directory, "emp_id")


def of_tenants(rows: DataFrame, tenants: DataFrame) -> DataFrame:
    """Rows of the listed tenants.

    Of stored tables only their folders are read: a list of up to ``MAX_SENT_TENANTS``
    is sent to the tasks and reaches the scan as a dynamic partition filter; a longer one
    is joined. The comparison tells the optimizer that the list is worth it, and leaves
    out a tenant without a name.
    """
    listed = settle(tenants.select(TENANT).distinct())
    few = listed.count() <= MAX_SENT_TENANTS
    listed = listed.filter(F.length(TENANT) > 0)
    return rows.join(F.broadcast(listed) if few else listed, TENANT, "left_semi").select(*rows.columns)


def rows_of_employees(rows: DataFrame, asked: DataFrame, employee: DataFrame) -> DataFrame:
    """What the employees in ``asked`` (``emp_id``) may see of a table: their tenants' rows."""
    return of_tenants(rows, tenant_of_employee(asked.select("emp_id").distinct(), employee))
