"""Filters and key lookups. ``keys`` is a DataFrame with the key column; without
it every row answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.operators.keyed import keep_keys
from parcelyard.schemas import ITEM_OPEN, PENDING, SECRET_COLUMNS


def customers_by_key(customers: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return keep_keys(customers, keys, "customer_id", one_each=True)


def addresses_by_key(addresses: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return keep_keys(addresses, keys, "address_id", one_each=True)


def addresses_of_customer(addresses: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return keep_keys(addresses, keys, "customer_id")


def unclaimed_packages(packages: DataFrame) -> DataFrame:
    return packages.filter(F.col("customer_id").isNull())


def open_items_of_package(items: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return keep_keys(items.filter(F.col("item_status") == ITEM_OPEN), keys, "tracking_number")


def subbox_by_key(subbox: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return keep_keys(subbox, keys, "subbox_id", one_each=True)


def box_by_key(box: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return keep_keys(box, keys, "box_id", one_each=True)


def items_of_box(items: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return keep_keys(items.filter(F.col("box_id").isNotNull()), keys, "box_id")


def slips_of_box(slip: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return keep_keys(slip, keys, "box_id")


def subboxes_of_box(subbox: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return keep_keys(subbox, keys, "box_id")


def pending_appointments(appointment: DataFrame, as_of: dt.date) -> DataFrame:
    """Pending pickups that start after the midnight one day before ``as_of``."""
    since = dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=1)
    start = F.col("start_date")
    return appointment.filter(
        (F.col("status") == PENDING)
        & (start > F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz"))
    ).withColumn("formatted_start_date", F.date_format(start, "yyyy-MM-dd"))


def without_secrets(employee: DataFrame) -> DataFrame:
    return employee.drop(*SECRET_COLUMNS)


def company_owner_accounts(employee: DataFrame) -> DataFrame:
    return without_secrets(employee).filter(F.col("company_name") == F.col("username"))


def employee_by_key(employee: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    staff = without_secrets(employee)
    if keys is None:
        return staff
    wanted = keys.select("emp_id").distinct()
    return staff.join(wanted, "emp_id", "left_semi").select(*staff.columns)
