"""Changes of appointments and staff."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.functions.values import flag
from parcelyard.operators.changes import insert_rows, number_rows, update_by_key
from parcelyard.schemas import OWNER_ROLE, PICKUP_MINUTES, TENANT

Tables = Mapping[str, DataFrame]

_PICKUP = ["note", "address_pickup", "phone_pickup", "name_pickup", "position", "vehicle"]


def appointment_insert(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """Half-hour pickups; the title is the customer. Wall clock, no zone shift.

    A request whose date or time cannot be read is refused.
    """
    base = tables["appointment"]
    start = F.concat_ws(" ", "pickupdate", "pickupTime").try_cast("timestamp_ntz")
    rows = changes.withColumns(
        {
            "start_date": start,
            "end_date": start + F.make_dt_interval(mins=F.lit(PICKUP_MINUTES)),
            "customer_id": F.col("title"),
        }
    ).filter(F.col("start_date").isNotNull())
    return {
        "appointment": insert_rows(base, number_rows(base, rows, "appoint_id"), "appointment")
    }


def appointment_edit(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """A request with a status changes only that, any other the pickup details."""
    requests = changes.withColumns(
        {"_status": flag(F.col("has_status")), "_details": ~flag(F.col("has_status"))}
    )
    return {
        "appointment": update_by_key(
            tables["appointment"],
            requests,
            "appoint_id",
            optional={"status": "_status", **{c: "_details" for c in _PICKUP}},
        )
    }


def employee_insert(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """New staff of the acting employee's company and database."""
    base = tables["employee"]
    actors = base.select(F.col("emp_id").alias("actor_id"), "emp_database", "company_name")
    rows = changes.withColumnRenamed("emp_id", "actor_id").join(actors, "actor_id")
    numbered = number_rows(base, rows.drop("eimg"), "emp_id", scope=None)
    return {"employee": insert_rows(base, numbered)}


def employee_edit(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    return {
        "employee": update_by_key(
            tables["employee"], changes, "emp_id", ["username", "emp_name", "role"], scope=()
        )
    }


def employee_delete(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """Owners and staff without a role cannot be removed."""
    base = tables["employee"]
    asked = changes.select("emp_id").distinct().withColumn("_asked", F.lit(True))
    removable = flag(F.col("_asked")) & flag(F.col("role") != OWNER_ROLE)
    return {
        "employee": base.join(asked, "emp_id", "left").filter(~removable).select(*base.columns)
    }


def log_append(tables: Tables, entries: DataFrame) -> dict[str, DataFrame]:
    base = tables["logedit"]
    return {"logedit": base.unionByName(entries.select(TENANT, "Detail", "type", "emp_id"))}
