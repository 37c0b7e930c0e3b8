"""Reading the tables and writing their new state."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.schemas import ASSETS, SCHEMAS, SECRET_COLUMNS, TENANT


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A stored table, partitioned by tenant, with its declared types."""
    stored = spark.read.schema(SCHEMAS[table]).parquet(f"{root}/{table}")
    return stored.select(*SCHEMAS[table].fieldNames())


def read_tables(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in names}


def write_table(
    rows: DataFrame, root: str, table: str, mode: str = "errorifexists"
) -> None:
    """Write the full new state to a new folder, tenants as partitions.

    Rebalancing keeps files of even size and splits a tenant with very many rows.
    """
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[table].fields])
    writer = rows.hint("rebalance", *([F.col(TENANT)] if TENANT in rows.columns else []))
    out = writer.write.mode(mode).option("partitionOverwriteMode", "static")
    if TENANT in rows.columns:
        out = out.partitionBy(TENANT)
    out.parquet(f"{root}/{table}")


def write_tables(tables: Mapping[str, DataFrame], root: str) -> None:
    """Write tables, and the photos to remove as a folder of their own."""
    for name, rows in tables.items():
        if name == ASSETS:
            rows.write.parquet(f"{root}/{ASSETS}")
        else:
            write_table(rows, root, name)


def hash_predicates(column: str, partitions: int) -> list[str]:
    """Conditions that deal the rows of a text key over ``partitions`` reads, each row once."""
    name = "`" + column.replace("`", "``") + "`"
    first = f"MOD(CRC32({name}), {partitions}) = 0 OR {name} IS NULL"
    return [first, *[f"MOD(CRC32({name}), {partitions}) = {i}" for i in range(1, partitions)]]


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    tenant_id: str,
    properties: Mapping[str, str],
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
) -> DataFrame:
    """One tenant's table from its database, read in parallel by its key.

    A numeric key is read in ranges between ``bounds``, a text key by its hash.
    Credentials come in ``properties``; secrets in the table are not selected.
    """
    fields = [f for f in SCHEMAS[table].fields if f.name != TENANT]
    split: dict = {}
    if split_on and bounds:
        split = {
            "column": split_on,
            "lowerBound": bounds[0],
            "upperBound": bounds[1],
            "numPartitions": partitions,
        }
    elif split_on:
        split = {"predicates": hash_predicates(split_on, partitions)}
    rows = spark.read.jdbc(url, table, properties=dict(properties), **split)
    known = rows.drop(*SECRET_COLUMNS).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]
    )
    if TENANT in SCHEMAS[table].fieldNames():
        known = known.select(F.lit(tenant_id).alias(TENANT), *known.columns)
    return known


def append_log(entries: DataFrame, root: str) -> None:
    """Append audit rows to the log, as a batch of their own."""
    rows = entries.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS["logedit"].fields])
    # Even files, and a tenant with very many rows in several.
    even = rows.hint("rebalance", F.col(TENANT))
    even.write.partitionBy(TENANT).parquet(f"{root}/logedit/batch=a-{uuid.uuid4().hex}")
