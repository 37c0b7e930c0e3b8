"""Applying change files as they arrive.

Requests reach the tables one after another. Here each micro-batch of a change log
is cut into levels of jobs (see ``plans.schedule``), which are applied in turn to the
rows of the tenants that the batch names. Only these tenants' partitions of the tables
that change are written; a version lists, for every table and tenant, the version that
holds its rows. A table whose rows have come to lie in many versions is written whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelyard.operators.joins import of_tenants
from parcelyard.plans.runs import apply_runs
from parcelyard.plans.schedule import Kind, cut_levels
from parcelyard.schemas import ASSETS, SCHEMAS, TENANT
from parcelyard.sources.checkpoints import settle
from parcelyard.sources.tables import read_table, write_table

# A row of the change log: ``body`` holds the request's fields as JSON.
LOG = "tenant_id string, seq bigint, kind string, body string"
_LISTING = "name string, tenant_id string, version bigint"
# Versions over which the rows of a table may lie.
MAX_VERSIONS = 16


def snapshot(root: str, version: int) -> str:
    """The folder of what version ``version`` has written."""
    return f"{root}/v={version:012d}"


def _listing(root: str, version: int) -> str:
    return f"{root}/versions/v={version:012d}"


def read_listing(spark: SparkSession, root: str, version: int) -> DataFrame:
    """``name``, ``tenant_id`` and the ``version`` that holds a tenant's rows of a table. A
    table without tenants has one row without."""
    return spark.read.schema(_LISTING).json(_listing(root, version))


def versions_in_use(listing: DataFrame) -> dict[str, list[int]]:
    """Per table the versions that hold rows of it, at most ``MAX_VERSIONS`` and one."""
    rows = listing.select("name", "version").distinct().collect()
    return {n: sorted(r["version"] for r in rows if r["name"] == n) for n in sorted({r["name"] for r in rows})}


def read_snapshot(
    spark: SparkSession,
    root: str,
    version: int,
    names: Iterable[str] | None = None,
    tenants: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The tables as of a version, of all tenants or of those listed."""
    listing = read_listing(spark, root, version)
    held = versions_in_use(listing)
    out = {}
    for name in names or held:
        found = None
        for v in held[name]:
            rows = read_table(spark, snapshot(root, v), name)
            if len(held[name]) > 1:
                rows = of_tenants(rows, listing.filter((F.col("name") == name) & (F.col("version") == v)))
            found = rows if found is None else found.unionByName(rows)
        whole = tenants is None or TENANT not in found.columns
        out[name] = found if whole else of_tenants(found, tenants)
    return out


def _list(listing: DataFrame, root: str, version: int) -> None:
    # Sorted by table, in few files: one small row per table and tenant.
    listing.repartition("name").write.mode("overwrite").json(_listing(root, version))


def start(tables: Mapping[str, DataFrame], root: str) -> None:
    """Write ``tables`` as version 0."""
    listing = None
    for name, rows in tables.items():
        write_table(rows, snapshot(root, 0), name)
        spark = rows.sparkSession
        # At least one row per table, so that an empty one is known.
        held = spark.createDataFrame([(None,)], "tenant_id string")
        if TENANT in rows.columns:
            stored = read_table(spark, snapshot(root, 0), name).select(TENANT)
            held = held.unionByName(stored.filter(F.col(TENANT).isNotNull()).distinct())
        held = held.select(F.lit(name).alias("name"), TENANT, F.lit(0).cast("bigint").alias("version"))
        listing = held if listing is None else listing.unionByName(held)
    _list(listing, root, 0)


def apply_batch(
    spark: SparkSession, kinds: Mapping[str, Kind], changes: DataFrame, root: str, version: int
) -> None:
    """Make version ``version + 1`` from version ``version`` and a stretch of the log.

    A repeated batch writes the same folders again, so a restart changes nothing. A
    request without a tenant changes nothing.
    """
    listing = read_listing(spark, root, version)
    held = versions_in_use(listing)
    touched = settle(changes.select(TENANT).filter(F.length(TENANT) > 0).distinct())
    tables = read_snapshot(spark, root, version, tenants=touched)
    state = apply_runs(tables, cut_levels(changes, kinds), settle)
    new = snapshot(root, version + 1)
    moved = []
    for name, rows in state.items():
        if name == ASSETS:
            rows.write.mode("overwrite").parquet(f"{new}/{ASSETS}")
        elif rows is not tables.get(name):
            whole = len(held[name]) >= MAX_VERSIONS
            if whole:
                before = read_snapshot(spark, root, version, [name])[name]
                rest = before.join(touched, TENANT, "left_anti").select(*before.columns)
                rows = rows.unionByName(rest)
            write_table(rows, new, name, mode="overwrite")
            moved.append((name, whole))
    changed = [n for n, _ in moved]
    here = F.lit(version + 1).cast("bigint").alias("version")
    kept = listing.join(touched.select(TENANT, F.lit(True).alias("_touched")), TENANT, "left")
    stays = ~F.col("name").isin(changed) | F.col("_touched").isNull()
    kept = kept.filter(stays).select("name", TENANT, "version")
    for name, whole in moved:
        now = touched.select(F.lit(name).alias("name"), TENANT, here)
        if whole:
            kept = kept.withColumn("version", F.when(F.col("name") == name, here).otherwise(F.col("version")))
        kept = kept.unionByName(now)
    _list(kept, root, version + 1)


def follow_changes(
    spark: SparkSession,
    kinds: Mapping[str, Kind],
    inbox: str,
    root: str,
    progress: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Apply the JSON files of one change log found in ``inbox``, then stop."""
    feed = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).json(inbox)

    def apply(changes: DataFrame, batch: int) -> None:
        apply_batch(changes.sparkSession, kinds, changes, root, batch)

    return (
        feed.writeStream.foreachBatch(apply)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def follow_log(spark: SparkSession, inbox: str, root: str, progress: str) -> StreamingQuery:
    """Append arriving audit rows to the log."""
    rows = spark.readStream.schema(SCHEMAS["logedit"]).json(inbox)

    def append(entries: DataFrame, batch: int) -> None:
        # Each batch replaces a folder of its own, so a repeated one adds nothing. Even
        # files, and a tenant with very many rows in several.
        even = entries.hint("rebalance", F.col(TENANT))
        writer = even.write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy(TENANT).parquet(f"{root}/logedit/batch={batch:012d}")

    return (
        rows.writeStream.foreachBatch(append)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
