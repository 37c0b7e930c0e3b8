"""Cutting lineage in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, named by ``spark.checkpoint.dir`` or set before.

    Where it is unset, a folder in the warehouse, which all executors share too.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        named = spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/checkpoints"
        spark.sparkContext.setCheckpointDir(named)
        current = spark.sparkContext.getCheckpointDir() or named
    return current


def settle(keys: DataFrame) -> DataFrame:
    """Store a key set once; adaptive execution decides by its real size how to join it."""
    ensure_checkpoint_dir(keys.sparkSession)
    return keys.checkpoint()
