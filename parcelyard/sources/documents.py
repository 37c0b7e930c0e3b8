"""Uploaded text documents, one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, value) with the whole text of each file."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return spark.read.text(path, wholetext=True).select(name.alias("file_name"), "value")


def documents_scan(files: DataFrame) -> DataFrame:
    return files.select(
        "file_name",
        "value",
        F.char_length("value").alias("n_chars"),
        F.octet_length("value").alias("n_bytes"),
    )
