"""The folder that driver and executors share, and cutting lineage in it."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.sources.checkpoints import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one in the warehouse."""
    set_before = ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or set_before


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def packed(df: DataFrame, *keys: str) -> DataFrame:
    """All columns as one struct ``row``, beside copies of ``keys``.

    What an operator adds on its way cannot clash with a column of the caller's.
    """
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[df[k] for k in keys])


def unpacked(columns: Iterable[str]) -> list[Column]:
    """The columns of ``row``, under their own names."""
    return [F.col("row").getField(c).alias(c) for c in columns]


def text_key(docs: DataFrame) -> Column:
    """The MD5 of each row's text, empty where there is none."""
    return F.coalesce(F.md5(docs["text"].cast("string").cast("binary")), F.lit(""))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as a table in the shared folder and read back."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
