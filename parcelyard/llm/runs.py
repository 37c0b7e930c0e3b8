"""SHA-256 of long sequences of texts, one pass per sequence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256_of_runs(
    rows: DataFrame, key: str, order: Sequence[str], text: Column, separator: str, name: str
) -> DataFrame:
    """Per ``key`` the SHA-256, in hex, of its texts in ``order`` with ``separator`` between.

    The digest takes its texts one after another, so those of a key meet in one task;
    they stream through it, sorted (and spilled) by Spark, and none is held.
    """
    kind = rows.schema[key].dataType.simpleString()
    between = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            keys, found = [], []
            for this, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or this != current:
                    if digest is not None:
                        keys.append(current)
                        found.append(digest.hexdigest())
                    current, digest = this, hashlib.sha256()
                else:
                    digest.update(between)
                digest.update(part.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(found, pa.string())], names=[key, name])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], batch.column(0).type), pa.array([digest.hexdigest()])], names=[key, name])

    dealt = rows.select(key, *order, text.alias("_text")).repartition(key).sortWithinPartitions(key, *order)
    return dealt.select(key, F.col("_text")).mapInArrow(run, f"`{key}` {kind}, {name} string")
