"""Text keys without regard to case, as a case-insensitive database compares them.

Give the tables of a lookup, join or aggregate the collation first: equality, grouping
and order of their text keys then ignore case, in whatever operator they go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark's names of the two ways to compare.
ANY_CASE, EXACT = "UTF8_LCASE", "UTF8_BINARY"

# Text columns that rows are found by.
TEXT_KEYS = (
    "customer_id", "tracking_number", "box_id", "old_id", "emp_id", "username", "company_name", "photo_name", "file_name",
)


def _collated(rows: DataFrame, collation: str, names: tuple[str, ...] | None) -> DataFrame:
    def column(field: T.StructField):
        if isinstance(field.dataType, T.StringType) and (names is None or field.name in names):
            return F.collate(F.col(f"`{field.name}`"), collation).alias(field.name)
        return F.col(f"`{field.name}`")

    return rows.select(*[column(f) for f in rows.schema.fields])


def any_case(rows: DataFrame, names: tuple[str, ...] = TEXT_KEYS) -> DataFrame:
    """The rows with text keys that compare without regard to case; values stay as written."""
    return _collated(rows, ANY_CASE, names)


def exact_case(rows: DataFrame) -> DataFrame:
    """The rows with all text compared exactly again, for a result that is stored or joined on."""
    return _collated(rows, EXACT, None)
