"""Small typed tables written by hand."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

from parcelyard.schemas import SCHEMAS


def table(spark, name, rows):
    schema = SCHEMAS[name]

    def value(field, row):
        v = row.get(field.name, "t" if field.name == "tenant_id" else None)
        if isinstance(field.dataType, T.DecimalType) and v is not None:
            return Decimal(str(v))
        if isinstance(field.dataType, T.DoubleType) and v is not None:
            return float(v)
        return v

    return spark.createDataFrame(
        [tuple(value(f, r) for f in schema.fields) for r in rows], schema
    )


def tables(spark, **named):
    out = {name: table(spark, name, []) for name in SCHEMAS}
    out |= {name: table(spark, name, rows) for name, rows in named.items()}
    return out


def requests(spark, columns, rows):
    """Rows of tenant 't'; ``columns`` is a DDL string without the tenant."""
    return spark.createDataFrame([("t", *r) for r in rows], f"tenant_id string, {columns}")


def pairs(df, *columns):
    return sorted(
        (tuple(r) for r in df.select(*columns).collect()),
        key=lambda r: tuple((v is not None, str(v)) for v in r),
    )
