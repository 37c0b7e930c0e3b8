"""Hash-seeded numbers that other engines can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(*parts: Column) -> Column:
    """Parts as one text; a null part reads ``null``."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def digest52(text: Column) -> Column:
    """The first 13 hexadecimal digits of the MD5 digest, as a number below 2**52."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def uniform(text: Column) -> Column:
    """A double in [0, 1) seeded by a text, exact to 52 bits."""
    return digest52(text) / F.lit(float(1 << 52))
