"""Column expressions that keep MySQL's NULL, division and cast rules on Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest UNSIGNED BIGINT and the size of its range.
_UNSIGNED_MAX = "18446744073709551615"
_UNSIGNED_RANGE = "18446744073709551616"


def greatest_or_null(*cols: Column) -> Column:
    """GREATEST that is NULL as soon as one argument is NULL."""
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(known, F.greatest(*cols))


def share(amount: Column, part: Column, whole: Column) -> Column:
    """``amount * part / whole``, NULL when ``whole`` is zero."""
    return F.try_divide(amount * part, whole)


def leading_unsigned(text: Column) -> Column:
    """CAST(text AS UNSIGNED): leading digits, 0 without any, clamped to 64 bits."""
    sign = F.regexp_extract(text, r"^\s*([+-]?)\d", 1)
    digits = F.regexp_extract(text, r"^\s*[+-]?0*(\d*)", 1)
    wide = "decimal(38,0)"
    number = (
        F.when(digits == "", F.lit(0).cast(wide))
        .when(F.length(digits) > 20, F.lit(_UNSIGNED_MAX).cast(wide))
        .otherwise(F.least(digits.try_cast(wide), F.lit(_UNSIGNED_MAX).cast(wide)))
    )
    wrapped = F.greatest(
        F.lit(_UNSIGNED_RANGE).cast(wide) - number, F.lit("9223372036854775808").cast(wide)
    )
    value = F.when((sign == "-") & (number > 0), wrapped).otherwise(number)
    return F.when(text.isNotNull(), value.cast("decimal(20,0)"))


def filled(col: Column) -> Column:
    """True for a text that is neither NULL nor empty."""
    return F.coalesce(col != "", F.lit(False))


def flag(col: Column) -> Column:
    """A presence flag with NULL read as absent."""
    return F.coalesce(col, F.lit(False))


def number_or_null(text: Column) -> Column:
    return F.trim(text).try_cast("double")
