"""Lenient casts: the numeric prefix of a string, as far as it goes; never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX, INT_MAX = 2**63 - 1, 2**31 - 1


def prefix_long(c: Column) -> Column:
    """The whole number that a string begins with, 0 without one; clamped to 64 bits."""
    digits = F.regexp_extract(c, r"^\s*([-+]?\d+)", 1)
    value = F.when(digits == "", F.lit("0")).otherwise(digits).cast("decimal(38,0)")
    return F.when(c.isNotNull(), F.greatest(F.lit(-LONG_MAX - 1).cast("decimal(38,0)"), F.least(F.lit(LONG_MAX).cast("decimal(38,0)"), value))).cast("bigint")


def prefix_double(c: Column) -> Column:
    """The number that a string begins with, 0.0 without one."""
    digits = F.regexp_extract(c, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.when(c.isNotNull(), F.when(digits == "", F.lit(0.0)).otherwise(digits.cast("double")))


def lenient(c: Column, source: str, target: str) -> Column:
    """A field's values as another type. Types: integer, integer64, real, string, boolean, date, datetime."""
    text = source == "string"
    whole = prefix_long(c) if text else F.round(c.cast("double")).cast("bigint") if source == "real" else c.cast("bigint")
    if target == "integer":
        return F.greatest(F.lit(-INT_MAX - 1), F.least(F.lit(INT_MAX), whole)).cast("int")
    if target == "integer64":
        return whole
    if target == "real":
        return prefix_double(c) if text else c.cast("double")
    if target == "boolean":
        return F.when(F.lower(c.cast("string")).isin("true", "t", "yes", "on"), True).otherwise(whole != 0) if text else whole != 0
    if target == "string":
        return c.cast("string")
    if target == "date":
        return F.try_to_timestamp(c.cast("string")).cast("date")
    if target == "datetime":
        return F.try_to_timestamp(c.cast("string"))
    raise ValueError(f"unknown field type {target}")
