"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorloom.config import EPSILON

INFINITY = float("inf")


def rain_temp_ratio(rain: Column, temperature: Column) -> Column:
    """rain / (temperature + 1); a zero divisor gives a signed infinity, or NULL for no rain."""
    base = temperature + 1.0
    return (
        F.when(base != 0, rain / base)
        .when((base == 0) & (rain > 0), F.lit(INFINITY))
        .when((base == 0) & (rain < 0), F.lit(-INFINITY))
    )


def relative_change(now: Column, before: Column) -> Column:
    return (now - before) / (F.abs(before) + EPSILON)


def standard_anomaly(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / (std + EPSILON)


def is_infinite(c: Column) -> Column:
    return F.abs(c) == INFINITY


def is_not_finite(c: Column) -> Column:
    """True for NULL, NaN and both infinities."""
    return c.isNull() | F.isnan(c) | is_infinite(c)


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)
