"""Calendar columns of a date."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months of the Indian meteorological seasons.
SEASONS = {
    "is_monsoon": (6, 7, 8, 9),
    "is_summer": (3, 4, 5),
    "is_post_monsoon": (10, 11),
    "is_winter": (12, 1, 2),
}


def calendar_parts(date: Column) -> dict[str, Column]:
    """Year down to day; Monday is day_of_week 0 and weeks are ISO weeks."""
    return {
        "year": F.year(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "week": F.weekofyear(date),
        "day": F.day(date),
        "day_of_week": F.weekday(date),
        "day_of_year": F.dayofyear(date),
    }


def calendar_flags(date: Column) -> dict[str, Column]:
    return {
        "is_month_start": (F.day(date) == 1).cast("int"),
        "is_month_end": (F.to_date(date) == F.last_day(date)).cast("int"),
        "is_weekend": (F.weekday(date) >= 5).cast("int"),
    }


def month_cycle(date: Column) -> dict[str, Column]:
    angle = F.month(date) * (2 * math.pi) / 12
    return {"month_sin": F.sin(angle), "month_cos": F.cos(angle)}


def day_of_year_cycle(date: Column) -> dict[str, Column]:
    days = F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))
    angle = F.dayofyear(date) * (2 * math.pi) / days
    return {"day_of_year_sin": F.sin(angle), "day_of_year_cos": F.cos(angle)}


def season_flags(date: Column) -> dict[str, Column]:
    return {name: F.month(date).isin(*months).cast("int") for name, months in SEASONS.items()}


def calendar_columns(date: Column) -> dict[str, Column]:
    """All 18 calendar columns."""
    return {
        **calendar_parts(date),
        **calendar_flags(date),
        **month_cycle(date),
        **day_of_year_cycle(date),
        **season_flags(date),
    }
