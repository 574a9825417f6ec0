"""Finding columns and categories by name; works on names only, never on rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# An exact name, then keywords, for each role a column can play.
ROLES = {
    "timestamp": ("data acquisition time", ("time", "date", "timestamp", "acquisition")),
    "district": ("district", ("district", "taluka", "taluk", "division")),
    "station": ("station", ("station", "site", "sensor")),
    "latitude": ("latitude", ("latitude", "lat")),
    "longitude": ("longitude", ("longitude", "lon")),
}
DATETIME_KEYWORDS = ROLES["timestamp"][1]


def find_by_keyword(columns: Iterable[str], keywords: Sequence[str]) -> str | None:
    return next((c for c in columns if any(k in c.strip().lower() for k in keywords)), None)


def find_role(columns: Sequence[str], role: str) -> str | None:
    """The column with the role's exact name, else the first one that holds a keyword."""
    exact, keywords = ROLES[role]
    same = next((c for c in columns if c.strip().lower() == exact), None)
    return same or find_by_keyword(columns, keywords)


def find_audit_role(columns: Sequence[str], role: str) -> str | None:
    """As find_role, but only the district prefers its exact name."""
    if role == "district":
        return find_role(columns, role)
    return find_by_keyword(columns, ROLES[role][1])


def find_coordinates(columns: Iterable[str]) -> tuple[str | None, str | None]:
    """Latitude and longitude columns; the last match wins."""
    lat = lon = None
    for c in columns:
        low = c.lower()
        if "latitude" in low or low == "lat":
            lat = c
        if "longitude" in low or low == "lon":
            lon = c
    return lat, lon


def datetime_columns(columns: Iterable[str], hints: Iterable[str] = ()) -> list[str]:
    wanted = set(hints)
    return [c for c in columns if c in wanted or any(k in c.lower() for k in DATETIME_KEYWORDS)]


def category_of(name: Column, keywords: Sequence[tuple[str, str]], default: str | None) -> Column:
    """Category whose keyword comes first in the list and occurs in the file name."""
    low = F.lower(name)
    found = F.lit(default).cast("string")
    for keyword, category in reversed(keywords):
        found = F.when(low.contains(keyword), F.lit(category)).otherwise(found)
    return found


def trimmed_names(columns: Iterable[str]) -> list[str]:
    return [c.strip() for c in columns]
