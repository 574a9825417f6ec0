"""Names, fixed values and settings shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Canonical column names -------------------------------------------------

CATEGORY = "category"
DISTRICT_CODE = "district_code"
DISTRICT = "district"
STATION = "station"
TIMESTAMP = "ts"
DATE = "date"
MEASUREMENT = "measurement"
STATION_COUNT = "station_count"
TARGET = "target"
SPLIT = "split"

MASTER_KEYS = (DISTRICT_CODE, DATE)


@dataclass(frozen=True)
class Category:
    """One kind of measurement: where it comes from and what it becomes."""

    name: str
    raw_column: str
    aggregate: str
    measure: str
    count: str
    sensor_keywords: tuple[str, ...]
    low: float | None
    high: float | None


# Measurement columns, aggregates, output names and physical ranges.
CATEGORIES = (
    Category(
        "groundwater",
        "Groundwater Level Telemetry 6 Hourly (meter)",
        "mean",
        "groundwater_level",
        "groundwater_station_count",
        ("groundwater", "gwl", "ground water"),
        -1000.0,
        200.0,
    ),
    Category(
        "humidity",
        "Telemetry Hourly Relative Humidity (%)",
        "mean",
        "relative_humidity",
        "humidity_station_count",
        ("humidity", "relative humidity", "humid"),
        0.0,
        100.0,
    ),
    Category(
        "rainfall",
        "Telemetry Hourly Rainfall (mm)",
        "sum",
        "rainfall_mm",
        "rainfall_station_count",
        ("rainfall", "rain"),
        0.0,
        None,
    ),
    Category(
        "river_level",
        "River Water Level Telemetry Hourly (meter)",
        "mean",
        "river_level",
        "river_station_count",
        ("river water level", "rwl", "river level", "water level"),
        -50.0,
        10000.0,
    ),
    Category(
        "temperature",
        "Air Temperature Telemetry Hourly (AoC)",
        "mean",
        "air_temperature",
        "temperature_station_count",
        ("temperature", "temp", "aoc"),
        -60.0,
        60.0,
    ),
)

CATEGORY_BY_NAME = {c.name: c for c in CATEGORIES}
MEASURES = tuple(c.measure for c in CATEGORIES)
COUNTS = tuple(c.count for c in CATEGORIES)
MASTER_COLUMNS = (DISTRICT_CODE, DISTRICT, DATE, *MEASURES, *COUNTS)

# Text that means "missing" once it is trimmed.
SENTINELS = (
    "NA", "N/A", "NULL", "null", "na", "n/a", "None", "none", "NONE", "nan", "NaN", "--", "-",
)

# Cells that pandas reads as missing, before any trimming.
CSV_NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# File-name keywords, first match wins.
RAW_FILE_KEYWORDS = (
    ("gwl", "Groundwater"),
    ("humid", "Humidity"),
    ("rainfall", "Rainfall"),
    ("rwl", "River Level"),
    ("temperature", "Temperature"),
)
CLEANING_FILE_KEYWORDS = (
    ("gwl", "Groundwater"),
    ("groundwater", "Groundwater"),
    ("humid", "Humidity"),
    ("rainfall", "Rainfall"),
    ("rwl", "River Level"),
    ("river", "River Level"),
    ("temperature", "Temperature"),
    ("temp", "Temperature"),
)
AGGREGATION_FILE_KEYWORDS = (
    ("gwl", "groundwater"),
    ("humid", "humidity"),
    ("rainfall", "rainfall"),
    ("rwl", "river_level"),
    ("temperature", "temperature"),
)

# Audit thresholds as shares of all cells and of all rows.
FAIL_MISSING_SHARE = 0.50
FAIL_DUPLICATE_SHARE = 0.20
WARN_MISSING_SHARE = 0.20
WARN_DUPLICATE_SHARE = 0.05

CONTINUITY_WARN_GAP_DAYS = 30
SPARSE_GROUP_ROWS = 10
LEAKAGE_CORRELATION = 0.999
EPSILON = 1e-5


@dataclass(frozen=True)
class RollingSpec:
    windows: tuple[int, ...]
    stats: tuple[str, ...] = ("mean",)


@dataclass(frozen=True)
class TrendSpec:
    columns: tuple[str, ...] = ()
    intervals: tuple[int, ...] = (1, 7)
    rainfall: str = "rainfall_mm"
    temperature: str = "air_temperature"
    dry_threshold: float = 1.0
    ratio: bool = True
    spells: bool = True
    anomaly: bool = True


@dataclass(frozen=True)
class FeatureSpec:
    """Which features to build; a family set to None is skipped."""

    lags: dict[str, tuple[int, ...]] | None = None
    rolling: dict[str, RollingSpec] | None = None
    trends: TrendSpec | None = None


def default_features() -> FeatureSpec:
    """The standard set: 18 calendar, 8 lag, 15 rolling and 24 trend columns."""
    return FeatureSpec(
        lags={
            "groundwater_level": (1, 7, 30),
            "rainfall_mm": (1, 7),
            "air_temperature": (1,),
            "relative_humidity": (1,),
            "river_level": (1,),
        },
        rolling={
            "rainfall_mm": RollingSpec((7, 30), ("mean", "sum", "std", "max")),
            "groundwater_level": RollingSpec((7, 30), ("mean", "std")),
            "relative_humidity": RollingSpec((15,)),
            "air_temperature": RollingSpec((30,)),
            "river_level": RollingSpec((7,)),
        },
        trends=TrendSpec(
            columns=(
                "groundwater_level",
                "rainfall_mm",
                "air_temperature",
                "relative_humidity",
                "river_level",
            )
        ),
    )


@dataclass(frozen=True)
class TargetSpec:
    source: str = "groundwater_level"
    group: str = DISTRICT_CODE
    date: str = DATE
    horizon: int = 7
    transform: str = "identity"
    name: str = TARGET

    def __post_init__(self) -> None:
        if self.horizon <= 0:
            raise ValueError(f"horizon must be positive, got {self.horizon}")
        for label in ("source", "group", "date"):
            if not getattr(self, label):
                raise ValueError(f"{label} must not be empty")


@dataclass(frozen=True)
class SplitShares:
    train: float = 0.70
    validation: float = 0.15
    test: float = 0.15

    def __post_init__(self) -> None:
        shares = (self.train, self.validation, self.test)
        if not all(0.0 < s < 1.0 for s in shares):
            raise ValueError(f"each share must lie between 0 and 1, got {shares}")
        if abs(sum(shares) - 1.0) > 1e-6:
            raise ValueError(f"shares must sum to 1, got {sum(shares)}")


@dataclass(frozen=True)
class PrepSpec:
    target: str = TARGET
    group: str = DISTRICT_CODE
    date: str = DATE
    scale: bool = True
    min_frequency: float = 0.01
    random_state: int = 42
    drop: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        # It also bounds how many values of a column can have a column of their own.
        if not 0.0 < self.min_frequency <= 1.0:
            raise ValueError(f"min_frequency must lie above 0 and be at most 1, got {self.min_frequency}")
