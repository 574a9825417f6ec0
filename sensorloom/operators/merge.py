"""Outer joins of standardised tables behind a guard against multiplying rows.

A step reads the key columns of an input once, for all that the guard asks, and its rows once, for the
join. The join runs once: its counts, and what the next step's guard asks of the keys' use, are observed
while its rows are written. An earlier step's result needs no guard of its own as long as the key stays.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sensorloom.errors import MergeExplosionError, MergeKeyError
from sensorloom.sources.scratch import written

# Columns that describe a reading rather than measure something.
DESCRIPTORS = ("district", "station", "latitude", "longitude")

KEY_CHOICES = (("timestamp", "station"), ("timestamp", "district"))
LEFT_MARK, RIGHT_MARK = "_in_left", "_in_right"


@dataclass(frozen=True)
class MergeResult:
    rows: DataFrame
    steps: list[dict]


@dataclass(frozen=True)
class KeyCounts:
    """What the guard knows of an input: rows, key columns that hold values, and for each choice of keys
    the repeated key groups and a table of the distinct keys (timestamp, label)."""

    n_rows: int
    usable: frozenset[str]
    repeated: dict[int, int]
    keys: dict[int, DataFrame]


def guard(df: DataFrame) -> KeyCounts:
    """The key columns read once, counted for both choices of keys in one aggregate."""
    labels = [keys[1] for keys in KEY_CHOICES]
    present = {c: F.col(c) if c in df.columns else F.lit(None) for c in ("timestamp", *labels)}
    choices = F.array(
        *[F.struct(F.lit(i).alias("choice"), present[c].cast("string").alias("label")) for i, c in enumerate(labels)]
    )
    rows = df.select(present["timestamp"].alias("timestamp"), F.explode(choices).alias("one"))
    counts = rows.groupBy("one.choice", "timestamp", "one.label").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts)
    stats = counts.groupBy("choice").agg(
        F.sum("n").alias("n_rows"),
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.count("timestamp").alias("timestamps"),
        F.count("label").alias("labels"),
    )
    found = {r["choice"]: r for r in stats.collect()}
    usable = {labels[i] for i, r in found.items() if r["labels"]}
    usable |= {"timestamp"} if any(r["timestamps"] for r in found.values()) else set()
    return KeyCounts(
        n_rows=found[0]["n_rows"] if found else 0,
        usable=frozenset(usable),
        repeated={i: found[i]["repeated"] if i in found else 0 for i in range(len(labels))},
        keys={i: counts.where(F.col("choice") == i).select("timestamp", "label") for i in range(len(labels))},
    )


def select_keys(left: KeyCounts, right: KeyCounts, left_name: str, right_name: str) -> int:
    """Which of KEY_CHOICES: timestamp with station, else with district; never the timestamp alone."""
    usable = left.usable & right.usable
    for i, keys in enumerate(KEY_CHOICES):
        if usable.issuperset(keys):
            return i
    raise MergeKeyError(
        f"'{right_name}' and '{left_name}' share no usable key: a timestamp and either a station "
        f"or a district must hold values on both sides (usable: {sorted(usable)})"
    )


def outer_join_null_safe(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    suffix: str,
    repeated: str | None = None,
    left_keys: DataFrame | None = None,
    right_keys: DataFrame | None = None,
) -> DataFrame:
    """Full outer join in which NULL keys match each other.

    Colliding columns of the right side take the suffix, except descriptors, which are filled
    from it. `repeated` names the side ("left" or "right") whose keys are not unique: a full
    outer join cannot split a hot key, so that case runs as an outer join from the repeated side,
    which adaptive execution can split. The keys that only the unique side has are added to the
    repeated side as rows without values, so that both sides are read once; they come from the
    distinct keys (timestamp, label) of both sides, as the guard counted them.
    """
    lhs = left.withColumn(LEFT_MARK, F.lit(1))
    rhs = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") for c in right.columns], F.lit(1).alias(RIGHT_MARK))
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    columns = _merged_columns(left, right, keys, suffix)
    if repeated is None:
        return lhs.join(rhs, on, "full_outer").select(*columns)
    many, one, prefix = (lhs, rhs, "") if repeated == "left" else (rhs, lhs, "_r_")
    there, here = (left_keys, right_keys) if repeated == "left" else (right_keys, left_keys)
    there = there.select(F.col("timestamp").alias("_timestamp"), F.col("label").alias("_label"))
    same = F.col("timestamp").eqNullSafe(F.col("_timestamp")) & F.col("label").eqNullSafe(F.col("_label"))
    alone = here.join(there, same, "left_anti")
    source = {f"{prefix}{keys[0]}": F.col("timestamp"), f"{prefix}{keys[1]}": F.col("label")}
    empty = [source.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in many.schema.fields]
    return many.unionByName(alone.select(*empty)).join(one, on, "left_outer").select(*columns)


def _merged_columns(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> list[Column]:
    columns = []
    for c in left.columns:
        mine, theirs = F.col(f"`{c}`"), F.col(f"`_r_{c}`")
        shared = c in right.columns and (c in keys or c in DESCRIPTORS)
        columns.append((F.coalesce(mine, theirs) if shared else mine).alias(c))
    for c in right.columns:
        if c in left.columns:
            if c not in keys and c not in DESCRIPTORS:
                columns.append(F.col(f"`_r_{c}`").alias(f"{c}{suffix}"))
        else:
            columns.append(F.col(f"`_r_{c}`").alias(c))
    return [*columns, F.col(LEFT_MARK), F.col(RIGHT_MARK)]


def _observed(joined: DataFrame) -> tuple[DataFrame, dict]:
    """The joined rows, written, with what is counted on the way."""
    seen = Observation()
    in_left, in_right = F.col(LEFT_MARK).isNotNull(), F.col(RIGHT_MARK).isNotNull()
    used = [F.count(c).alias(f"n_{c}") for c in ("timestamp", "station", "district") if c in joined.columns]
    joined = joined.observe(
        seen,
        F.count(F.lit(1)).alias("rows_after"),
        F.count_if(in_left & in_right).alias("matched_rows"),
        F.count_if(in_left & ~in_right).alias("left_only_rows"),
        F.count_if(~in_left & in_right).alias("right_only_rows"),
        *used,
    )
    rows = written(joined.drop(LEFT_MARK, RIGHT_MARK))
    return rows, seen.get


def _step(
    left: DataFrame, right: DataFrame, left_name: str, right_name: str, known: KeyCounts | None
) -> tuple[DataFrame, dict, KeyCounts]:
    known = known or guard(left)
    other = guard(right)
    choice = select_keys(known, other, left_name, right_name)
    if choice not in known.repeated:  # an earlier result, whose other key nobody has counted
        known = guard(left)
    keys = list(KEY_CHOICES[choice])
    left_dup, right_dup = known.repeated[choice], other.repeated[choice]
    if left_dup and right_dup:
        raise MergeExplosionError(
            f"'{left_name}' repeats {left_dup} and '{right_name}' repeats {right_dup} keys of {keys}; "
            "joining them would multiply rows"
        )
    repeated = "left" if left_dup else "right" if right_dup else None
    joined = outer_join_null_safe(left, right, keys, f"__{right_name}", repeated, known.keys[choice], other.keys[choice])
    rows, counts = _observed(joined)
    step = {
        "left_dataset": left_name,
        "right_dataset": right_name,
        "merge_keys": keys,
        "merge_strategy": "_".join(keys),
        "validate_mode": {"left": "m:1", "right": "1:m", None: "1:1"}[repeated],
        "left_rows_before": known.n_rows,
        "right_rows_before": other.n_rows,
        "left_duplicate_key_groups": left_dup,
        "right_duplicate_key_groups": right_dup,
        **{c: counts[c] for c in ("rows_after", "matched_rows", "left_only_rows", "right_only_rows")},
    }
    # A key of the result repeats where that of the one repeating side does.
    after = KeyCounts(
        n_rows=counts["rows_after"],
        usable=frozenset(c for c in ("timestamp", "station", "district") if counts.get(f"n_{c}")),
        repeated={choice: left_dup + right_dup},
        keys={choice: known.keys[choice].union(other.keys[choice]).distinct()},
    )
    return rows, step, after


def merge_pair(
    left: DataFrame, right: DataFrame, left_name: str, right_name: str
) -> tuple[DataFrame, dict]:
    """One guarded outer join, written, and its statistics; raises when both sides repeat keys."""
    return _step(left, right, left_name, right_name, None)[:2]


def merge_all(frames: Sequence[DataFrame], names: Sequence[str] | None = None) -> MergeResult | None:
    """Fold of guarded joins; nothing for an empty list, the input itself for a single one."""
    if not frames:
        return None
    names = list(names or [f"dataset_{i}" for i in range(len(frames))])
    if len(names) != len(frames):
        raise ValueError("names must be as many as frames")
    rows, name, steps, known = frames[0], names[0], [], None
    for right, right_name in zip(frames[1:], names[1:]):
        rows, step, known = _step(rows, right, name, right_name, known)
        steps.append(step)
        name = f"({name}+{right_name})"
    return MergeResult(rows, steps)
