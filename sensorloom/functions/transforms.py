"""Named target transforms, each a pair of column functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnFunction = Callable[[Column], Column]


@dataclass(frozen=True)
class Transform:
    forward: ColumnFunction
    inverse: ColumnFunction
    # True where the forward transform cannot take the value.
    rejects: ColumnFunction


_REGISTRY: dict[str, Transform] = {}


def register_transform(
    name: str,
    forward: ColumnFunction,
    inverse: ColumnFunction,
    rejects: ColumnFunction = lambda c: F.lit(False),
) -> None:
    _REGISTRY[name] = Transform(forward, inverse, rejects)


def get_transform(name: str) -> Transform:
    if name not in _REGISTRY:
        raise ValueError(f"unknown transform '{name}'; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


register_transform("identity", lambda c: c, lambda c: c)
register_transform("log1p", F.log1p, F.expm1, rejects=lambda c: c < 0)
