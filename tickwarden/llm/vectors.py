"""Vectors as exact integers, shared by the searches.

A component x weighs ``floor(scale * x)``, computed as a double.  Rows
whose weights stay within ``NARROW`` are held as numbers of a fixed width,
with which products cannot overflow; others ("wide" rows) as Python
integers, so that every score is exact.  Scores travel as
``DECIMAL(38,0)``: beyond 38 digits they count as equal, and a result
column of type long holds the nearest long.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
NARROW = 1 << 20
SCORE = "decimal(38,0)"
_MOST = 10**38 - 1
_LONGS = (-(1 << 63), (1 << 63) - 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str, **others: Column) -> DataFrame:
    """(vec_id, x array<double>, others): rows with an id and a vector whose
    components are all finite."""
    x = F.col(vector_col)
    good = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    return vectors.where(good).select(
        F.col(id_col).cast("bigint").alias("vec_id"), x.cast("array<double>").alias("x"),
        *[c.alias(name) for name, c in others.items()],
    )


def exact(x: np.ndarray, scale: int = SCALE) -> list[int]:
    """A vector's weights as Python integers."""
    return [math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in map(float, x)]


class Rows:
    """The rows of a block: a matrix of the narrow ones, the wide ones apart."""

    def __init__(self, vectors: list, scale: int = SCALE) -> None:
        vectors = [np.asarray(v, np.float64) for v in vectors]
        self.width = max((len(v) for v in vectors), default=0)
        self.matrix = np.zeros((len(vectors), self.width))
        for i, v in enumerate(vectors):
            self.matrix[i, : len(v)] = v
        with np.errstate(over="ignore"):
            self.matrix = np.floor(self.matrix * scale)
        most = np.abs(self.matrix).max(axis=1, initial=0.0)
        self.wide = {int(i): exact(vectors[i], scale) for i in np.flatnonzero(most > NARROW)}
        self.matrix[list(self.wide)] = 0.0

    def weights(self, i: int) -> list[int]:
        return self.wide.get(i) or [int(v) for v in self.matrix[i]]

    def product(self, i: int, query: list[int]) -> int:
        return sum(a * b for a, b in zip(self.weights(i), query))


def as_score(value: int) -> Decimal:
    return Decimal(max(-_MOST, min(_MOST, int(value))))


def as_long(score: Column) -> Column:
    """A score as a long; out of range: the nearest one."""
    low, high = (F.lit(Decimal(v)).cast(SCORE) for v in _LONGS)
    return F.least(F.greatest(score, low), high).cast("bigint")
