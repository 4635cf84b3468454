"""Vector columns: coordinates, distances, distance bands."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vectors up to this length travel as plain double columns, so that distances
# stay inside whole-stage codegen; longer ones travel as arrays.
FLAT_DIMS = 8

# Every pruning key is widened (or, for dense cells, narrowed) by this share of
# the radius, so that rounding can never hide a pair the distance test accepts.
SLACK = 1e-3

# Cell indices are only trusted up to this size: beyond it the rounding of
# x / width could exceed SLACK.  Larger values share the outermost cell.
MAX_CELL = 4e12


def finite(x: Column) -> Column:
    """True for ordinary numbers, false for null, NaN and the infinities."""
    return F.coalesce(F.abs(x) <= F.lit(1.7976931348623157e308), F.lit(False))


def euclidean(a: Column, b: Column, same_length: bool = False) -> Column:
    """Euclidean distance of two array columns over their common prefix."""
    if not same_length:
        n = F.least(F.size(a), F.size(b))
        a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def cell_index(x: Column, width: float) -> Column:
    """Integer cell of a coordinate; values that are not numbers go to cell 0."""
    scaled = F.greatest(F.least(x / F.lit(width), F.lit(MAX_CELL)), F.lit(-MAX_CELL))
    return F.when(finite(x), F.floor(scaled)).otherwise(F.lit(0).cast("bigint"))


def grid_width(radius: float) -> float:
    """Cell width whose +-1 neighbourhood covers everything within radius."""
    return radius * (1 + SLACK) if radius > 0 else 1.0


def distance_band(d: Column, radii: Sequence[float]) -> Column:
    """0-based index of the smallest radius that covers d; len(radii) = none."""
    ordered = sorted(set(radii))
    return F.size(F.filter(F.array(*[F.lit(float(r)) for r in ordered]), lambda r: r < d))


@dataclass(frozen=True)
class Metric:
    """A distance of two array columns, and what plans may rely on.

    ``axis`` says that two coordinates differ by at most so many times the distance, which lets grids and
    boundaries partition by coordinates.  ``diameter`` is the largest distance within a cell of side 1, by the number
    of coordinates, and must grow in proportion with the side; it tells how small a dense cell has to be.
    """

    function: Callable[[Column, Column], Column]
    axis: float | None = None
    diameter: Callable[[int], float] | None = None

    def __call__(self, a: Column, b: Column) -> Column:
        return self.function(a, b)


def _gaps(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


#: Sum and maximum of the coordinates' differences.
MANHATTAN = Metric(lambda a, b: F.aggregate(_gaps(a, b), F.lit(0.0), lambda t, x: t + x), 1.0, float)
CHEBYSHEV = Metric(lambda a, b: F.aggregate(_gaps(a, b), F.lit(0.0), lambda t, x: F.greatest(t, x)), 1.0, lambda n: 1.0)


@dataclass(frozen=True)
class Space:
    """How vectors are laid out and compared.

    ``dims`` is the common vector length; ``None`` allows ragged vectors, which
    are compared over their common prefix.  ``metric`` replaces the Euclidean
    distance and receives two array columns; as a ``Metric`` it says what it
    allows.  ``centres`` are the middles of balls that take the place of dense
    cells where cells are unknown or too many; they only steer the plan.
    """

    dims: int | None = None
    metric: Callable[[Column, Column], Column] | None = None
    centres: tuple[tuple[float, ...], ...] = ()

    @property
    def flat(self) -> bool:
        return self.metric is None and self.dims is not None and self.dims <= FLAT_DIMS

    def coords(self, prefix: str = "") -> list[str]:
        if self.flat:
            return [f"{prefix}x{i}" for i in range(self.dims)]
        return [f"{prefix}value"]

    def project(self, points: DataFrame, *keep: Column | str) -> DataFrame:
        """Points as the columns in ``keep`` followed by the coordinates.

        A declared length is checked: another one is an error.  A null vector or
        coordinate counts as NaN, which is near to nothing, and so does a vector
        without coordinates where no length is declared.
        """
        value = F.col("value").cast("array<double>")
        nan = F.lit(float("nan"))
        if self.dims is None:
            held = F.coalesce(F.size(value), F.lit(0)) > 0
            return points.select(*keep, F.when(held, value).otherwise(F.array(nan)).alias("value"))
        size = F.size(value)
        wrong = F.raise_error(F.concat(F.lit(f"a vector has not {self.dims} coordinates but "), size.cast("string")))
        value = (
            F.when(F.col("value").isNull(), F.array_repeat(nan, self.dims))
            .when(size == self.dims, value)
            .otherwise(wrong)
        )
        if not self.flat:
            return points.select(*keep, F.transform(value, lambda x: F.coalesce(x, nan)).alias("value"))
        checked = points.select(*keep, value.alias("_checked"))
        names = checked.columns[:-1]
        return checked.select(
            *names, *[F.coalesce(F.get("_checked", F.lit(i)), nan).alias(f"x{i}") for i in range(self.dims)]
        )

    def prefixed(self, df: DataFrame, prefix: str) -> list[Column]:
        return [F.col(c).alias(f"{prefix}{c}") for c in self.coords()]

    def axis(self, i: int) -> Column:
        return F.col(f"x{i}") if self.flat else F.get("value", F.lit(i))

    @property
    def axis_bound(self) -> float | None:
        """How far coordinates can be apart at distance 1, if that is known."""
        return 1.0 if self.metric is None else getattr(self.metric, "axis", None)

    @property
    def cell_axes(self) -> int:
        """Axes used for grid cells; the distance test settles the others."""
        return min(self.dims or 1, 3)

    def distance(self, left: str = "", right: str = "n") -> Column:
        if self.flat:
            return _root([(F.col(a), F.col(b)) for a, b in zip(self.coords(left), self.coords(right))])
        return self._arrays(F.col(f"{left}value"), F.col(f"{right}value"))

    def between(self, a: Column, b: Column) -> Column:
        """Distance of two structs that hold the coordinates."""
        if self.flat:
            return _root([(a[c], b[c]) for c in self.coords()])
        return self._arrays(a["value"], b["value"])

    def distance_to(self, vector: Sequence[float]) -> Column:
        """Distance of each row to a fixed vector."""
        if self.flat:
            return F.expr(self._root_sql(vector))
        return self._arrays(F.col("value"), F.expr(_array_sql(vector)))

    def distances_to(self, vectors: Sequence[Sequence[float]]) -> Column:
        """Array of each row's distances to some fixed vectors."""
        if self.flat:
            return F.expr(f"array({', '.join(self._root_sql(v) for v in vectors)})")
        if self.metric is None and self.dims is not None:
            return _batched_distances(vectors, F.col("value"))
        fixed = F.expr(f"array({', '.join(_array_sql(v) for v in vectors)})")
        return F.transform(fixed, lambda v: self._arrays(F.col("value"), v))

    def distances_to_many(self, vectors: Sequence[Sequence[float]]) -> Column:
        """The same for lists that are too long for the text of a plan."""
        if self.metric is None and self.dims is not None:
            return _batched_distances(vectors, F.array(*self.coords()) if self.flat else F.col("value"))
        return self.distances_to(vectors)

    def _root_sql(self, vector: Sequence[float]) -> str:
        squares = [f"({c} - {number_sql(v)}) * ({c} - {number_sql(v)})" for c, v in zip(self.coords(), vector)]
        return f"sqrt({' + '.join(squares)})"

    def _arrays(self, a: Column, b: Column) -> Column:
        if self.metric is not None:
            return self.metric(a, b)
        return euclidean(a, b, same_length=self.dims is not None)

    def dense_cell(self, radius: float) -> Column:
        """Key of a cell whose members are all within radius of each other.

        Null for vectors with a coordinate that is not an ordinary number, and
        always null under a metric for which no such cell is known.  With centres
        the cell is the nearest one's ball of half the radius, null outside of it.
        """
        if self.centres and not self.flat:
            return self._nearest_centre(radius)
        diameter = getattr(self.metric, "diameter", None)
        if self.metric is not None and (diameter is None or self.dims is None):
            return F.lit(None).cast("bigint")
        if radius == 0:
            parts = [self.axis(i) for i in range(self.dims)] if self.flat else None
            key = F.array(*parts) if parts else F.col("value")
            return F.when(F.forall(key, finite), key)
        if self.flat:
            side = radius / math.sqrt(self.dims) * (1 - SLACK)
            scaled = [F.col(c) / F.lit(side) for c in self.coords()]
            ok = scaled[0].between(-MAX_CELL, MAX_CELL)
            for s in scaled[1:]:
                ok = ok & s.between(-MAX_CELL, MAX_CELL)
            cells = [F.floor(s) for s in scaled]
            return F.when(ok, cells[0] if self.dims == 1 else F.array(*cells))
        value = F.col("value")
        across = F.sqrt(F.size(value)) if diameter is None else F.lit(diameter(self.dims))
        side = F.lit(radius * (1 - SLACK)) / across
        ok = F.forall(value, lambda x: F.coalesce(F.abs(x / side) <= F.lit(MAX_CELL), F.lit(False)))
        return F.when(ok, F.transform(value, lambda x: F.floor(x / side)))

    def _nearest_centre(self, radius: float) -> Column:
        d = self.distances_to(self.centres)
        inside = F.lit(radius / 2 * (1 - SLACK))
        # Computed once: the first centre that is nearest, if it is near enough.
        found = F.transform(F.array(d), lambda x: F.when(F.array_min(x) <= inside, F.array_position(x, F.array_min(x))))
        return F.get(found, F.lit(0))


def _batched_distances(vectors: Sequence[Sequence[float]], value: Column) -> Column:
    """Distances computed in batches; what is not a number, which batches return as null, is NaN again."""
    return F.transform(_distances_udf(vectors)(value), lambda d: F.coalesce(d, F.lit(float("nan"))))


def _distances_udf(vectors: Sequence[Sequence[float]]):
    """Distances of long vectors to a few fixed ones, a batch of rows at a time."""
    fixed = np.asarray(vectors, dtype=float)

    @F.pandas_udf("array<double>")
    def distances(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        rows = np.stack(values.to_numpy()).astype(float)
        columns = [np.sqrt(((rows - v) ** 2).sum(axis=1)) for v in fixed]
        return pd.Series(list(np.stack(columns, axis=1)))

    return distances


def number_sql(x: float) -> str:
    """A double literal.  Long lists of fixed numbers go into plans as SQL text."""
    return f"({float(x)!r}D)"


def _array_sql(vector: Sequence[float]) -> str:
    if not len(vector):
        return "cast(array() as array<double>)"
    return f"array({', '.join(number_sql(v) for v in vector)})"


def _root(pairs: list[tuple[Column, Column]]) -> Column:
    total = None
    for a, b in pairs:
        square = (a - b) * (a - b)
        total = square if total is None else total + square
    return F.sqrt(total)
