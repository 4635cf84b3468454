"""Routes: which partition a point lives in, and which ones its ball touches.

Every route answers two questions as plain columns.  ``with_home`` adds
``part``, the one partition of the point.  ``with_reach`` adds ``parts``, all
partitions that may hold a point within the radius, the home included.  Two
points within the radius then always meet: the home of one is in the reach of
the other.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import MAX_CELL, SLACK, Space, cell_index, finite, grid_width, number_sql
from .training import Balls, VantageTree

# Published axis boundaries of the stock, gauss, tao and fc data
# sets.  A cell holds the values up to and including its upper boundary.
PRESET_BOUNDS: dict[str, list[list[float]]] = {
    "gauss": [[0.11139, 0.68263, 1.163, 1.6835, 2.5132, 3.8782, 4.5221, 5.0112, 5.4983, 6.1691,
               8.4946, 9.3379, 9.8515, 10.33, 10.903]],
    "tao": [[-0.01], [79.23, 82.47, 85.77], [26.932]],
    "fc_2d": [[58.0, 127.0, 260.0], [0.0, 71.0, 142.0]],
    "fc_5d": [[0.56878], [0.35278], [0.19697], [0.15605], [0.26227]],
}

# Stock boundaries by number of partitions.
STOCK_BOUNDS: dict[int, list[float]] = {
    2: [100.37],
    4: [97.633, 100.37, 104.25],
    8: [94.222, 97.633, 99.25, 100.37, 102.13, 104.25, 106.65],
    12: [90.7, 95.965, 97.633, 98.75, 99.7, 100.37, 101.49, 102.84, 104.25, 105.59, 108.36],
    16: [87.231, 94.222, 96.5, 97.633, 98.5, 99.25, 99.897, 100.37, 101.16, 102.13, 103.18,
         104.25, 105.25, 106.65, 109.75],
    32: [77.457, 87.231, 91.88, 94.222, 95.59, 96.5, 97.125, 97.633, 98.074, 98.5, 98.888, 99.25,
         99.588, 99.897, 100.07, 100.37, 100.72, 101.16, 101.65, 102.13, 102.65, 103.18, 103.72,
         104.25, 104.78, 105.25, 105.79, 106.65, 107.84, 109.75, 112.14],
}
PRESET_BOUNDS["stock"] = [STOCK_BOUNDS[16]]


def _product(axes: list[list[Column]]) -> list[Column]:
    return [F.array(*combo) for combo in itertools.product(*axes)]


class Route:
    """Base of all routes."""

    def with_home(self, df: DataFrame, space: Space) -> DataFrame:
        raise NotImplementedError

    def with_reach(self, df: DataFrame, space: Space) -> DataFrame:
        raise NotImplementedError


class GridRoute(Route):
    """Uniform cells a little wider than the radius, on the first axes only."""

    def __init__(self, radius: float, axes: int | None = None):
        self.width = grid_width(radius)
        self.axes = axes

    def _cells(self, space: Space) -> list[Column]:
        n = self.axes or space.cell_axes
        return [cell_index(space.axis(i), self.width) for i in range(n)]

    def with_home(self, df, space):
        cells = self._cells(space)
        return df.withColumn("part", cells[0] if len(cells) == 1 else F.array(*cells))

    def with_reach(self, df, space):
        cells = self._cells(space)
        if len(cells) == 1:
            return df.withColumn("parts", F.sequence(cells[0] - 1, cells[0] + 1))
        around = [[c - 1, c, c + 1] for c in cells]
        return df.withColumn("parts", F.array(*_product(around)))


def grid_route(space: Space, radius: float) -> GridRoute:
    """The grid for a radius, as wide as the metric needs."""
    if space.axis_bound is None:
        raise ValueError("grid partitioning needs a metric that bounds coordinates")
    return GridRoute(radius * space.axis_bound)


class HashRoute(Route):
    """Replicate to ``width`` hash partitions, each split further by ``inner``.

    The home is ``id mod width``.  As the probing side goes to every hash
    partition, the stored side of a crowded inner partition is shared out
    evenly: this is salting with the id as the salt.
    """

    def __init__(self, width: int, inner: Route | None = None):
        self.width = int(width)
        self.inner = inner

    def _home(self) -> Column:
        return F.pmod(F.col("id"), F.lit(self.width).cast("bigint"))

    def with_home(self, df, space):
        if self.inner is None:
            return df.withColumn("part", self._home())
        df = self.inner.with_home(df, space)
        return df.withColumn("part", F.struct(self._home().alias("salt"), F.col("part").alias("cell")))

    def with_reach(self, df, space):
        salts = F.sequence(F.lit(0).cast("bigint"), F.lit(self.width - 1).cast("bigint"))
        if self.inner is None:
            return df.withColumn("parts", salts)
        df = self.inner.with_reach(df, space)
        pairs = F.flatten(
            F.transform(
                salts,
                lambda s: F.transform("parts", lambda c: F.struct(s.alias("salt"), c.alias("cell"))),
            )
        )
        return df.withColumn("parts", pairs)


class BoundsRoute(Route):
    """Cells between given boundaries on each axis, numbered from 0."""

    def __init__(self, bounds: Sequence[Sequence[float]], radius: float):
        self.bounds = [sorted(float(b) for b in axis) for axis in bounds]
        self.reach = radius * (1 + SLACK)
        self.strides = []
        cells = 1
        for axis in reversed(self.bounds):
            self.strides.insert(0, cells)
            cells *= len(axis) + 1
        self.cells = cells

    @classmethod
    def preset(cls, name: str, radius: float) -> BoundsRoute:
        """Published boundaries; ``stock:<n>`` takes those of the stock data for n partitions."""
        kind, _, count = name.partition(":")
        if not count:
            return cls(PRESET_BOUNDS[name], radius)
        if kind != "stock" or not count.isdigit() or int(count) not in STOCK_BOUNDS:
            raise ValueError(f"unknown boundaries {name!r}, expected stock:<n> with n in {sorted(STOCK_BOUNDS)}")
        return cls([STOCK_BOUNDS[int(count)]], radius)

    @staticmethod
    def _count(bounds: list[float], x: Column, inclusive: bool = False) -> Column:
        """How many boundaries are below x."""
        listed = F.expr(f"array({', '.join(number_sql(b) for b in bounds)})")
        return F.size(F.filter(listed, (lambda b: b <= x) if inclusive else (lambda b: b < x)))

    @staticmethod
    def _steps(low: Column, high: Column, stride: int):
        """From a cell number to those reached along one axis."""
        return lambda p: F.transform(F.sequence(low, high), lambda j: p + j.cast("bigint") * stride)

    def with_home(self, df, space):
        part = F.lit(0)
        for i, (axis, stride) in enumerate(zip(self.bounds, self.strides)):
            x = space.axis(i)
            part = part + self._count(axis, x) * stride
        return df.withColumn("part", part.cast("bigint"))

    def with_reach(self, df, space):
        parts = F.array(F.lit(0).cast("bigint"))
        for i, (axis, stride) in enumerate(zip(self.bounds, self.strides)):
            x = space.axis(i)
            low = self._count(axis, x - F.lit(self.reach))
            high = self._count(axis, x + F.lit(self.reach), inclusive=True)
            parts = F.flatten(F.transform(parts, self._steps(low, high, stride)))
        return df.withColumn("parts", parts)


class BandRoute(Route):
    """Rings of one radius around a fixed point."""

    def __init__(self, pivot: Sequence[float], radius: float):
        self.pivot = [float(v) for v in pivot]
        self.width = grid_width(radius)

    def _ring(self, space: Space) -> Column:
        return cell_index(space.distance_to(self.pivot), self.width)

    def with_home(self, df, space):
        return df.withColumn("part", self._ring(space))

    def with_reach(self, df, space):
        ring = self._ring(space)
        return df.withColumn("parts", F.sequence(ring - 1, ring + 1))


class VantageRoute(Route):
    """Leaves of a balanced vantage-point tree built from a sample.

    With ``rings`` each leaf is split further into rings of one radius around
    the vantage point above it, for data with many points per leaf.
    """

    def __init__(self, tree: VantageTree, radius: float, rings: bool = False):
        self.tree = tree
        self.reach = radius * (1 + SLACK)
        self.rings = rings
        self.width = grid_width(radius)

    def _ring(self, leaf: str) -> str:
        """Ring of a point around the vantage point above a leaf."""
        vantage = f"_vd[cast(({leaf} + {len(self.tree.nodes) - 1}) div 2 as int)]"
        return f"floor(least({vantage} / {number_sql(self.width)}, {number_sql(MAX_CELL)}))"

    def _measured(self, df: DataFrame, space: Space) -> DataFrame:
        # One array, not a column per node: the optimizer would otherwise derive
        # constraints for every combination of node columns.
        return df.withColumn("_vd", space.distances_to([v for v, _ in self.tree.nodes]))

    def with_home(self, df, space):
        nodes = self.tree.nodes

        def walk(i: int) -> str:
            if i >= len(nodes):
                return f"{i - len(nodes)}L"
            return f"if(_vd[{i}] <= {number_sql(nodes[i][1])}, {walk(2 * i + 1)}, {walk(2 * i + 2)})"

        df = self._measured(df, space).withColumn("part", F.expr(walk(0)))
        if self.rings:
            df = df.withColumn("part", F.expr(f"named_struct('leaf', part, 'ring', {self._ring('part')})"))
        return df.drop("_vd")

    def with_reach(self, df, space):
        nodes = self.tree.nodes

        def walk(i: int) -> str:
            """Array of the leaves below a node that the ball may touch."""
            if i >= len(nodes):
                return f"array({i - len(nodes)}L)"
            closer, farther = walk(2 * i + 1), walk(2 * i + 2)
            inner = number_sql(nodes[i][1] + self.reach)
            outer = number_sql(nodes[i][1] - self.reach)
            none = "cast(array() as array<bigint>)"
            return f"concat(if(_vd[{i}] <= {inner}, {closer}, {none}), if(_vd[{i}] > {outer}, {farther}, {none}))"

        df = self._measured(df, space).withColumn("parts", F.expr(walk(0)))
        if self.rings:
            ring = self._ring("l")
            df = df.withColumn("parts", F.expr(
                f"flatten(transform(parts, l -> transform(sequence({ring} - 1, {ring} + 1), "
                "r -> named_struct('leaf', l, 'ring', r))))"
            ))
        return df.drop("_vd")


class PivotRoute(Route):
    """Nearest of a few pivots; touches pivot j when d(x,c_j) <= d(x,home) + 2R."""

    def __init__(self, pivots: Sequence[Sequence[float]], radius: float):
        self.pivots = [[float(v) for v in p] for p in pivots]
        self.reach = 2 * radius * (1 + SLACK)

    def distances(self, space: Space) -> Column:
        return space.distances_to(self.pivots)

    def with_home(self, df, space):
        df = df.withColumn("_pd", self.distances(space))
        return df.withColumn("part", nearest_pivot("_pd")).drop("_pd")

    def with_reach(self, df, space):
        df = df.withColumn("_pd", self.distances(space)).withColumn("_pmin", F.array_min("_pd"))
        numbered = F.sequence(F.lit(0).cast("bigint"), F.lit(len(self.pivots) - 1).cast("bigint"))
        parts = F.filter(
            numbered, lambda j: F.get("_pd", j.cast("int")) <= F.col("_pmin") + F.lit(self.reach)
        )
        return df.withColumn("parts", parts).drop("_pd", "_pmin")


class BallRoute(Route):
    """Chunks of balls; a point's ball touches ball j when d(x,c_j) <= r_j + R.

    A ball holds the points that are nearest to its centre, so d(x,c_j) <=
    d(x,home) + 2R has to hold as well.  The radii are those of the table the
    balls were trained on; storing a point outside of its ball is an error.
    """

    def __init__(self, balls: Balls, radius: float):
        self.balls = balls
        self.reach = radius * (1 + SLACK)

    def _chunks(self) -> str:
        return f"array({', '.join(f'{c}L' for c in self.balls.chunks)})"

    def _limits(self, more: float) -> str:
        return f"array({', '.join(number_sql((r + more) * (1 + SLACK)) for r in self.balls.radii)})"

    def with_home(self, df, space):
        df = df.withColumn("_pd", space.distances_to_many(self.balls.centres)).withColumn("_ball", nearest_pivot("_pd"))
        d = F.array_min("_pd")
        outside = finite(d) & (d > F.expr(f"get({self._limits(0.0)}, cast(_ball as int))"))
        lost = F.raise_error(F.lit("a stored point lies outside of the balls: train them on the stored points"))
        home = F.when(outside, lost.cast("bigint")).otherwise(F.expr(f"get({self._chunks()}, cast(_ball as int))"))
        return df.withColumn("part", home).drop("_pd", "_ball")

    def with_reach(self, df, space):
        df = df.withColumn("_pd", space.distances_to_many(self.balls.centres)).withColumn("_pmin", F.array_min("_pd"))
        zipped = F.filter(
            F.arrays_zip(F.col("_pd"), F.expr(self._limits(self.reach)).alias("_limit"), F.expr(self._chunks()).alias("_chunk")),
            lambda b: (b["_pd"] <= F.col("_pmin"))
            | ((b["_pd"] <= b["_limit"]) & (b["_pd"] <= F.col("_pmin") + F.lit(2 * self.reach))),
        )
        return df.withColumn("parts", F.array_distinct(F.transform(zipped, lambda b: b["_chunk"]))).drop("_pd", "_pmin")


def nearest_pivot(distances: str) -> Column:
    """Index of the smallest distance; the first one on ties."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("bigint")


def assign(df: DataFrame, route: Route, space: Space) -> DataFrame:
    """One row per partition of each point; ``is_home`` marks the home copy."""
    routed = route.with_reach(route.with_home(df, space), space)
    home = routed.withColumnRenamed("part", "_home")
    return (
        home.withColumn("part", F.explode_outer(F.array_distinct("parts")))
        .withColumn("is_home", F.col("part") == F.col("_home"))
        .drop("_home", "parts")
    )


def drop_stale_replicas(assigned: DataFrame, newest: Column) -> DataFrame:
    """Keep home copies, and replicas only in the slide they arrived in."""
    return assigned.where(F.col("is_home") | (F.col("sl") == newest))
