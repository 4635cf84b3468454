"""Partition training over the whole table.

Vantage points, pivots and thresholds come from a bounded sample, which a hash of
the id draws from all rows in one pass; its number grows with the leaves.  They
steer how even the partitions are, never the result.  Under a metric of its own
a tree's thresholds are quantiles over all rows, one aggregate per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Space, finite, number_sql
from ..sources.points import sample_random

# Candidates for vantage points and pivots, and the accuracy of approximate
# quantiles: a rank is off by at most 1 / ACCURACY of the rows.
CANDIDATES = 1_024
ACCURACY = 10_000
MAX_HEIGHT = 6
#: Balls for each chunk of a ball partitioning: more make the chunks more even.
CHUNK_BALLS = 8
MAX_PIVOTS = 256
#: Sampled rows for each leaf of a tree, and bytes of a sample.
LEAF_ROWS = 256
SAMPLE_BYTES = 1 << 26


@dataclass(frozen=True)
class VantageTree:
    """Complete binary tree in heap order: node i has children 2i+1 and 2i+2."""

    nodes: list[tuple[list[float], float]]

    @property
    def leaves(self) -> int:
        return len(self.nodes) + 1


def shortest_length(points: DataFrame) -> int:
    """Length of the shortest vector of the table that has coordinates.

    Vectors of different lengths are compared over their common prefix, which is
    no metric.  Over the first ``shortest_length`` coordinates it is one, and
    never larger than the distance itself, so routes by it lose no pair.
    """
    return points.where(F.size("value") > 0).agg(F.min(F.size("value"))).first()[0] or 0


def usable_points(points: DataFrame) -> DataFrame:
    """``id, value`` of the vectors without odd coordinates, cut to the shortest length."""
    value = F.slice("value", 1, max(1, shortest_length(points)))
    cut = points.where(F.size("value") > 0).select("id", value.cast("array<double>").alias("value"))
    return cut.where(F.forall("value", finite))


def candidate_vectors(usable: DataFrame, n: int = CANDIDATES) -> np.ndarray:
    """Vectors drawn by a hash of the id from all rows, as a matrix."""
    rows = [r[0] for r in sample_random(usable, n).select("value").collect()]
    if not rows:
        raise ValueError("cannot train a partitioning on no usable vector")
    return np.array(rows, dtype=float).reshape(len(rows), -1)


@dataclass(frozen=True)
class Balls:
    """Balls that hold all points of a table, and the chunk of each.

    ``radii`` cover the points that are nearer to the centre than to any other.
    """

    centres: list[list[float]]
    radii: list[float]
    chunks: list[int]


def train_balls(points: DataFrame, chunks: int, space: Space) -> Balls:
    """Balls around drawn centres, packed into chunks of about equally many points.

    Centres are drawn from all rows, a fixed number for each chunk, so crowded
    places get more and smaller balls.  One aggregate over the table counts the
    points of each ball and takes its radius.  Balls are then lined up, each
    next to the nearest one left, and the line is cut into chunks; a chunk
    differs from its fair share by at most one ball's points.
    """
    if space.dims is None:
        raise ValueError("balls need vectors of a declared length")
    value = F.col("value").cast("array<double>")
    usable = points.where((F.size("value") == space.dims) & F.forall("value", finite))
    usable = usable.select("id", value.alias("value"))
    centres = np.unique(candidate_vectors(usable, CHUNK_BALLS * chunks), axis=0)
    measured = space.project(usable, "id").select(space.distances_to_many(centres.tolist()).alias("pd"))
    found = {
        r["ball"]: (r["radius"], r["rows"])
        for r in measured.select(F.array_min("pd").alias("d"), F.array_position("pd", F.array_min("pd")).alias("ball"))
        .groupBy("ball")
        .agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("rows"))
        .collect()
    }
    radii = [float(found.get(i + 1, (0.0, 0))[0]) for i in range(len(centres))]
    rows = [int(found.get(i + 1, (0.0, 0))[1]) for i in range(len(centres))]
    left, line = set(range(1, len(centres))), [0]
    while left:
        line.append(min(left, key=lambda i: (float(((centres[i] - centres[line[-1]]) ** 2).sum()), i)))
        left.remove(line[-1])
    of, before, total = [0] * len(centres), 0, sum(rows)
    for i in line:
        of[i] = min(chunks - 1, int((before + rows[i] / 2) * chunks / total))
        before += rows[i]
    return Balls(centres.tolist(), radii, of)


def train_pivot(points: DataFrame) -> list[float]:
    """A vector in the middle of the candidates."""
    return median_vector(candidate_vectors(usable_points(points))).tolist()


def median_vector(matrix: np.ndarray) -> np.ndarray:
    """The middle vector in lexicographic order."""
    order = np.lexsort(matrix.T[::-1])
    return matrix[order[len(order) // 2]]


def train_vantage_tree(
    points: DataFrame, partitions: int = 16, quantile: float = 0.5, space: Space = Space()
) -> VantageTree:
    height = partitions.bit_length() - 1
    if partitions < 2 or partitions != 1 << height or height > MAX_HEIGHT:
        raise ValueError(f"partitions must be a power of two from 2 to {1 << MAX_HEIGHT}")
    if space.metric is None and space.dims is not None:
        return _sampled_tree(points, height, quantile, space.dims)
    space = Space(metric=space.metric)
    usable = usable_points(points)
    members = [candidate_vectors(usable)]
    vantages: list[list[float]] = []
    thresholds: list[float] = []

    def walk(i: int, first: int) -> str:
        """Node of the level that starts at ``first`` into which a row falls."""
        if i >= first:
            return str(i)
        closer = f"_vd[{i}] <= {number_sql(thresholds[i])}"
        return f"if({closer}, {walk(2 * i + 1, first)}, {walk(2 * i + 2, first)})"

    for level in range(height):
        first = (1 << level) - 1
        vantages += [median_vector(m).tolist() for m in members]
        measured = usable.select(space.distances_to(vantages).alias("_vd"))
        placed = measured.select(F.expr(walk(0, first)).alias("node"), "_vd")
        found = dict(
            placed.groupBy("node")
            .agg(F.percentile_approx(F.get("_vd", F.col("node")), quantile, ACCURACY).alias("threshold"))
            .collect()
        )
        # A node without rows splits nothing.
        thresholds += [float(found.get(first + i, 0.0)) for i in range(1 << level)]
        below = []
        for i, inside in enumerate(members):
            d = np.sqrt(((inside - np.array(vantages[first + i])) ** 2).sum(axis=1))
            for part in (inside[d <= thresholds[first + i]], inside[d > thresholds[first + i]]):
                # A side that got no candidate keeps its parent's, so that the
                # tree stays complete.
                below.append(part if len(part) else inside)
        members = below
    return VantageTree(list(zip(vantages, thresholds)))


def _sampled_tree(points: DataFrame, height: int, quantile: float, dims: int) -> VantageTree:
    """A tree from one sample, for vectors of a known length."""
    value = F.col("value").cast("array<double>")
    usable = points.where((F.size("value") == dims) & F.forall("value", finite)).select("id", value.alias("value"))
    rows = min(max(CANDIDATES, LEAF_ROWS << height), max(1, SAMPLE_BYTES // (8 * dims)))
    members, nodes = [candidate_vectors(usable, rows)], []
    for _ in range(height):
        below = []
        for inside in members:
            vantage = median_vector(inside)
            d = np.sqrt(((inside - vantage) ** 2).sum(axis=1))
            threshold = float(np.quantile(d, quantile))
            nodes.append((vantage.tolist(), threshold))
            for part in (inside[d <= threshold], inside[d > threshold]):
                # A side that got no row keeps its parent's, so that the tree stays complete.
                below.append(part if len(part) else inside)
        members = below
    return VantageTree(nodes)


def train_pivots(points: DataFrame, count: int = 16) -> list[list[float]]:
    """Pivots far apart from each other, picked farthest-first from the candidates."""
    matrix = candidate_vectors(usable_points(points))
    chosen = [median_vector(matrix)]
    gap = np.sqrt(((matrix - chosen[0]) ** 2).sum(axis=1))
    while len(chosen) < count and gap.max() > 0:
        chosen.append(matrix[int(gap.argmax())])
        gap = np.minimum(gap, np.sqrt(((matrix - chosen[-1]) ** 2).sum(axis=1)))
    return [c.tolist() for c in chosen]


def draw_pivots(points: DataFrame) -> list[list[float]]:
    """About as many pivots as the root of the number of rows, drawn from all rows.

    Drawn pivots are as dense as the data, so that cells hold about equally many
    rows; the number is held between 16 and ``MAX_PIVOTS``, since every row is
    compared with every pivot.
    """
    usable = usable_points(points)
    matrix = candidate_vectors(usable, min(MAX_PIVOTS, max(16, int(usable.count() ** 0.5))))
    return np.unique(matrix, axis=0).tolist()


def train_bounds(points: DataFrame, partitions: int, axes: int = 1, accuracy: int = 10_000) -> list[list[float]]:
    """Quantile boundaries per axis, so that the cells hold about equally many points."""
    shares = [i / partitions for i in range(1, partitions)]
    row = points.agg(
        *[
            F.percentile_approx(F.get("value", F.lit(a)), shares, accuracy).alias(f"b{a}")
            for a in range(axes)
        ]
    ).first()
    return [sorted(set(row[f"b{a}"])) for a in range(axes)]


def rows_at(df: DataFrame, key: str, order: list[str], rank: int, rows: int, count: int) -> DataFrame:
    """The rows at places ``rank .. rank + rows - 1`` of the order, which begins with ``key``; exact.

    Approximate quantiles bracket the place; only the rows inside the bracket
    are sorted, a few thousandths of the table unless many share a key.
    """
    slack = 2 / ACCURACY + 1 / max(count, 1)
    shares = [max(0.0, rank / count - slack), min(1.0, (rank + rows) / count + slack)]
    low, high = df.agg(F.percentile_approx(key, shares, ACCURACY).alias("q")).first()["q"]
    below = df.where(F.col(key) < F.lit(low)).count()
    inside = df.where(F.col(key).between(F.lit(low), F.lit(high)))
    return inside.orderBy(*order).offset(rank - below).limit(rows)


def median_distance(points: DataFrame, space: Space, quantile: float = 0.5) -> DataFrame:
    """Split threshold: a quantile of all distances to the middle vector, between two rows interpolated."""
    keyed = points.select("value", F.get("value", F.lit(0)).alias("key"))
    count = keyed.count()
    middle = rows_at(keyed, "key", ["key", "value"], count // 2, 1, count).first()["value"]
    distances = space.project(points, "id").select(space.distance_to(middle).alias("d"))
    place = quantile * (count - 1)
    rank = int(place)
    near = rows_at(distances, "d", ["d"], rank, min(2, count - rank), count)
    return near.agg((F.min("d") + (F.max("d") - F.min("d")) * F.lit(place - rank)).alias("threshold"))
