"""Dense balls around free centres, for long vectors and any metric.

A ball of half the radius around any point holds points that are all within the radius of each other, so with more
than k of them in a slide they settle one another as the members of a dense cell do.  Centres are chosen in
rounds: the next few points by a hash of their id become centres unless an earlier one is near, and what they
cover leaves; a hash draws crowded places in proportion to their points, so large clusters go first.  Which centres
are found steers how much is settled early, never the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import SLACK, Space, finite

#: Points drawn in a round, fewer if they are long.
PER_ROUND = 64
ROUND_BYTES = 1 << 22
#: Rounds end when one covers less than this share of all points: the rest is not clustered.
LEAST_SHARE = 1 / 64


def _usable(points: DataFrame, space: Space) -> DataFrame:
    right = F.col("value").isNotNull() & F.forall("value", finite)
    if space.dims is not None:
        right = right & (F.size("value") == space.dims)
    return points.where(right).select(F.col("id").cast("bigint").alias("id"), F.col("value").cast("array<double>").alias("value"))


def free_centres(points: DataFrame, radius: float, space: Space, least: int) -> tuple[tuple[float, ...], ...]:
    """Centres of balls with half the radius that hold many points, none in the ball of another.

    Each round draws ``PER_ROUND`` of the points that are still outside, which the driver sees, and counts what
    each covers; those with more than ``least`` points become centres.  No more rounds come when a round's centres cover
    less than ``LEAST_SHARE`` of all points.  Vectors of no declared length have no centres.
    """
    if space.dims is None or space.flat:
        return ()
    usable = _usable(points, space).withColumn("draw", F.xxhash64("id"))
    half = radius / 2 * (1 - SLACK)
    count = max(1, min(PER_ROUND, ROUND_BYTES // (8 * space.dims)))
    centres: list[tuple[float, ...]] = []
    total, rest, last = usable.count(), usable, None
    while total:
        # A point is drawn once: rounds go upwards in the hash.
        later = rest if last is None else rest.where(F.col("draw") > last)
        drawn = later.orderBy("draw", "id").limit(count).collect()
        if not drawn:
            break
        last = drawn[-1]["draw"]
        chosen = _apart([tuple(r["value"]) for r in drawn], points.sparkSession, space, half)
        nearest = rest.select(space.distances_to(chosen).alias("d")).where(F.array_min("d") <= half)
        sizes = nearest.groupBy(F.array_position("d", F.array_min("d")).alias("at")).count().where(F.col("count") > least).collect()
        centres += [chosen[r["at"] - 1] for r in sorted(sizes)]
        if sum(r["count"] for r in sizes) < LEAST_SHARE * total:
            break
        rest = usable.where(F.array_min(space.distances_to(centres)) > half)
    return tuple(centres)


def _apart(vectors: list[tuple[float, ...]], spark, space: Space, half: float) -> list[tuple[float, ...]]:
    """Of a few vectors in order, those that lie in no ball of one before them."""
    rows = spark.createDataFrame([(i, list(v)) for i, v in enumerate(vectors)], "id bigint, value array<double>")
    found = rows.select("id", space.distances_to(vectors).alias("d")).collect()
    matrix = np.array([r["d"] for r in sorted(found, key=lambda r: r["id"])], dtype=float)
    kept: list[int] = []
    for i in range(len(vectors)):
        if not (matrix[i, kept] <= half).any():
            kept.append(i)
    return [vectors[i] for i in kept]
