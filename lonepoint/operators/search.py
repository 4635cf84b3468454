"""Nearest points without a radius, for few plain coordinates.

Counts of a pyramid of cells, deeper in crowded places, tell for each query how large a ball is sure to hold enough
points; only that ball is searched.  A query in a crowd looks at a small ball, a lonely one at a large ball with few points in it, and nobody
starts from a radius that is wrong for one of the two.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import SLACK, Space, finite, number_sql
from ..session import written
from .joins import _near, collapse_copies, knn_join, nearest_first

#: Coordinates up to which balls are covered with cells.
MAX_AXES = 3
#: Cells with more than so many times the points asked for are counted finer, by so many halvings at once.
CROWD = 4
STEP = 8
#: Halvings, over all axes, to the coarse cells that tell on which levels their points are searched.
COARSE = 14


def _ordinary(space: Space) -> Column:
    return functools.reduce(lambda a, b: a & b, [finite(F.col(c)) for c in space.coords()])


def nearest_anywhere(
    queries: DataFrame, points: DataFrame, n: int, space: Space, exclude_self: bool = True
) -> DataFrame:
    """The n nearest points of each query, however far: ``(qid, nid, d, rank)``, exact, ties by id.

    All points but the query's own id if there are fewer.  Vectors with a null, NaN or infinite coordinate neither ask
    nor answer; without points there are no rows.  Long vectors and other metrics go through ``knn_join``.

    Points are sent once to each level of cells that some query searches around them; a cell above the size of a task is cut
    by the join.
    """
    if not space.flat or space.dims > MAX_AXES:
        return knn_join(queries, points, n, space, exclude_self=exclude_self)
    keep = n + 1 if exclude_self else n
    names = space.coords()
    stored = space.project(collapse_copies(points, keep), "id").where(_ordinary(space))
    box = stored.agg(
        F.count(F.lit(1)), *[F.min(c) for c in names], *[F.max(c) for c in names]
    ).first()
    asked = space.project(queries, F.col("id").alias("qid")).where(_ordinary(space))
    if not box[0]:
        none = asked.where(F.lit(False))
        return none.select("qid", F.col("qid").alias("nid"), F.lit(0.0).alias("d"), F.lit(0).alias("rank"))
    rows, low, high = box[0], box[1 : 1 + space.dims], box[1 + space.dims :]
    root = max(b - a for a, b in zip(low, high)) * (1 + SLACK)
    if not math.isfinite(root):
        raise ValueError("the coordinates are too far apart for their difference to be a number")
    # The cells must be wider than the rounding of the coordinates, or neighbours of a cell could be taken for others.
    finest = max([abs(v) for v in (*low, *high)] + [1e-300]) * 1e-9
    root = max(root, finest)
    deepest = int(math.log2(root / finest))
    first = min(deepest, math.ceil(math.log2(rows) / space.dims))
    counts = _pyramid(stored, keep, space, low, root, first, deepest)
    searched = written(_balls(asked, counts, keep, space, low, high, root, deepest), "search")

    side = f"({number_sql(root)} / pow(2D, level))"
    last = "(cast(pow(2D, level) as bigint) - 1L)"

    def cell(at: str, i: int) -> str:
        return f"greatest(0L, least({last}, floor(({at} - {number_sql(low[i])}) / {side})))"

    left = searched
    for i, c in enumerate(names):
        left = left.withColumn(f"c{i}", F.explode(F.expr(f"sequence({cell(f'({c} - ub)', i)}, {cell(f'({c} + ub)', i)})")))
    part = F.struct("level", *[f"c{i}" for i in range(space.dims)]).alias("part")
    cells = left.select("level", *[f"c{i}" for i in range(space.dims)])
    left = left.select("qid", "ub", part, *names)
    right = _on_levels(stored, cells, min(deepest, COARSE // space.dims), names, cell)
    for i, c in enumerate(names):
        right = right.withColumn(f"c{i}", F.expr(cell(c, i)))
    right = right.select(part, F.col("id").alias("nid"), *space.prefixed(right, "n"))
    pairs = _near(left, right, space).where(F.col("d") <= F.col("ub"))
    if exclude_self:
        pairs = pairs.where(F.col("qid") != F.col("nid"))
    return nearest_first(pairs.select("qid", "nid", "d"), n)


def _on_levels(
    stored: DataFrame, cells: DataFrame, coarse: int, names: list[str], cell: Callable[[str, int], str]
) -> DataFrame:
    """Points once for each ``level`` on which one of the cells lies in, or around, their coarse cell."""
    keys = [f"k{i}" for i in range(len(names))]
    reached = cells.select("level", *[
        F.expr(
            f"if(level >= {coarse}, array(shiftright(c{i}, level - {coarse})), "
            f"sequence(shiftleft(c{i}, {coarse} - level), shiftleft(c{i} + 1L, {coarse} - level) - 1L))"
        ).alias(k)
        for i, k in enumerate(keys)
    ]).distinct()
    for k in keys:
        reached = reached.withColumn(k, F.explode(k))
    reached = reached.groupBy(*keys).agg(F.collect_set("level").alias("levels"))
    placed = stored.withColumn("level", F.lit(coarse)).withColumns({k: F.expr(cell(c, i)) for i, (k, c) in enumerate(zip(keys, names))})
    return placed.drop("level").join(reached, keys).withColumn("level", F.explode("levels")).drop("levels", *keys)


def _place(space: Space, at: list[str], low: list, root: float, deepest: int) -> list[Column]:
    """Cells of the deepest level, one column for each axis."""
    side, top = number_sql(root / 2**deepest), 2**deepest - 1
    return [F.expr(f"least({top}L, floor(({c} - {number_sql(v)}) / {side}))").alias(f"f{i}") for i, (c, v) in enumerate(zip(at, low))]


def _above(i: int, deepest: int, step: int = 0) -> Column:
    """A deepest cell's cell on the row's level, on one axis, or one next to it."""
    return F.expr(f"shiftright(f{i}, {deepest} - level) + {step}L").alias(f"c{i}")


def _pyramid(
    stored: DataFrame, keep: int, space: Space, low: list, root: float, first: int, deepest: int
) -> DataFrame:
    """Points of the cells ``(level, c0, .., n)``, on finer levels only inside of crowded cells.

    A count that is missing makes a ball larger than it had to be, never too small.
    """
    places, axes = [f"f{i}" for i in range(space.dims)], [f"c{i}" for i in range(space.dims)]
    cells = stored.select(*_place(space, space.coords(), low, root, deepest)).groupBy(*places).agg(F.count(F.lit(1)).alias("n"))
    cells, tables, done, until = written(cells, "search-cells"), [], -1, first
    while True:
        levels = F.explode(F.sequence(F.lit(done + 1), F.lit(until))).alias("level")
        counts = cells.select(*places, "n", levels).groupBy("level", *[_above(i, deepest) for i in range(space.dims)])
        tables.append(written(counts.agg(F.sum("n").alias("n")), "search-counts"))
        crowded = tables[-1].where((F.col("level") == until) & (F.col("n") > CROWD * keep)).select(*axes)
        if until == deepest or crowded.isEmpty():
            return functools.reduce(DataFrame.unionByName, tables)
        inside = cells.withColumn("level", F.lit(until))
        inside = inside.select(*places, "n", *[_above(i, deepest) for i in range(space.dims)])
        cells = inside.join(crowded, axes, "left_semi").select(*places, "n")
        done, until = until, min(deepest, until + STEP)


def _balls(
    asked: DataFrame, counts: DataFrame, keep: int, space: Space, low: list, high: list, root: float, deepest: int
) -> DataFrame:
    """Queries with ``ub``, the radius of a ball that holds ``keep`` points, and the ``level`` to search it on.

    The block of cells around a query's own holds only points within two sides along each axis.  Queries outside of
    the box of all points are moved to its border first, which adds the way there to the radius.
    """
    names = space.coords()
    places, axes = [f"f{i}" for i in range(space.dims)], [f"c{i}" for i in range(space.dims)]
    every = F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level")
    moved = [f"greatest(least({c}, {number_sql(b)}), {number_sql(a)})" for c, a, b in zip(names, low, high)]
    way = f"sqrt({' + '.join(f'({c} - {m}) * ({c} - {m})' for c, m in zip(names, moved))})"
    at_home = asked.select("qid", *names, F.expr(way).alias("way"), *_place(space, moved, low, root, deepest))
    block = F.array(*[
        F.struct(*[_above(i, deepest, s) for i, s in enumerate(step)])
        for step in itertools.product((-1, 0, 1), repeat=space.dims)
    ])
    enough = (
        at_home.select("qid", *places, every)
        .select("qid", "level", F.inline(block))
        .join(counts, ["level", *axes])
        .groupBy("qid", "level")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= keep)
        .groupBy("qid")
        .agg(F.max("level").alias("enough"))
    )
    # On level 0 one cell holds all points, also where they are fewer than asked for.
    across = 2 * math.sqrt(space.dims) * root * (1 + SLACK)
    level = F.coalesce("enough", F.lit(0))
    return (
        at_home.join(enough, "qid", "left")
        .withColumn("ub", F.col("way") * F.lit(1 + SLACK) + F.lit(across) / F.pow(F.lit(2.0), level))
        .withColumn("level", F.floor(F.log2(F.lit(2 * root) / F.col("ub"))).cast("int"))
        .select("qid", *names, "ub", F.greatest(F.lit(0), F.least(F.lit(deepest), F.col("level"))).alias("level"))
    )
