"""Similarity joins: window pairs, range join, nearest neighbours.

All of them turn a distance condition into an equi-join on a partition key and
leave the distance as a residual test.  The probing side is copied to the
partitions its ball touches, the stored side stays in its home partition.

Keys are exploded with the outer form throughout: for the plain one Spark adds
a filter that computes the exploded expression a second time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import SLACK, Space, grid_width
from ..session import joined, spread, written
from . import line
from .blocks import BLOCK_ROWS, block_join
from .routes import PivotRoute, Route, grid_route, nearest_pivot
from .training import draw_pivots

# Upper bound on the stored rows of one join key.
CHUNK_ROWS = 1 << 20
MIN_CHUNK = 64
# A block join has a price per block, so its blocks may be longer than a window.
MIN_BLOCK = 1 << 11


def window_pairs(
    probes: DataFrame,
    stored: DataFrame,
    *,
    slide: int,
    span: int,
    radius: float,
    space: Space,
    route: Route | None = None,
    chunk: int | None = None,
    keep: line.Recent | line.Skyband | None = None,
) -> DataFrame:
    """Pairs of points that share a window and lie within the radius.

    Both inputs have ``id``, ``sl`` and the coordinates of ``space``; probes may
    also bring the slides ``first .. last`` beyond which nothing matters.  The
    result is ``(id, sl, nid, nsl, d)``, with the column ``n`` of the stored
    side if it has one, and holds each probe's pair with itself if its slide is
    searched, so that a probe without neighbours is not lost in an aggregate.

    The join key is (partition, id chunk).  Ids are unique, so a chunk of C
    ids holds at most C rows however crowded a partition is, and the work grows
    with the length of the stream, not with its square.

    ``keep`` says what bounded list of earlier neighbours the pairs are for.  On one coordinate only the pairs that can be
    on it are made then, in sorted slides; otherwise all pairs are returned.
    """
    if keep is not None and route is None and "n" not in stored.columns and line.usable(space, slide, span):
        if "first" not in probes.columns:
            probes = probes.withColumns({"first": F.col("sl") - (span - 1), "last": F.col("sl") - 1})
        return line.line_pairs(probes, stored, slide, span, radius, keep)
    route = route or grid_route(space, radius)
    blocks = uses_blocks(space)
    least, most = (MIN_BLOCK, BLOCK_ROWS) if blocks else (MIN_CHUNK, CHUNK_ROWS)
    size = chunk or max(least, min(most, slide * span))
    if "first" not in probes.columns:
        probes = probes.withColumns({"first": F.col("sl") - (span - 1), "last": F.col("sl") + (span - 1)})
    reach = F.expr(f"sequence(first * {slide}L div {size}L, ((last + 1) * {slide}L - 1L) div {size}L)")

    left = route.with_reach(probes.select("id", "sl", "first", "last", *space.coords()), space)
    left = (
        left.withColumn("part", F.explode_outer("parts"))
        .drop("parts")
        .withColumn("chunk", F.explode_outer(reach))
    )
    weight = ["n"] if "n" in stored.columns else []
    right = route.with_home(stored.select("id", "sl", *weight, *space.coords()), space).select(
        "part",
        F.expr(f"id div {size}L").alias("chunk"),
        F.col("id").alias("nid"),
        F.col("sl").alias("nsl"),
        *weight,
        *space.prefixed(stored, "n"),
    )
    found = ["id", "sl", "nid", "nsl", "d", *weight]
    timely = F.col("nsl").between(F.col("first"), F.col("last"))
    if blocks:
        # The probes of a chunk are cut by their own chunk, so that both sides
        # of a block are bounded.
        left = left.withColumn("own", F.expr(f"id div {size}L"))
        near = span * slide // size + 1
        right = right.withColumn("own", F.explode_outer(F.sequence(F.col("chunk") - near, F.col("chunk") + near)))
        pairs = block_join(left, right, ["part", "chunk", "own"], radius, same=("id", "nid"))
        return pairs.where(timely).select(*found)
    d = F.when(F.col("nid") == F.col("id"), F.lit(0.0)).otherwise(space.distance("", "n"))
    return (
        joined(left, right, "part", "chunk")
        .withColumn("d", d)
        .where(timely & (F.col("d") <= F.lit(float(radius))))
        .select(*found)
    )


def uses_blocks(space: Space) -> bool:
    """Long vectors of known length are compared block by block."""
    return space.metric is None and space.dims is not None and not space.flat


def _crowded(rows: DataFrame, target: int, name: str) -> DataFrame:
    """Partitions with more than ``target`` rows, and into how many to cut them."""
    return (
        rows.groupBy("part")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > target)
        .select("part", F.ceil(F.col("rows") / target).alias(name))
    )


def _salted(left: DataFrame, right: DataFrame, space: Space) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cut crowded partitions by id hash; both sides and the keys to join on.

    The stored side is cut, and for blocks the probing side too; the other side
    is copied to the cuts.  Only partitions above the target are listed, so the
    lists are short; Spark decides from their size whether to broadcast them.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    blocks = uses_blocks(space)
    target = BLOCK_ROWS if blocks else CHUNK_ROWS
    cuts = _crowded(right, target, "cuts")
    n = F.coalesce("cuts", one)
    right = right.join(cuts, "part", "left").withColumn("salt", F.pmod(F.xxhash64("nid"), n)).drop("cuts")
    probes = left.join(cuts, "part", "left")
    probes = probes.withColumn("salt", F.explode_outer(F.sequence(zero, n - 1))).drop("cuts")
    if not blocks:
        # A number first: rows are then sorted by it and not by arrays of cells.
        keys = ["_cell", "part", "salt"]
        probes, right = (x.withColumn("_cell", F.xxhash64("part")) for x in (probes, right))
        return probes, right, keys
    slices = _crowded(left, target, "slices")
    n = F.coalesce("slices", one)
    probes = probes.join(slices, "part", "left").withColumn("slice", F.pmod(F.xxhash64("qid"), n)).drop("slices")
    right = right.join(slices, "part", "left")
    right = right.withColumn("slice", F.explode_outer(F.sequence(zero, n - 1))).drop("slices")
    return probes, right, ["part", "salt", "slice"]


def _near(
    left: DataFrame,
    right: DataFrame,
    space: Space,
    radius: float | None = None,
    limit: int | None = None,
    bound: str | None = None,
) -> DataFrame:
    """Pairs of the same partition within the radius, with all columns but the vectors, and ``d``.

    ``limit`` and ``bound`` (a column of the left side) let blocks return only the nearest pairs.
    """
    left, right, keys = _salted(left, right, space)
    if uses_blocks(space):
        if limit is not None:
            # Few blocks, each with all its pairs to compare.
            left, right = spread(left, *keys), spread(right, *keys)
        return block_join(left, right, keys, radius, limit, bound=bound)
    pairs = joined(left, right, *keys).withColumn("d", space.distance("", "n"))
    if radius is not None:
        pairs = pairs.where(F.col("d") <= F.lit(float(radius)))
    return pairs.drop(*keys, *space.coords(), *space.coords("n"))


def range_join(
    queries: DataFrame, points: DataFrame, radius: float, space: Space, route: Route | None = None
) -> DataFrame:
    """All points within the radius of each query: ``(qid, nid, d)``."""
    route = route or grid_route(space, radius)
    left = route.with_reach(space.project(queries, F.col("id").alias("qid")), space)
    left = left.withColumn("part", F.explode_outer("parts")).drop("parts")
    right = route.with_home(space.project(points, "id"), space)
    right = right.select("part", F.col("id").alias("nid"), *space.prefixed(right, "n"))
    return _near(left, right, space, radius).select("qid", "nid", "d")


def nearest_first(pairs: DataFrame, n: int | None = None) -> DataFrame:
    """Number each query's pairs by distance, then id; keep the first n if given.

    With a limit Spark trims every map task to n rows per query before the
    shuffle.
    """
    order = Window.partitionBy("qid").orderBy("d", "nid")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def range_limit_join(
    queries: DataFrame, points: DataFrame, radius: float, n: int, space: Space, route: Route | None = None
) -> DataFrame:
    """The n nearest points within the radius: ``(qid, nid, d, rank)``."""
    return nearest_first(range_join(queries, points, radius, space, route), n)


def pivot_prune_join(
    queries: DataFrame, points: DataFrame, radius: float, space: Space, pivots: Sequence[Sequence[float]]
) -> DataFrame:
    """Range join that first compares distances to the pivots.

    By the triangle inequality, two points whose distances to a pivot differ by
    more than the radius are no pair.  Rings of one radius around the home
    pivot therefore are part of the join key; unless vectors are compared block
    by block, the other pivots are looked at before the vectors themselves.
    """
    route, width = PivotRoute(pivots, radius), grid_width(radius)
    reach = radius * (1 + SLACK)

    def ring(distance: Column) -> Column:
        return F.floor(distance / F.lit(width))

    left = space.project(queries, F.col("id").alias("qid")).withColumn("pd", route.distances(space))
    left = route.with_reach(left, space).withColumn("pivot", F.explode_outer("parts")).drop("parts")
    mine = ring(F.get("pd", F.col("pivot").cast("int")))
    left = left.withColumn("ring", F.explode_outer(F.sequence(mine - 1, mine + 1)))
    left = left.withColumn("part", F.struct("pivot", "ring")).drop("pivot", "ring")
    right = space.project(points, "id").withColumn("npd", route.distances(space))
    right = route.with_home(right, space).withColumnRenamed("part", "pivot")
    right = right.select(
        F.struct("pivot", ring(F.get("npd", F.col("pivot").cast("int"))).alias("ring")).alias("part"),
        F.col("id").alias("nid"), "npd", *space.prefixed(right, "n"),
    )
    apart = F.exists(F.zip_with("pd", "npd", lambda a, b: F.abs(a - b) > F.lit(reach)), lambda x: x)
    if uses_blocks(space):
        return _near(left.drop("pd"), right.drop("npd"), space, radius).select("qid", "nid", "d")
    left, right, keys = _salted(left, right, space)
    return (
        joined(left, right, *keys)
        .where(~apart)
        .select("qid", "nid", space.distance("", "n").alias("d"))
        .where(F.col("d") <= F.lit(float(radius)))
    )


def collapse_copies(points: DataFrame, keep: int) -> DataFrame:
    """Of points with equal vectors, the ``keep`` smallest ids.

    Ties in distance are broken by id, so no other copy can be among a query's
    first ``keep`` neighbours: nothing of the answer is lost.
    """
    order = Window.partitionBy("value").orderBy("id")
    return points.withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") <= keep).drop("_copy")


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    n: int,
    space: Space,
    pivots: Sequence[Sequence[float]] | None = None,
    exclude_self: bool = True,
) -> DataFrame:
    """The n nearest points of each query: ``(qid, nid, d, rank)``, exact.

    First each query looks into the part of its nearest pivot, which bounds its
    n-th distance.  Then it visits only the parts that the bound cannot rule
    out.  A query whose first part is too small stays unbounded and visits all
    of them.  Blocks compare many rows at the price of moving a query once, so
    there a part is a group of neighbouring cells; otherwise it is one cell.
    """
    pivots = pivots or draw_pivots(points)
    keep = n + 1 if exclude_self else n
    bounded = collapse_copies(points, keep)
    stored = space.project(bounded, "id").withColumn("_pd", space.distances_to(pivots))
    stored = stored.select(
        nearest_pivot("_pd").alias("cell"),
        F.col("id").alias("nid"),
        *space.prefixed(stored, "n"),
    )
    parts = list(range(len(pivots)))
    if uses_blocks(space):
        stored = written(stored, "knn-points")
        rows = {r["cell"]: r["count"] for r in stored.groupBy("cell").count().collect()}
        parts = cell_groups(pivots, [rows.get(i, 0) for i in parts], BLOCK_ROWS)
    numbers = F.expr(f"array({', '.join(f'{p}L' for p in parts)})")

    def part_of(cell: Column) -> Column:
        return F.get(numbers, cell.cast("int"))

    stored = stored.withColumn("part", part_of(F.col("cell"))).drop("cell")
    asked = space.project(queries, "id").withColumn("pd", space.distances_to(pivots))
    asked = asked.select(
        F.col("id").alias("qid"), part_of(nearest_pivot("pd")).alias("home"), nearest_pivot("pd").alias("cell"),
        "pd", F.array_min("pd").alias("pmin"), *space.coords(),
    )

    def candidates(left: DataFrame) -> DataFrame:
        """Pairs of the query's part; from blocks only the nearest ones."""
        pairs = _near(left, stored, space, limit=keep, bound="ub" if "ub" in left.columns else None)
        if "ub" in left.columns:
            pairs = pairs.where(F.col("ub").isNull() | (F.col("d") <= F.col("ub")))
        if exclude_self:
            pairs = pairs.where(F.col("qid") != F.col("nid"))
        return pairs.select("qid", "nid", "d")

    own = asked.select("qid", F.col("home").alias("part"), *space.coords())
    local = nearest_first(candidates(own), n)
    if uses_blocks(space):
        # Used three times below.
        local = written(local, "knn-local")
    bounds = local.groupBy("qid").agg(
        F.max(F.when(F.col("rank") == n, F.col("d"))).alias("ub")
    )
    # Every member of cell j is nearer to c_j than to any other pivot, so it is
    # at least half the difference of the query's two pivot distances away.
    numbered = F.sequence(F.lit(0).cast("bigint"), F.lit(len(pivots) - 1).cast("bigint"))
    reached = F.filter(
        numbered,
        lambda j: (j != F.col("cell"))
        & (
            F.col("ub").isNull()
            | (
                F.get("pd", j.cast("int")) - F.col("pmin")
                <= F.col("ub") * 2 * (1 + SLACK)
            )
        ),
    )
    others = asked.join(bounds, "qid", "left").withColumn(
        "parts", F.array_except(F.transform(reached, part_of), F.array("home"))
    )
    others = others.select("qid", "parts", "ub", *space.coords())
    if uses_blocks(space):
        others = written(others, "knn-routes")
    rest = candidates(others.withColumn("part", F.explode("parts")).drop("parts"))
    return nearest_first(local.select("qid", "nid", "d").unionByName(rest), n)


def cell_groups(pivots: Sequence[Sequence[float]], rows: Sequence[int], most: int) -> list[int]:
    """Number of the group of each pivot's cell, by the rows of the cells.

    The pivots are lined up, each next to the nearest one left, and the line is cut where a group would get more
    than ``most`` rows; a cell is not split.
    """
    matrix = np.asarray(pivots, dtype=float)
    of, left = np.zeros(len(matrix), dtype=int), np.ones(len(matrix), dtype=bool)
    at = group = held = 0
    for _ in range(len(matrix)):
        if held and held + rows[at] > most:
            group, held = group + 1, 0
        of[at], left[at], held = group, False, held + rows[at]
        at = int(np.where(left, ((matrix - matrix[at]) ** 2).sum(axis=1), np.inf).argmin())
    return of.tolist()
