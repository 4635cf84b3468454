"""Dense cells: how far a point has to look for its neighbours.

A dense cell is so small that all of its members are neighbours.  As soon as
the slides next to a point hold more than k members of its own cell, every
window with these slides makes it an inlier, and neighbours beyond them cannot
change any answer.  All of this follows from counts per cell and slide, so a
crowded place costs no pairs among its own points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.slides import windows_of
from ..functions.vectors import Space

# Slides per window-function partition, in multiples of the window.
BLOCK_SPANS = 32


def cell_slides(pts: DataFrame, space: Space, radius: float) -> DataFrame:
    """Members per dense-cell key and slide: ``(dcell, sl, n)``."""
    return (
        pts.select(space.dense_cell(radius).alias("dcell"), "sl")
        .where(F.col("dcell").isNotNull())
        .groupBy("dcell", "sl")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def search_spans(pts: DataFrame, space: Space, radius: float, k: int, span: int) -> DataFrame:
    """How far members of a cell have to look: ``(dcell, sl, first, last, earlier)``.

    The slides ``first .. sl`` hold more than k members of the cell, and so do
    the slides ``sl .. last`` and ``earlier .. sl - 1``.  Older or newer slides
    never matter.  A bound is null where the cell is too sparse; cells without
    any bound are left out.
    """
    # Long runs of slides are cut into blocks that overlap by one window, so a
    # cell that is busy for ever is not one task.
    block = span * BLOCK_SPANS
    own = F.floor(F.col("sl") / block)
    blocks = F.array_distinct(
        F.array(F.floor((F.col("sl") - span) / block), own, F.floor((F.col("sl") + span) / block))
    )
    cell = Window.partitionBy("dcell", "blk")
    until_now = cell.orderBy("sl").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = cell.orderBy("start").rangeBetween(0, k)
    behind = cell.orderBy("stop").rangeBetween(-k, 0)
    return (
        cell_slides(pts, space, radius)
        .withColumn("blk", F.explode_outer(blocks))
        .withColumn("stop", F.sum("n").over(until_now))
        .withColumn("start", F.col("stop") - F.col("n"))
        # Both frames end with the slide in which the (k+1)-th member is met,
        # or with the last one there is.
        .withColumn("next", F.max(F.struct("sl", "stop")).over(ahead))
        .withColumn("prev", F.min(F.struct("sl", "start")).over(behind))
        .withColumn("first", F.when(F.col("stop") - F.col("prev.start") > k, F.col("prev.sl")))
        .withColumn("earlier", F.lag("first").over(cell.orderBy("sl")))
        .where(F.col("blk") == own)
        .select(
            "dcell", "sl", "first",
            F.when(F.col("next.stop") - F.col("start") > k, F.col("next.sl")).alias("last"),
            "earlier",
        )
        .where("first is not null or last is not null or earlier is not null")
    )


def with_search_span(
    pts: DataFrame, space: Space, radius: float, k: int, longest: int, shortest: int | None = None
) -> DataFrame:
    """Points with the slides ``first .. last`` that can matter to them.

    ``longest`` and ``shortest`` are the extreme window lengths in slides.
    ``settled`` marks points that are inliers in all their windows: each window
    of the shortest length holds all of ``first .. sl`` or all of ``sl .. last``.
    ``safe`` marks those that are inliers by their own slide alone.
    """
    spans = search_spans(pts, space, radius, k, longest)
    shortest = shortest or longest
    settled = F.coalesce(F.col("last") - F.col("first") <= shortest, F.lit(False))
    safe = F.coalesce(F.col("last") == F.col("sl"), F.lit(False))
    first = F.greatest(F.col("sl") - (longest - 1), F.col("first"))
    last = F.least(F.col("sl") + (longest - 1), F.col("last"))
    return (
        pts.withColumn("dcell", space.dense_cell(radius))
        .join(spans, ["dcell", "sl"], "left")
        .select(
            "id", "sl", first.alias("first"), last.alias("last"),
            settled.alias("settled"), safe.alias("safe"), *space.coords(),
        )
    )


def unsettled_points(
    pts: DataFrame, space: Space, radius: float, k: int, longest: int, shortest: int | None = None
) -> DataFrame:
    """The points that still need a neighbour search."""
    return with_search_span(pts, space, radius, k, longest, shortest).where(~F.col("settled")).drop("settled", "safe")


def looking_back(pts: DataFrame, space: Space, radius: float, k: int, span: int) -> DataFrame:
    """Points with the earlier slides that can hold their k most recent neighbours."""
    spans = search_spans(pts, space, radius, k, span).select("dcell", "sl", "earlier")
    first = F.greatest(F.col("sl") - (span - 1), F.col("earlier"))
    return (
        pts.withColumn("dcell", space.dense_cell(radius))
        .join(spans, ["dcell", "sl"], "left")
        .select("id", "sl", first.alias("first"), (F.col("sl") - 1).alias("last"), *space.coords())
        .where(F.col("first") <= F.col("last"))
    )


def dense_cells(pts: DataFrame, space: Space, radius: float, k: int, span: int) -> DataFrame:
    """Cells with more than k members in a window: ``(e, dcell, n)``."""
    return (
        cell_slides(pts, space, radius)
        .withColumn("e", F.explode_outer(windows_of(F.col("sl"), span)))
        .groupBy("e", "dcell")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > k)
    )


def outside_dense_cells(pts: DataFrame, space: Space, radius: float, k: int, span: int) -> DataFrame:
    """Points with the windows in which no dense cell holds them: ``(e, id)``."""
    return (
        pts.select("id", space.dense_cell(radius).alias("dcell"), F.explode_outer(windows_of(F.col("sl"), span)).alias("e"))
        .join(dense_cells(pts, space, radius, k, span), ["e", "dcell"], "left_anti")
        .select("e", "id")
    )
