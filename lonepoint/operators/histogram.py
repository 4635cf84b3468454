"""Full neighbour histograms, without limits.

Points of one slide with equal vectors have the same neighbours, so the search
runs once per distinct vector and slide, against distinct vectors with their
numbers.  However many copies of a point there are, they cost one pair.  Where
distinct vectors crowd, a pyramid of cell counts replaces the pairs.  On one
coordinate sorted slides replace them all.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Space, finite
from . import line, pyramid
from .joins import window_pairs
from .routes import Route
from .windows import histogram_counts

#: A place is crowded if a cell holds so many times more sites, within a window's length, than a ball has cells.
CROWD = 4


def sites(pts: DataFrame, space: Space) -> DataFrame:
    """Distinct vectors per slide: smallest id, number of points ``n``.

    Equal vectors with a coordinate that is not an ordinary number are not near
    to each other, so each of them stays by itself.
    """
    if space.flat:
        ordinary = functools.reduce(lambda a, b: a & b, [finite(F.col(c)) for c in space.coords()])
    else:
        ordinary = F.coalesce(F.forall("value", finite), F.lit(False))
    alone = F.when(~ordinary, F.col("id")).alias("_alone")
    found = pts.groupBy("sl", *space.coords(), alone).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return found.drop("_alone")


def neighbour_histogram(
    pts: DataFrame, slide: int, span: int, radii: Sequence[float], space: Space, route: Route | None = None
) -> DataFrame:
    """Neighbours of each point per slide and radius: ``(id, sl, nsl, c0, c1, ..)``.

    Covers the slides that share a window with the point.  The point itself is
    not counted; its own slide is always listed, other slides if they hold a
    neighbour.
    """
    radii = sorted(radii)
    own = F.when(F.col("nsl") == F.col("sl"), 1).otherwise(0)
    others = [(F.col(f"c{i}") - own).alias(f"c{i}") for i in range(len(radii))]
    if line.usable(space, slide, span):
        return line.line_histogram(pts, pts, slide, span, radii, space, route).select("id", "sl", "nsl", *others)
    distinct = sites(pts, space)
    sparse, crowded = distinct, None
    if pyramid.usable(space, radii):
        # Sites whose ball may hold more of them than it has cells are looked up in the pyramid.
        crowds = pyramid.crowded_cells(distinct, span, radii[-1], space, CROWD * pyramid.CELLS[space.dims])
        placed = distinct.withColumn("home", pyramid.home_cell(space, radii[-1]))
        placed = placed.join(crowds.withColumn("crowd", F.lit(True)), "home", "left").drop("home")
        sparse = placed.where("crowd is null").drop("crowd")
        crowded = placed.where("crowd").drop("crowd")
    pairs = window_pairs(
        sparse, distinct, slide=slide, span=span, radius=radii[-1], space=space, route=route
    )
    per_site = pairs.groupBy("id", "nsl").agg(
        *[F.expr(f"sum(if(d <= double({float(r)!r}), n, 0)) as c{i}") for i, r in enumerate(radii)]
    )
    if crowded is not None:
        counted = pyramid.crowded_counts(crowded, distinct, span, radii, space)
        # Other slides are listed if they hold a neighbour; the own one holds the site itself.
        per_site = per_site.unionByName(counted.where(F.col(f"c{len(radii) - 1}") > 0))
    # A site of one point is that point; only sites with copies go back to the points.
    single = distinct.where(F.col("n") == 1).select(F.col("id").alias("site"), "id", "sl")
    several = distinct.where(F.col("n") > 1).withColumnRenamed("id", "site")
    keys = ["sl", *space.coords()]
    members = pts.join(several.select("site", *keys), keys).select("site", "id", "sl")
    return (
        single.unionByName(members)
        .join(per_site.withColumnRenamed("id", "site"), "site")
        .select("id", "sl", "nsl", *others)
    )


def neighbour_totals(histogram: DataFrame, count: str = "c0") -> DataFrame:
    """Neighbours per point over all slides it shares a window with: ``(id, n)``."""
    return histogram.groupBy("id").agg(F.sum(count).alias("n"))


def cumulative_counts(histogram: DataFrame, radii: Sequence[float], span: int) -> DataFrame:
    """Neighbours per point, window and radius: ``(e, id, r, n)``."""
    radii = sorted(radii)
    rows = ", ".join(f"named_struct('r', double({float(r)!r}), 'n', n{i})" for i, r in enumerate(radii))
    return histogram_counts(histogram, len(radii), [span]).selectExpr("e", "id", f"inline(array({rows}))")


def band_counts(histogram: DataFrame, radii: Sequence[float]) -> DataFrame:
    """Neighbours per point, slide and distance band: ``(id, sl, nsl, band, n)``."""
    bands = ", ".join(
        f"named_struct('band', {i}, 'n', c{i}{f' - c{i - 1}' if i else ''})" for i in range(len(radii))
    )
    return histogram.selectExpr("id", "sl", "nsl", f"inline(array({bands}))").where("n > 0")
