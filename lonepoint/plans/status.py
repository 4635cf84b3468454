"""Status of each point over its windows, status changes, expiry schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import Space
from ..operators.density import with_search_span
from ..operators.joins import window_pairs
from ..operators.routes import Route, grid_route
from .detect import keyed_points

OUTLIER, INLIER, SAFE = "outlier", "inlier", "safe_inlier"


def _histories(
    points: DataFrame, window: int, slide: int, radius: float, k: int, space: Space, route: Route | None
) -> tuple[DataFrame, DataFrame]:
    """Points that are safe from the start, and the others with their neighbour counts.

    The second frame is ``(id, sl, h)``; ``h[i]`` counts the neighbours, the
    point included, in slides ``sl - m + 1 .. sl - m + i``.  Counts stop where
    ``first .. last`` ends, which leaves every status as it is.
    """
    if window % slide:
        raise ValueError("the window must be a multiple of the slide")
    m = window // slide
    pts = keyed_points(points, slide, space)
    spans = with_search_span(pts, space, radius, k, m)
    is_safe = F.col("safe") | F.lit(k == 0)
    safe, rest = spans.where(is_safe), spans.where(~is_safe)
    pairs = window_pairs(
        rest.drop("settled", "safe"), pts, slide=slide, span=m, radius=radius, space=space, route=route or grid_route(space, radius)
    )
    # Running sums at the slides that hold a neighbour, each repeated up to the next one.
    by_time = Window.partitionBy("id").orderBy("nsl")
    steps = pairs.groupBy("id", "sl", "nsl").agg(F.count(F.lit(1)).alias("c")).select(
        "id", "sl",
        F.struct(
            "nsl",
            F.sum("c").over(by_time).alias("sum"),
            F.coalesce(F.lead("nsl").over(by_time), F.col("sl") + m).alias("until"),
        ).alias("step"),
    )
    counted = steps.groupBy("id", "sl").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    none = F.array_repeat(F.lit(0).cast("bigint"), (F.col("steps")[0]["nsl"] - F.col("sl") + m).cast("int"))
    runs = F.transform("steps", lambda x: F.array_repeat(x["sum"], (x["until"] - x["nsl"]).cast("int")))
    history = F.concat(none, F.flatten(runs))
    return safe.select("id", "sl"), counted.select("id", "sl", history.alias("h"))


def point_status(
    points: DataFrame, window: int, slide: int, radius: float, k: int,
    space: Space = Space(), route: Route | None = None,
) -> DataFrame:
    """``(e, id, status)`` for every window of every point.

    A safe inlier has k neighbours that arrived with it or later, so no expiry
    can make it an outlier.
    """
    m = window // slide
    safe, counted = _histories(points, window, slide, radius, k, space, route)
    step = F.posexplode_outer(F.sequence(F.col("sl"), F.col("sl") + (m - 1))).alias("j", "e")
    status = (
        F.when(F.expr(f"h[j + {m}] - h[{m - 1}]") > k, F.lit(SAFE))
        .when(F.expr(f"h[j + {m}] - h[j]") > k, F.lit(INLIER))
        .otherwise(F.lit(OUTLIER))
    )
    rows = counted.select("id", "h", step).select("e", "id", status.alias("status"))
    settled = safe.select(
        F.explode_outer(F.sequence(F.col("sl"), F.col("sl") + (m - 1))).alias("e"), "id", F.lit(SAFE).alias("status")
    )
    return rows.unionByName(settled)


def safe_inliers(
    points: DataFrame, window: int, slide: int, radius: float, k: int,
    space: Space = Space(), route: Route | None = None,
) -> DataFrame:
    """Points with k neighbours that arrived with them or later: ``(id)``."""
    m = window // slide
    safe, counted = _histories(points, window, slide, radius, k, space, route)
    late = counted.where(F.expr(f"h[{2 * m - 1}] - h[{m - 1}]") > k)
    return safe.select("id").unionByName(late.select("id"))


def status_transitions(status: DataFrame) -> DataFrame:
    """Rows at which a point's status differs from the window before."""
    by_time = Window.partitionBy("id").orderBy("e")
    return (
        status.withColumn("previous", F.lag("status").over(by_time))
        .where(F.col("previous") != F.col("status"))
        .select("e", "id", "previous", "status")
    )


def expiry_schedule(
    points: DataFrame, window: int, slide: int, radius: float, k: int,
    space: Space = Space(), route: Route | None = None,
) -> DataFrame:
    """When inliers would become outliers without new arrivals: ``(e, id, expires)``.

    One row per window in which a point is an inlier but not a safe one;
    ``expires`` is null if the point leaves first.
    """
    m = window // slide
    _, counted = _histories(points, window, slide, radius, k, space, route)
    step = F.posexplode_outer(F.sequence(F.col("sl"), F.col("sl") + (m - 1))).alias("j", "e")
    inlier = F.expr(f"h[j + {m}] - h[{m - 1}] <= {k} and h[j + {m}] - h[j] > {k}")
    # The counts only fall with x, so the first x that leaves too few is found by halving.
    middle = "(s.low + s.high) div 2"
    first_gone = F.expr(
        f"aggregate(sequence(1, {m.bit_length()}), named_struct('low', j + 1L, 'high', {m}L), "
        f"(s, i) -> if(s.low >= s.high, s, if(h[j + {m}] - h[cast({middle} as int)] <= {k}, "
        f"named_struct('low', s.low, 'high', {middle}), named_struct('low', {middle} + 1L, 'high', s.high))), "
        f"s -> if(s.low < {m}, s.low, null))"
    )
    return (
        counted.select("id", "sl", "h", step)
        .where(inlier)
        .select("e", "id", (F.col("sl") + first_gone).alias("expires"))
    )
