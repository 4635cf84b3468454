"""Outlier reports over sliding windows.

``detect_outliers`` answers one query, ``detect_rk`` many radii and ks over one
window, ``detect_rkws`` all combinations of windows, slides, radii and ks.  The
strategies are different plans for the same rows.

Every plan has the same frame:

1. counts per small cell settle most points in crowded places, and tell the
   others how many slides they have to look at;
2. the rest is joined, through a partition key and an id chunk, with the points
   around it;
3. neighbours are counted per window, and outliers per window and query.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slides import slide_index
from ..functions.vectors import Space
from ..operators.clusters import free_centres
from ..operators.density import unsettled_points
from ..operators.joins import uses_blocks, window_pairs
from ..operators.line import line_histogram, usable
from ..operators.routes import BandRoute, BoundsRoute, HashRoute, PivotRoute, Route, VantageRoute, grid_route
from ..operators.training import train_pivot, train_pivots, train_vantage_tree
from ..operators.windows import histogram_counts, occupied_windows, slide_histogram, window_counts
from .params import QuerySet, parse_rk, reporting_windows


@dataclass(frozen=True)
class Strategy:
    """How a named strategy partitions and counts."""

    part: str = "grid"             # default partitioning
    histogram: bool = False        # count per slide first, then per window
    clusters: bool = False         # dense balls around free centres instead of dense cells


SINGLE = {
    "parallel": Strategy(part="hash"),
    "advanced": Strategy(part="hash_band"),
    "advanced_vp": Strategy(part="metric"),
    "slicing": Strategy(histogram=True),
    "pmcod": Strategy(),
    "free_clusters": Strategy(part="metric", clusters=True),
}
RK = {
    "pamcod": Strategy(histogram=True),
    "sop": Strategy(histogram=True),
    "pmcsky": Strategy(part="metric", histogram=True),
    "psod": Strategy(histogram=True),
}
RKWS = {name: RK[name] for name in ("sop", "pmcsky", "psod")}


#: Radii up to this factor apart are searched in one join.
GROUP_RATIO = 2.5


def radius_groups(radii: Sequence[float]) -> list[list[int]]:
    """Places of the ascending radii, those of like size together.

    A group is pruned at its smallest radius and joined at its largest, so its
    price is about that of its largest radius alone.
    """
    groups: list[list[int]] = []
    for i, r in enumerate(radii):
        if groups and r <= GROUP_RATIO * radii[groups[-1][0]]:
            groups[-1].append(i)
        else:
            groups.append([i])
    return groups


def make_route(part: str | Route, points: DataFrame, radius: float, space: Space, parallelism: int = 4) -> Route:
    """A route by name, or the given one."""
    return route_maker(part, points, space, parallelism)(radius)


def route_maker(
    part: str | Route, points: DataFrame, space: Space, parallelism: int = 4
) -> Callable[[float], Route]:
    """Routes of one kind for any radius; what has to be trained is trained once.

    ``hash`` and ``hash_band`` share the stored points out to ``parallelism``
    partitions by id and look them up there by cell or by distance ring.
    ``preset:<name>`` uses the published boundaries of a data set.
    """
    if isinstance(part, Route):
        return lambda radius: part
    if part.startswith("preset:") or part in ("grid", "hash"):
        if space.axis_bound is None:
            raise ValueError("partitioning by coordinates needs a metric that bounds them")
    if part.startswith("preset:"):
        return lambda radius: BoundsRoute.preset(part.split(":", 1)[1], radius * space.axis_bound)
    if part == "grid":
        return lambda radius: grid_route(space, radius)
    if part == "hash":
        return lambda radius: HashRoute(parallelism, grid_route(space, radius))
    if part == "hash_band":
        pivot = train_pivot(points)
        return lambda radius: HashRoute(parallelism, BandRoute(pivot, radius))
    if part == "metric":
        tree = train_vantage_tree(points, 16, space=space)
        return lambda radius: VantageRoute(tree, radius, rings=not uses_blocks(space))
    if part == "pivot":
        pivots = train_pivots(points, 16)
        return lambda radius: PivotRoute(pivots, radius)
    raise ValueError(f"unknown partitioning {part!r}")


def keyed_points(points: DataFrame, unit: int, space: Space) -> DataFrame:
    """Points as ``id, sl`` and coordinates."""
    return space.project(points, F.col("id").cast("bigint").alias("id"), slide_index(unit).alias("sl"))


def neighbour_counts(
    points: DataFrame,
    queries: QuerySet,
    plan: Strategy,
    space: Space,
    route: Route,
    chunk: int | None = None,
    radii: Sequence[float] | None = None,
) -> DataFrame:
    """Counts of the unsettled points: ``(wi, e, id, sl, n0, n1, ..)``.

    ``n<i>`` counts the points within ``radii[i]``, the point itself included.
    A point that is missing here is an inlier for all these radii.
    """
    pts = keyed_points(points, queries.unit, space)
    spans, radii = queries.spans, radii or queries.radii
    probes = unsettled_points(pts, space, radii[0], queries.ks[-1], spans[-1], spans[0])
    if chunk is None and usable(space, queries.unit, spans[-1]):
        histogram = line_histogram(probes, pts, queries.unit, spans[-1], radii, space, route, per_id=True)
        return histogram_counts(histogram, len(radii), spans)
    pairs = window_pairs(
        probes, pts, slide=queries.unit, span=spans[-1], radius=radii[-1],
        space=space, route=route, chunk=chunk,
    )
    if not plan.histogram:
        return window_counts(pairs, radii, spans)
    histogram = slide_histogram(pairs, radii)
    return histogram_counts(histogram, len(radii), spans)


def evaluate(
    points: DataFrame,
    queries: QuerySet,
    plan: Strategy,
    space: Space = Space(),
    part: str | Route | None = None,
    parallelism: int = 4,
    between: tuple[int | None, int | None] = (None, None),
    chunk: int | None = None,
) -> DataFrame:
    """The full report: ``(e, w, s, r, k, n_outliers)``.

    ``between`` restricts the report to windows from the first to the second
    bound, both included.
    """
    route = route_maker(part or plan.part, points, space, parallelism)
    cells = [(i, j) for i in range(len(queries.radii)) for j in range(len(queries.ks))]
    limit = queries.ks[-1]
    suspects = []
    for group in radius_groups(queries.radii):
        radii = [queries.radii[i] for i in group]
        if plan.clusters:
            # A ball settles points if slides have more than k of its points, on average at least.
            ends = points.agg(F.min(slide_index(queries.unit)).alias("a"), F.max(slide_index(queries.unit)).alias("b")).first()
            least = limit * ((ends["b"] or 0) - (ends["a"] or 0) + 1)
            space = replace(space, centres=free_centres(points, radii[0], space, least))
        counts = neighbour_counts(points, queries, plan, space, route(radii[-1]), chunk, radii)
        few = _within(counts, between).where(F.col("n0") <= limit)
        suspects.append(few.select("wi", "e", *[F.col(f"n{j}").alias(f"n{i}") for j, i in enumerate(group)]))
    # Every occupied window joins the suspects as one row without counts, so
    # that windows without outliers are reported too.
    blank = [F.lit(None).cast("bigint").alias(f"n{i}") for i in range(len(queries.radii))]
    slides = points.select(slide_index(queries.unit).alias("sl"))
    windows = _within(occupied_windows(slides, queries.spans), between).select("wi", "e", *blank)
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), suspects, windows)
    found = (
        rows.groupBy("wi", "e")
        .agg(*[F.expr(f"count_if(n{i} <= {queries.ks[j]}) as o{i}_{j}") for i, j in cells])
    )
    answers = ", ".join(
        f"named_struct('r', double({queries.radii[i]!r}), 'k', {queries.ks[j]}, 'n_outliers', o{i}_{j})"
        for i, j in cells
    )
    report = found.selectExpr("wi", "e", f"explode(array({answers})) as a")
    return reporting_windows(report, queries).select("e", "w", "s", "a.r", "a.k", "a.n_outliers")


def _within(df: DataFrame, between: tuple[int | None, int | None]) -> DataFrame:
    low, high = between
    if low is not None:
        df = df.where(F.col("e") >= low)
    if high is not None:
        df = df.where(F.col("e") <= high)
    return df


def _named(strategies: dict[str, Strategy], name: str) -> Strategy:
    if name not in strategies:
        raise ValueError(f"unknown strategy {name!r}, expected one of {sorted(strategies)}")
    return strategies[name]


def _full_windows(points: DataFrame, queries: QuerySet, head: bool, tail: bool) -> tuple[int | None, int | None]:
    """Window bounds without the filling first and draining last windows."""
    if head and tail:
        return None, None
    row = points.agg(F.min(slide_index(queries.unit)), F.max(slide_index(queries.unit))).first()
    if row[0] is None:
        return None, None
    return (None if head else row[0] + queries.spans[-1] - 1, None if tail else row[1])


def detect_outliers(
    points: DataFrame,
    window: int,
    slide: int,
    radius: float,
    k: int,
    strategy: str = "pmcod",
    space: Space = Space(),
    part: str | Route | None = None,
    include_head: bool = True,
    include_tail: bool = True,
    **options,
) -> DataFrame:
    """Outliers per window: ``(e, n_outliers)``, also for windows without any."""
    plan = _named(SINGLE, strategy)
    if window % slide:
        raise ValueError("the window must be a multiple of the slide")
    queries = QuerySet([window], [slide], [radius], [k])
    between = _full_windows(points, queries, include_head, include_tail)
    return evaluate(points, queries, plan, space, part, between=between, **options).select("e", "n_outliers")


def detect_rk(
    points: DataFrame,
    window: int,
    slide: int,
    queries: str | Sequence[tuple[int, float]],
    strategy: str = "sop",
    space: Space = Space(),
    part: str | Route | None = None,
    pairs_only: bool = False,
    include_head: bool = True,
    include_tail: bool = True,
    **options,
) -> DataFrame:
    """Outliers per window, radius and k: ``(e, r, k, n_outliers)``.

    ``queries`` lists (k, R) pairs, or is their text form ``"k;R,k;R"``.  The
    report covers all listed radii with all listed ks, unless ``pairs_only``.
    """
    plan = _named(RK, strategy)
    listed = parse_rk(queries) if isinstance(queries, str) else [(int(k), float(r)) for k, r in queries]
    if window % slide:
        raise ValueError("the window must be a multiple of the slide")
    wanted = QuerySet([window], [slide], [r for _, r in listed], [k for k, _ in listed])
    between = _full_windows(points, wanted, include_head, include_tail)
    report = evaluate(points, wanted, plan, space, part, between=between, **options)
    if pairs_only:
        asked = None
        for k, r in sorted(set(listed)):
            one = (F.col("k") == k) & (F.col("r") == r)
            asked = one if asked is None else asked | one
        report = report.where(asked)
    return report.select("e", "r", "k", "n_outliers")


def detect_rkws(
    points: DataFrame,
    windows: Sequence[int],
    slides: Sequence[int],
    radii: Sequence[float],
    ks: Sequence[int],
    strategy: str = "sop",
    space: Space = Space(),
    part: str | Route | None = None,
    include_head: bool = True,
    include_tail: bool = True,
    **options,
) -> DataFrame:
    """Outliers per window and query: ``(e, w, s, r, k, n_outliers)``.

    ``e`` counts slides of the greatest common divisor of the given slides; a
    query with slide S reports the windows that end on a multiple of S.
    """
    plan = _named(RKWS, strategy)
    queries = QuerySet(windows, slides, radii, ks)
    between = _full_windows(points, queries, include_head, include_tail)
    return evaluate(points, queries, plan, space, part, between=between, **options)


def partition_outliers(
    points: DataFrame, window: int, slide: int, radius: float, k: int, route: Route, space: Space = Space()
) -> DataFrame:
    """Outliers per home partition and window: ``(part, e, n_outliers)``.

    Partial counts: adding them up per window gives the report.
    """
    queries = QuerySet([window], [slide], [radius], [k])
    counts = neighbour_counts(points, queries, Strategy(), space, route)
    homes = route.with_home(keyed_points(points, slide, space), space)
    flagged = counts.where(F.col("n0") <= k).select("e", "id")
    occupied = homes.select("part", "sl").distinct().select(
        "part", F.explode_outer(F.sequence(F.col("sl"), F.col("sl") + queries.spans[0] - 1)).alias("e")
    ).distinct()
    found = flagged.join(homes.select("id", "part"), "id").groupBy("part", "e").agg(
        F.count(F.lit(1)).alias("n_outliers")
    )
    return occupied.join(found, ["part", "e"], "left").select(
        "part", "e", F.coalesce("n_outliers", F.lit(0).cast("bigint")).alias("n_outliers")
    )
