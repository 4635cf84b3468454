"""The operators as named queries over the shared test tables, with their SQL.

Each query reads whole tables.  ``ORACLE`` holds the SQL that must return the
same rows; queries without an entry are not deterministic across engines (they
depend on a trained sample or on hashing) and are covered by tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.slides import slide_index
from .functions.vectors import CHEBYSHEV, MANHATTAN, SLACK, Space
from .operators import neighbours as nb
from .operators.density import dense_cells, looking_back, outside_dense_cells
from .operators.histogram import band_counts, cumulative_counts, neighbour_histogram, neighbour_totals
from .operators.joins import knn_join, nearest_first, pivot_prune_join, range_join, range_limit_join, window_pairs
from .operators.line import Recent, Skyband
from .operators.routes import BallRoute, BandRoute, BoundsRoute, GridRoute, HashRoute, PivotRoute, Route, VantageRoute
from .operators.routes import assign, drop_stale_replicas
from .operators.search import nearest_anywhere
from .operators.training import median_distance, train_balls, train_vantage_tree
from .operators.windows import window_population
from .plans import status as st
from .plans.detect import detect_outliers, detect_rk, detect_rkws, keyed_points, partition_outliers
from .plans.params import QuerySet, reporting_windows, with_queries
from .session import shared_dir, written
from .sources.points import (
    format_points, parse_points, points_from_table, sample_head, sample_random, stream_table_points, stream_text_points,
)
from .sources.reports import report_lines, table_sink
from .streaming.keyed import stream_outliers, stream_rk, stream_rkws, stream_transitions
from .streaming.native import window_density, window_outliers, window_replicas

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

W, S, M = 1000, 200, 5
D1, D2, D64 = Space(1), Space(2), Space(64)
RADII = [1.0, 2.0, 5.0]
BOUNDS = [5.0, 10.0, 20.0, 35.0, 50.0, 75.0, 100.0, 150.0]
PLANE_BOUNDS = [[10.0, 35.0, 75.0], [6.0, 12.0, 18.0]]


def query(name: str, sql: str | None = None):
    """Register a query and, if given, the SQL with the same result."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# --- inputs ---------------------------------------------------------------


def events(spark: SparkSession, sf: str) -> DataFrame:
    return points_from_table(spark.read.parquet(f"{sf}/events.parquet"), "event_id", ["value"])


def event_slides(spark: SparkSession, sf: str, slide: int = S) -> DataFrame:
    return keyed_points(events(spark, sf), slide, D1)


HOUR = "timestampdiff(MICROSECOND, date_trunc('DAY', ts), ts) / 3600000000"


def plane(spark: SparkSession, sf: str) -> DataFrame:
    """Events as (value, hour of the day)."""
    return points_from_table(spark.read.parquet(f"{sf}/events.parquet"), "event_id", ["value", F.expr(HOUR)])


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Events as (position in the stream, value): as dense at any size."""
    return points_from_table(
        spark.read.parquet(f"{sf}/events.parquet"), "event_id", [F.col("event_id") * F.lit(0.02), "value"]
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return points_from_table(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", array_col="embedding")


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as (lines, pieces): many equal vectors, and gaps between ids."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("pieces")
    )
    return points_from_table(lines, "l_orderkey", ["lines", "pieces"])


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Events as (user): neighbours at radius 0 are the user's other events."""
    return points_from_table(spark.read.parquet(f"{sf}/events.parquet"), "event_id", ["user_id"])


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return points_from_table(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey", ["o_totalprice"])


def head_vectors(spark: SparkSession, sf: str, n: int = 8) -> list[list[float]]:
    return [r["value"] for r in sample_head(vectors(spark, sf), n).orderBy("id").collect()]


# --- SQL building blocks --------------------------------------------------

EVENTS_SQL = "SELECT event_id AS id, value AS x0 FROM events"
PLANE_SQL = (
    "SELECT event_id AS id, value AS x0, (epoch_us(ts) % 86400000000) / 3600000000 AS x1 FROM events"
)
TIMELINE_SQL = "SELECT event_id AS id, event_id * 0.02::DOUBLE AS x0, value AS x1 FROM events"
LINES_SQL = (
    "SELECT l_orderkey AS id, count(*)::DOUBLE AS x0, sum(l_quantity) AS x1 FROM lineitem GROUP BY l_orderkey"
)
USERS_SQL = "SELECT event_id AS id, user_id::DOUBLE AS x0 FROM events"
ORDERS_SQL = "SELECT o_orderkey AS id, o_totalprice AS x0 FROM orders"
VECTORS_SQL = "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"


def points_sql(source: str, slide: int = S) -> str:
    return f"p AS (SELECT *, id // {slide} AS sl FROM ({source}))"


def distance_sql(a: str, b: str, dims: int) -> str:
    if dims > 8:
        return f"list_distance({a}.v, {b}.v)"
    return "sqrt(" + " + ".join(f"({a}.x{i}-{b}.x{i})*({a}.x{i}-{b}.x{i})" for i in range(dims)) + ")"


def pairs_sql(radius: float, span: int = M, dims: int = 1, earlier: bool = False) -> str:
    """Window pairs, the point's pair with itself included."""
    high = "a.sl - 1" if earlier else f"a.sl + {span - 1}"
    d = distance_sql("a", "b", dims)
    return (
        f"pr AS (SELECT a.id, a.sl, b.id AS nid, b.sl AS nsl, {d} AS d FROM p a JOIN p b "
        f"ON b.sl BETWEEN a.sl - {span - 1} AND {high} AND {d} <= {radius}::DOUBLE)"
    )


def histogram_sql(radii: list[float]) -> str:
    """Per point and slide: neighbours within each radius, self not counted."""
    counts = ", ".join(f"count(*) FILTER (d <= {r}::DOUBLE AND nid <> id) AS c{i}" for i, r in enumerate(radii))
    return f"h AS (SELECT id, sl, nsl, {counts} FROM pr GROUP BY id, sl, nsl)"


def counts_sql(spans: dict[int, int], n_radii: int) -> str:
    """Neighbours per window length, window and point."""
    lengths = ", ".join(f"({w}, {m})" for w, m in spans.items())
    sums = ", ".join(f"sum(c{i})::BIGINT AS n{i}" for i in range(n_radii))
    return (
        f"ww(w, m) AS (VALUES {lengths}), "
        "pe AS (SELECT w, m, id, sl, unnest(range(sl, sl + m)) AS e FROM p, ww), "
        f"n AS (SELECT pe.w, pe.e, pe.id, pe.sl, {sums} FROM pe JOIN h ON h.id = pe.id "
        "AND h.nsl BETWEEN pe.e - pe.m + 1 AND pe.e GROUP BY ALL)"
    )


def single_sql(
    source: str, window: int, slide: int, radius: float, k: int, dims: int = 1, closed_only: bool = False
) -> str:
    m = window // slide
    closed = " WHERE e < (SELECT max(sl) FROM p)" if closed_only else ""
    return (
        f"WITH {points_sql(source, slide)}, {pairs_sql(radius, m, dims)}, {histogram_sql([radius])}, "
        f"{counts_sql({window: m}, 1)} "
        f"SELECT e, count(*) FILTER (n0 < {k}) AS n_outliers FROM n{closed} GROUP BY e"
    )


def rk_sql(source: str, window: int, slide: int, radii: list[float], ks: list[int], closed_only: bool = False) -> str:
    m = window // slide
    picks = " ".join(f"WHEN {r}::DOUBLE THEN n{i}" for i, r in enumerate(radii))
    rs = ", ".join(f"({r}::DOUBLE)" for r in radii)
    kk = ", ".join(f"({k})" for k in ks)
    closed = " WHERE e < (SELECT max(sl) FROM p)" if closed_only else ""
    return (
        f"WITH {points_sql(source, slide)}, {pairs_sql(radii[-1], m)}, {histogram_sql(radii)}, "
        f"{counts_sql({window: m}, len(radii))}, rr(r) AS (VALUES {rs}), kk(k) AS (VALUES {kk}) "
        f"SELECT e, r, k, count(*) FILTER ((CASE r {picks} END) < k) AS n_outliers "
        f"FROM n, rr, kk{closed} GROUP BY e, r, k"
    )


def rkws_sql(
    source: str, windows: list[int], slides: list[int], radii: list[float], ks: list[int], unit: int,
    closed_only: bool = False,
) -> str:
    spans = {w: w // unit for w in windows}
    picks = " ".join(f"WHEN {r}::DOUBLE THEN n{i}" for i, r in enumerate(radii))
    rs = ", ".join(f"({r}::DOUBLE)" for r in radii)
    kk = ", ".join(f"({k})" for k in ks)
    ss = ", ".join(f"({s})" for s in slides)
    closed = " AND e < (SELECT max(sl) FROM p)" if closed_only else ""
    return (
        f"WITH {points_sql(source, unit)}, {pairs_sql(radii[-1], max(spans.values()))}, {histogram_sql(radii)}, "
        f"{counts_sql(spans, len(radii))}, rr(r) AS (VALUES {rs}), kk(k) AS (VALUES {kk}), ss(s) AS (VALUES {ss}) "
        f"SELECT e, w, s, r, k, count(*) FILTER ((CASE r {picks} END) < k) AS n_outliers "
        f"FROM n, rr, kk, ss WHERE (e + 1) % (s // {unit}) = 0{closed} GROUP BY e, w, s, r, k"
    )


def _list(values: list[float]) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def _below(bounds: list[float], test: str) -> str:
    return f"len(list_filter({_list(bounds)}, lambda b: {test}))"


# --- sources, scalars, windows --------------------------------------------


@query("text_points", "SELECT event_id AS id, value AS x FROM events")
def _(spark, sf):
    parsed = parse_points(format_points(events(spark, sf)))
    return parsed.select("id", F.col("value")[0].alias("x"))


@query("table_points", f"SELECT id, x0, x1 FROM ({PLANE_SQL})")
def _(spark, sf):
    return D2.project(plane(spark, sf), "id")


@query("sample_head", "SELECT event_id AS id, value AS x FROM events ORDER BY event_id LIMIT 10000")
def _(spark, sf):
    return sample_head(events(spark, sf)).select("id", F.col("value")[0].alias("x"))


@query(
    "sample_random",
    "SELECT event_id AS id, value AS x FROM events ORDER BY md5(event_id::VARCHAR || '-1'), event_id LIMIT 1000",
)
def _(spark, sf):
    return sample_random(events(spark, sf), 1000).select("id", F.col("value")[0].alias("x"))


@query("slide_assign", f"SELECT event_id AS id, event_id // {S} AS sl, event_id // {S} * {S} AS sl_start FROM events")
def _(spark, sf):
    return events(spark, sf).select("id", slide_index(S).alias("sl"), (slide_index(S) * S).alias("sl_start"))


@query(
    "window_membership",
    f"WITH {points_sql(EVENTS_SQL)}, q AS (SELECT sl, unnest(range(sl, sl + {M})) AS e FROM p) "
    f"SELECT e, count(*) AS n_points, count(*) FILTER (sl = e) AS n_new, "
    f"count(*) FILTER (sl = e - {M - 1}) AS n_expiring FROM q GROUP BY e",
)
def _(spark, sf):
    return window_population(event_slides(spark, sf), M)


@query(
    "consecutive_distances",
    f"WITH p AS ({VECTORS_SQL}) SELECT a.id, round(list_distance(a.v, b.v), 6) AS d FROM p a JOIN p b ON b.id = a.id + 1",
)
def _(spark, sf):
    pts = vectors(spark, sf)
    nxt = pts.select((F.col("id") - 1).alias("id"), F.col("value").alias("nvalue"))
    return pts.join(nxt, "id").select("id", F.round(D64.distance("", "n"), 6).alias("d"))


@query(
    "slide_minmax",
    f"WITH {points_sql(EVENTS_SQL)} SELECT sl, min(x0) AS lo, max(x0) AS hi FROM p GROUP BY sl",
)
def _(spark, sf):
    return event_slides(spark, sf).groupBy("sl").agg(F.min("x0").alias("lo"), F.max("x0").alias("hi"))


@query(
    "report_schedule",
    f"WITH {points_sql(EVENTS_SQL, 100)}, ww(w, m) AS (VALUES (1000, 10), (2000, 20)), ss(s) AS (VALUES (200), (500)), "
    "q AS (SELECT w, unnest(range(sl, sl + m)) AS e FROM p, ww) "
    "SELECT e, w, s, count(*) AS n_points FROM q, ss WHERE (e + 1) % (s // 100) = 0 GROUP BY e, w, s",
)
def _(spark, sf):
    queries = QuerySet([1000, 2000], [200, 500], [1.0], [1])
    per_slide = event_slides(spark, sf, queries.unit).groupBy("sl").agg(F.count(F.lit(1)).alias("n"))
    lengths = ", ".join(f"named_struct('wi', {i}, 'm', {m}L)" for i, m in enumerate(queries.spans))
    windows = (
        per_slide.selectExpr("sl", "n", f"inline(array({lengths}))")
        .select("wi", "n", F.explode(F.expr("sequence(sl, sl + m - 1)")).alias("e"))
        .groupBy("wi", "e")
        .agg(F.sum("n").alias("n_points"))
    )
    return reporting_windows(windows, queries)


# --- partition assignment -------------------------------------------------


@query("hash_assign", "SELECT event_id AS id, event_id % 4 AS part FROM events")
def _(spark, sf):
    return HashRoute(4).with_home(events(spark, sf), D1).select("id", "part")


@query(
    "replicate_assign",
    "SELECT event_id AS id, part, part = event_id % 4 AS is_home FROM events, (SELECT unnest(range(0, 4)) AS part)",
)
def _(spark, sf):
    return assign(events(spark, sf), HashRoute(4), D1).select("id", "part", "is_home")


_GRID1D = (
    f"g AS (SELECT id, id // {S} AS sl, {_below(BOUNDS, 'b < x0')} AS home, "
    f"unnest(range({_below(BOUNDS, f'b < x0 - {5 * (1 + SLACK)!r}::DOUBLE')}, "
    f"{_below(BOUNDS, f'b <= x0 + {5 * (1 + SLACK)!r}::DOUBLE')} + 1)) AS part FROM ({EVENTS_SQL}))"
)


@query("grid1d_assign", f"WITH {_GRID1D} SELECT id, part, part = home AS is_home FROM g")
def _(spark, sf):
    return assign(event_slides(spark, sf), BoundsRoute([BOUNDS], 5.0), D1).select("id", "part", "is_home")


def _axis(bounds: list[float], x: str, radius: float) -> str:
    reach = f"{radius * (1 + SLACK)!r}::DOUBLE"
    return (
        f"{_below(bounds, f'b < {x}')} AS h, "
        f"unnest(range({_below(bounds, f'b < {x} - {reach}')}, {_below(bounds, f'b <= {x} + {reach}')} + 1)) AS c"
    )


def _gridnd_sql(bounds: list[list[float]], source: str, radius: float) -> str:
    stride = len(bounds[1]) + 1
    return (
        f"WITH p AS ({source}), a AS (SELECT id, {_axis(bounds[0], 'x0', radius)} FROM p), "
        f"b AS (SELECT id, {_axis(bounds[1], 'x1', radius)} FROM p) "
        f"SELECT a.id, a.c * {stride} + b.c AS part, (a.c = a.h AND b.c = b.h) AS is_home FROM a JOIN b ON a.id = b.id"
    )


@query("gridnd_assign", _gridnd_sql(PLANE_BOUNDS, PLANE_SQL, 1.0))
def _(spark, sf):
    return assign(D2.project(plane(spark, sf), "id"), BoundsRoute(PLANE_BOUNDS, 1.0), D2).select("id", "part", "is_home")


@query(
    "preset_grid_assign",
    _gridnd_sql(
        [[58.0, 127.0, 260.0], [0.0, 71.0, 142.0]],
        "SELECT event_id AS id, value AS x0, user_id::DOUBLE AS x1 FROM events", 5.0,
    ),
)
def _(spark, sf):
    pts = points_from_table(spark.read.parquet(f"{sf}/events.parquet"), "event_id", ["value", "user_id"])
    return assign(D2.project(pts, "id"), BoundsRoute.preset("fc_2d", 5.0), D2).select("id", "part", "is_home")


@query(
    "uniform_grid_assign",
    f"WITH p AS (SELECT id, floor(x0 / {5 * (1 + SLACK)!r}::DOUBLE)::BIGINT AS h0, "
    f"floor(x1 / {5 * (1 + SLACK)!r}::DOUBLE)::BIGINT AS h1 FROM ({PLANE_SQL})), "
    "o AS (SELECT unnest(range(-1, 2)) AS o) "
    "SELECT id, h0 + a.o AS c0, h1 + b.o AS c1, (a.o = 0 AND b.o = 0) AS is_home FROM p, o a, o b",
)
def _(spark, sf):
    cells = assign(D2.project(plane(spark, sf), "id"), GridRoute(5.0), D2)
    return cells.select("id", F.col("part")[0].alias("c0"), F.col("part")[1].alias("c1"), "is_home")


@query("vantage_assign")
def _(spark, sf):
    pts = plane(spark, sf)
    route = VantageRoute(train_vantage_tree(pts, 16), 1.0)
    return assign(D2.project(pts, "id"), route, D2).select("id", "part", "is_home")


_MEETS = "SELECT event_id AS id, 1::BIGINT AS n_home, 0::BIGINT AS n_missed FROM events"


def _meets(route: Callable[[DataFrame], Route]) -> Query:
    """Every point has one home, and every near pair meets: what a partitioning has to keep."""

    def run(spark, sf):
        pts = timeline(spark, sf)
        # Distances to all centres are dear, and the places are used twice.
        placed = written(assign(D2.project(pts, "id"), route(pts), D2).select("id", "part", "is_home"), "places")
        homes = placed.where("is_home").groupBy("id").agg(F.count(F.lit(1)).alias("n_home"), F.first("part").alias("home"))
        near = range_join(pts, pts, 1.0, D2).select(F.col("qid").alias("id"), "nid")
        seen = placed.select("id", F.col("part").alias("home"), F.lit(True).alias("seen"))
        missed = (
            near.join(homes.select(F.col("id").alias("nid"), "home"), "nid")
            .join(seen, ["id", "home"], "left")
            .groupBy("id")
            .agg(F.count_if(F.col("seen").isNull()).alias("n_missed"))
        )
        return homes.join(missed, "id", "left").select(
            "id", "n_home", F.coalesce("n_missed", F.lit(0).cast("bigint")).alias("n_missed")
        )

    return run


query("vantage_meets", _MEETS)(_meets(lambda pts: VantageRoute(train_vantage_tree(pts, 16), 1.0)))
query("ball_meets", _MEETS)(_meets(lambda pts: BallRoute(train_balls(pts, 16, D2), 1.0)))


_PIVOTS = (
    f"p AS ({VECTORS_SQL}), c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS j, v FROM p ORDER BY id LIMIT 8), "
    "pc AS (SELECT p.id, c.j, list_distance(p.v, c.v) AS d FROM p, c), "
    "m AS (SELECT id, min(d) AS dm, arg_min(j, (d, j)) AS home FROM pc GROUP BY id)"
)


@query(
    "pivot_assign",
    f"WITH {_PIVOTS} SELECT pc.id, pc.j AS part, pc.j = m.home AS is_home FROM pc JOIN m ON m.id = pc.id "
    f"WHERE pc.d <= m.dm + {2 * 0.05 * (1 + SLACK)!r}::DOUBLE",
)
def _(spark, sf):
    route = PivotRoute(head_vectors(spark, sf), 0.05)
    return assign(D64.project(vectors(spark, sf), "id"), route, D64).select("id", "part", "is_home")


@query("nearest_centre", f"WITH {_PIVOTS} SELECT id, home AS centre, round(dm, 6) AS d FROM m")
def _(spark, sf):
    pts = D64.project(vectors(spark, sf), "id")
    route = PivotRoute(head_vectors(spark, sf), 0.0)
    return route.with_home(pts.withColumn("pd", route.distances(D64)), D64).select(
        "id", F.col("part").alias("centre"), F.round(F.array_min("pd"), 6).alias("d")
    )


@query("partitions_hit", f"WITH {_GRID1D} SELECT id, count(DISTINCT part) AS n_parts FROM g GROUP BY id")
def _(spark, sf):
    reach = BoundsRoute([BOUNDS], 5.0).with_reach(event_slides(spark, sf), D1)
    return reach.select("id", F.size(F.array_distinct("parts")).cast("bigint").alias("n_parts"))


@query(
    "stale_replicas",
    f"WITH {_GRID1D}, q AS (SELECT part, home, sl, unnest(range(sl, sl + {M})) AS e FROM g) "
    "SELECT e, count(*) FILTER (part = home) AS n_home, count(*) FILTER (part <> home) AS n_replica "
    "FROM q WHERE part = home OR sl = e GROUP BY e",
)
def _(spark, sf):
    copies = assign(event_slides(spark, sf), BoundsRoute([BOUNDS], 5.0), D1)
    shown = copies.withColumn("e", F.explode(F.expr(f"sequence(sl, sl + {M - 1})")))
    kept = drop_stale_replicas(shown, F.col("e"))
    return kept.groupBy("e").agg(
        F.count_if("is_home").alias("n_home"), F.count_if(~F.col("is_home")).alias("n_replica")
    )


@query(
    "median_threshold",
    f"WITH p AS ({EVENTS_SQL}), "
    "o AS (SELECT x0, row_number() OVER (ORDER BY x0) - 1 AS i, count(*) OVER () AS n FROM p), "
    "v AS (SELECT x0 FROM o WHERE i = n // 2) "
    "SELECT round(median(abs(p.x0 - v.x0)), 9) AS threshold FROM p, v",
)
def _(spark, sf):
    return median_distance(events(spark, sf), D1).select(F.round("threshold", 9).alias("threshold"))


# --- similarity joins -----------------------------------------------------

_TIMELINE_PAIRS = (
    f"WITH p AS ({TIMELINE_SQL}), pr AS (SELECT a.id AS qid, b.id AS nid, {distance_sql('a', 'b', 2)} AS d "
    f"FROM p a JOIN p b ON b.id BETWEEN a.id - 51 AND a.id + 51 AND {distance_sql('a', 'b', 2)} <= 1.0::DOUBLE)"
)
_VECTOR_PAIRS = (
    f"WITH p AS ({VECTORS_SQL}), pr AS (SELECT a.id AS qid, b.id AS nid, list_distance(a.v, b.v) AS d FROM p a, p b)"
)


@query(
    "range_join_chebyshev",
    f"WITH p AS ({TIMELINE_SQL}) SELECT a.id AS qid, b.id AS nid, round(greatest(abs(a.x0 - b.x0), abs(a.x1 - b.x1)), 6) AS d "
    "FROM p a JOIN p b ON abs(a.x0 - b.x0) <= 0.8::DOUBLE AND abs(a.x1 - b.x1) <= 0.8::DOUBLE",
)
def _(spark, sf):
    pts = timeline(spark, sf)
    pairs = range_join(pts, pts, 0.8, Space(2, CHEBYSHEV))
    return pairs.select("qid", "nid", F.round("d", 6).alias("d"))


@query("range_join_events", f"{_TIMELINE_PAIRS} SELECT qid, nid, round(d, 6) AS d FROM pr")
def _(spark, sf):
    pts = timeline(spark, sf)
    return range_join(pts, pts, 1.0, D2).select("qid", "nid", F.round("d", 6).alias("d"))


@query("range_join_embeddings", f"{_VECTOR_PAIRS} SELECT qid, nid FROM pr WHERE d <= 1.2::DOUBLE")
def _(spark, sf):
    pts = vectors(spark, sf)
    return range_join(pts, pts, 1.2, D64, PivotRoute(head_vectors(spark, sf), 1.2)).select("qid", "nid")


@query("pivot_prune_join", f"{_VECTOR_PAIRS} SELECT qid, nid FROM pr WHERE d <= 1.15::DOUBLE")
def _(spark, sf):
    pts = vectors(spark, sf)
    return pivot_prune_join(pts, pts, 1.15, D64, head_vectors(spark, sf)).select("qid", "nid")


@query("range_join_vantage", f"{_TIMELINE_PAIRS} SELECT qid, nid, round(d, 6) AS d FROM pr")
def _(spark, sf):
    pts = timeline(spark, sf)
    route = VantageRoute(train_vantage_tree(pts, 16), 1.0, rings=True)
    return range_join(pts, pts, 1.0, D2, route).select("qid", "nid", F.round("d", 6).alias("d"))


@query(
    "range_limit_join",
    f"{_TIMELINE_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, nid) AS rank FROM pr) "
    "SELECT qid, nid, rank FROM r WHERE rank <= 3",
)
def _(spark, sf):
    pts = timeline(spark, sf)
    return range_limit_join(pts, pts, 1.0, 3, D2).select("qid", "nid", F.col("rank").cast("bigint").alias("rank"))


@query(
    "ordered_search",
    f"{_TIMELINE_PAIRS} SELECT qid, nid, row_number() OVER (PARTITION BY qid ORDER BY d, nid) AS rank FROM pr",
)
def _(spark, sf):
    pts = timeline(spark, sf)
    return nearest_first(range_join(pts, pts, 1.0, D2)).select("qid", "nid", F.col("rank").cast("bigint").alias("rank"))


_KNN = (
    "SELECT qid, nid, rank, round(d, 6) AS d FROM "
    "(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, nid) AS rank FROM pr WHERE qid <> nid) WHERE rank <= 10"
)


@query("knn_join_embeddings", f"{_VECTOR_PAIRS} {_KNN}")
def _(spark, sf):
    pts = vectors(spark, sf)
    found = knn_join(pts, pts, 10, D64)
    return found.select("qid", "nid", F.col("rank").cast("bigint").alias("rank"), F.round("d", 6).alias("d"))


@query(
    "search_unbounded",
    f"WITH p AS ({PLANE_SQL}), pr AS (SELECT a.id AS qid, b.id AS nid, {distance_sql('a', 'b', 2)} AS d "
    "FROM p a JOIN p b ON a.id <> b.id WHERE a.id % 100 = 0) SELECT qid, nid, rank, round(d, 6) AS d FROM "
    "(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, nid) AS rank FROM pr) WHERE rank <= 10",
)
def _(spark, sf):
    """The ten nearest points of every hundredth one, without a radius."""
    pts = plane(spark, sf)
    found = nearest_anywhere(pts.where(F.col("id") % 100 == 0), pts, 10, D2)
    return found.select("qid", "nid", F.col("rank").cast("bigint").alias("rank"), F.round("d", 6).alias("d"))


@query(
    "window_range_join",
    f"WITH {points_sql(EVENTS_SQL)}, {pairs_sql(0.2)} SELECT id, nid FROM pr WHERE id <> nid",
)
def _(spark, sf):
    pts = event_slides(spark, sf)
    return nb.others(window_pairs(pts, pts, slide=S, span=M, radius=0.2, space=D1)).select("id", "nid")


_TOTALS = (
    f"WITH {points_sql(EVENTS_SQL)}, {pairs_sql(2.0)} "
    "SELECT id, count(*) FILTER (nid <> id) AS n FROM pr GROUP BY id"
)


def _totals(route: Callable[[DataFrame], Route]) -> Query:
    def run(spark, sf):
        pts = event_slides(spark, sf)
        return neighbour_totals(neighbour_histogram(pts, S, M, [2.0], D1, route(events(spark, sf))))

    return run


query("grid_range_join", _TOTALS)(_totals(lambda pts: GridRoute(2.0)))
query("bounds_range_join", _TOTALS)(_totals(lambda pts: BoundsRoute([BOUNDS], 2.0)))
query("replicated_range_join", _TOTALS)(_totals(lambda pts: HashRoute(4, GridRoute(2.0))))
query("banded_range_join", _TOTALS)(_totals(lambda pts: HashRoute(4, BandRoute([35.0], 2.0))))
query("metric_range_join", _TOTALS)(_totals(lambda pts: VantageRoute(train_vantage_tree(pts, 16), 2.0, rings=True)))


# --- neighbour counts and lists -------------------------------------------

_HIST5 = f"WITH {points_sql(EVENTS_SQL)}, {pairs_sql(5.0)}, {histogram_sql([5.0])}"


def histogram5(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_histogram(event_slides(spark, sf), S, M, [5.0], D1)


@query("neighbor_histogram", f"{_HIST5} SELECT id, sl, nsl, c0 AS n FROM h WHERE c0 > 0")
def _(spark, sf):
    return histogram5(spark, sf).where("c0 > 0").withColumnRenamed("c0", "n")


@query(
    "succ_pred_counts",
    f"{_HIST5} SELECT id, sl, sum(CASE WHEN nsl < sl THEN c0 ELSE 0 END)::BIGINT AS n_before, "
    "sum(CASE WHEN nsl < sl THEN 0 ELSE c0 END)::BIGINT AS n_after FROM h GROUP BY id, sl",
)
def _(spark, sf):
    return nb.before_after_counts(histogram5(spark, sf))


@query(
    "earliest_predecessor",
    f"{_HIST5}, pe AS (SELECT id, sl, unnest(range(sl, sl + {M})) AS e FROM p) "
    "SELECT pe.e, pe.id, min(h.nsl) AS first_nsl FROM pe LEFT JOIN h ON h.id = pe.id AND h.nsl < pe.sl "
    f"AND h.nsl > pe.e - {M} AND h.c0 > 0 GROUP BY pe.e, pe.id",
)
def _(spark, sf):
    return nb.earliest_expiring(histogram5(spark, sf), M)


_HISTS = f"WITH {points_sql(EVENTS_SQL)}, {pairs_sql(5.0)}, {histogram_sql(RADII)}"
_BAND = "CASE WHEN d <= 1.0::DOUBLE THEN 0 WHEN d <= 2.0::DOUBLE THEN 1 ELSE 2 END"


def histogram3(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_histogram(event_slides(spark, sf), S, M, RADII, D1)


@query(
    "distance_buckets",
    f"WITH {points_sql(EVENTS_SQL)}, {pairs_sql(5.0)} "
    f"SELECT id, sl, nsl, {_BAND} AS band, count(*) AS n FROM pr WHERE nid <> id GROUP BY ALL",
)
def _(spark, sf):
    return band_counts(histogram3(spark, sf), RADII)


@query(
    "bucket_cumulative",
    f"{_HISTS}, {counts_sql({W: M}, 3)} "
    "SELECT e, id, 1.0::DOUBLE AS r, n0 AS n FROM n UNION ALL SELECT e, id, 2.0::DOUBLE, n1 FROM n "
    "UNION ALL SELECT e, id, 5.0::DOUBLE, n2 FROM n",
)
def _(spark, sf):
    return cumulative_counts(histogram3(spark, sf), RADII, M)


@query(
    "point_query_scores",
    f"{_HISTS}, {counts_sql({W: M}, 3)}, rr(r) AS (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE)), "
    "kk(k) AS (VALUES (5), (10), (20)) SELECT id, r, k, count(*) FILTER ((CASE r WHEN 1.0::DOUBLE THEN n0 "
    "WHEN 2.0::DOUBLE THEN n1 ELSE n2 END) < k) AS n_windows FROM n, rr, kk GROUP BY id, r, k",
)
def _(spark, sf):
    queries = QuerySet([W], [S], RADII, [5, 10, 20])
    counts = cumulative_counts(histogram3(spark, sf), RADII, M).withColumnRenamed("r", "radius")
    asked = with_queries(counts, queries).where(F.col("radius") == F.col("r"))
    return asked.groupBy("id", "r", "k").agg(F.count_if(F.col("n") < F.col("k")).alias("n_windows"))


def earlier_pairs(
    spark: SparkSession, sf: str, radius: float, keep: Recent | Skyband, limit: tuple[float, int] | None = None
) -> DataFrame:
    """Pairs with earlier neighbours for a list; ``limit`` = (radius, k) skips slides that cannot matter."""
    pts = event_slides(spark, sf)
    if limit is not None:
        probes = looking_back(pts, D1, limit[0], limit[1], M)
    else:
        probes = pts.withColumns({"first": F.col("sl") - (M - 1), "last": F.col("sl") - 1})
    return window_pairs(probes, pts, slide=S, span=M, radius=radius, space=D1, keep=keep)


_EARLIER5 = f"WITH {points_sql(EVENTS_SQL)}, {pairs_sql(5.0, earlier=True)}"
_RECENT = (
    f"{_EARLIER5}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nsl DESC, nid DESC) AS rank FROM pr) "
    "SELECT id, nid, rank FROM r WHERE rank <= 10"
)


@query("topk_recent_neighbors", _RECENT)
def _(spark, sf):
    recent = nb.most_recent(earlier_pairs(spark, sf, 5.0, Recent(10), (5.0, 10)), 10)
    return recent.select("id", "nid", F.col("rank").cast("bigint").alias("rank"))


@query("merge_recent_neighbors", _RECENT)
def _(spark, sf):
    pairs = earlier_pairs(spark, sf, 5.0, nb.parted(4, 10), (5.0, 10)).withColumn("part", F.pmod("nid", F.lit(4)))
    return nb.merge_recent(pairs, 10).select("id", "nid", F.col("rank").cast("bigint").alias("rank"))


@query(
    "topk_recent_per_band",
    f"{_EARLIER5}, r AS (SELECT *, {_BAND} AS band, row_number() OVER (PARTITION BY id, {_BAND} "
    "ORDER BY nsl DESC, nid DESC) AS rank FROM pr) SELECT id, band, nid, rank FROM r WHERE rank <= 3",
)
def _(spark, sf):
    banded = nb.most_recent_per_band(earlier_pairs(spark, sf, 5.0, nb.banded(RADII, 3)), RADII, 3)
    return banded.select("id", "band", "nid", F.col("rank").cast("bigint").alias("rank"))


@query(
    "layered_skyband",
    f"{_EARLIER5}, b AS (SELECT *, {_BAND} AS band FROM pr), r AS (SELECT *, "
    + ", ".join(
        f"count(*) FILTER (band <= {i}) OVER (PARTITION BY id ORDER BY nsl DESC, nid DESC "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k{i}" for i in range(3)
    )
    + " FROM b) SELECT id, nid, band FROM r WHERE (CASE band WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END) < 5",
)
def _(spark, sf):
    return nb.layered_skyband(earlier_pairs(spark, sf, 5.0, nb.banded(RADII, 5), (1.0, 5)), RADII, 5).select("id", "nid", "band")


@query(
    "k_skyband",
    f"WITH {points_sql(EVENTS_SQL)}, {pairs_sql(2.0, earlier=True)} "
    "SELECT a.id, a.nid, (SELECT count(*) FROM pr b WHERE b.id = a.id AND b.d <= a.d AND b.nsl > a.nsl) AS dominators "
    "FROM pr a WHERE (SELECT count(*) FROM pr b WHERE b.id = a.id AND b.d <= a.d AND b.nsl > a.nsl) <= 4",
)
def _(spark, sf):
    return nb.k_skyband(earlier_pairs(spark, sf, 2.0, Skyband(4)), 4, M).select("id", "nid", "dominators")


@query(
    "k_skyband_long",
    f"WITH {points_sql(EVENTS_SQL, 5)}, {pairs_sql(1.0, span=200, earlier=True)} "
    "SELECT a.id, a.nid, (SELECT count(*) FROM pr b WHERE b.id = a.id AND b.d <= a.d AND b.nsl > a.nsl) AS dominators "
    "FROM pr a WHERE (SELECT count(*) FROM pr b WHERE b.id = a.id AND b.d <= a.d AND b.nsl > a.nsl) <= 4",
)
def _(spark, sf):
    """The skyband in windows of 200 slides."""
    pts = event_slides(spark, sf, 5)
    probes = pts.withColumns({"first": F.col("sl") - 199, "last": F.col("sl") - 1})
    pairs = window_pairs(probes, pts, slide=5, span=200, radius=1.0, space=D1, keep=Skyband(4))
    return nb.k_skyband(pairs, 4, 200).select("id", "nid", "dominators")


# --- dense cells, partial counts, status ----------------------------------


def _cell(radius: float) -> str:
    return f"floor(x0 / {radius * (1 - SLACK)!r}::DOUBLE)::BIGINT"


@query(
    "dense_cells",
    f"WITH {points_sql(EVENTS_SQL)}, q AS (SELECT {_cell(2.0)} AS dcell, unnest(range(sl, sl + {M})) AS e FROM p) "
    "SELECT e, dcell, count(*) AS n FROM q GROUP BY e, dcell HAVING count(*) > 20",
)
def _(spark, sf):
    return dense_cells(event_slides(spark, sf), D1, 2.0, 20, M)


@query(
    "dense_anti_join",
    f"WITH {points_sql(EVENTS_SQL)}, q AS (SELECT id, {_cell(2.0)} AS dcell, unnest(range(sl, sl + {M})) AS e FROM p), "
    "z AS (SELECT e, dcell FROM q GROUP BY e, dcell HAVING count(*) > 20) "
    "SELECT e, id FROM q ANTI JOIN z USING (e, dcell)",
)
def _(spark, sf):
    return outside_dense_cells(event_slides(spark, sf), D1, 2.0, 20, M)


@query(
    "partition_outliers",
    f"WITH {points_sql(EVENTS_SQL)}, {pairs_sql(5.0)}, {histogram_sql([5.0])}, {counts_sql({W: M}, 1)} "
    f"SELECT {_below(BOUNDS, 'b < x0')} AS part, e, count(*) FILTER (n0 < 10) AS n_outliers "
    "FROM n JOIN p USING (id) GROUP BY ALL",
)
def _(spark, sf):
    return partition_outliers(events(spark, sf), W, S, 5.0, 10, BoundsRoute([BOUNDS], 5.0), D1)


_STATUS = (
    f"{_HIST5}, pe AS (SELECT id, sl, unnest(range(sl, sl + {M})) AS e FROM p), "
    "c AS (SELECT pe.e, pe.id, sum(CASE WHEN h.nsl >= pe.sl THEN c0 ELSE 0 END) AS late, sum(c0) AS total "
    f"FROM pe JOIN h ON h.id = pe.id AND h.nsl BETWEEN pe.e - {M - 1} AND pe.e GROUP BY pe.e, pe.id), "
    "st AS (SELECT e, id, CASE WHEN late >= 10 THEN 'safe_inlier' WHEN total >= 10 THEN 'inlier' ELSE 'outlier' END "
    "AS status FROM c)"
)


@query("point_status", f"{_STATUS} SELECT e, id, status FROM st")
def _(spark, sf):
    return st.point_status(events(spark, sf), W, S, 5.0, 10, D1)


_STATUS_LONG = (
    f"WITH p AS (SELECT *, id // 5 AS sl FROM ({EVENTS_SQL})), "
    "pr AS (SELECT a.id, a.sl, b.id AS nid, b.sl AS nsl FROM p a JOIN p b "
    "ON b.id BETWEEN a.id - 1000 AND a.id + 1000 AND abs(a.sl - b.sl) < 200 "
    "AND abs(a.x0 - b.x0) <= 0.5::DOUBLE), "
    "h AS (SELECT id, nsl, count(*) FILTER (nid <> id) AS c FROM pr GROUP BY id, nsl), "
    "cum AS (SELECT id, nsl, sum(c) OVER (PARTITION BY id ORDER BY nsl) AS s FROM h), "
    "pe AS (SELECT id, sl, unnest(range(sl, sl + 200)) AS e FROM p), "
    "t AS (SELECT pe.e, x.s AS upto, coalesce(y.s, 0) AS gone, coalesce(z.s, 0) AS early FROM pe "
    "ASOF JOIN cum x ON pe.id = x.id AND x.nsl <= pe.e "
    "ASOF LEFT JOIN cum y ON pe.id = y.id AND y.nsl <= pe.e - 200 "
    "ASOF LEFT JOIN cum z ON pe.id = z.id AND z.nsl <= pe.sl - 1) "
    "SELECT e, CASE WHEN upto - early >= 10 THEN 'safe_inlier' WHEN upto - gone >= 10 THEN 'inlier' ELSE 'outlier' END "
    "AS status, count(*) AS n FROM t GROUP BY ALL"
)


@query("point_status_long", _STATUS_LONG)
def _(spark, sf):
    """Points per window and status, with 200 slides in a window."""
    return st.point_status(events(spark, sf), 1000, 5, 0.5, 10, D1).groupBy("e", "status").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "status_transitions",
    f"{_STATUS}, l AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY e) AS previous FROM st) "
    "SELECT e, id, previous, status FROM l WHERE previous <> status",
)
def _(spark, sf):
    return st.status_transitions(st.point_status(events(spark, sf), W, S, 5.0, 10, D1))


@query(
    "safe_inliers",
    f"{_HIST5} SELECT id FROM h WHERE nsl >= sl GROUP BY id HAVING sum(c0) >= 10",
)
def _(spark, sf):
    return st.safe_inliers(events(spark, sf), W, S, 5.0, 10, D1)


@query(
    "expiry_schedule",
    f"{_STATUS}, i AS (SELECT st.e, st.id, p.sl FROM st JOIN p USING (id) WHERE status = 'inlier'), "
    f"f AS (SELECT i.e, i.id, i.sl, unnest(range(i.e + 1, i.sl + {M})) AS x FROM i), "
    "g AS (SELECT f.e, f.id, f.x, coalesce(sum(h.c0), 0) AS n FROM f LEFT JOIN h ON h.id = f.id "
    f"AND h.nsl > f.x - {M} AND h.nsl <= f.e GROUP BY f.e, f.id, f.x), "
    "b AS (SELECT e, id, min(x) AS expires FROM g WHERE n < 10 GROUP BY e, id) "
    "SELECT i.e, i.id, b.expires FROM i LEFT JOIN b ON b.e = i.e AND b.id = i.id",
)
def _(spark, sf):
    return st.expiry_schedule(events(spark, sf), W, S, 5.0, 10, D1)


# --- detection ------------------------------------------------------------


def _single(strategy: str) -> Query:
    return lambda spark, sf: detect_outliers(events(spark, sf), W, S, 5.0, 10, strategy, D1)


for _name in ("parallel", "advanced", "advanced_vp", "slicing", "pmcod"):
    query(f"single_{_name}", single_sql(EVENTS_SQL, W, S, 5.0, 10))(_single(_name))


@query("single_narrow", single_sql(EVENTS_SQL, W, S, 2.0, 20))
def _(spark, sf):
    return detect_outliers(events(spark, sf), W, S, 2.0, 20, space=D1)


@query("single_tumbling", single_sql(EVENTS_SQL, 500, 500, 2.0, 10))
def _(spark, sf):
    return detect_outliers(events(spark, sf), 500, 500, 2.0, 10, space=D1)


@query("single_long_window", single_sql(EVENTS_SQL, 2000, 10, 1.0, 10))
def _(spark, sf):
    return detect_outliers(events(spark, sf), 2000, 10, 1.0, 10, space=D1)


@query("single_bounds_grid", single_sql(EVENTS_SQL, W, S, 5.0, 10))
def _(spark, sf):
    return detect_outliers(events(spark, sf), W, S, 5.0, 10, space=D1, part=BoundsRoute([BOUNDS], 5.0))


@query("single_2d_grid", single_sql(PLANE_SQL, W, S, 5.0, 5, 2))
def _(spark, sf):
    return detect_outliers(plane(spark, sf), W, S, 5.0, 5, space=D2)


@query("single_2d_metric", single_sql(PLANE_SQL, W, S, 5.0, 5, 2))
def _(spark, sf):
    return detect_outliers(plane(spark, sf), W, S, 5.0, 5, "slicing", D2, part="metric")


@query("single_embeddings", single_sql(VECTORS_SQL, 100, 50, 1.2, 2, 64))
def _(spark, sf):
    return detect_outliers(vectors(spark, sf), 100, 50, 1.2, 2, "advanced_vp", D64)


def _taxi(sql: str) -> str:
    """The same SQL in the plane with the sum of the coordinates' differences."""
    return sql.replace(distance_sql("a", "b", 2), "(abs(a.x0-b.x0) + abs(a.x1-b.x1))")


@query("single_manhattan", _taxi(single_sql(PLANE_SQL, W, S, 5.0, 5, 2)))
def _(spark, sf):
    """Another metric, with cells and dense cells by what it says of coordinates."""
    return detect_outliers(plane(spark, sf), W, S, 5.0, 5, space=Space(2, MANHATTAN))


@query("single_plug_in_clusters", _taxi(single_sql(PLANE_SQL, W, S, 5.0, 5, 2)))
def _(spark, sf):
    """A metric of which nothing is known but that it is one: free centres and vantage points."""
    return detect_outliers(plane(spark, sf), W, S, 5.0, 5, "free_clusters", Space(2, lambda a, b: MANHATTAN(a, b)))


@query("single_embedding_clusters", single_sql(VECTORS_SQL, 100, 50, 1.2, 2, 64))
def _(spark, sf):
    return detect_outliers(vectors(spark, sf), 100, 50, 1.2, 2, "free_clusters", D64)


@query("single_order_lines", single_sql(LINES_SQL, 2000, 500, 1.0, 3, 2))
def _(spark, sf):
    return detect_outliers(order_lines(spark, sf), 2000, 500, 1.0, 3, space=D2)


@query("single_same_user", single_sql(USERS_SQL, W, S, 0.0, 3))
def _(spark, sf):
    return detect_outliers(users(spark, sf), W, S, 0.0, 3, space=D1)


@query("single_orders", single_sql(ORDERS_SQL, 1000, 250, 2000.0, 5))
def _(spark, sf):
    return detect_outliers(orders(spark, sf), 1000, 250, 2000.0, 5, "slicing", D1)


@query(
    "single_report_text",
    f"SELECT concat(e, ';', n_outliers) AS line FROM ({single_sql(EVENTS_SQL, W, S, 5.0, 10)})",
)
def _(spark, sf):
    return report_lines(detect_outliers(events(spark, sf), W, S, 5.0, 10, space=D1))


RK_PAIRS = [(5, 1.0), (10, 2.0), (20, 5.0)]


def _rk(strategy: str) -> Query:
    return lambda spark, sf: detect_rk(events(spark, sf), W, S, RK_PAIRS, strategy, D1)


for _name in ("pamcod", "sop", "pmcsky", "psod"):
    query(f"rk_{_name}", rk_sql(EVENTS_SQL, W, S, RADII, [5, 10, 20]))(_rk(_name))

RKWS_ARGS = ([1000, 2000], [200, 500], [1.0, 5.0], [5, 20])


def _rkws(strategy: str) -> Query:
    return lambda spark, sf: detect_rkws(events(spark, sf), *RKWS_ARGS, strategy, D1)


for _name in ("sop", "pmcsky", "psod"):
    query(f"rkws_{_name}", rkws_sql(EVENTS_SQL, *RKWS_ARGS, 100))(_rkws(_name))


# --- streams --------------------------------------------------------------


BATCHES = 4
FILES_PER_BATCH = 2


def _in_batches(spark: SparkSession, sf: str, late: int | None = None) -> tuple[list[DataFrame], int]:
    """The events by ranges of ids, and the ids in a range; every ``late``-th event goes to the range after its own."""
    table = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    low, high = (x or 0 for x in table.agg(F.min("event_id"), F.max("event_id")).first())
    shift = f" + int(event_id % {late} = 0)" if late else ""
    place = F.expr(f"least((event_id - {low}) * {BATCHES} div {high - low + 1}{shift}, {BATCHES - 1})")
    return [table.where(place == i) for i in range(BATCHES)], -(-(high - low + 1) // BATCHES)


def _table_stream(spark: SparkSession, batches: list[DataFrame]) -> DataFrame:
    """Batches that arrive one after the other as parquet files."""
    folder = shared_dir(spark, "event-files")
    for batch in batches:
        batch.repartition(FILES_PER_BATCH).write.mode("append").parquet(folder)
    return stream_table_points(
        spark, folder, "event_id bigint, value double", "event_id", ["value"], files_per_trigger=FILES_PER_BATCH
    )


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of several batches, by ranges of ids that arrive one after the other."""
    return _table_stream(spark, _in_batches(spark, sf)[0])


def late_stream(spark: SparkSession, sf: str, slide: int) -> tuple[DataFrame, int]:
    """The same, with every seventh point a batch late; also how many slides late that can be."""
    batches, size = _in_batches(spark, sf, late=7)
    return _table_stream(spark, batches), 2 * size // slide + 2


def text_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as text files that arrive one after the other."""
    folder = shared_dir(spark, "event-text")
    for batch in _in_batches(spark, sf)[0]:
        lines = format_points(points_from_table(batch, "event_id", ["value"]))
        lines.coalesce(1).write.mode("append").text(folder)
    return stream_text_points(spark, folder, files_per_trigger=1)


def _finished(started) -> DataFrame:
    running, report = started
    running.awaitTermination()
    return report()


@query("stream_single", single_sql(EVENTS_SQL, W, S, 5.0, 10, closed_only=True))
def _(spark, sf):
    store = shared_dir(spark, "stream-single")
    return _finished(stream_outliers(event_stream(spark, sf), W, S, 5.0, 10, store, space=D1))


@query("stream_rk", rk_sql(EVENTS_SQL, W, S, RADII, [5, 10, 20], closed_only=True))
def _(spark, sf):
    store = shared_dir(spark, "stream-rk")
    return _finished(stream_rk(event_stream(spark, sf), W, S, RK_PAIRS, store, space=D1))


@query("stream_rkws", rkws_sql(EVENTS_SQL, *RKWS_ARGS, 100, closed_only=True))
def _(spark, sf):
    store = shared_dir(spark, "stream-rkws")
    return _finished(stream_rkws(event_stream(spark, sf), *RKWS_ARGS, store, space=D1))


@query("stream_text_single", single_sql(EVENTS_SQL, W, S, 5.0, 10, closed_only=True))
def _(spark, sf):
    store = shared_dir(spark, "stream-text")
    return _finished(stream_outliers(text_stream(spark, sf), W, S, 5.0, 10, store, space=D1))


@query("stream_plane", single_sql(PLANE_SQL, W, S, 5.0, 5, dims=2, closed_only=True))
def _(spark, sf):
    """Two coordinates, of which the second is computed from the stream's own columns."""
    store = shared_dir(spark, "stream-plane")
    table = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value", "ts")
    folder = shared_dir(spark, "plane-files")
    table.repartitionByRange(BATCHES, "event_id").write.parquet(folder)
    stream = points_from_table(
        spark.readStream.schema(table.schema).parquet(folder), "event_id", ["value", F.expr(HOUR)]
    )
    return _finished(stream_outliers(stream, W, S, 5.0, 5, store, space=D2))


@query("stream_corrections", single_sql(EVENTS_SQL, W, S, 5.0, 10, closed_only=True))
def _(spark, sf):
    """Late points correct the windows that were reported without them."""
    points, late = late_stream(spark, sf, S)
    store = shared_dir(spark, "stream-corrections")
    return _finished(stream_outliers(points, W, S, 5.0, 10, store, space=D1, lateness=late))


@query(
    "stream_transitions",
    f"{_STATUS}, l AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY e) AS previous FROM st) "
    "SELECT e, id, previous, status FROM l WHERE previous <> status AND e < (SELECT max(sl) FROM p)",
)
def _(spark, sf):
    store = shared_dir(spark, "stream-transitions")
    return _finished(stream_transitions(event_stream(spark, sf), W, S, 5.0, 10, store, D1))


@query(
    "stream_native_single",
    f"SELECT * FROM ({single_sql(EVENTS_SQL, W, S, 5.0, 10)}) WHERE e < (SELECT max(event_id) // {S} FROM events) - {M}",
)
def _(spark, sf):
    """Joins and aggregates of the stream alone; a window is reported one window's length later."""
    store = shared_dir(spark, "stream-native")
    report = window_outliers(event_stream(spark, sf), W, S, 5.0, 10, D1)
    table_sink(report, f"{store}/report", f"{store}/checkpoint").awaitTermination()
    return spark.read.schema("e bigint, n_outliers bigint").parquet(f"{store}/report")


@query(
    "stream_replicas",
    f"WITH {_GRID1D}, q AS (SELECT part, home, sl, unnest(range(sl, sl + {M})) AS e FROM g) "
    "SELECT e, count(*) FILTER (part = home) AS n_home, count(*) FILTER (part <> home) AS n_replica "
    "FROM q WHERE (part = home OR sl = e) AND e < (SELECT max(sl) FROM g) GROUP BY e",
)
def _(spark, sf):
    store = shared_dir(spark, "stream-replicas")
    counts = window_replicas(event_stream(spark, sf), BoundsRoute([BOUNDS], 5.0), W, S, D1)
    table_sink(counts, f"{store}/report", f"{store}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{store}/report")


@query(
    "stream_window_density",
    f"WITH {points_sql(EVENTS_SQL)}, q AS (SELECT {_cell(2.0)} AS dcell, unnest(range(sl, sl + {M})) AS e FROM p), "
    "c AS (SELECT e, dcell, count(*) AS n FROM q GROUP BY e, dcell) "
    "SELECT e, sum(n)::BIGINT AS n_points, coalesce(sum(n) FILTER (n > 20), 0)::BIGINT AS n_settled, "
    "count(*) FILTER (n > 20) AS n_dense_cells FROM c WHERE e < (SELECT max(sl) FROM p) GROUP BY e",
)
def _(spark, sf):
    store = shared_dir(spark, "stream-density")
    density = window_density(event_stream(spark, sf), W, S, 2.0, 20, D1)
    table_sink(density, f"{store}/report", f"{store}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{store}/report")
