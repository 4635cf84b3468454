"""Window aggregates in Spark's own streaming state.

Event time, watermark, sliding windows and the report stage behind them.  What
is kept per window is one counter per cell, so the state is small however many
points a cell holds; it expires with the watermark.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slides import event_time, slide_index, slide_of_time
from ..functions.vectors import Space, finite
from ..operators.routes import Route, assign, drop_stale_replicas, grid_route


def with_event_time(points: DataFrame, slide: int, delay: int = 0) -> DataFrame:
    """Points with their slide, their event time and a watermark ``delay`` slides behind."""
    return (
        points.withColumn("sl", slide_index(slide))
        .withColumn("ts", event_time("sl"))
        .withWatermark("ts", f"{int(delay)} seconds")
    )


def window_cells(
    points: DataFrame, window: int, slide: int, radius: float, space: Space = Space(), delay: int = 0
) -> DataFrame:
    """Points per sliding window and dense cell: ``(window, dcell, n)``."""
    if window % slide:
        raise ValueError("the window must be a multiple of the slide")
    timed = with_event_time(points, slide, delay)
    keyed = space.project(timed, "ts").withColumn("dcell", space.dense_cell(radius))
    # One counter per slide and cell first: counters are copied to windows, points are not.
    per_slide = keyed.groupBy(F.window("ts", "1 second").alias("slide"), "dcell").agg(F.count(F.lit(1)).alias("n"))
    length = f"{window // slide} seconds"
    return (
        per_slide.withColumn("at", F.window_time("slide"))
        .groupBy(F.window("at", length, "1 second"), "dcell")
        .agg(F.sum("n").alias("n"))
    )


def window_replicas(
    points: DataFrame, route: Route, window: int, slide: int, space: Space = Space(), delay: int = 0
) -> DataFrame:
    """Per window: home points, and replicas that arrived in its last slide.

    Replicas of older slides are evicted from each window as it forms; a stream
    keeps two counters per open window.
    """
    if window % slide:
        raise ValueError("the window must be a multiple of the slide")
    copies = assign(space.project(with_event_time(points, slide, delay), "id", "sl", "ts"), route, space)
    placed = copies.withColumn("window", F.window("ts", f"{window // slide} seconds", "1 second"))
    newest = slide_of_time(F.col("window.end")) - 1
    return (
        drop_stale_replicas(placed, newest)
        .groupBy("window")
        .agg(F.count_if("is_home").alias("n_home"), F.count_if(~F.col("is_home")).alias("n_replica"))
        .select((slide_of_time(F.col("window.end")) - 1).alias("e"), "n_home", "n_replica")
    )


def window_density(
    points: DataFrame, window: int, slide: int, radius: float, k: int, space: Space = Space(), delay: int = 0
) -> DataFrame:
    """Per window: points, points in dense cells, dense cells.

    A second, tumbling stage adds up the cells of each window, as a stream: the
    report row of a window appears once the watermark has passed its end.
    """
    cells = window_cells(points, window, slide, radius, space, delay)
    dense = F.col("dcell").isNotNull() & (F.col("n") > k)
    return (
        cells.withColumn("closed", F.window_time("window"))
        .groupBy(F.window("closed", "1 second").alias("report"))
        .agg(
            F.sum("n").alias("n_points"),
            F.coalesce(F.sum(F.when(dense, F.col("n"))), F.lit(0)).alias("n_settled"),
            F.count_if(dense).alias("n_dense_cells"),
        )
        .select(
            slide_of_time(F.col("report.start")).alias("e"), "n_points", "n_settled", "n_dense_cells"
        )
    )


def _stream_cells(points: DataFrame, slide: int, space: Space, delay: int, route: Route, reach: bool) -> DataFrame:
    """Distinct vectors of each slide and partition, once the slide is closed.

    ``part, ts, sites``, and ``parts`` with ``reach``; ``sites`` are structs of ``id, n`` and the coordinates.  Vectors
    with a coordinate that is not an ordinary number stay by themselves.
    """
    timed = space.project(with_event_time(points, slide, delay), F.col("id").cast("bigint").alias("id"), "ts")
    if space.flat:
        ordinary = functools.reduce(lambda a, b: a & b, [finite(F.col(c)) for c in space.coords()])
    else:
        ordinary = F.forall("value", finite)
    alone = F.when(~ordinary, F.col("id")).alias("alone")
    placed = route.with_home(timed, space)
    placed = route.with_reach(placed, space) if reach else placed
    keys = ["part", "parts"] if reach else ["part"]
    point = F.struct(*space.coords(), alone, "id")
    cells = placed.groupBy(F.window("ts", "1 second").alias("slide"), *keys).agg(F.collect_list(point).alias("listed"))
    listed = cells.select(*keys, F.window_time("slide").alias("ts"), F.sort_array("listed").alias("listed"))

    def differs(i):
        a, b = F.get("listed", i), F.get("listed", i - 1)
        return ~functools.reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in (*space.coords(), "alone")])

    # Equal vectors are neighbours in the list, from each first place to a last one.
    newest = F.size("listed") - 1
    places = F.sequence(F.lit(0), newest)
    first = F.filter(places, lambda i: (i == 0) | differs(i))
    last = F.filter(places, lambda i: (i == newest) | differs(i + 1))

    def site(i, j):
        kept = F.get("listed", i)
        return F.struct(kept["id"].alias("id"), (j - i + 1).cast("bigint").alias("n"), *[kept[c].alias(c) for c in space.coords()])

    return listed.select(*keys, "ts", F.zip_with(first, last, site).alias("sites"))


def window_outliers(
    points: DataFrame, window: int, slide: int, radius: float, k: int,
    space: Space = Space(), route: Route | None = None, delay: int = 0,
) -> DataFrame:
    """Outliers per closed window, ``(e, n_outliers)``, by joins and aggregates of the stream alone.

    The distinct vectors of a slide and partition are one row.  Such rows are probes and stored points of a
    stream-stream join on the partition, within one window of time; the watermark removes both sides.  Vectors with
    more than k points near them in their own slide and partition are no probes: no window makes them outliers.  Two
    chained aggregates follow: neighbours per probe and window, outliers per window.  A window is reported when the
    watermark has passed its last probe by the length of a window, since a pair may come that late.
    """
    if window % slide:
        raise ValueError("the window must be a multiple of the slide")
    m = window // slide
    route = route or grid_route(space, radius)

    def close(p, q):
        return (space.between(p, q) <= F.lit(float(radius))) | (p["id"] == q["id"])

    def settled(p):
        """More than k points near a site in its own row, itself included."""
        add = lambda total, q: total + F.when(close(p, q), q["n"]).otherwise(F.lit(0).cast("bigint"))
        return F.aggregate("sites", F.lit(0).cast("bigint"), add) > k

    probes = _stream_cells(points, slide, space, delay, route, True)
    probes = probes.withColumn("open", F.filter("sites", lambda p: ~settled(p))).drop("sites")
    # Without open sites a row still says that its windows have points; it only meets itself.
    searching = F.size("open") > 0
    # Blocks of two windows' length are part of the key: rows meet the stored ones around their time, not all of their cell.
    sl, length = slide_of_time(F.col("ts")), 2 * m
    around = F.sequence(F.floor((sl - (m - 1)) / length), F.floor((sl + (m - 1)) / length))
    # Outer, though neither array is empty: Spark would test that by computing the arrays, and what they depend on, twice.
    parts = F.when(searching, F.array_distinct("parts")).otherwise(F.array("part"))
    blocks = F.when(searching, around).otherwise(F.array(F.floor(sl / length)))
    probes = probes.select("ts", "open", F.explode_outer(parts).alias("part"), blocks.alias("blocks"))
    probes = probes.select("ts", "open", "part", F.explode_outer("blocks").alias("block"))
    stored = _stream_cells(points, slide, space, delay, route, False).select(
        F.col("part").alias("npart"), F.col("sites").alias("nsites"), F.floor(sl / length).alias("nblock"), F.col("ts").alias("nts")
    )
    near_time = F.expr(f"nts BETWEEN ts - INTERVAL {m - 1} SECONDS AND ts + INTERVAL {m - 1} SECONDS")
    same = (F.col("part") == F.col("npart")) & (F.col("block") == F.col("nblock"))

    gap = slide_of_time(F.col("nts")) - slide_of_time(F.col("ts"))
    pairs = probes.join(stored, same & near_time).select("ts", gap.alias("gap"), F.explode_outer("open").alias("p"), "nsites")
    pairs = pairs.select("ts", "gap", "p", F.explode_outer("nsites").alias("q"))
    pairs = pairs.where(F.col("p").isNull() | close(F.col("p"), F.col("q"))).select(
        "ts", "gap", F.col("p.id").alias("id"), F.coalesce("p.n", F.lit(0).cast("bigint")).alias("n"), F.col("q.n").alias("nn")
    )
    # One row per probe with its neighbours by slide: probes are copied to windows, pairs are not.
    per_gap = [
        F.sum(F.when(F.col("gap") == j, F.col("nn")).otherwise(F.lit(0))).alias(f"g{j + m - 1}") for j in range(1 - m, m)
    ]
    counted = pairs.groupBy(F.window("ts", "1 second").alias("slide"), "id").agg(F.max("n").alias("n"), *per_gap)
    counted = counted.select("n", F.array(*[f"g{j}" for j in range(2 * m - 1)]).alias("near"), F.window_time("slide").alias("at"))
    placed = counted.withColumn("window", F.window("at", f"{m} seconds", "1 second"))
    after = slide_of_time(F.col("window.end")) - 1 - slide_of_time(F.col("at"))
    inside = F.aggregate(F.slice("near", after.cast("int") + 1, m), F.lit(0).cast("bigint"), lambda t, x: t + x)
    # A probe's own copies are counted with it, so fewer than k others reads: at most k.
    outliers = F.sum(F.when(inside <= k, F.col("n")).otherwise(F.lit(0)))
    return (
        placed.groupBy("window")
        .agg(outliers.alias("n_outliers"))
        .select((slide_of_time(F.col("window.end")) - 1).alias("e"), "n_outliers")
    )
