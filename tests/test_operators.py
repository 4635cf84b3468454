import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lonepoint.functions import MANHATTAN, Space, distance_band, euclidean, event_time
from lonepoint.functions.slides import EVENT_BASE, slide_of_time
from lonepoint.operators import joins, line
from lonepoint.operators import neighbours as nb
from lonepoint.operators import routes as rt
from lonepoint.operators import search
from lonepoint.operators.blocks import near_pairs
from lonepoint.operators.histogram import neighbour_histogram
from lonepoint.operators.joins import collapse_copies, knn_join, pivot_prune_join, range_join, window_pairs
from lonepoint.operators.search import nearest_anywhere
from lonepoint.operators.training import (
    median_distance, median_vector, train_balls, train_bounds, train_pivots, train_vantage_tree,
)
from lonepoint.operators.windows import histogram_counts, slide_histogram, window_counts
from lonepoint.plans.detect import keyed_points
from lonepoint.sources import (
    duplicate_ids, format_points, parse_points, points_from_table, read_text_points, report_lines,
    sample_head, sample_random, write_report,
)

from . import brute
from .test_detect import crowd, frame


def routes(pts, radius, dims):
    tree = train_vantage_tree(pts, 8)
    bounds = train_bounds(pts, 4, axes=min(dims, 2))
    return {
        "grid": rt.GridRoute(radius),
        "hash": rt.HashRoute(3),
        "salted grid": rt.HashRoute(3, rt.GridRoute(radius)),
        "bounds": rt.BoundsRoute(bounds, radius),
        "band": rt.BandRoute(median_vector(np.array([[1.0] * dims])), radius),
        "vantage": rt.VantageRoute(tree, radius),
        "rings": rt.VantageRoute(tree, radius, rings=True),
        "pivot": rt.PivotRoute(train_pivots(pts, 5), radius),
        "balls": rt.BallRoute(train_balls(pts, 3, Space(dims)), radius),
    }


@pytest.mark.parametrize("dims", [1, 2, 10])
def test_routes_never_lose_a_pair(spark, dims):
    radius, points = 1.5, crowd(90, dims, seed=dims)
    pts = frame(spark, points)
    space = Space(dims)
    pairs = {(i, j) for i, v in points for j, u in points if brute.near(v, u, radius)}
    for name, route in routes(pts, radius, dims).items():
        rows = rt.assign(space.project(pts, "id"), route, space).select("id", "part", "is_home").collect()
        homes = {}
        for r in rows:
            if r["is_home"]:
                assert r["id"] not in homes, name
                homes[r["id"]] = str(r["part"])
        assert len(homes) == len(points), name
        copies = {(r["id"], str(r["part"])) for r in rows}
        assert all((j, homes[i]) in copies for i, j in pairs), name


def test_presets(spark):
    pts = Space(1).project(frame(spark, [(0, [80.0]), (1, [100.37]), (2, [200.0])]), "id")
    got = rt.BoundsRoute.preset("stock", 0.1).with_home(pts, Space(1)).collect()
    assert [r["part"] for r in sorted(got, key=lambda r: r["id"])] == [0, 7, 15]
    for bounds in rt.STOCK_BOUNDS.items():
        assert len(bounds[1]) == bounds[0] - 1
    assert rt.BoundsRoute.preset("tao", 1.0).cells == 16 and rt.BoundsRoute.preset("fc_5d", 1.0).cells == 32


def test_stale_replicas(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, False)], "sl bigint, is_home boolean")
    assert rt.drop_stale_replicas(rows, F.lit(2)).count() == 2


def test_distances(spark):
    row = spark.range(1).select(
        euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("a"),
        euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0))).alias("b"),
        distance_band(F.lit(1.0), [2.0, 1.0]).alias("c"),
        distance_band(F.lit(2.5), [2.0, 1.0]).alias("d"),
        slide_of_time(event_time("id")).alias("e"),
        F.unix_timestamp(event_time("id")).alias("f"),
    ).first()
    assert tuple(row) == (5.0, 4.0, 0, 2, 0, EVENT_BASE)


def test_training(spark):
    pts = frame(spark, [(i, [float(i % 10), float(i)]) for i in range(101)])
    assert median_vector(np.array([[1.0, 5.0], [1.0, 2.0], [0.0, 9.0]])).tolist() == [1.0, 2.0]
    tree = train_vantage_tree(pts, 16)
    assert tree.leaves == 16
    assert len(train_pivots(pts, 4)) == 4
    line = frame(spark, [(i, [float(i)]) for i in range(11)])
    assert median_distance(line, Space(1)).first()[0] == 3.0
    for bad in (1, 3, 128):
        with pytest.raises(ValueError):
            train_vantage_tree(pts, bad)


@pytest.mark.parametrize("dims", [2, 12])
def test_range_join(spark, dims):
    points = crowd(80, dims, seed=21)
    pts, space, radius = frame(spark, points), Space(dims), 2.0
    expected = {(i, j) for i, v in points for j, u in points if brute.near(v, u, radius)}
    for name, route in routes(pts, radius, dims).items():
        got = [(r[0], r[1]) for r in range_join(pts, pts, radius, space, route).select("qid", "nid").collect()]
        assert len(got) == len(set(got)) and set(got) == expected, name
    pruned = pivot_prune_join(pts, pts, radius, space, train_pivots(pts, 4)).select("qid", "nid").collect()
    assert {(r[0], r[1]) for r in pruned} == expected and len(pruned) == len(expected)


def test_range_join_cuts_crowded_partitions(spark, monkeypatch):
    from lonepoint.operators import joins

    for name in ("CHUNK_ROWS", "BLOCK_ROWS"):
        monkeypatch.setattr(joins, name, 5)
    for dims in (2, 12):
        points = crowd(80, dims, seed=22)
        pts = frame(spark, points)
        got = range_join(pts, pts, 2.0, Space(dims)).select("qid", "nid").collect()
        expected = {(i, j) for i, v in points for j, u in points if brute.near(v, u, 2.0)}
        assert len(got) == len(expected) and {(r[0], r[1]) for r in got} == expected


@pytest.mark.parametrize("dims", [2, 12])
def test_knn(spark, dims):
    points = crowd(90, dims, seed=31)
    pts = frame(spark, points)
    got = {}
    for r in knn_join(pts, pts, 4, Space(dims)).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["nid"])
    for i, v in points:
        order = sorted((round(brute.distance(v, u), 9), j) for j, u in points if j != i)[:4]
        assert got[i] == [j for _, j in order]


def test_knn_of_long_vectors_sends_a_query_once_per_group(spark, monkeypatch):
    """Distances are nearly equal, so no cell is ruled out; a query must not be sent to each of the 20 cells."""
    rng = random.Random(3)
    points = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)]
    sent, near = [], joins._near

    def counted(left, *args, **options):
        sent.append(left.count())
        return near(left, *args, **options)

    monkeypatch.setattr(joins, "BLOCK_ROWS", 100)
    monkeypatch.setattr(joins, "_near", counted)
    pts = frame(spark, points)
    assert _ranked(knn_join(pts, pts, 3, Space(16))) == _nearest(points, points, 3)
    assert sent[0] == 400 and sum(sent) <= 8 * 400


def test_cell_groups():
    assert joins.cell_groups([[0.0], [10.0], [1.0], [11.0], [30.0]], [4, 3, 4, 3, 50], 8) == [0, 1, 0, 1, 2]
    assert joins.cell_groups([[0.0]], [0], 8) == [0]


def _nearest(queries, points, n, exclude_self=True):
    out = {}
    for i, v in queries:
        order = sorted(
            (brute.distance(v, u), j) for j, u in points
            if u is not None and None not in u and np.isfinite(u).all() and (j != i or not exclude_self)
        )
        out[i] = [j for _, j in order[:n]]
    return out


def _ranked(df):
    got = {}
    for r in df.orderBy("qid", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["qid"], [])) + 1
        got[r["qid"]].append(r["nid"])
    return got


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_search_without_radius(spark, dims):
    """Crowds, lonely points, copies, odd coordinates, and queries far from all points."""
    rng = random.Random(dims)
    points = crowd(150, dims, seed=40 + dims)
    points += [(200 + i, [1e6 + rng.random() * 1e-3 for _ in range(dims)]) for i in range(12)]
    points += [(300, [-5e4] * dims), (301, [float("nan")] * dims), (302, [float("inf")] * dims)]
    far = [(900, [3e7] * dims), (901, [-7e6] + [0.0] * (dims - 1)), (902, [float("nan")] * dims)]
    space, pts = Space(dims), frame(spark, points)
    asked = points[:40] + points[150:163] + far
    expected = {i: js for i, js in _nearest(asked, points, 5).items() if i != 902}
    assert _ranked(nearest_anywhere(frame(spark, asked), pts, 5, space)) == expected
    assert _ranked(nearest_anywhere(frame(spark, asked), pts, 3, space, exclude_self=False)) == {
        i: js for i, js in _nearest(asked, points, 3, False).items() if i != 902
    }


def test_search_in_small_tables(spark):
    space = Space(2)
    same = [(i, [7.0, -7.0]) for i in range(9)]
    assert _ranked(nearest_anywhere(frame(spark, same), frame(spark, same), 4, space)) == _nearest(same, same, 4)
    few = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None)]
    pts = spark.createDataFrame(few, "id bigint, value array<double>")
    assert _ranked(nearest_anywhere(pts, pts, 4, space)) == {1: [2], 2: [1]}
    assert nearest_anywhere(pts, pts.where("false"), 4, space).collect() == []
    assert nearest_anywhere(pts.where("false"), pts, 4, space).collect() == []


def test_search_reads_balls_not_tables(spark):
    """Rows of the distance join stay near the number asked for, in crowds as well as outside."""
    from lonepoint.operators import search

    rng = random.Random(5)
    points = [(i, [rng.gauss(0, 1), rng.gauss(0, 1)] if i % 3 else [50 + rng.random() * 1e-4, rng.random() * 1e-4]) for i in range(6000)]
    pts, compared = frame(spark, points), spark.sparkContext.accumulator(0)
    original = search._near

    def counted(left, right, space):
        pairs = original(left, right, space)
        compared.add(pairs.count())
        return pairs

    search._near = counted
    try:
        found = nearest_anywhere(pts.where("id % 100 = 0"), pts, 5, Space(2)).count()
    finally:
        search._near = original
    assert found == 60 * 5 and compared.value < 60 * 300


def test_balls(spark):
    points = [(i, [random.Random(i).gauss(0, 1), random.Random(-i - 1).gauss(0, 1)]) for i in range(3000)]
    pts, space = frame(spark, points), Space(2)
    balls = train_balls(pts, 6, space)
    homes = rt.BallRoute(balls, 0.1).with_home(space.project(pts, "id"), space)
    sizes = [r["count"] for r in homes.groupBy("part").count().collect()]
    assert len(sizes) == 6 and sum(sizes) == 3000 and max(sizes) <= 2 * min(sizes)
    away = space.project(frame(spark, [(1, [90.0, 90.0])]), "id")
    with pytest.raises(Exception, match="outside of the balls"):
        rt.BallRoute(balls, 0.1).with_home(away, space).collect()
    assert rt.BallRoute(balls, 0.1).with_reach(away, space).first()["parts"]
    odd = space.project(frame(spark, [(1, [float("nan"), 0.0])]), "id")
    assert rt.BallRoute(balls, 0.1).with_home(odd, space).first()["part"] is not None
    with pytest.raises(ValueError):
        train_balls(pts, 6, Space())


def test_collapse_copies(spark):
    pts = frame(spark, [(i, [1.0]) for i in range(20)] + [(30, [2.0])])
    assert sorted(r["id"] for r in collapse_copies(pts, 3).collect()) == [0, 1, 2, 30]


def test_joins_of_points_are_not_broadcast(spark, tmp_path):
    """Their files are small, their rows are not: neither side may be gathered in the driver."""
    frame(spark, crowd(60, 2, seed=5)).write.parquet(f"{tmp_path}/points")
    pts = spark.read.parquet(f"{tmp_path}/points")
    keyed = keyed_points(pts, 10, Space(2, MANHATTAN))
    joins = [
        window_pairs(keyed, keyed, slide=10, span=2, radius=1.0, space=Space(2, MANHATTAN)),
        range_join(pts, pts, 1.0, Space(2)),
        pivot_prune_join(pts, pts, 1.0, Space(2), [[0.0, 0.0], [5.0, 5.0]]),
    ]
    for pairs in joins:
        joined = [x for x in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "Inner" in x]
        assert joined and all("SortMergeJoin" in x for x in joined)


def test_near_pairs_tiles(monkeypatch):
    from lonepoint.operators import blocks

    monkeypatch.setattr(blocks, "TILE_CELLS", 64)
    rng = np.random.default_rng(1)
    x, y = rng.random((40, 9)), rng.random((30, 9))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    i, j, _ = near_pairs(x, y, 1.0, None)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(d <= 1.0))))
    i, j, _ = near_pairs(x, y, None, 3)
    for q in range(len(x)):
        assert set(np.argsort(d[q])[:3]) <= set(j[i == q])


def test_near_pairs_keep_ties_and_bounds(monkeypatch):
    """Whole numbers, so that many distances are equal; tiles shorter than the limit and longer."""
    from lonepoint.operators import blocks

    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, 3, (n, 9)).astype(float) for n in (23, 60))
    x[4], y[7], y[8] = np.nan, np.inf, 1e200
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    d = np.where(np.isfinite(d), d, np.inf)
    bound = np.where(np.arange(23) % 3, np.nan, 3.0)
    for columns in (2, 7, 64):
        monkeypatch.setattr(blocks, "TILE_COLUMNS", columns)
        monkeypatch.setattr(blocks, "TILE_CELLS", 4 * columns)
        for limit in (1, 5, 100):
            last = np.sort(d, axis=1)[:, min(limit, 60) - 1]
            for most in (None, bound):
                wanted = (d <= last[:, None]) & np.isfinite(d)
                if most is not None:
                    wanted &= ~(d > most[:, None])
                i, j, found = near_pairs(x, y, None, limit, most)
                assert sorted(zip(i.tolist(), j.tolist())) == list(zip(*(a.tolist() for a in np.nonzero(wanted))))
                assert (found == d[i, j]).all()


def test_functions_ship_by_value(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(near_pairs))
    code = (
        "import pickle, numpy as np; f = pickle.load(open('f.pkl', 'rb')); "
        "print(len(f(np.zeros((2, 9)), np.zeros((3, 9)), 1.0, None)[0]))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "6"


def test_histogram_with_copies(spark):
    points = crowd(90, 1, seed=41)
    pts = keyed_points(frame(spark, points), 10, Space(1))
    got = {
        (r["id"], r["nsl"]): (r["c0"], r["c1"])
        for r in neighbour_histogram(pts, 10, 3, [0.2, 1.0], Space(1)).collect()
    }
    for i, v in points:
        for nsl in range(i // 10 - 2, i // 10 + 3):
            counts = tuple(
                sum(1 for j, u in points if j != i and j // 10 == nsl and brute.near(v, u, r)) for r in (0.2, 1.0)
            )
            assert got.get((i, nsl), (0, 0)) == counts


def test_trimming_keeps_all_answers(spark):
    radii, k, span = [0.3, 1.0, 2.0], 3, 4
    pts = keyed_points(frame(spark, crowd(120, 1, seed=51)), 10, Space(1))
    pairs = window_pairs(pts, pts, slide=10, span=span, radius=2.0, space=Space(1))
    full = {
        (r["e"], r["id"]): [min(r[f"n{i}"], k) for i in range(3)]
        for r in window_counts(pairs, radii, [span]).collect()
    }
    histogram = slide_histogram(pairs, radii)
    for rule in ("band", "layer", "skyband"):
        trimmed = histogram_counts(nb.trim_histogram(histogram, 3, k, rule), 3, [span])
        got = {(r["e"], r["id"]): [min(r[f"n{i}"], k) for i in range(3)] for r in trimmed.collect()}
        assert got == full, rule
    with pytest.raises(ValueError):
        nb.trim_histogram(histogram, 3, k, "other")


def test_skybands(spark):
    rng = random.Random(6)
    rows = [(i, 9, 100 + n, rng.randrange(5, 9), rng.choice([0.1, 0.5, 0.9, 1.5])) for i in range(4) for n in range(25)]
    pairs = spark.createDataFrame(rows, "id bigint, sl bigint, nid bigint, nsl bigint, d double")
    sky = {(r["id"], r["nid"]) for r in nb.k_skyband(pairs, 3, 6).collect()}
    assert sky == {
        (a[0], a[2]) for a in rows
        if sum(1 for b in rows if b[0] == a[0] and b[4] <= a[4] and b[3] > a[3]) <= 3
    }
    # The layered form, checked against inserting neighbours newest first.
    radii, k, expected = [0.2, 1.0, 2.0], 3, set()
    for i in range(4):
        kept = [0, 0, 0]
        for _, _, nid, _, d in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[3], -r[2])):
            band = sum(1 for r in radii if r < d)
            if sum(kept[: band + 1]) < k:
                kept[band] += 1
                expected.add((i, nid))
    assert {(r["id"], r["nid"]) for r in nb.layered_skyband(pairs, radii, k).collect()} == expected


def test_points_go_only_to_levels_that_are_searched_near_them(spark, monkeypatch):
    rng = random.Random(3)
    points = [(i, [rng.random() * 0.01, rng.random() * 0.01] if i % 2 else [rng.uniform(0, 100), rng.uniform(0, 100)]) for i in range(3000)]
    pts = spark.createDataFrame(points, "id bigint, value array<double>")
    sent, near = [], search._near

    def spy(left, right, space):
        sent.append((right.count(), left.select("part.level").distinct().count()))
        return near(left, right, space)

    monkeypatch.setattr(search, "_near", spy)
    found = nearest_anywhere(pts.where("id % 50 < 2"), pts, 3, Space(2)).collect()
    rows, levels = sent[0]
    assert levels > 2 and rows < 0.6 * levels * len(points)
    every = np.array([v for _, v in points])
    got = {}
    for r in found:
        got.setdefault(r["qid"], {})[r["rank"]] = r["nid"]
    assert len(got) == 120
    for q, ranks in got.items():
        d = np.sqrt(((every - every[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [ranks[i] for i in (1, 2, 3)] == np.argsort(d, kind="stable")[:3].tolist()


def odd_line(spark):
    """Crowded slides, copies of rows, values that are no numbers, gaps and a null id."""
    rng = random.Random(12)
    rows = [(i, rng.choice([1.0, 1.0, rng.uniform(0, 4), 900.0])) for i in range(260) if not 90 <= i < 130]
    rows += rows[40:60] + [(300, float("nan")), (301, float("inf")), (302, None), (303, 1.0), (None, 1.0)]
    pts = spark.createDataFrame([(i, None if v is None else [v]) for i, v in rows], "id bigint, value array<double>")
    return keyed_points(pts, 10, Space(1))


def listed(df):
    return sorted(map(repr, df.drop("sl").collect()))


@pytest.mark.parametrize("block", [1, 1 << 13])
def test_lists_on_a_line_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(line, "BLOCK_POINTS", block)
    monkeypatch.setattr(line, "PIECE_PAIRS", 50 * block)
    pts, span, radii = odd_line(spark), 4, [0.3, 1.0, 2.0]
    probes = pts.withColumns({"first": F.col("sl") - (span - 1), "last": F.col("sl") - 1})
    every = window_pairs(probes, pts, slide=10, span=span, radius=2.0, space=Space(1)).cache()
    lists = {
        "recent": (line.Recent(4), lambda p: nb.most_recent(p, 4).drop("d")),
        "band": (nb.banded(radii, 2), lambda p: nb.most_recent_per_band(p, radii, 2).drop("d")),
        "merged": (nb.parted(3, 4), lambda p: nb.merge_recent(p.withColumn("part", F.pmod("nid", F.lit(3))), 4)),
        "skyband": (line.Skyband(2), lambda p: nb.k_skyband(p, 2, span).select("id", "nid", "nsl", "d", "dominators")),
    }
    for name, (keep, build) in lists.items():
        pairs = window_pairs(probes, pts, slide=10, span=span, radius=2.0, space=Space(1), keep=keep)
        assert listed(build(pairs)) == listed(build(every)), name
    every.unpersist()


def test_crowds_on_a_line_hand_on_bounded_lists(spark):
    rows = spark.range(600).select("id", F.array(F.lit(5.0)).alias("value"))
    pts = keyed_points(rows, 100, Space(1))
    probes = pts.withColumns({"first": F.col("sl") - 3, "last": F.col("sl") - 1})
    for keep, most in ((line.Recent(5), 5), (nb.parted(4, 2), 8), (nb.banded([1.0, 2.0], 3), 3), (line.Skyband(4), 100)):
        pairs = window_pairs(probes, pts, slide=100, span=4, radius=2.0, space=Space(1), keep=keep)
        assert pairs.groupBy("id").count().agg(F.max("count")).first()[0] == most


def test_skybands_send_their_pairs_once(spark):
    rows = [(i, 9, n, n // 10, float(n % 7)) for i in range(40) for n in range(90)]
    pairs = spark.createDataFrame(rows, "id bigint, sl bigint, nid bigint, nsl bigint, d double")
    sky = nb.k_skyband(pairs, 4, 10)
    plan = sky._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    merged = nb.merge_recent(pairs.withColumn("part", F.pmod("nid", F.lit(4))), 5)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    # A walk that goes on over many batches.
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = sorted(map(repr, sky.collect()))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        assert sorted(map(repr, nb.k_skyband(pairs, 4, 10).collect())) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)


def test_text_points(spark, tmp_path):
    path = str(tmp_path / "points.txt")
    with open(path, "w") as f:
        f.write("1&0.5,2\n2&3&ignored\n3&1e-3,\n")
    rows = {r["id"]: r["value"] for r in read_text_points(spark, path).collect()}
    assert rows == {1: [0.5, 2.0], 2: [3.0], 3: [0.001]}
    back = parse_points(format_points(read_text_points(spark, path)))
    assert {r["id"]: r["value"] for r in back.collect()} == rows
    lines = spark.createDataFrame([("7&abc",), ("x&1",), ("8",), ("9&1",)], "value string")
    assert [r["id"] for r in parse_points(lines, permissive=True).collect()] == [9]
    for bad in ("7&abc", "x&1", "8"):
        with pytest.raises(Exception, match="not a point line"):
            parse_points(spark.createDataFrame([(bad,)], "value string")).collect()


def test_tables_samples_reports(spark, tmp_path):
    table = spark.range(50).select((F.col("id") + 5).alias("key"), (F.col("id") * 2).alias("v"))
    pts = points_from_table(table, "key", ["v", F.col("v") + 1])
    assert pts.first()["value"] == [0.0, 1.0]
    with pytest.raises(ValueError):
        points_from_table(table, "key")
    assert sorted(r["id"] for r in sample_head(pts, 3).collect()) == [5, 6, 7]
    one, two = sample_random(pts, 10, 1), sample_random(pts, 10, 1)
    assert {r["id"] for r in one.collect()} == {r["id"] for r in two.collect()} and one.count() == 10
    assert duplicate_ids(pts).count() == 0 and duplicate_ids(pts.union(pts)).count() == 50
    report = spark.createDataFrame([(3, 10, 5, 0.5, 2, 7)], "e bigint, w int, s int, r double, k int, n_outliers bigint")
    assert report_lines(report).first()[0] == "3;0.5;2;10;5;7"
    assert report_lines(report.select("e", "n_outliers")).first()[0] == "3;7"
    write_report(report.select("e", "r", "k", "n_outliers"), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first()[0] == "3;0.5;2;7"


def test_sorted_slides_count_as_the_distance_does(spark):
    """On one coordinate no pairs are made, also where x - r and x - y round differently."""
    rng = random.Random(8)
    values = [rng.randrange(400) / 100 for _ in range(160)] + [5e-17, -5e-17, 1e300, -1e300, math.inf, -math.inf, math.nan, 0.0, -0.0, 1e16]
    points = [(3 * i, [v]) for i, v in enumerate(values)]
    radii = [0.0, 0.07, 1.1, 2.0]
    pts = keyed_points(frame(spark, points), 30, Space(1))
    found = neighbour_histogram(pts, 30, 3, radii, Space(1))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.id, r.nsl): (r.c0, r.c1, r.c2, r.c3) for r in found.collect()}
    expected = {}
    for i, (x,) in points:
        for nsl in range(i // 30 - 2, i // 30 + 3):
            d = [abs(x - y) for j, (y,) in points if j != i and j // 30 == nsl]
            counts = tuple(sum(1 for t in d if t <= r) for r in radii)
            if counts[-1] or nsl == i // 30:
                expected[i, nsl] = counts
    assert got == expected


def test_sorted_slides_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(line, "BLOCK_POINTS", 1)
    points = [(i, [x]) for i, x in enumerate([None, 1.0, 1.5, 1.0, 7.0] * 12)] + [(4, [7.0]), (5, [None]), (None, [1.0])]
    pts = keyed_points(spark.createDataFrame(points, "id bigint, value array<double>"), 5, Space(1))
    made = []
    for most in (1 << 22, 0):
        monkeypatch.setattr(line, "MAX_SEARCHES", most)
        found = neighbour_histogram(pts, 5, 3, [0.5, 2.0], Space(1))
        made.append(sorted(tuple(r) for r in found.collect()))
    assert made[0] == made[1] and len(made[0]) > 60


def test_routes_deal_sorted_slides(spark):
    """Probes meet the points whose home is in their reach, without pairs; a route that hides points would show."""
    points = crowd(90, 1, seed=42)
    pts = keyed_points(frame(spark, points), 10, Space(1))
    plain = sorted(tuple(r) for r in neighbour_histogram(pts, 10, 3, [0.2, 1.0], Space(1)).collect())
    some = [rt.HashRoute(3, rt.GridRoute(1.0)), rt.HashRoute(2, rt.BandRoute([1.0], 1.0)), rt.VantageRoute(train_vantage_tree(frame(spark, points), 8), 1.0, rings=True)]
    for route in some:
        found = neighbour_histogram(pts, 10, 3, [0.2, 1.0], Space(1), route)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == plain
    class Nowhere(rt.HashRoute):
        def with_reach(self, df, space):
            return df.withColumn("parts", F.array(F.lit(self.width).cast("bigint")))
    assert neighbour_histogram(pts, 10, 3, [0.2, 1.0], Space(1), Nowhere(2)).count() == 0
