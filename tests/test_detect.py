import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lonepoint.functions import CHEBYSHEV, MANHATTAN, Metric, Space
from lonepoint.operators import histogram, pyramid
from lonepoint.operators.clusters import free_centres
from lonepoint.operators.density import unsettled_points
from lonepoint.operators.routes import BoundsRoute, GridRoute
from lonepoint.plans.detect import RK, RKWS, SINGLE, detect_outliers, detect_rk, detect_rkws, keyed_points
from lonepoint.plans.params import QuerySet, gcd_of, parse_rk, with_queries
from lonepoint.plans.status import expiry_schedule, point_status, safe_inliers, status_transitions

from . import brute

HAND = [(0, [0.0]), (1, [0.1]), (2, [0.2]), (3, [5.0]), (4, [5.1]), (5, [0.0])]


def frame(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in points], "id bigint, value array<double>")


def as_dict(df):
    return {r["e"]: r["n_outliers"] for r in df.collect()}


def crowd(n, dims, seed, spread=10.0):
    """A third of the points in one spot, some exact copies, the rest spread out."""
    rng = random.Random(seed)
    points = []
    for i in range(n):
        if i % 3 == 0:
            v = [2.0 + rng.random() * 0.01 for _ in range(dims)]
        elif i % 7 == 0:
            v = [4.0] * dims
        else:
            v = [rng.random() * spread for _ in range(dims)]
        points.append((i, v))
    return points


@pytest.mark.parametrize("strategy", sorted(SINGLE))
def test_hand_checked(spark, strategy):
    got = detect_outliers(frame(spark, HAND), 4, 2, 0.5, 2, strategy, Space(1))
    assert as_dict(got) == {0: 2, 1: 1, 2: 4, 3: 2}


def test_hand_checked_status(spark):
    got = point_status(frame(spark, HAND), 4, 2, 0.5, 2, Space(1)).where("e = 1").collect()
    assert {r["id"]: r["status"] for r in got} == {
        0: "safe_inlier", 1: "safe_inlier", 2: "inlier", 3: "outlier"
    }


@pytest.mark.parametrize("strategy", sorted(SINGLE))
@pytest.mark.parametrize("dims", [1, 2])
def test_single_strategies_with_crowd(spark, strategy, dims):
    points = crowd(240, dims, seed=dims)
    got = detect_outliers(frame(spark, points), 60, 12, 0.8, 4, strategy, Space(dims))
    assert as_dict(got) == brute.single(points, 60, 12, 0.8, 4)


@pytest.mark.parametrize("part", ["grid", "metric", "pivot", "hash", "hash_band"])
def test_ten_dimensions(spark, part):
    points = crowd(150, 10, seed=3, spread=3.0)
    got = detect_outliers(frame(spark, points), 50, 10, 2.5, 4, space=Space(10), part=part)
    assert as_dict(got) == brute.single(points, 50, 10, 2.5, 4)


def test_random_parameters(spark):
    rng = random.Random(5)
    for _ in range(6):
        slide, m, k = rng.choice([1, 3, 10]), rng.choice([1, 2, 5, 8]), rng.choice([1, 3, 6])
        points = crowd(120, 1, seed=rng.random())
        expected = brute.single(points, slide * m, slide, 0.5, k)
        got = detect_outliers(frame(spark, points), slide * m, slide, 0.5, k, "slicing", Space(1))
        assert as_dict(got) == expected


@pytest.mark.parametrize("strategy", sorted(RK))
def test_rk(spark, strategy):
    points = crowd(200, 1, seed=8)
    got = detect_rk(frame(spark, points), 50, 10, "2;0.3,5;1.0", strategy, Space(1)).collect()
    expected = brute.report(points, [50], [10], [0.3, 1.0], [2, 5])
    assert {(r["e"], 50, 10, r["r"], r["k"]): r["n_outliers"] for r in got} == expected
    assert len(got) == len(expected)


@pytest.mark.parametrize("strategy", sorted(RKWS))
def test_rkws(spark, strategy):
    points = crowd(160, 1, seed=9)
    got = detect_rkws(frame(spark, points), [40, 60], [10, 20], [0.3, 1.0], [2, 5], strategy, Space(1)).collect()
    expected = brute.report(points, [40, 60], [10, 20], [0.3, 1.0], [2, 5])
    assert {(r["e"], r["w"], r["s"], r["r"], r["k"]): r["n_outliers"] for r in got} == expected


def test_pairs_only_and_monotone(spark):
    pts = frame(spark, crowd(120, 1, seed=4))
    queries = [(2, 0.3), (5, 1.0)]
    full = {(r["e"], r["r"], r["k"]): r["n_outliers"] for r in detect_rk(pts, 40, 10, queries, space=Space(1)).collect()}
    pairs = detect_rk(pts, 40, 10, queries, space=Space(1), pairs_only=True).collect()
    assert {(r["r"], r["k"]) for r in pairs} == {(0.3, 2), (1.0, 5)}
    assert all(full[r["e"], r["r"], r["k"]] == r["n_outliers"] for r in pairs)
    for e, r, k in full:
        assert full[e, 1.0, k] <= full[e, 0.3, k]
        assert full[e, r, 2] <= full[e, r, 5]


def test_long_windows_use_intervals(spark):
    points = crowd(300, 1, seed=12)
    got = detect_outliers(frame(spark, points), 200, 1, 0.4, 3, space=Space(1))
    assert as_dict(got) == brute.single(points, 200, 1, 0.4, 3)


def test_bounds_wider_than_neighbour_cells(spark):
    points = crowd(150, 1, seed=6)
    route = BoundsRoute([[1.0, 1.5, 2.0, 2.5, 6.0]], 2.0)
    got = detect_outliers(frame(spark, points), 50, 10, 2.0, 12, space=Space(1), part=route)
    assert as_dict(got) == brute.single(points, 50, 10, 2.0, 12)


EDGES = {
    "boundary": ([(0, [0.0]), (1, [1.0])], 2, 2, 1.0, 1, {0: 0}),
    "copies": ([(0, [3.0]), (1, [3.0])], 2, 2, 0.5, 1, {0: 0}),
    "radius 0": ([(0, [3.0]), (1, [3.0]), (2, [3.1]), (3, [9.0])], 4, 4, 0.0, 1, {0: 2}),
    "gap": ([(0, [0.0]), (1, [0.0]), (100, [0.0])], 4, 2, 1.0, 1, {0: 0, 1: 0, 50: 1, 51: 1}),
    "k = 0": ([(0, [0.0]), (5, [9.0])], 2, 2, 1.0, 0, {0: 0, 2: 0}),
    "nan": ([(0, [float("nan")]), (1, [0.0]), (2, [0.0])], 4, 4, 1.0, 1, {0: 1}),
    "infinite": ([(0, [float("inf")]), (1, [float("inf")]), (2, [0.0])], 4, 4, 1.0, 1, {0: 3}),
    "huge": ([(0, [1e300]), (1, [1e300]), (2, [-1e300]), (3, [0.0])], 4, 4, 1.0, 1, {0: 2}),
}


@pytest.mark.parametrize("case", sorted(EDGES))
@pytest.mark.parametrize("strategy", ["slicing", "advanced"])
def test_edges(spark, case, strategy):
    points, window, slide, radius, k, expected = EDGES[case]
    got = detect_outliers(frame(spark, points), window, slide, radius, k, strategy, Space(1))
    assert as_dict(got) == expected


def test_unequal_lengths_use_the_common_prefix(spark):
    points = [(0, [1.0, 2.0]), (1, [1.0]), (2, [1.5, 9.0]), (3, [7.0, 2.0])]
    got = detect_outliers(frame(spark, points), 4, 4, 0.6, 1)
    assert as_dict(got) == brute.single(points, 4, 4, 0.6, 1)


def test_custom_metric(spark):
    def manhattan(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)

    points = crowd(60, 2, seed=2)
    got = detect_outliers(
        frame(spark, points), 20, 10, 1.0, 3, "slicing", Space(2, manhattan), part=GridRoute(1.0, axes=2)
    )
    expected = {}
    for e in range(7):
        inside = [(i, v) for i, v in points if e - 2 < i // 10 <= e]
        if inside:
            expected[e] = sum(
                1 for i, v in inside
                if sum(1 for j, u in inside if j != i and sum(abs(a - b) for a, b in zip(v, u)) <= 1.0) < 3
            )
    assert as_dict(got) == expected
    with pytest.raises(ValueError):
        detect_outliers(frame(spark, points), 20, 10, 1.0, 3, space=Space(2, manhattan))


def test_head_and_tail(spark):
    pts = frame(spark, crowd(100, 1, seed=1))
    full = as_dict(detect_outliers(pts, 40, 10, 0.5, 3, space=Space(1)))
    cut = as_dict(detect_outliers(pts, 40, 10, 0.5, 3, space=Space(1), include_head=False, include_tail=False))
    assert cut == {e: n for e, n in full.items() if 3 <= e <= 9}


def test_bad_arguments(spark):
    pts = frame(spark, HAND)
    for call in (
        lambda: detect_outliers(pts, 5, 2, 1.0, 1),
        lambda: detect_outliers(pts, 4, 2, 1.0, 1, "sop"),
        lambda: detect_outliers(pts, 4, 2, -1.0, 1),
        lambda: detect_outliers(pts, 4, 2, 1.0, 1, part="cube"),
        lambda: detect_rk(pts, 4, 2, [(1, 1.0)], "pmcod"),
        lambda: detect_rkws(pts, [5], [2, 4], [1.0], [1]),
        lambda: QuerySet([], [1], [1.0], [1]),
    ):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("window, slide, k", [(40, 10, 3), (20, 20, 2), (36, 3, 4)])
def test_status(spark, window, slide, k):
    points = crowd(120, 1, seed=window)
    pts = frame(spark, points)
    got = point_status(pts, window, slide, 0.5, k, Space(1))
    expected = brute.statuses(points, window, slide, 0.5, k)
    rows = {(r["e"], r["id"]): r["status"] for r in got.collect()}
    assert rows == expected
    changes = {(r["e"], r["id"]) for r in status_transitions(got).collect()}
    assert changes == {key for key in expected if expected.get((key[0] - 1, key[1]), expected[key]) != expected[key]}
    safe = {r["id"] for r in safe_inliers(pts, window, slide, 0.5, k, Space(1)).collect()}
    last = {i: i // slide + window // slide - 1 for i, _ in points}
    assert safe == {i for i, _ in points if expected[last[i], i] == "safe_inlier"}


def test_expiry(spark):
    points, window, slide, r, k = crowd(120, 1, seed=77), 40, 10, 0.5, 4
    m = window // slide
    got = {(x["e"], x["id"]): x["expires"] for x in expiry_schedule(frame(spark, points), window, slide, r, k, Space(1)).collect()}
    expected = {}
    for (e, i), status in brute.statuses(points, window, slide, r, k).items():
        if status != "inlier":
            continue
        v = dict(points)[i]
        slides = [j // slide for j, u in points if j != i and brute.near(v, u, r)]
        later = [
            x for x in range(e + 1, i // slide + m) if sum(1 for sl in slides if x - m < sl <= e) < k
        ]
        expected[e, i] = later[0] if later else None
    assert got == expected


def test_parameters(spark):
    assert parse_rk("50;0.45,40;0.35") == [(50, 0.45), (40, 0.35)]
    assert gcd_of([200, 500]) == 100
    queries = QuerySet([10, 20, 10], [5], [1.0, 0.5], [3])
    assert queries.windows == (10, 20) and queries.radii == (0.5, 1.0) and queries.spans == [2, 4]
    assert with_queries(spark.range(3), queries).count() == 12


def by_metric(points, window, slide, radius, k, distance):
    expected = {}
    for e in range(max(i for i, _ in points) // slide + window // slide):
        inside = [(i, v) for i, v in points if e - window // slide < i // slide <= e]
        if inside:
            expected[e] = sum(sum(1 for j, u in inside if j != i and distance(v, u) <= radius) < k for i, v in inside)
    return expected


def taxi(a, b):
    return sum(abs(x - y) for x, y in zip(a, b))


@pytest.mark.parametrize("name", ["manhattan", "chebyshev", "stretched"])
@pytest.mark.parametrize("part", ["grid", "hash", "metric"])
def test_metrics_that_bound_coordinates(spark, name, part):
    # The stretched one counts the first coordinate a tenth, so that it may differ by ten times the distance.
    tenth = Metric(lambda a, b: F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0))) / 10 + F.abs(F.get(a, F.lit(1)) - F.get(b, F.lit(1))), 10.0, lambda n: 1.1)
    metric, distance = {
        "manhattan": (MANHATTAN, taxi),
        "chebyshev": (CHEBYSHEV, lambda a, b: max(abs(x - y) for x, y in zip(a, b))),
        "stretched": (tenth, lambda a, b: abs(a[0] - b[0]) / 10 + abs(a[1] - b[1])),
    }[name]
    points = crowd(90, 2, seed=12)
    got = detect_outliers(frame(spark, points), 30, 10, 0.7, 3, "slicing", Space(2, metric), part=part)
    assert as_dict(got) == by_metric(points, 30, 10, 0.7, 3, distance)


def clustered(n, dims, seed):
    """A third of all points in one small ball, some in another, the others far apart."""
    rng = random.Random(seed)
    far = lambda: [rng.uniform(-50, 50) for _ in range(dims)]
    middles = [far(), far()]
    near = lambda m: [x + rng.uniform(-1, 1) * 0.2 / dims for x in m]
    return [(i, near(middles[0]) if i % 3 == 0 else near(middles[1]) if i % 7 == 0 else far()) for i in range(n)]


@pytest.mark.parametrize("dims, plug_in", [(64, False), (12, True), (3, True)])
def test_free_clusters_settle_points(spark, dims, plug_in):
    points = clustered(240, dims, seed=4)
    space = Space(dims, (lambda a, b: MANHATTAN(a, b)) if plug_in else None)
    got = detect_outliers(frame(spark, points), 80, 40, 1.0, 5, "free_clusters", space)
    assert as_dict(got) == by_metric(points, 80, 40, 1.0, 5, taxi if plug_in else brute.distance)
    centres = free_centres(frame(spark, points), 1.0, space, 5)
    assert 2 <= len(centres) < 100
    pts = keyed_points(frame(spark, points), 40, space)
    left = {r.id for r in unsettled_points(pts, replace(space, centres=centres), 1.0, 5, 2).collect()}
    assert not any(i % 3 == 0 for i in left) and len(left) < 170
    if plug_in:
        assert unsettled_points(pts, space, 1.0, 5, 2).count() == 240


def test_free_centres_of_nothing(spark):
    empty = frame(spark, [(0, [0.0, 0.0])]).limit(0)
    assert free_centres(empty, 1.0, Space(64), 2) == () and free_centres(empty, 1.0, Space(2, MANHATTAN), 2) == ()


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_histogram_in_crowds_equals_pairs(spark, monkeypatch, dims):
    rng = random.Random(dims)
    points = [(i, [rng.gauss(0, 0.6) if i % 3 else rng.uniform(-9, 9) for _ in range(dims)]) for i in range(400)]
    points[7:12] = [(i, [x] * dims) for i, x in zip(range(7, 12), (math.nan, math.inf, 1e300, 0.25, 0.25))]
    pts = keyed_points(frame(spark, points), 50, Space(dims))
    made = []
    for crowd_of in (10**9, 0.02):
        monkeypatch.setattr(histogram, "CROWD", crowd_of)
        found = histogram.neighbour_histogram(pts, 50, 3, [0.5, 2.0], Space(dims))
        made.append(sorted(tuple(r) for r in found.collect()))
    assert made[0] == made[1]


def test_pyramid_work_is_linear_in_a_crowd(spark):
    # All points are in one radius: pairs would be the square of their number.
    def cells(n):
        points = spark.range(n).selectExpr("id", "array(cast(id AS double) / 100000) AS value")
        pts = keyed_points(points, n // 2, Space(1))
        columns, edge = pyramid._cover([5.0], Space(1))
        for name, text in columns:
            pts = pts.withColumn(name, F.expr(text))
        return pts.agg(F.max(F.size("whole")), F.max(F.size(edge))).first()

    assert cells(1000) == cells(4000) and sum(cells(1000)) <= 2 * pyramid.CELLS[1]


def test_long_vectors_with_odd_coordinates(spark):
    """A point that is near to nothing is an outlier of its windows under trained partitionings too."""
    points = [(i, [float(i % 3)] * 12) for i in range(30)]
    points[4] = (4, [float("nan")] * 12)
    points[17] = (17, [1.0] * 11 + [float("inf")])
    expected = brute.single(points, 10, 5, 0.5, 2)
    for strategy in ("advanced_vp", "advanced"):
        assert as_dict(detect_outliers(frame(spark, points), 10, 5, 0.5, 2, strategy, Space(12))) == expected, strategy
