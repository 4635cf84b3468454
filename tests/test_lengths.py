"""Vector lengths, odd numbers, and partitionings trained on the whole table."""

import math

import numpy as np
import pytest

from lonepoint.functions import Space
from lonepoint.functions.slides import slide_index
from lonepoint.operators import routes as rt
from lonepoint.operators.blocks import near_pairs
from lonepoint.operators.histogram import neighbour_histogram, neighbour_totals
from lonepoint.operators.training import rows_at, shortest_length, train_vantage_tree
from lonepoint.plans.detect import SINGLE, detect_outliers


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, value array<double>")


def plain_counts(rows, window, slide, radius, k):
    """Outliers per window in plain Python, over common prefixes."""

    def near(a, b):
        d = math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
        return bool(a and b) and d <= radius

    found = {}
    for e in range(rows[0][0] // slide, rows[-1][0] // slide + window // slide):
        inside = [(i, v) for i, v in rows if e - window // slide < i // slide <= e]
        if inside:
            found[e] = sum(sum(near(v, o) for j, o in inside if j != i) < k for i, v in inside)
    return found


@pytest.mark.parametrize("strategy", sorted(SINGLE))
@pytest.mark.parametrize("short", [1, 0])
def test_short_vectors_behind_long_ones(spark, strategy, short):
    rng = np.random.default_rng(1)
    rows = [(i, rng.uniform(0, 6, 2).round(2).tolist()) for i in range(60)]
    rows += [(60 + i, rng.uniform(0, 6, 1).round(2).tolist()[:short]) for i in range(20)]
    got = detect_outliers(frame(spark, rows), 40, 20, 1.0, 6, strategy).collect()
    assert {r.e: r.n_outliers for r in got} == plain_counts(rows, 40, 20, 1.0, 6)


@pytest.mark.parametrize("dims", [1, 8, 9, 64])
@pytest.mark.parametrize("change", [-1, 1])
def test_declared_length_is_checked(spark, dims, change):
    rows = [(i, [1.0] * dims) for i in range(5)] + [(5, [1.0] * (dims + change))]
    with pytest.raises(Exception, match="coordinates"):
        detect_outliers(frame(spark, rows), 4, 2, 1.0, 1, space=Space(dims)).collect()


@pytest.mark.parametrize("dims", [1, 8, 9, 64])
def test_null_vectors_are_near_to_nothing(spark, dims):
    rows = [(0, [1.0] * dims), (1, [1.0] * dims), (2, None), (3, [None] * dims), (4, None)]
    got = detect_outliers(frame(spark, rows), 8, 8, 1.0, 1, space=Space(dims)).collect()
    assert [r.n_outliers for r in got] == [3]


@pytest.mark.parametrize("space", [Space(1), Space(9), Space()])
def test_odd_copies_are_no_neighbours(spark, space):
    n = space.dims or 2
    values = [[float("nan")] * n] * 2 + [[float("inf")] * n] * 2 + [[1.0] * n] * 3
    pts = space.project(frame(spark, list(enumerate(values))), "id", slide_index(10).alias("sl"))
    totals = neighbour_totals(neighbour_histogram(pts, 10, 1, [1.0], space)).collect()
    assert {r.id: r.n for r in totals if r.n} == {4: 2, 5: 2, 6: 2}


def test_near_pairs_with_odd_rows():
    x, y = np.array([[0.0], [np.nan]]), np.array([[np.nan]] * 4 + [[1.0]])
    i, j, d = near_pairs(x, y, None, 3)
    assert (i.tolist(), j.tolist(), d.tolist()) == ([0], [4], [1.0])
    assert [len(p) for p in near_pairs(x[1:], y, 1.0, None)] == [0, 0, 0]


def test_training_sees_all_rows(spark):
    rows = [(i, [float(i), 0.0]) for i in range(3000)] + [(3000, [5.0])]
    pts = frame(spark, rows)
    assert shortest_length(pts) == 1
    tree = train_vantage_tree(pts, 4)
    assert all(len(v) == 1 for v, _ in tree.nodes)
    homes = rt.VantageRoute(tree, 1.0).with_home(Space().project(pts, "id"), Space()).groupBy("part").count().collect()
    assert len(homes) == 4 and min(r["count"] for r in homes) > 500
    skewed = train_vantage_tree(pts, 2, quantile=0.9)
    inside = rt.VantageRoute(skewed, 1.0).with_home(Space().project(pts, "id"), Space()).where("part = 0").count()
    assert abs(inside - 2700) < 60


def test_rows_at_is_exact(spark):
    values = [float((i * 7919) % 5003) for i in range(5000)] + [1.0] * 3000
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values)
    for rank in (0, 2999, 3001, 5555, 7999):
        assert rows_at(df, "x", ["x"], rank, 1, len(values)).first()["x"] == ordered[rank]


def test_stock_boundaries_by_count(spark):
    for n in rt.STOCK_BOUNDS:
        assert len(rt.BoundsRoute.preset(f"stock:{n}", 1.0).bounds[0]) == n - 1
    with pytest.raises(ValueError):
        rt.BoundsRoute.preset("stock:5", 1.0)
