import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lonepoint.functions import Space
from lonepoint.functions.slides import EVENT_BASE
from lonepoint.operators.routes import GridRoute, HashRoute
from lonepoint.plans.detect import RK, detect_outliers, evaluate
from lonepoint.plans.params import QuerySet
from lonepoint.plans.status import point_status, status_transitions
from lonepoint.sources import console_sink, stream_text_points, table_sink
from lonepoint.streaming.keyed import WindowReports, keyed_report, stream_outliers, stream_transitions
from lonepoint.streaming.native import window_density, window_outliers

from . import brute
from .test_detect import crowd, frame


def write_file(folder, name, points):
    # Files are read in the order of their times, so each gets its own second.
    import os

    path = folder / f"{name}.txt"
    path.write_text("".join(f"{i}&{','.join(repr(x) for x in v)}\n" for i, v in points))
    os.utime(path, (1_700_000_000 + name, 1_700_000_000 + name))


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def rows(df):
    return {(r["e"], r["w"], r["s"], r["r"], r["k"]): r["n_outliers"] for r in df.collect()}


def started(spark, tmp_path, batches, name="in"):
    """A stream of text files, one per batch."""
    source = tmp_path / name
    source.mkdir()
    for n, points in enumerate(batches):
        write_file(source, n, points)
    return stream_text_points(spark, str(source), files_per_trigger=1)


@pytest.mark.parametrize("dims, buckets", [(1, 3), (2, 1), (3, 16)])
def test_stream_equals_batch_on_closed_windows(spark, tmp_path, dims, buckets):
    points = crowd(200, dims, seed=61)
    points[5] = (points[5][0], [float("nan")] * dims)
    points[17] = (points[17][0], [float("inf")] * dims)
    stream = started(spark, tmp_path, [points[n * 50 : (n + 1) * 50] for n in range(4)])
    query, report = stream_outliers(stream, 40, 10, 0.5, 3, str(tmp_path / "store"), Space(dims), buckets=buckets)
    run(query)
    expected = brute.single(points, 40, 10, 0.5, 3)
    got = {r["e"]: r["n_outliers"] for r in report().collect()}
    assert got == {e: n for e, n in expected.items() if e < 19}


@pytest.mark.parametrize("radius, k", [(0.0, 1), (0.0, 0), (0.5, 0), (1e-3, 2)])
def test_stream_small_radii_and_ks(spark, tmp_path, radius, k):
    points = [(i, [float(i % 4), -0.0 if i % 8 else 0.0]) for i in range(80)]
    stream = started(spark, tmp_path, [points[:33], points[33:]])
    query, report = stream_outliers(stream, 20, 5, radius, k, str(tmp_path / "store"), Space(2))
    run(query)
    expected = brute.single(points, 20, 5, radius, k)
    assert {r["e"]: r["n_outliers"] for r in report().collect()} == {e: n for e, n in expected.items() if e < 15}


def test_restart_and_drain(spark, tmp_path):
    points = crowd(200, 1, seed=62)
    queries = QuerySet([40, 60], [10, 20], [0.3, 1.0], [2, 5])
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for n in range(4):
        # Two runs, each picking up where the other one stopped.
        write_file(source, n, points[n * 50 : (n + 1) * 50])
        if n % 2:
            stream = stream_text_points(spark, str(source), files_per_trigger=1)
            query, report = keyed_report(stream, queries, store, Space(1))
            run(query)
    whole = rows(evaluate(frame(spark, points), queries, RK["sop"], Space(1)))
    closed, rest = rows(report.results()), rows(report.drain())
    assert not set(closed) & set(rest)
    assert {**closed, **rest} == whole
    # Slides that no open window needs have been removed.
    assert report.points().agg(F.min("sl")).first()[0] >= 19 - 6


def test_state_does_not_grow_with_the_stream(spark, tmp_path):
    points = [(i, [float(i % 7)]) for i in range(600)]
    stream = started(spark, tmp_path, [points[n : n + 50] for n in range(0, 600, 50)])
    query, _ = stream_outliers(stream, 40, 10, 0.5, 3, str(tmp_path / "store"), Space(1), buckets=2)
    run(query)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    # 60 slides went through windows of 4; a key holds its slides and timers.
    assert len(held) == 12 and max(held[6:]) <= max(held[:6])


def test_late_points_are_dropped(spark, tmp_path):
    batches = [[(0, [0.0]), (1, [5.0]), (10, [0.1])], [(20, [0.0])], [(2, [0.0]), (40, [9.0])]]
    query, report = stream_outliers(started(spark, tmp_path, batches), 20, 10, 0.5, 1, str(tmp_path / "store"), Space(1))
    run(query)
    # Window 0 was reported before point 2 came, and its slide was closed.
    assert {r["e"]: r["n_outliers"] for r in report().collect()} == {0: 2, 1: 1, 2: 0, 3: 1}


def test_late_points_correct_reported_windows(spark, tmp_path):
    batches = [[(0, [0.0]), (1, [5.0]), (10, [0.1])], [(2, [0.0]), (20, [0.0])], [(40, [9.0]), (3, [5.0]), (11, [0.0])], [(4, [0.0]), (50, [1.0])]]
    stream = started(spark, tmp_path, batches)
    query, report = keyed_report(stream, QuerySet([20], [10], [0.5], [1]), str(tmp_path / "store"), Space(1), lateness=2)
    run(query)
    # Point 3 is two slides late; so is point 11 then; point 4 is four late, which is too much.
    arrived = [p for batch in batches for p in batch if p[0] != 4]
    expected = brute.single(sorted(arrived), 20, 10, 0.5, 1)
    got = {r["e"]: r["n_outliers"] for r in report.results().collect()}
    assert got == {e: n for e, n in expected.items() if e < 5}
    seen = {r["e"]: r["version"] for r in report.versions().groupBy("e").agg(F.max("version").alias("version")).collect()}
    assert seen[0] == 2 and seen[3] == 0


def test_shuffled_arrival_gives_the_batch_report(spark, tmp_path):
    import random

    points = crowd(240, 1, seed=71)
    order = sorted(points, key=lambda p: p[0] + random.Random(p[0]).randint(0, 60))
    stream = started(spark, tmp_path, [order[n : n + 30] for n in range(0, 240, 30)])
    queries = QuerySet([40, 80], [10], [0.3, 1.0], [2, 5])
    query, report = keyed_report(stream, queries, str(tmp_path / "store"), Space(1), lateness=10, buckets=3)
    run(query)
    whole = rows(evaluate(frame(spark, points), queries, RK["sop"], Space(1)))
    assert rows(report.results()) == {key: n for key, n in whole.items() if key[0] < 23}


@pytest.mark.parametrize("seed, k", [(81, 3), (82, 1), (83, 0)])
def test_transitions_equal_batch(spark, tmp_path, seed, k):
    points = crowd(200, 1, seed=seed)
    stream = started(spark, tmp_path, [points[n * 50 : (n + 1) * 50] for n in range(4)])
    query, report = stream_transitions(stream, 60, 10, 0.5, k, str(tmp_path / "store"), Space(1), buckets=3)
    run(query)
    expected = status_transitions(point_status(frame(spark, points), 60, 10, 0.5, k, Space(1))).where("e < 19")
    assert sorted(tuple(r) for r in report().collect()) == sorted(tuple(r) for r in expected.collect())


def test_events_wake_a_key_without_new_points(spark, tmp_path):
    # Point 20 loses its neighbours in slides 0 and 1 while nothing arrives near it.
    points = [(0, [0.0]), (10, [0.0]), (20, [0.0]), *[(i, [50.0]) for i in range(30, 100, 10)]]
    query, report = stream_transitions(started(spark, tmp_path, [points]), 50, 10, 0.5, 2, str(tmp_path / "store"), Space(1))
    run(query)
    got = [tuple(r) for r in report().where("id < 30").orderBy("e", "id").collect()]
    assert got == [(2, 0, "outlier", "safe_inlier"), (2, 10, "outlier", "inlier"), (5, 10, "inlier", "outlier"), (5, 20, "inlier", "outlier")]


def test_stream_with_another_metric(spark, tmp_path):
    points = crowd(120, 2, seed=64)
    space = Space(2, metric=lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x))
    matrix = lambda a, b: np.abs(a[:, None, :] - b[None, :, :]).sum(2)
    stream = started(spark, tmp_path, [points[:70], points[70:]])
    queries = QuerySet([40], [10], [0.5], [3])
    with pytest.raises(ValueError):
        keyed_report(stream, queries, str(tmp_path / "bad"), space)
    query, report = keyed_report(stream, queries, str(tmp_path / "store"), space, route=HashRoute(3), distance=matrix)
    run(query)
    whole = rows(evaluate(frame(spark, points), queries, RK["sop"], space, part=HashRoute(3)))
    assert rows(report.results()) == {key: n for key, n in whole.items() if key[0] < 11}


def test_empty_stream(spark, tmp_path):
    query, report = stream_outliers(started(spark, tmp_path, [[]]), 40, 10, 0.5, 3, str(tmp_path / "store"), Space(1))
    run(query)
    assert report().count() == 0


@pytest.mark.parametrize("dims", [1, 2])
def test_native_outliers_and_restart(spark, tmp_path, dims):
    points = [(i, [round(x, 1) for x in v]) for i, v in crowd(160, dims, seed=65)]
    points[3], points[4] = (3, [float("nan")] * dims), (4, [float("nan")] * dims)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n in range(4):
        write_file(source, n, points[n * 40 : (n + 1) * 40])
        if n % 2:
            stream = stream_text_points(spark, str(source), files_per_trigger=1)
            run(table_sink(window_outliers(stream, 40, 10, 0.5, 3, Space(dims)), out, str(tmp_path / "checkpoint")))
    got = {r["e"]: r["n_outliers"] for r in spark.read.parquet(out).collect()}
    expected = brute.single(points, 40, 10, 0.5, 3)
    assert got == {e: n for e, n in expected.items() if e < 15 - 4}


def test_native_density(spark, tmp_path):
    points = crowd(120, 1, seed=63)
    source = tmp_path / "in"
    source.mkdir()
    for n in range(3):
        write_file(source, n, points[n * 40 : (n + 1) * 40])
    stream = stream_text_points(spark, str(source), files_per_trigger=1)
    out = str(tmp_path / "out")
    run(table_sink(window_density(stream, 40, 10, 1.0, 4, Space(1)), out, str(tmp_path / "checkpoint")))
    got = {r["e"]: (r["n_points"], r["n_settled"]) for r in spark.read.parquet(out).collect()}
    batch = frame(spark, points)
    assert set(got) == set(range(11))
    for e, (n_points, n_settled) in got.items():
        inside = [v[0] for i, v in points if e - 4 < i // 10 <= e]
        cells = {}
        for x in inside:
            cell = int(x // (1.0 * (1 - 1e-3)))
            cells[cell] = cells.get(cell, 0) + 1
        assert n_points == len(inside) and n_settled == sum(n for n in cells.values() if n > 4)
    assert batch.count() == 120


def test_console_sink(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_file(source, 0, [(5, [1.5])])
    query = console_sink(stream_text_points(spark, str(source)).select(F.col("id")), str(tmp_path / "checkpoint"))
    run(query)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 1


def test_bad_window(spark):
    with pytest.raises(ValueError):
        window_density(frame(spark, [(0, [0.0])]), 5, 2, 1.0, 1)
    with pytest.raises(ValueError):
        detect_outliers(frame(spark, [(0, [0.0])]), 5, 2, 1.0, 1)


def test_a_key_wakes_once_in_a_batch(spark, tmp_path):
    # 300 slides close in one batch: state is read and written once, not for each window.
    points = [(i, [float(i % 3)]) for i in range(600)]
    query, report = stream_outliers(started(spark, tmp_path, [points]), 20, 2, 0.5, 3, str(tmp_path / "store"), Space(1), buckets=1)
    run(query)
    expected = brute.single(points, 20, 2, 0.5, 3)
    assert {r["e"]: r["n_outliers"] for r in report().collect()} == {e: n for e, n in expected.items() if e < 299}
    removed = [int(o["numRowsRemoved"]) for p in query.recentProgress for o in p["stateOperators"]]
    assert sum(removed) < 300


def test_native_join_meets_near_times_only(spark, tmp_path):
    points = [(i, [0.001 * i]) for i in range(400)]
    stream = started(spark, tmp_path, [points[:200], points[200:]])
    frame = window_outliers(stream, 20, 5, 10.0, 3, Space(1))
    out = str(tmp_path / "out")
    query = table_sink(frame, out, str(tmp_path / "checkpoint"))
    run(query)
    expected = brute.single(points, 20, 5, 10.0, 3)
    assert {r["e"]: r["n_outliers"] for r in spark.read.parquet(out).collect()} == {e: n for e, n in expected.items() if e < 79 - 4}
    plan = query._jsq.explainInternal(False)
    join = next(line for line in plan.splitlines() if "StreamingSymmetricHashJoin" in line)
    assert "nblock" in join


def test_wide_gaps_between_ids_in_one_batch(spark, tmp_path):
    points = [(i + base, [float(i % 3)]) for base in (0, 4 * 10**10) for i in range(40)] + [(8 * 10**10, [0.0])]
    query, report = stream_outliers(started(spark, tmp_path, [points]), 20, 10, 0.5, 4, str(tmp_path / "store"), Space(1), buckets=1)
    run(query)
    expected = {e + base: n for base in (0, 4 * 10**9) for e, n in brute.single(points[:40], 20, 10, 0.5, 4).items()}
    assert {r["e"]: r["n_outliers"] for r in report().collect()} == expected


class State(dict):
    """State of one key in memory, and its timers; counts what is read."""

    read = 0

    def getMapState(self, name, *_):
        return self.setdefault(name, State())

    getValueState = getMapState
    containsKey, updateValue, removeKey = dict.__contains__, dict.__setitem__, dict.pop

    def getValue(self, key):
        self.read += 1
        return self[key]

    def iterator(self):
        self.read += len(self)
        return iter(list(self.items()))

    def exists(self):
        return 0 in self

    def get(self):
        return self[0]

    def update(self, value):
        self[0] = value

    def registerTimer(self, ms):
        self[0] = ms

    getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: self[0]


def wake(cells, state, points, slide, e):
    """Hand points to a key and wake it with the watermark at slide ``e``; its rows."""
    frame = pd.DataFrame({
        "id": [i for i, _ in points], "sl": [i // slide for i, _ in points], "cell": 0, "is_home": True,
        "x0": [v[0] for _, v in points],
    })
    list(cells.handleInputRows((0,), iter([frame]), state))
    state[0] = (EVENT_BASE + e - cells.lateness) * 1000
    return pd.concat([pd.DataFrame(columns=["e", "version", "n_outliers"]), *cells.handleExpiredTimer((0,), state, state)])


@pytest.mark.parametrize("lateness", [300, 1500])
def test_late_points_read_only_blocks_near_them(lateness):
    points = crowd(1200, 1, seed=91)
    late = [p for p in points if 500 <= p[0] < 520 and p[0] % 3 == 0]
    state, cells = State(), WindowReports(QuerySet([20], [4], [0.3], [2]), lateness, Space(1), None)
    cells.init(state)
    seen = [wake(cells, state, [p for p in points if p not in late], 4, 299)]
    blocks, state["slides"].read = len(state["slides"]), 0
    seen.append(wake(cells, state, late, 4, 299))
    # The blocks of late points, one on either side, and those of the newest window.
    assert blocks >= 15 and state["slides"].read <= 10
    rows = pd.concat(seen).sort_values("version").groupby("e")["n_outliers"].last()
    assert rows.to_dict() == {e: n for e, n in brute.single(points, 20, 4, 0.3, 2).items() if e <= 299}
    assert set(seen[1]["e"]) == {e for i, _ in late for e in range(i // 4, i // 4 + 5)} and set(seen[1]["version"]) == {1}


def test_blocks_of_late_slides_are_removed():
    # Blocks of several windows: what no window needs leaves them, whole blocks and parts of one.
    points = [(i, [float(i % 3)]) for i in range(4000)]
    state, cells = State(), WindowReports(QuerySet([4], [2], [0.5], [1]), 520, Space(1), None)
    cells.init(state)
    assert cells.length == 8
    wake(cells, state, points[:3000], 2, 1499)
    wake(cells, state, points[3000:], 2, 1999)
    slides = [s for v in state["slides"].values() for s in np.frombuffer(v[1], np.int64).tolist()]
    assert sorted(set(slides)) == list(range(2000 - 520 - 2, 2000)) and len(state["slides"]) < 80


@pytest.mark.parametrize("route, k", [(None, 30), (None, 3), (HashRoute(3, GridRoute(1.0)), 30)])
def test_native_join_holds_a_row_per_slide_and_cell(spark, tmp_path, route, k):
    # Equal and unlike vectors, some that are no numbers, and a slide whose points are all settled at once.
    points = [(i, [0.3 * (i % 40) + 0.001 * (i % 7)]) for i in range(600)]
    points[5:8] = [(5, [float("nan")]), (6, [float("inf")]), (7, [-0.0])]
    points[200:300] = [(i, [2.0]) for i in range(200, 300)]
    stream = started(spark, tmp_path, [points[:350], points[350:]])
    out = str(tmp_path / "out")
    query = table_sink(window_outliers(stream, 200, 100, 1.0, k, Space(1), route), out, str(tmp_path / "checkpoint"))
    run(query)
    expected = brute.single(points, 200, 100, 1.0, k)
    assert {r["e"]: r["n_outliers"] for r in spark.read.parquet(out).collect()} == {e: n for e, n in expected.items() if e < 5 - 2}
    states = [o for p in query.recentProgress for o in p["stateOperators"] if o["operatorName"] == "symmetricHashJoin"]
    cells = 13 * (1 if route is None else 3)
    # A row for each slide and cell, and up to three cells and two blocks that it searches.
    assert 0 < sum(int(o["numRowsUpdated"]) for o in states) <= 6 * cells * (1 + 3 * 2 * (1 if route is None else 3))
