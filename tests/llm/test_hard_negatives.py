"""Operator 11 against plain Python."""

import math

import numpy as np
import pytest

from lonepoint.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int, anchor int, rank string"


def brute(rows):
    whole = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a, va, la in {(i, tuple(v), g) for i, v, g in whole if i % 50 == 0}:
        score = lambda v: sum(x * y for x, y in zip(va, v))  # noqa: E731, B023
        mates = sorted((-score(v), i) for i, v, g in whole if g == la and i != a)[:5]
        others = sorted((-score(v), i) for i, v, g in whole if g != la)
        for p, positive in mates:
            inside = [(s, i) for s, i in others if 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, positive, n + 1, i, -p, -s) for n, (s, i) in enumerate(inside)]
    return sorted(out)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = hn.hard_negatives(frame)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed, shape", [(0, (1, 1, 1)), (1, (40, 33, 70)), (2, (65, 129, 200)), (3, (128, 64, 31)), (4, (37, 300, 41)), (5, (3, 0, 2))])
def test_strassen_is_exact(seed, shape):
    rng, (m, k, n) = np.random.default_rng(seed), shape
    for size in (100, 2**40, 2**63 - 1):
        a, b = (rng.integers(-size, size, s) for s in ((m, k), (k, n)))
        assert (hn.strassen(a, b) == a @ b).all()


def test_windows_are_exact():
    for p in [*range(400), 2**63 - 1, 2**62 + 7, 10**18 + 99]:
        low, high = hn.windows(np.array([p]), 50, 95)
        assert (low[0], high[0]) == (-(-50 * p // 100), 95 * p // 100)


@pytest.mark.parametrize("part, chunk", [(1 << 24, (512, 4096)), (2000, (3, 17))])
def test_like_brute_force(spark, monkeypatch, part, chunk):
    monkeypatch.setattr(hn, "PART_BYTES", part)
    monkeypatch.setattr(hn, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.3, (300, 6)).round(1)
    vectors[100:180] = vectors[100]
    rows = [(i, v.tolist(), int(i * 7 % 3)) for i, v in enumerate(vectors)]
    rows += [(i, [0.5] * n, 0) for i, n in ((400, 0), (401, 40), (402, 2), (450, 9))]
    rows += [(50, vectors[50].tolist(), 50 * 7 % 3), (0, [1.0, 1.0], 1), (None, [1.0], 1), (500, [1.0], None), (550, None, 1)]
    rows += [(600, [1.0, None], 1), (650, [float("nan")], 1), (651, [float("inf")], 1), (700, [0.0] * 6, 2), (701, [0.0], 2)]
    want = brute(rows)
    assert len(want) > 50 and run(spark, rows) == want


def test_large_components(spark):
    # Some products leave 64 bits, but none that an answer holds.
    rows = [(0, [2.0**20, 1.0], 0), (1, [2.0**26, 3.0], 0), (2, [1.5 * 2.0**25, -5.0], 1), (3, [-(2.0**40), 0.0], 1), (4, [2.0**40], 2)]
    want = brute(rows)
    assert want and run(spark, rows) == want
    with pytest.raises(Exception, match="does not fit"):
        run(spark, [(0, [1e9], 0), (1, [1e9], 0)])
    with pytest.raises(Exception, match="does not fit"):
        run(spark, [(0, [1e300], 0)])


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 1)]) == [] and run(spark, [(0, [1.0], 1)]) == []


def test_query_labels(spark):
    rows = spark.createDataFrame([(7, 9), (8, 9), (0, None)], "vec_id bigint, label int")
    assert [(r.vec_id, r.label) for r in hn.shifted_labels(rows).collect()] == [(7, 0), (8, 9), (0, None)]
