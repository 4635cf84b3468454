"""Near duplicates and repeated passages, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lonepoint.llm import near_dedup, substring_dedup
from lonepoint.llm.components import components
from lonepoint.llm.fm_index import FmIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, node string, component_id int, kept string, place int, bands int"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in rows], SCHEMA)


# Operator 6


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups(rows):
    """Size of the set and smallest reachable id of every document; one text per id."""
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def crowd(seed, size, edits, words=60):
    """Copies of one text, each with its own edits, among unrelated ones."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(size):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"e{rng.random()}"
        rows.append((i * 3 + 1, " ".join(text)))
    rows += [(1000 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(30))) for i in range(20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small, block", [(32, 512), (2, 8)])
def test_near_duplicates_like_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    rows = crowd(1, 60, 3) + [(5000, "One two THREE"), (5001, "one TWO three"), (5002, "one two"), (5003, ""), (5004, None)]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    want = groups(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert 1 < len({c for _, c in want.values()}) < len(rows) - 20


def test_near_duplicates_odd_rows(spark):
    text = "a b c d e f g h"
    rows = [(3, text), (3, text), (7, text), (None, text), (None, None), (9, "w " * 20_000), (10, "z"), (10, "y"), (12, "y")]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {
        (3, 3, True), (7, 3, False), (None, None, True), (9, 9, True), (10, 10, True), (12, 10, False)
    }
    empty = near_dedup.near_duplicates(frame(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    share = (near_dedup.signature(a, 2000) == near_dedup.signature(b, 2000)).mean()
    assert abs(share - 300 / 500) < 0.05


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = components(spark.createDataFrame(chain, "a bigint, b bigint"))
    want = {(i, 0) for i in range(41)} | {(i, 90) for i in (90, 95, 100)}
    assert {(r.node, r.component) for r in got.collect()} == want and got.count() == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Operator 7


@pytest.mark.parametrize("every", [1, 4, 16])
def test_fm_index_gives_matching_statistics_and_places(every):
    rng = np.random.default_rng(1)
    for n, symbols, most, cuts in [(300, 3, 4, 5), (800, 6, 7, 40), (60, 1, 20, 0), (200, 2, 20, 3), (90, 50, 9, 60), (1, 1, 3, 0)]:
        text = np.append(rng.integers(1, symbols + 1, n), 0)
        text[rng.choice(n, cuts, replace=False)] = 0
        index = FmIndex(text, symbols + 1, every)
        assert sorted(index.locate(np.arange(len(text))).tolist()) == list(range(len(text)))
        places = {}
        for i in range(len(text)):
            for size in range(1, most + 1):
                if i + size <= len(text) and text[i : i + size].all():
                    places.setdefault(tuple(text[i : i + size]), []).append(i)
        ends = np.arange(len(text))
        length, low, high = index.statistics(text, ends, most)
        want = [max((s for s in range(1, min(most, e) + 1) if len(places.get(tuple(text[e - s : e]), ())) > 1), default=0) for e in ends]
        assert length.tolist() == want
        # Pieces of one length lie in intervals that are equal or apart.
        for size in range(1, most + 1):
            some = length == size
            pieces = [places[tuple(text[e - size : e])] for e in ends[some]]
            assert (high - low)[some].tolist() == list(map(len, pieces))
            assert index.earliest(low[some], high[some]).tolist() == [p[0] for p in pieces]


def without(rows):
    seen, found = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for j in range(len(words) - 19):
            window = tuple(words[j : j + 20])
            if window in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        found[i] = len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()
    return found


@pytest.mark.parametrize("hot", [2048, 1])
def test_substring_dedup_like_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_NAME", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_FRAGMENTS", 16)
    rng = random.Random(5)
    base = [f"é{i}" for i in range(200)]
    rows = [(None, " ".join(base[:50])), (900, None), (901, ""), (902, "w " * 3000)]
    for i in range(60):
        if rng.random() < 0.3:
            words = (["x", "y", "z"][: rng.randint(1, 3)] * 30)[: rng.randint(1, 70)]
        else:
            words = []
            for _ in range(rng.randint(1, 4)):
                at = rng.randint(0, 180)
                words += base[at : at + rng.randint(5, 60)] + [str(rng.random())] * rng.randint(0, 2)
        rows.append((i, " ".join(words)))
    got = substring_dedup.without_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == without(rows)


def test_substring_dedup_odd_rows(spark):
    text = " ".join(map(str, range(30)))
    got = substring_dedup.without_repeats(frame(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 30)]
    assert substring_dedup.without_repeats(frame(spark, [(1, text)]).limit(0)).count() == 0


def test_substring_dedup_tells_texts_under_one_id_apart(spark):
    def run(prefix, n):
        return " ".join(f"{prefix}{i}" for i in range(n))

    rows = [(1, run("a", 30)), (None, run("a", 30)), (None, run("u", 40)), (None, run("v", 25)), (7, run("a", 25)), (7, run("z", 50)), (None, None)]
    got = substring_dedup.without_repeats(frame(spark, rows)).collect()
    want = [(1, 30, 0), (7, 25, 25), (7, 50, 0), (None, 0, 0), (None, 25, 0), (None, 30, 30), (None, 40, 0)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in got), key=str) == sorted(want, key=str)
    # A third of all rows without id, with texts of their own and one common passage.
    rng = random.Random(6)
    rows = [(i if i % 3 else None, run(f"t{i}x", rng.randint(5, 40)) + (" " + run("p", 25) if i % 4 == 0 else "")) for i in range(90)]
    got = substring_dedup.without_repeats(frame(spark, rows)).collect()
    assert sum(r.n_removed for r in got) == 25 * (sum(i % 4 == 0 for i in range(90)) - 1)


def test_hashes_tell_regular_patterns_apart():
    from lonepoint.llm.words import Words, span_hashes, window_hashes

    thue = [bin(i).count("1") % 2 for i in range(4096)]
    first, second = ("".join("ab"[b] for b in thue), "".join("ba"[b] for b in thue))
    hashes = Words(pa.array([first, second, first])).hashes()
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
    values = np.array([5, 9, 5, 9, 9, 5, 9, 5, 5, 9], np.uint64)
    for width in (1, 2, 3, 5, 7):
        made = window_hashes(values, width)
        runs = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
        assert len(made) == len(runs) and len(set(made.tolist())) == len(set(runs))
        assert all((made[i] == made[j]) == (runs[i] == runs[j]) for i in range(len(runs)) for j in range(len(runs)))
    spans = span_hashes(values, np.array([0, 2, 4, 0]), np.array([2, 4, 4, 2]))
    assert spans[0] == spans[1] == spans[3] != spans[2]
