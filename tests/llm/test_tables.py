"""Operators on conversations, vectors, sources and URLs, against brute force."""

import math
import random

import numpy as np
import pytest

from lonepoint.llm import chat, mixing, topk, url_filters

# Operator 3


def test_chats_keep_maximal_conversations(spark):
    rng = random.Random(1)
    chats = {}
    for c in range(60):
        base = chats[rng.choice(list(chats))] if chats and rng.random() < 0.6 else []
        cut = base[: rng.randint(0, len(base))]
        chats[c] = cut + [(rng.choice(["user", None]), rng.choice(["hi", "", None, "yes"])) for _ in range(rng.randint(0 if cut else 1, 2))]
    rows = [(c, t, r, x, 0, "p") for c, turns in chats.items() for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns int, place string")
    got = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    want = {
        c
        for c, t in chats.items()
        if not any((len(o) > len(t) and o[: len(t)] == t) or (o == t and d < c) for d, o in chats.items())
    }
    assert set(got) == want
    for c in want:
        assert got[c].n_turns == len(chats[c])
        assert got[c].rendered == "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in chats[c])


def test_chats_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (1, None, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "q"), (2, 0, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.n_turns) for r in chat.format_chats(turns).collect()}
    assert got == {(1, 2), (2, 2)}
    assert chat.format_chats(turns.limit(0)).count() == 0


# Operator 5


@pytest.mark.parametrize("block, part", [(1 << 15, 256), (16, 2)])
def test_top_k_like_matrix_product(spark, monkeypatch, block, part):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", part)
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 0.3, (150, 7)).round(2)
    vectors[40:90] = vectors[40]
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(vectors)]
    odd = [(1000, None, 1, 2), (1001, [1.0, None], 1, 2), (1050, [float("nan")] * 7, 1, 2), (1051, [float("inf")], 1, 2)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, score int, rank int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(frame).collect()}
    whole = np.floor(256 * vectors).astype(np.int64)
    want = {}
    for q in range(0, 150, 50):
        scores = whole @ whole[q]
        order = sorted((i for i in range(150) if i != q), key=lambda i: (-scores[i], i))[:5]
        want |= {(q, n + 1): (i, scores[i]) for n, i in enumerate(order)}
    assert got == want


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0]), (0, [1.0]), (50, [0.5, 2.0]), (3, []), (4, [-1.0]), (None, [9.0]), (7, [1e9])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame).collect())
    a, b = 256 * 256, 256 * 128
    high = 256 * 10**9
    assert got == [
        (0, 1, 7, 256 * high), (0, 2, 50, b), (0, 3, 3, 0), (0, 4, 4, -a),
        (50, 1, 7, 128 * high), (50, 2, 0, b), (50, 3, 0, b), (50, 4, 3, 0), (50, 5, 4, -b),
    ]
    assert topk.top_k(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1 << 15, 8])
def test_top_k_takes_large_components(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rng = random.Random(4)
    rows = [(i, [rng.choice([1, -1]) * 2.0 ** rng.randint(-8, 21), rng.uniform(-1, 1), rng.uniform(-1, 1) * 1e6]) for i in range(40)]
    rows[0][1][1] = 0.0
    rows += [(100, [0.0, 1 / 256, 0.0]), (101, [0.0, 3.5e16, 0.0]), (102, [0.0, -3.5e16, 0.0]), (103, [1e9]), (104, [-524288.0, 0.5, 0.0])]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = {}
    for q in (0, 50, 100):
        if q in whole:
            scores = {i: sum(a * b for a, b in zip(v, whole[q])) for i, v in whole.items() if i != q}
            best = sorted(scores, key=lambda i: (-scores[i], i))[:5]
            want |= {(q, n + 1): (i, scores[i]) for n, i in enumerate(best)}
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(frame).collect()}
    assert got == want and (101 in {i for i, _ in want.values()})


def test_top_k_refuses_what_leaves_64_bits(spark):
    for rows, error in [([(0, [1.0]), (1, [1e17])], "component"), ([(0, [1e9]), (1, [1e9])], "score of query 0")]:
        frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        with pytest.raises(Exception, match=error):
            topk.top_k(frame).collect()
    low, high = -(2**63), 2**63 - 1
    slices = topk.Slices(np.array([[low, 3], [high, 3], [0, 3]]))
    found, scores = slices.top(np.array([high, -1]), 3)
    assert dict(zip(found.tolist(), scores.tolist())) == {0: low * high - 3, 1: high * high - 3, 2: -3}


def test_top_k_counts_copies_and_vectors_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(9, [2.0, 0.0])] * 7 + [(3, [0.0, 3.0]), (4, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(frame).collect())
    u = 256 * 256
    first = [(1, 4, 2 * u)] + [(n, 9, 2 * u) for n in range(2, 6)]
    second = [(1, 3, 3 * u), (2, 4, 0)] + [(n, 9, 0) for n in range(3, 6)]
    assert got == sorted(first + second)


def test_slices_are_read_as_written():
    rng = np.random.default_rng(5)
    values = rng.integers(-300, 300, (200, 6))
    values[:, 2] = 7
    slices = topk.Slices.unpacked(*topk.Slices(values).packed())
    query = np.array([127, -255, 3, 0, -1, 86])
    rows, scores = slices.top(query, 5, (10, 140))
    want = sorted((-int(s), i) for i, s in enumerate(values @ query) if not 10 <= i < 140)
    assert sorted(zip((-scores).tolist(), rows.tolist()))[:5] == want[:5]
    for number in (*range(-70, 70), 2**63 - 1, -(2**63)):
        powers = topk._signed_powers(number)
        assert sum(sign << at for at, sign in powers) == number
        assert all(b - a > 1 for (a, _), (b, _) in zip(powers, powers[1:]))


# Operator 8


def goals(spark, sizes):
    """Targets of sources with one document each, in order; the last may be without a name."""
    rows = [(i, "w " * n, None if 0 < i == len(sizes) - 1 else f"s{i:03}") for i, n in enumerate(sizes)]
    sized = mixing._sized(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    found = mixing.source_targets(sized).collect()
    found.sort(key=lambda r: (r.goal_source is None, r.goal_source))
    return [r.target for r in found]


def shared(sizes, weights, most=3):
    """The same by plain rounds."""
    full, total = set(), sum(sizes)
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        heavy = sum(w for i, w in enumerate(weights) if i not in full)
        made = [most * s if i in full else rest * w / heavy for i, (s, w) in enumerate(zip(sizes, weights))]
        over = {i for i, (t, s) in enumerate(zip(made, sizes)) if t > most * s} - full
        if not over:
            return made
        full |= over


def test_targets_share_the_excess(spark):
    assert goals(spark, [10, 10, 10]) == [18.75, 7.5, 3.75]
    found = goals(spark, [1, 10, 10])
    assert found[0] == 3 and found[1] == pytest.approx(12) and found[2] == pytest.approx(6)
    assert goals(spark, [0, 0]) == [0, 0] and goals(spark, []) == []
    rng = random.Random(8)
    sizes = [rng.choice([0, 1, 5, 70, 900]) for _ in range(40)]
    assert goals(spark, sizes) == pytest.approx(shared(sizes, [(5, 2, 1)[i % 3] for i in range(40)]))


def by_source(rows):
    """Target, taken words and the largest light document of each source."""
    found = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        entry = found.setdefault((r.source_size, r.target), [0, 0])
        entry[0] += r.taken
        if r.size * mixing.HEAVY <= r.source_size:
            entry[1] = max(entry[1], r.size)
    return found


@pytest.mark.parametrize("group", [4096, 16])
def test_mix_with_heavy_documents(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP_ROWS", group)
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 60), "abc"[i % 3]) for i in range(1500)]
    rows += [(5000, "w " * 20_000, "a"), (5001, "w " * 5_184, "b"), (5002, "w " * 5_184, "b"), (5003, "w " * 300_000, "d")]
    rows += [(6000 + i, "w " * 40, "d") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for (size, target), (taken, light) in by_source(mixing.mix(docs).collect()).items():
        # Nothing can make up for a document that is longer than all others of its source.
        assert abs(taken - target) <= (max(0.01 * target, light, 60) if size < 300_000 else 150_000)


@pytest.mark.parametrize("others", [200, 2000])
def test_mix_of_rows_alike(spark, others):
    rng = random.Random(10)
    rows = [(None, "w w w w", "a")] * 4000 + [(i, "w " * rng.randint(1, 9), "abc"[i % 3]) for i in range(others)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    made = mixing.mix(docs).collect()
    assert len(made) == len(rows)
    for (_, target), (taken, _) in by_source(made).items():
        assert abs(taken - target) <= 9
    mixed = mixing.mixed(docs.selectExpr("*", "1 AS its_copies", "2 AS row", "3 AS copy", "'x' AS `a.b`"))
    assert mixed.columns == ["doc_id", "text", "source", "its_copies", "row", "copy", "a.b"]
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in made)


@pytest.mark.parametrize("group", [4096, 16])
def test_mix_meets_targets_and_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP_ROWS", group)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["a", "a", "a", "b", "c", None]), 1, 2) for i in range(900)]
    rows += [(2000, None, "b", 1, 2), (2001, "", None, 1, 2), (None, "x y", "a", 1, 2), (5, "w", "a", 1, 2), (5, "w", "a", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, copies int")
    first = mixing.mix(docs).collect()
    assert len(first) == len(rows)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(first, key=key) == sorted(again, key=key)
    sources = by_source(first)
    assert len(sources) == 4
    for (_, target), (taken, _) in sources.items():
        assert abs(taken - target) <= max(0.01 * target, 40)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in first)


def test_rounding_keeps_expectations(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5 + 1), "ab"[i % 2]) for i in range(60)], "doc_id bigint, text string, source string")
    taken = np.zeros(60)
    for seed in range(30):
        for r in mixing.mix(docs, seed).collect():
            taken[r.doc_id] += r.taken / r.size / 30
    for side in (0, 1):
        want = mixing.mix(docs).where(f"doc_id % 2 = {side}").first()
        assert np.abs(taken[side::2] - want.target / want.source_size).mean() < 0.12


def test_mix_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]


# Operator 9

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?q#f", "http://example.org/es/", "https://example.org/en/12",
    "https://example.org/en/2", "http://notexample.org/es/1", "http://com/fr/", "x://y.com/de/?a", "http://y.com:80/de/",
    "http://net/", "http://www.dup.net/a.html", "http://dup.net/a/", "http://a..org/" + "x" * 5000, "://z.org/#q", "http://É.org/ä",
]


def judged(url, listed):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut : min([i for i in (rest.find(c, cut) for c in "?#") if i >= 0], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[1:]
    return host, path, None, "block" if host.removeprefix("www.") == "dup.net" and listed else "allow"


@pytest.mark.parametrize("few", [True, False])
def test_url_verdicts(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(url_filters, "BROADCAST_KEYS", 0)
    rows = [(i if i else None, u, "h", "r", "v") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string, verdict string")
    listed = url_filters.repeated_urls(spark.createDataFrame([(u,) for u in URLS], "url string"))
    got = sorted(map(tuple, url_filters.url_verdicts(pages, url_filters.RULES, listed).collect()), key=str)
    assert got == sorted(((i, *judged(u, True)) for i, u, *_ in rows), key=str)
    assert url_filters.url_verdicts(pages.limit(0), url_filters.RULES, listed).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS key")
    blocks, n = url_filters.bloom_filter(keys, 5000)
    looked = spark.range(20000).selectExpr("concat('k', id) AS key")
    passed = {r.key for r in url_filters.possible(looked, blocks, n, True).collect()}
    assert passed >= {f"k{i}" for i in range(5000)} and len(passed) < 5000 + 0.05 * 15000
