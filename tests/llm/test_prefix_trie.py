"""Operator 12 against a brute-force trie."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest

from lonepoint.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    chats = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            chats[c].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in chats.values():
        turns.sort()
    whole = {}
    for c, turns in chats.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(t[2:] for t in chats.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    below = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for path, inside in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(inside) - 1) * words
            leaves[path[:d]] += below[path] == 0
    out = []
    for path, inside in members.items():
        ends = ",".join(map(str, sorted(c for c in inside if whole[c] == path)))
        up = min(members[path[:-1]]) if path else None
        out.append((min(inside), len(path), up, len(inside), below[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    turns = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id bigint, turn int, role string, text string, id int, words string")
    got = prefix_trie.conversation_trie(turns)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def chats(seed, n, longest, words=3):
    """Conversations that branch off one another, repeat one another or stop early, with nulls."""
    rng, made = random.Random(seed), {}
    text = lambda: rng.choice([None, "", *(" ".join(["w"] * rng.randint(0, 4)) + str(i) for i in range(words))])
    for c in rng.sample(range(n * 3), n):
        base = list(made[rng.choice(list(made))]) if made and rng.random() < 0.7 else []
        base = base[: rng.randint(0, len(base))] if rng.random() < 0.8 else base
        made[c] = base + [(rng.choice(["user", "bot", None]), text()) for _ in range(rng.randint(0, longest))]
    return [(c, t if t else None, r, x) for c, turns in made.items() for t, (r, x) in enumerate(turns)]


@pytest.mark.parametrize("seed, n, longest", [(1, 60, 3), (2, 150, 12), (3, 40, 70)])
def test_like_brute_force(spark, seed, n, longest):
    rows = chats(seed, n, longest)
    assert run(spark, rows) == brute(rows)


def test_one_common_first_turn_and_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 900, 2)]
    rows += [(c, 1, "bot", f"answer {c // 100}") for c in range(0, 900, 2)]
    rows += [(c, 2, "user", f"own {c}") for c in range(0, 400, 2)]
    assert run(spark, rows) == brute(rows)


def test_cumulative_snapshots(spark):
    # No id below 20 has a family, and the first turns of the others come from conversation 20.
    rows = [(20 + c, t, "user", f"t{t}") for c in range(20) for t in range(3 * c + 1)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(["word"] * 200_000)
    rows = [
        (None, 0, "user", "no id"), (1, None, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, None),
        (-45, 0, "u", "x"), (-40, 0, "u", "y"), (-40, 1, "u", "z"), (5, 0, "u", long), (6, 0, "u", long + " more"), (2**62, 3, "u", "y"),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(4, 0, "u", "gone"), (3, 1, "u", "gone")]) == brute([(4, 0, "u", "gone"), (3, 1, "u", "gone")])
    assert run(spark, [(None, 0, "u", "a")]) == []
    assert run(spark, [(0, 0, "u", "a")]) == brute([(0, 0, "u", "a")])


def test_conversations_that_lose_all_turns(spark):
    ids = [c for c in range(21, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:7]
    rows = [(c, t, "u", "x") for c in ids for t in range(2)]
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    frame = spark.createDataFrame(pairs, "low int, high int").select("low", "high", prefix_trie.two_fattest("low", "high").alias("f"))
    for r in frame.collect():
        assert r.f == max(range(r.low + 1, r.high + 1), key=lambda x: x & -x)


def test_sql_like_brute_force():
    rows = chats(5, 50, 4)
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        assert sorted((tuple(r) for r in db.execute(prefix_trie.ORACLE).fetchall()), key=str) == brute(rows)
