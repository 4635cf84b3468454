"""Operator 13 against a brute-force version and held-out documents."""

import collections
import unicodedata
import zlib

import pytest

from lonepoint.llm import language

SF = "/root/testdata/sf0.01"


def grams(text):
    """N-grams of one to three characters of all words, with a border on both sides."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            words.append("\x01" + word + "\x01")
            word = ""
    if not any(unicodedata.category(c)[0] == "L" for w in words for c in w):
        return collections.Counter()
    found = collections.Counter()
    for w in words:
        for n in (1, 2, 3):
            found.update(w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] != "\x01")
    # A border between two words belongs to both.
    return found


def place(counter):
    def number(g):
        n = 0
        for c in g:
            n = n << 21 | ord(c)
        return n

    order = sorted(counter, key=lambda g: (-counter[g], number(g)))[: language.PROFILE]
    return {g: i for i, g in enumerate(order)}


def brute(train, texts):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in train:
        if text is not None and lang is not None:
            counts[lang].update(grams(text))
    profiles = {lang: place(c) for lang, c in counts.items() if c}
    answers = []
    for text in texts:
        own = place(grams(text))
        if not own or not profiles:
            answers.append(("und", 0.0))
            continue
        far = {
            lang: sum(abs(r - p[g]) if g in p else language.PROFILE for g, r in own.items()) for lang, p in profiles.items()
        }
        best = min(sorted(far), key=far.get)
        answers.append((best, 1 - far[best] / (language.PROFILE * len(own))))
    return answers


ODD = [None, "", "  42 !?", "́", "Ünïcode ΣΑΣ straße", "a", "好 好 好", "x" * 5000, "the THE The\nthe", "e\x00f \U0001d4d0 ab"]


@pytest.mark.parametrize("piece, held", [(1 << 20, 1 << 20), (64, 500)])
def test_like_brute_force(spark, monkeypatch, piece, held):
    monkeypatch.setattr(language, "PIECE", piece)
    monkeypatch.setattr(language, "HELD", held)
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in rows] + [(1000 + i, t, "odd" if i % 2 else None) for i, t in enumerate(ODD)]
    rows += [(None, "null id", "xx"), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id bigint, text string, lang string, gram int, held_out string")
    train = [(t, g) for i, t, g in rows if i is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    want = sorted(
        ((i or -1), i is not None and zlib.crc32(str(i).encode()) % 4 == 2, lang, round(score, 9))
        for (i, t, _), (lang, score) in zip(rows, brute(train, [r[1] for r in rows]))
    )
    got = [(r.doc_id or -1, r.held_out, r.lang_pred, round(r.score, 9)) for r in language.language_id(docs).collect()]
    assert sorted(got) == want


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.language_id(docs).collect()}
    assert got == {1: ("und", 0.0), 2: ("und", 0.0)}
    assert language.language_id(docs.limit(0)).count() == 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(9)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.language_profiles(docs)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    worded = [r for r in found if r.lang_pred != "und" and r.lang is not None]
    right = sum(r.lang_pred == r.lang for r in worded)
    print(right, len(worded), [(r.lang, r.lang_pred, r.text[:60]) for r in worded if r.lang_pred != r.lang][:10])
    assert len(worded) > 150 and right / len(worded) > 0.97
