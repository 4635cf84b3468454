"""Removal of repeated passages by an FM-index per shard.

A window is ``WIDTH`` consecutive words of a document.  A word goes if it lies in a window whose words also
start at an earlier place, in a smaller document or further up in the same one.

1. Consecutive windows that share their smallest word shingle make a fragment, which is named by that
   shingle.  Equal windows lie in fragments of one name, so names make the shards, and a name that occurs
   once in the corpus can hold no repeated window: nearly all text leaves here.
2. Equal fragments collapse to their earliest place.  All windows of the other ones are repeats.
3. The fragments of a shard are streamed through the shard's compressed FM-index: backward search over a wavelet
   matrix gives the matching statistic at each word, the length of the longest passage that ends there and occurs
   twice, as far as ``WIDTH``.  Where it reaches that, the smallest text position among the suffixes found, from
   a sample of the suffix order, is the window's first place.  Windows that have an earlier one are reported as
   intervals.
4. A name with very many different fragments would make one shard too large.  Its windows are dealt out one
   by one, by their own hash, and compared by a pre-aggregated minimum.

Words are compared by 64-bit hashes; windows by those of all their words, or by 128 bits where they are dealt out,
and fragments by the 128 bits of name and content.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.llm.fm_index import FmIndex
from lonepoint.llm.words import Words, map_texts, mix, span_hashes, window_hashes
from lonepoint.session import written

WIDTH = 20
SHINGLE = 5
#: Different fragments of one name that a shard takes; a name with more is dealt out by windows.
HOT_NAME = 2_048
#: Different fragments that one shard gets on average.
SHARD_FRAGMENTS = 4_096

_LAST = (1 << 63) - 1


def _texts(docs: DataFrame) -> DataFrame:
    """``place, row, doc_id, text``: the order of the documents, and what tells those at one place apart.

    ``place`` is the id, the largest number for a null one.  Where ids are not unique, texts under one id are
    told apart by ``row``, a hash of the text.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("place"), "doc_id", "text")
    several = rows.groupBy("place").agg(F.count("*").alias("rows")).where("rows > 1")
    row = F.lit(0).cast("bigint") if several.isEmpty() else F.xxhash64("text")
    return rows.select("place", row.alias("row"), "doc_id", "text")


def _digests(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Hashes of fragments, by the sequence of their windows."""
    return span_hashes(window_hashes(hashes, width), first, first + count)


def _names(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and the smallest shingle of each."""
    at = words.windows(width)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    least = window_hashes(hashes, SHINGLE)
    # Minima over runs of 1, 2, 4, ... shingles, then over the whole run from two that overlap.
    run, wanted = 1, width - SHINGLE + 1
    while run * 2 <= wanted:
        least = np.minimum(least[: len(least) - run], least[run:])
        run *= 2
    return at, np.minimum(least[at], least[at + wanted - run])


def _fragments(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows and name of every fragment, and whether it may repeat itself."""
    at, names = _names(words, hashes, width)
    new = np.ones(len(at), bool)
    new[1:] = (names[1:] != names[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    reach = width - SHINGLE
    itself = count > reach + 1
    windows, home = window_hashes(hashes, width)[at], np.cumsum(new) - 1
    for step in range(1, min(reach + 1, len(at))):
        same = np.flatnonzero(windows[step:] == windows[:-step])
        itself[home[same[home[same] == home[same + step]]]] = True
    return at[first], count, names[first], itself


def fragments(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """``name, digest, place, row, start, windows, itself``: all fragments, with a hash of their content.

    ``itself`` is false if no window can occur twice in the fragment.
    """

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(piece.column(2))
        hashes = words.hashes()
        first, count, names, itself = _fragments(words, hashes, width)
        digests = _digests(hashes, first, count, width)
        doc = words.doc[first]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names.view(np.int64)),
                pa.array(digests.view(np.int64)),
                piece.column(0).take(pa.array(doc)),
                piece.column(1).take(pa.array(doc)),
                pa.array((first - words.first[doc]).astype(np.int32)),
                pa.array(count.astype(np.int32)),
                pa.array(itself),
            ],
            ["name", "digest", "place", "row", "start", "windows", "itself"],
        )

    return map_texts(
        texts.select("place", "row", "text"),
        "text",
        run,
        "name bigint, digest bigint, place bigint, row bigint, start int, windows int, itself boolean",
    )


def _content(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` rows (``name, digest, place, row, start, windows``) with their word hashes.

    Rows that agree in place and row are read once.
    """
    entry = F.struct("name", "digest", "start", "windows")
    lists = wanted.groupBy("place", "row").agg(F.collect_list(entry).alias("wanted"))
    read = texts.select("place", "row", "text").join(lists, ["place", "row"])
    read = read.groupBy("place", "row").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        words = Words(piece.column(2))
        hashes = words.hashes()
        lists = piece.column(3)
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        name, digest, start, windows = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
        first = words.first[doc] + start
        size = windows.astype(np.int64) + width - 1
        if not len(doc):
            return None
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        content = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(hashes[at].view(np.int64))
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array(name), pa.array(digest), piece.column(0).take(pa.array(doc)), piece.column(1).take(pa.array(doc)),
                pa.array(start), content,
            ],
            ["name", "digest", "place", "row", "start", "words"],
        )

    return map_texts(
        read.select("place", "row", "text", "wanted"),
        "text",
        run,
        "name bigint, digest bigint, place bigint, row bigint, start int, words array<bigint>",
    )


def _intervals(place: np.ndarray, row: np.ndarray, start: np.ndarray, width: int) -> pd.DataFrame:
    """Runs of windows at consecutive starts, as intervals of words."""
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place))[: len(first)] - 1
    return pd.DataFrame({
        "place": place[first], "row": row[first],
        "from_word": start[first].astype("int64"), "to_word": start[last].astype("int64") + width,
    })


def _search_shard(width: int):
    """Repeated windows among the fragments of one shard."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "row", "start"])
        sizes = group["words"].map(len).to_numpy()
        # A separator after each fragment; it is symbol 0 and in no window.
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        known, symbols = np.unique(np.concatenate(group["words"].tolist()), return_inverse=True)
        text[inside] = symbols + 1
        fragment = np.repeat(np.arange(len(sizes)), sizes + 1)
        at = np.arange(len(text))
        window = at[at + width <= ends[fragment]]
        index = FmIndex(text, len(known) + 1)
        length, low, high = index.statistics(text, window + width, width)
        again = length == width
        window = window[again]
        window = window[index.earliest(low[again], high[again]) < window]
        home = fragment[window]
        begins = ends - sizes
        start = group["start"].to_numpy()[home] + window - begins[home]
        return _intervals(group["place"].to_numpy()[home], group["row"].to_numpy()[home], start, width)

    return run


def _window_rows(content: DataFrame, width: int) -> DataFrame:
    """``window, check, place, row, start``: every window of the fragments by two hashes."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(sizes)
            home = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(hashes))
            at = at[at + width <= ends[home]]
            home = home[at]
            start = batch.column(2).to_numpy()[home] + at - (ends - sizes)[home]
            both = [window_hashes(h, width)[at].view(np.int64) for h in (hashes, mix(hashes + np.uint64(1)))]
            yield pa.RecordBatch.from_arrays(
                [
                    *map(pa.array, both),
                    batch.column(0).take(pa.array(home)),
                    batch.column(1).take(pa.array(home)),
                    pa.array(start.astype(np.int32)),
                ],
                ["window", "check", "place", "row", "start"],
            )

    return content.select("place", "row", "start", "words").mapInArrow(
        run, "window bigint, check bigint, place bigint, row bigint, start int"
    )


def repeated_intervals(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """``place, row, from_word, to_word``: words to remove from ``place, row, text``; intervals may overlap."""
    # Read twice: the fragments of all texts take more room than making them again takes time.
    every = fragments(texts, width)
    counted = every.groupBy("name").agg(F.count("*").alias("times"), F.max("itself").alias("itself"))
    again = counted.where("times > 1 or itself").select("name")
    repeated = written(every.join(again, "name"), "repeated")
    origin = F.min(F.struct("place", "row", "start")).alias("origin")
    distinct = repeated.groupBy("name", "digest").agg(
        origin, F.min("windows").alias("windows"), F.max("itself").alias("itself")
    )
    distinct = written(distinct, "distinct")
    later = F.expr("place <> origin.place or row <> origin.row or start <> origin.start")
    copies = (
        repeated.join(distinct.select("name", "digest", "origin"), ["name", "digest"])
        .where(later)
        .select(
            "place",
            "row",
            F.col("start").cast("long").alias("from_word"),
            (F.col("start") + F.col("windows") + width - 1).cast("long").alias("to_word"),
        )
    )
    by_name = distinct.groupBy("name").agg(F.count("*").alias("fragments"), F.max("itself").alias("itself"))
    searched = by_name.where((F.col("fragments") > 1) | F.col("itself")).select("name", "fragments")
    wanted = distinct.join(searched, "name").select(
        "name", "digest", "origin.place", "origin.row", "origin.start", "windows", (F.col("fragments") > HOT_NAME).alias("hot")
    )
    wanted = written(wanted, "wanted")
    sizes = {r["hot"]: r["count"] for r in wanted.groupBy("hot").count().collect()}
    shards = max(1, -(-sizes.get(False, 0) // SHARD_FRAGMENTS))
    found = (
        _content(texts, wanted.where("not hot").drop("hot"), width)
        .withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_search_shard(width), "place bigint, row bigint, from_word bigint, to_word bigint")
    )
    if not sizes.get(True):
        return copies.union(found)
    windows = _window_rows(_content(texts, wanted.where("hot").drop("hot"), width), width)
    first = windows.groupBy("window", "check").agg(origin)
    single = (
        windows.join(first, ["window", "check"])
        .where(later)
        .select(
            "place",
            "row",
            F.col("start").cast("long").alias("from_word"),
            (F.col("start") + width).cast("long").alias("to_word"),
        )
    )
    return copies.union(found).union(single)


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Digest what is left of every text: ``doc_id, n_words, n_removed, kept_sha256``.

    A null or empty text has no words.  A null ``doc_id`` comes after all others.  Different texts under one
    ``doc_id``, or without one, are documents of their own, one after the other by a hash of the text; rows that
    agree in id and text are one document, and each is left with the same words.  An empty table gives no rows.
    Only ``doc_id`` and ``text`` are read.
    """
    texts = _texts(docs)
    cut = (
        repeated_intervals(texts, width)
        .groupBy("place", "row")
        .agg(F.sort_array(F.collect_set(F.struct("from_word", "to_word"))).alias("cut"))
    )
    rows = texts.join(cut, ["place", "row"], "left")

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(piece.column(1))
        lists = piece.column(2)
        n = len(words.doc)
        delta = np.zeros(n + 1, np.int64)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lists)), lengths)
        if len(doc):
            low, high = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            first, last = words.first[doc], words.first[doc + 1]
            np.add.at(delta, np.minimum(first + low, last), 1)
            np.add.at(delta, np.minimum(first + high, last), -1)
        kept = np.cumsum(delta[:n]) == 0
        raw = words.data.tobytes()
        digests = []
        for d in range(len(words.count)):
            part = slice(words.first[d], words.first[d + 1])
            mask = kept[part]
            spans = zip(words.start[part][mask].tolist(), words.end[part][mask].tolist())
            digests.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in spans])).hexdigest())
        removed = words.count - np.bincount(words.doc, kept, len(words.count)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(words.count.astype(np.int64)), pa.array(removed), pa.array(digests, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return map_texts(
        rows.select("doc_id", "text", "cut"),
        "text",
        run,
        "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    )


ORACLE = """
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(words[s + 1 : s + 20], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(len(words) - 19)) AS s FROM texts)
), again AS (
  SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM again
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM texts) w
  ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i
  GROUP BY w.doc_id
)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, len(t.words)::BIGINT - coalesce(k.n, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
