"""Language identification by rank-order profiles.

A text is lower-cased and cut into words, the runs of letters and marks, and its n-grams are those of one to
three characters inside a word with its two borders.  A language's profile is the list of its most frequent
n-grams over all training texts; a document's profile is made in the same way from its own text.  The
out-of-place distance sums, over the n-grams of the document, how far the rank in one profile is from the rank in
the other, and the profile's length for an n-gram that the language's profile lacks.  The closest language wins.

Training counts are one aggregate over all training texts.  Profiles have a fixed length, so what the tasks
receive grows with the number of languages alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonepoint.llm.words import Kept, map_texts, pieces

#: N-grams of a profile, of a language and of a document.
PROFILE = 400
#: Characters of a text counted at once, and counted n-grams held by a task.
PIECE, HELD = 1 << 20, 1 << 20
#: Languages whose profiles fit into a task; more are an error.
MOST_LANGUAGES = 1 << 14
UNKNOWN = "und"

_BORDER = 1
_tables: dict[str, np.ndarray] = Kept()


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point, whether it is a letter, and whether it belongs to a word."""
    if not _tables:
        kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        _tables["letter"] = np.array([k == "L" for k in kinds])
        _tables["word"] = np.array([k in "LM" for k in kinds])
    return _tables["letter"], _tables["word"]


def word_codes(text: str) -> np.ndarray:
    """Code points of the words, one border before, between and after them; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter, word = _characters()
    if not letter[codes].any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[_BORDER], np.where(word[codes], codes, _BORDER), [_BORDER]]).astype(np.int64)
    border = codes == _BORDER
    return codes[~border | np.append(True, ~border[:-1])]


def _counted(grams: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order and how often they occur."""
    if counts is None:
        return np.unique(grams, return_counts=True)
    found, place = np.unique(grams, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and their counts; an n-gram is a number, 21 bits a character."""
    codes = word_codes(text) if text else np.zeros(0, np.int64)
    made = []
    for at in range(0, len(codes), PIECE):
        # Two characters more, for the n-grams that begin in this piece.
        part = codes[at : at + PIECE + 2]
        one, two, three = part[:PIECE], part[:-1][:PIECE], part[:-2][:PIECE]
        second, third = part[1:][: len(two)], part[2:][: len(three)]
        inner = second[: len(three)] != _BORDER
        made.append(
            _counted(np.concatenate([
                one[one != _BORDER],
                two << 21 | second,
                (three << 42 | second[: len(three)] << 21 | third)[inner],
            ]))
        )
    if not made:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(made) == 1:
        return made[0]
    return _counted(*(np.concatenate(x) for x in zip(*made)))


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams in order of frequency, ties to the smaller one."""
    return grams[np.argsort(-counts, kind="stable")[:PROFILE]]


def _count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, made in held.items():
            grams, counts = _counted(*(np.concatenate(x) for x in zip(*made)))
            yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), grams, counts], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for piece in pieces(batch, "text"):
            for text, lang in zip(piece["text"].to_pylist(), piece["lang"].to_pylist()):
                made = ngram_counts(text)
                held.setdefault(lang, []).append(made)
                size += len(made[0])
                if size > HELD:
                    for name, parts in held.items():
                        held[name] = [_counted(*(np.concatenate(x) for x in zip(*parts)))]
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > HELD // 2:
                        yield from flush()
                        size = 0
    yield from flush()


class Profiles(NamedTuple):
    """Profiles of all languages: per n-gram, in ascending order, the languages that rank it and their ranks."""

    languages: list[str]
    grams: np.ndarray
    first: np.ndarray
    language: np.ndarray
    rank: np.ndarray

    def nearest(self, document: np.ndarray) -> tuple[str, float]:
        """The closest language to a ranked list of n-grams, and one less the distance as a share of the largest."""
        if not len(document) or not self.languages:
            return UNKNOWN, 0.0
        place = np.searchsorted(self.grams, document)
        place[place == len(self.grams)] = 0
        own = np.flatnonzero(self.grams[place] == document)
        begin, count = self.first[place[own]], self.first[place[own] + 1] - self.first[place[own]]
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        saved = PROFILE - np.abs(self.rank[at] - np.repeat(own, count))
        near = np.bincount(self.language[at], saved, len(self.languages))
        best = int(near.argmax())
        return self.languages[best], float(near[best] / (PROFILE * len(document)))


def language_profiles(docs: DataFrame) -> Profiles:
    """Profiles of the languages in ``lang``, from the ``text`` of all rows that have one.

    Rows with a null text or language, or without letters, teach nothing; repeated rows count as often as they
    occur.  Of an empty table nothing is learned.
    """
    given = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = given.mapInArrow(_count_by_language, "lang string, gram bigint, n bigint")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROFILE)
    # One row more than fit: the number of languages is checked before anything of their size is held.
    rows = top.select("lang", "gram", "place").limit(PROFILE * MOST_LANGUAGES + 1).toPandas()
    languages = sorted(rows["lang"].unique())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows["code"] = np.searchsorted(np.array(languages, dtype=object), rows["lang"].to_numpy()) if languages else 0
    rows = rows.sort_values(["gram", "code"])
    grams, first = np.unique(rows["gram"].to_numpy(np.int64), return_index=True)
    return Profiles(
        languages,
        grams,
        np.append(first, len(rows)),
        rows["code"].to_numpy(np.int64),
        rows["place"].to_numpy(np.int64) - 1,
    )


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its whole text alone.

    ``score`` is 1 for a document whose profile is the language's own and 0 for one that shares no n-gram with
    it.  Equally close languages go by code point.  A text that is null, or has no letter, and any text if no
    language was learned, is ``und`` with score 0.  Repeated rows get equal answers; an empty table gives no rows.
    Only ``doc_id`` and ``text`` are read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [profiles.nearest(ranked(*ngram_counts(t))) for t in batch["text"].to_pylist()]
        return pa.record_batch(
            [batch["doc_id"], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
            ["doc_id", "lang_pred", "score"],
        )

    return map_texts(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "text", run, "doc_id bigint, lang_pred string, score double"
    )


def held_out(docs: DataFrame) -> DataFrame:
    """Every row's ``held_out``: the checksum of its id leaves 2 when divided by 4; false without id."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: profiles learned from rows that are not held out, applied to all."""
    found = identify(docs, language_profiles(held_out(docs).where("not held_out and doc_id is not null")))
    return held_out(found).select("doc_id", "held_out", "lang_pred", "score")
