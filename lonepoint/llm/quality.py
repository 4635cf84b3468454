"""Quality by counting rules and a calibrated classifier on hashed word and character n-grams.

The classifier sees, for every text, the shares of its words, word pairs and runs of three characters in hash buckets.
It is fitted on one part of a bounded sample of labelled rows and its probabilities are calibrated on the
other.  Texts are scored in Arrow batches, all texts of a batch at once, and a fixed threshold decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.llm.linear import Rows, fit, labelled_sample, prior, sigmoid
from lonepoint.llm.words import Words, map_texts, mix, span_hashes, window_hashes

#: At most so many labelled rows train the model; every fifth of them calibrates it.
SAMPLE_ROWS = 4_000
BUCKETS = 1 << 15
THRESHOLD = 0.5
L2 = 1e-6
LEAST_WORDS = 50
REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Shares are multiplied by this, so that a bucket that matters is of the order of one.
_SCALE = 30.0


def _summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _ngrams(words: Words, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(text, bucket)`` of the words, word pairs and runs of three characters, each in its own range."""
    pairs = words.windows(2)
    # Characters of UTF-8 begin where a byte does not go on with the one before it.
    begins = np.flatnonzero((words.data & 0xC0) != 0x80)
    letters = span_hashes(words.data.astype(np.uint64), begins, np.append(begins[1:], len(words.data)))
    home = np.searchsorted(words.offsets, begins, "right") - 1
    triples = np.flatnonzero(home[: max(0, len(home) - 2)] == home[2:])
    kinds = [
        (words.doc, (hashes % np.uint64(BUCKETS)).astype(np.int64)),
        (words.doc[pairs], (window_hashes(hashes, 2)[pairs] % np.uint64(BUCKETS)).astype(np.int64)),
        (home[triples], (window_hashes(letters, 3)[triples] % np.uint64(BUCKETS)).astype(np.int64)),
    ]
    return [(doc, bucket + i * BUCKETS) for i, (doc, bucket) in enumerate(kinds)]


@dataclass
class Model:
    """Weights of the buckets, and slope and offset of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        n = len(words.count)
        log_odds = np.full(n, float(self.bias))
        for doc, bucket in _ngrams(words, hashes):
            total = np.maximum(np.bincount(doc, minlength=n), 1)
            log_odds += np.bincount(doc, self.weights[bucket], n) * _SCALE / total
        return sigmoid(self.slope * log_odds + self.offset)


def _rows(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    words = Words(texts)
    columns, values = [[] for _ in texts], [[] for _ in texts]
    for doc, bucket in _ngrams(words, words.hashes()):
        cell, count = np.unique(doc * (3 * BUCKETS) + bucket, return_counts=True)
        doc, bucket = np.divmod(cell, 3 * BUCKETS)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        for d in range(len(texts)):
            part = slice(cut[d], cut[d + 1])
            columns[d].append(bucket[part])
            values[d].append(count[part] * (_SCALE / max(1, count[part].sum())))
    return [np.concatenate(c) for c in columns], [np.concatenate(v) for v in values]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fit and calibrate on at most ``rows`` labelled documents; without any, every text scores a half or more."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        columns, values = _rows(piece.column(0))
        at = np.cumsum([0, *map(len, columns)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                piece.column(1),
                piece.column(2),
                pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(columns).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values).astype(np.float32))),
            ],
            ["doc_id", "label", "columns", "shares"],
        )

    sample = labelled_sample(docs, labels, label, rows).select("text", "doc_id", "label")
    made = map_texts(sample, "text", run, "doc_id bigint, label int, columns array<int>, shares array<float>")
    got = made.toArrow().combine_chunks().sort_by("doc_id")
    target = got["label"].to_numpy().astype(float)
    if not len(target):
        return Model(np.zeros(3 * BUCKETS), 0.0, 1.0, 0.0)
    columns = [np.asarray(x.values) for x in got["columns"]]
    shares = [np.asarray(x.values) for x in got["shares"]]
    seen = np.bincount(np.concatenate(columns), minlength=3 * BUCKETS) >= 3
    kept = [seen[c] for c in columns]
    columns, shares = [c[k] for c, k in zip(columns, kept)], [s[k] for s, k in zip(shares, kept)]
    held = np.arange(len(target)) % 5 == 0
    part = lambda mask: Rows([columns[i] for i in np.flatnonzero(mask)], [shares[i] for i in np.flatnonzero(mask)])
    weights, bias = fit(part(~held), target[~held], 3 * BUCKETS, L2, steps=80)
    slope, offset = _calibration(part(held).times(weights) + bias, target[held])
    return Model(weights, bias, slope, offset)


def _calibration(log_odds: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make the log-odds fit held-back labels, with smoothed targets."""
    if not len(target):
        return 1.0, 0.0
    pos, neg = target.sum(), len(target) - target.sum()
    goal = np.where(target > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(slope * log_odds + offset)
        w = p * (1 - p) + 1e-6
        first = np.array([np.sum((p - goal) * log_odds) + 1e-3 * (slope - 1), np.sum(p - goal)])
        second = np.array(
            [[np.sum(w * log_odds**2) + 1e-3, np.sum(w * log_odds)], [np.sum(w * log_odds), np.sum(w) + 1e-6]]
        )
        slope, offset = np.array([slope, offset]) - np.clip(np.linalg.solve(second, first), -1, 1)
    return (float(slope), float(offset)) if slope > 0 else (1.0, float(prior(target)))


def counts(words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The counting rules' figures for every text of a batch."""
    n = len(words.count)
    letters = (words.data & 0xC0) != 0x80
    inside = np.concatenate([[0], np.cumsum(letters)])
    symbols = _summed(_SYMBOL[words.data].astype(np.int64), words.offsets)

    starts, ends = words.lines()
    at = np.searchsorted(words.start, starts)
    filled = np.flatnonzero(at < len(words.start))
    filled = filled[words.start[at[filled]] < ends[filled]]
    starts, ends = starts[filled], ends[filled]
    home = np.searchsorted(words.offsets, starts, "right") - 1
    lines = span_hashes_of(words, starts, ends, home)
    distinct = np.unique(np.stack([home.astype(np.uint64), lines], 1), axis=0) if len(lines) else np.zeros((0, 2))
    duplicates = np.bincount(home, minlength=n) - np.bincount(distinct[:, 0].astype(np.int64), minlength=n)

    at = words.windows(3)
    keys = mix(window_hashes(hashes, 3)[at] + mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(keys)
    often = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(len(words.doc) + 3, bool)
    if len(often):
        found = np.minimum(np.searchsorted(often, keys), len(often) - 1)
        hit = at[often[found] == keys]
        for i in range(3):
            covered[hit + i] = True
    repeated = np.bincount(words.doc, covered[: len(words.doc)], n).astype(np.int64)
    return {
        "n_words": words.count,
        "word_chars": np.bincount(words.doc, inside[words.end] - inside[words.start], n).astype(np.int64),
        "n_symbols": symbols,
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated,
    }


def span_hashes_of(words: Words, starts: np.ndarray, ends: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Hashes of byte spans that differ between texts."""
    return mix(words.byte_hashes(starts, ends) + mix(home.astype(np.uint64) + np.uint64(1)))


def quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Judge every row by the rules, then by the classifier.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score``.
    A null or empty text has zeros everywhere and fails the rules.  Repeated rows are judged alike, an
    empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
    """
    model = model or train(docs, labels)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(piece.column(1))
        hashes = words.hashes()
        found = counts(words, hashes)
        scores = model.scores(words, hashes)
        failed = (found["n_words"] < LEAST_WORDS) | (
            100 * found["n_repeat_words"] > REPEAT_PERCENT * found["n_words"]
        )
        return pa.RecordBatch.from_arrays(
            [
                piece.column(0),
                *[pa.array(v.astype(np.int64)) for v in found.values()],
                pa.array(failed),
                pa.array(~failed & (scores >= THRESHOLD)),
                pa.array(scores),
            ],
            ["doc_id", *found, "base_failed", "kept", "score"],
        )

    return map_texts(
        docs.select("doc_id", "text"),
        "text",
        run,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean, score double",
    )
