"""Toxicity by a classifier that is regularised with counterfactuals.

Features are the words of a text, lower-cased, and their first 4, 5 and 6 bytes, each by presence.  Those
that go with the label on the training sample are kept, and so are those of the identity terms.  Each
sample text that names a group gets a twin in which every identity term is swapped for another of its
family; the loss adds the squared difference of the two scores, so that a neutral mention of one group
cannot weigh more than that of another.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.llm.linear import Rows, fit, labelled_sample, sigmoid
from lonepoint.llm.words import Words, Kept, map_texts, mix
from lonepoint.session import written

#: Families of identity terms; fixed values.
FAMILIES = [
    "women men frauen männer femmes hommes mujeres hombres".split(),
    "woman man girl boy".split(),
    "christian muslim jewish hindu buddhist atheist".split(),
    "christians muslims jews hindus buddhists atheists".split(),
    "gay straight lesbian bisexual transgender".split(),
    "black white asian latino african european".split(),
    "immigrants refugees foreigners locals".split(),
    "disabled deaf blind elderly young".split(),
]

#: At most so many labelled rows train the model, and so many features enter it.
SAMPLE_ROWS = 10_000
FEATURES = 5_000
LEAST_ROWS = 4
LEAST_Z = 4.0
L2 = 1e-4
PENALTY = 5.0

_PREFIXES = (4, 5, 6)


def _swaps() -> tuple[re.Pattern, dict[str, str]]:
    other = {t: f[(i + 1) % len(f)] for f in FAMILIES for i, t in enumerate(f)}
    return re.compile(r"\b(" + "|".join(sorted(other, key=len, reverse=True)) + r")\b", re.I), other


def swapped(text: str) -> str | None:
    """The text with every identity term exchanged within its family, or None if it has none."""
    pattern, other = _swaps()
    if text is None or not pattern.search(text):
        return None
    return pattern.sub(lambda m: other[m[0].lower()], text)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` for every word and prefix, repeats included."""
    words = Words(column, lower=True, bare=True)
    docs, keys = [words.doc], [words.hashes()]
    for n in _PREFIXES:
        long = np.flatnonzero(words.end - words.start > n)
        start = words.start[long]
        docs.append(words.doc[long])
        keys.append(mix(words.byte_hashes(start, start + n) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(keys).view(np.int64)


def _distinct(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    return docs[new], keys[new]


class Model:
    """Weights by feature hash; a bit mask skips most features that have none."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self._mask = Kept()

    @property
    def mask(self) -> np.ndarray:
        if "mask" not in self._mask:
            mask = self._mask["mask"] = np.zeros(1 << 20, bool)
            mask[self.keys & 0xFFFFF] = True
        return self._mask["mask"]

    def known(self, docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``(text, index of the feature)`` of features in the model."""
        near = self.mask[keys & 0xFFFFF]
        docs, keys = docs[near], keys[near]
        if not len(self.keys) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return _distinct(docs[hit], at[hit])

    def scores(self, column: pa.Array) -> np.ndarray:
        docs, at = self.known(*features(column))
        return sigmoid(np.bincount(docs, self.weights[at], len(column)) + self.bias)


def _counted(sample: DataFrame) -> DataFrame:
    """``feature, pos, neg``: sample rows with the feature, by label."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        label = piece.column(1).to_numpy(zero_copy_only=False)
        docs, keys = _distinct(*features(piece.column(0)))
        found, index = np.unique(keys, return_inverse=True)
        pos = np.bincount(index, label[docs], len(found)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(pos), pa.array(np.bincount(index, minlength=len(found)) - pos)],
            ["feature", "pos", "neg"],
        )

    parts = map_texts(sample.select("text", "label"), "text", run, "feature bigint, pos bigint, neg bigint")
    return parts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents; without any, every text scores a quarter."""
    sample = written(labelled_sample(docs, labels, label, rows), "toxicity-sample")
    totals = sample.agg(F.sum("label"), F.count("*")).first()
    pos, n = totals[0] or 0, totals[1]
    neg = n - pos
    share = (F.col("pos") + F.col("neg")) / F.lit(max(n, 1))
    spread = F.sqrt(share * (1 - share) * F.lit(1 / max(pos, 1) + 1 / max(neg, 1)) + F.lit(1e-9))
    z = F.abs(F.col("pos") / F.lit(max(pos, 1)) - F.col("neg") / F.lit(max(neg, 1))) / spread
    told = (
        _counted(sample)
        .where(F.col("pos") + F.col("neg") >= LEAST_ROWS)
        .withColumn("z", z)
        .where(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "feature")
        .limit(FEATURES)
        .select("feature")
    )
    terms = features(pa.array([t for f in FAMILIES for t in f]))[1]
    keys = np.union1d(np.array([r[0] for r in told.collect()], np.int64), terms)
    model = Model(keys, np.zeros(len(keys)), 0.0)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        twins = pa.array([swapped(t) for t in piece.column(0).to_pylist()], pa.string())
        lists = []
        for column in (piece.column(0), twins):
            docs, at = model.known(*features(column))
            cut = np.searchsorted(docs, np.arange(len(column) + 1)).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(at.astype(np.int64))))
        return pa.RecordBatch.from_arrays(
            [piece.column(1), piece.column(2), *lists, pa.array([t.is_valid for t in twins])],
            ["doc_id", "label", "known", "twin", "has_twin"],
        )

    made = map_texts(
        sample.select("text", "doc_id", "label"),
        "text",
        run,
        "doc_id bigint, label int, known array<bigint>, twin array<bigint>, has_twin boolean",
    ).collect()
    made.sort(key=lambda r: (r.doc_id, r.known))
    as_rows = lambda lists: Rows([np.array(x, np.int64) for x in lists])
    named = [r for r in made if r.has_twin]
    weights, bias = fit(
        as_rows([r.known for r in made]),
        np.array([r.label for r in made], float),
        len(keys),
        L2,
        pairs=(as_rows([r.known for r in named]), as_rows([r.twin for r in named])),
        penalty=PENALTY,
    )
    return Model(model.keys, weights, bias)


def _fold(docs: DataFrame):
    return F.crc32(F.col("doc_id").cast("string")) % 5


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows of ``labels`` outside the held-out fold."""
    return labels.where(_fold(labels) != 0)


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Score every row: ``doc_id, held_out, score, predicted``.

    Trains on ``labels`` outside the held-out fold unless a model is given.  A null or empty text has no
    features and scores the intercept.  Rows that repeat score alike, a null ``doc_id`` is scored and not
    held out, an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
    """
    model = model or train(docs, training_labels(labels))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.scores(piece.column(1))
        return pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
            ["doc_id", "score", "predicted"],
        )

    scored = map_texts(docs.select("doc_id", "text"), "text", run, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", F.coalesce(_fold(scored) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    at = docs.columns.index("text")

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        return piece.filter(pa.array(model.scores(piece.column(at)) < 0.5))

    return map_texts(docs, "text", run, docs.schema)
