"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to ``floor(256 * x)``.  The rows are dealt into blocks; for each block and component
the index holds one bitmap per bit of the component, so that bitmap ``b`` has a bit for every row.  A
query adds these slices with bitmap arithmetic, each as often as the query's own component says, which
gives the slices of all scores of the block.  From the most significant slice downward the rows that are
surely among the best are kept, until the rest is tied; the boundary rows are resolved by id.

The slices of a block are made once and written as one row of a table.  Queries come to every block in groups,
by a join on the numbers of block and group.  A block returns its best rows per query, and these meet in one
ranking.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonepoint.session import spread, written

SCALE = 256
#: Rows of one index block on average, and queries that meet it at once.
BLOCK_ROWS = 1 << 15
QUERY_ROWS = 2048
#: Numbers below this, in absolute value, and their sums with one another fit into 64 bits.
SAFE = 1 << 62


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, values``: whole numbers of the vectors that take part; an error where one leaves 64 bits."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    error = F.raise_error(F.lit("a quantised component does not fit into 64 bits")).cast("bigint")
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**63), F.floor(x)).otherwise(error)
    return rows.where(F.col(vector).isNotNull() & fits & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform(vector, lambda x: whole(x.cast("double") * SCALE)).alias("values")
    )


def _matrix(lists: list) -> np.ndarray:
    """Rows of whole numbers; shorter ones end in zeros, which add nothing to a product."""
    full = np.zeros((len(lists), max(map(len, lists), default=0)), np.int64)
    for row, values in zip(full, lists):
        row[: len(values)] = values
    return full


class Slices:
    """Bitmaps of one block: ``bits[d]`` are the slices of component ``d``, least significant first.

    A component is stored less its minimum, so slices have no sign; ``low`` keeps the minima.
    """

    def __init__(self, values: np.ndarray):
        self.rows, self.width = values.shape
        words = -(-self.rows // 64)
        self.low = values.min(0) if self.rows else np.zeros(self.width, np.int64)
        # The difference wraps around to the right number without sign.
        shifted = np.zeros((self.width, words * 64), np.uint64)
        shifted[:, : self.rows] = (values - self.low).view(np.uint64).T
        self.bits = []
        for column in shifted:
            depth = int(column.max(initial=0)).bit_length()
            planes = ((column >> np.arange(depth, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)
            self.bits.append(np.packbits(planes, axis=1, bitorder="little").view(np.uint64).reshape(depth, words))
        self.valid = np.packbits(np.arange(words * 64) < self.rows, bitorder="little").view(np.uint64)

    def packed(self) -> tuple[int, bytes, bytes, bytes]:
        """Number of rows, minima, slices per component, and all slices one after the other."""
        depths = np.array([len(planes) for planes in self.bits], np.int64)
        return self.rows, self.low.tobytes(), depths.tobytes(), b"".join(planes.tobytes() for planes in self.bits)

    @classmethod
    def unpacked(cls, rows: int, low: bytes, depths: bytes, bits: bytes) -> Slices:
        new = cls(np.zeros((rows, 0), np.int64))
        new.low = np.frombuffer(low, np.int64)
        new.width = len(new.low)
        stops = np.cumsum(np.frombuffer(depths, np.int64))[:-1]
        planes = np.frombuffer(bits, np.uint64).reshape(-1, len(new.valid))
        new.bits = np.split(planes, stops) if new.width else []
        return new

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the non-negative scores, and what to add to them.

        A factor is a sum of few powers of two with signs, no two of them next to each other.  A negative power
        counts the complement of the slice: ``-p * a = p * (m - a) - p * m`` with ``m`` the largest number of the
        component's bits.
        """
        columns: list[list[np.ndarray]] = []
        offset = 0
        for d in range(min(self.width, len(query))):
            q = int(query[d])
            offset += q * int(self.low[d])
            planes = self.bits[d]
            if q == 0 or not len(planes):
                continue
            other = ~planes
            for j, sign in _signed_powers(q):
                if sign < 0:
                    offset -= ((1 << len(planes)) - 1) << j
                while len(columns) < j + len(planes):
                    columns.append([])
                for i, plane in enumerate(planes if sign > 0 else other):
                    columns[i + j].append(plane)
        return _added(columns), offset

    def top(self, query: np.ndarray, k: int, skip: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
        """Rows that can be among the ``k`` best, boundary ties included, and their scores.

        Rows from ``skip[0]`` to before ``skip[1]`` take no part.

        Slices have any number of bits; scores that 64 bits may not hold are Python's whole numbers.
        """
        slices, offset = self.scores(query)
        sure, open_rows = np.zeros_like(self.valid), self.valid.copy()
        low, high = skip
        if low < high:
            at = np.arange(len(self.valid) * 64)
            open_rows &= np.packbits((at < low) | (at >= high), bitorder="little").view(np.uint64)
        need = min(k, self.rows - (high - low))
        for plane in reversed(slices):
            ahead = open_rows & plane
            n = int(np.bitwise_count(ahead).sum())
            if n >= need:
                open_rows = ahead
            else:
                sure |= ahead
                need -= n
                open_rows &= ~plane
        found = np.flatnonzero(np.unpackbits((sure | open_rows).view(np.uint8), bitorder="little"))
        kind = np.int64 if len(slices) <= 62 and abs(offset) < SAFE else object
        value = np.zeros(len(found), kind)
        for b, plane in enumerate(slices):
            value += ((plane[found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64).astype(kind) << b
        return found, value + offset


def _signed_powers(number: int) -> list[tuple[int, int]]:
    """``(exponent, sign)`` of the powers of two that add up to the number, as few as possible."""
    out, at = [], 0
    while number:
        if number & 1:
            sign = 2 - (number & 3)
            out.append((at, sign))
            number -= sign
        number >>= 1
        at += 1
    return out


def _added(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One slice per weight: adders take two or three bitmaps of a weight to a sum and a carry."""
    blank = next((np.zeros_like(p) for pile in columns for p in pile), None)
    out = []
    for pile in columns:
        carries = []
        while len(pile) > 1:
            a, b = pile.pop(), pile.pop()
            either = a ^ b
            carry = a & b
            if pile:
                c = pile.pop()
                carry |= either & c
                either ^= c
            pile.append(either)
            carries.append(carry)
        out.append(pile[0] if pile else blank)
        if carries:
            # The list grows while it is walked; the last carry has a column of its own.
            if len(out) == len(columns):
                columns.append([])
            columns[len(out)].extend(carries)
    return out


def _sliced(group: pd.DataFrame) -> pd.DataFrame:
    """The index of one block; rows stand by id, so that ties at the boundary are resolved by place."""
    group = group.sort_values("vec_id")
    copies = group["copies"].to_numpy()
    values = np.repeat(_matrix(group["values"].tolist()), copies, axis=0)
    row = (group["block"].iloc[0], np.repeat(group["vec_id"].to_numpy(), copies).tobytes(), *Slices(values).packed())
    return pd.DataFrame([row], columns=["block", "ids", "rows", "low", "depths", "bits"])


def _best_in_block(k: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        for ids, *packed in index[["ids", "rows", "low", "depths", "bits"]].itertuples(index=False):
            ids = np.frombuffer(ids, np.int64)
            slices = Slices.unpacked(*packed)
            for query, mark, check, vector in queries[["query_id", "mark", "check", "vector"]].itertuples(index=False):
                own = np.searchsorted(ids, query), np.searchsorted(ids, query, side="right")
                rows, scores = slices.top(np.asarray(vector), k, own)
                if scores.dtype == object:
                    if any(not -(2**63) <= s < 2**63 for s in scores):
                        raise OverflowError(f"a score of query {query} does not fit into 64 bits")
                    scores = scores.astype(np.int64)
                # The complement orders like the negative, which 64 bits may not hold.
                order = np.lexsort((rows, ~scores))[:k]
                found += [(query, mark, check, ids[r], s) for r, s in zip(rows[order], scores[order])]
        return pd.DataFrame(found, columns=["query_id", "mark", "check", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, every: int = 50, k: int = 5, vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: best ``k`` rows for every row whose id is divisible by ``every``.

    Vectors that are null, or hold a null or non-finite component, take no part, nor do rows without id.
    Scores are exact; a component that leaves 64 bits when quantised is an error, and so is a score that does
    among a query's best of a block.  Vectors of different lengths are compared as if the shorter one ended in zeros.  Rows that repeat an id are separate candidates, but not for a query of that
    id; query rows that agree in id and vector are one query.  Ties go to the smaller id.  An empty table
    gives no rows.  Only ``vec_id`` and the vector are read.
    """
    # Rows that agree in id and vector tie with each other everywhere, so more than k of them are never returned.
    alike = quantised(rows, vector).groupBy("vec_id", "values").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    numbers = written(alike, "quantised")
    blocks = max(1, -(-numbers.count() // BLOCK_ROWS))
    queries = numbers.where(F.col("vec_id") % every == 0)
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    dealt = numbers.withColumn("block", F.pmod(F.xxhash64("vec_id", "values"), F.lit(blocks)))
    index = written(
        spread(dealt, "block")
        .groupBy("block")
        .applyInPandas(_sliced, "block bigint, ids binary, rows bigint, low binary, depths binary, bits binary"),
        "slices",
    )
    # A block's row goes to every group of queries, and each group to every block.
    met = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = queries.select(
        F.col("vec_id").alias("query_id"),
        # Two hashes tell the vectors of one id apart.
        F.xxhash64("values").alias("mark"),
        F.xxhash64(F.lit(1), "values").alias("check"),
        F.col("values").alias("vector"),
        F.pmod(F.xxhash64("vec_id", "values", F.lit(1)), F.lit(groups)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
    )
    found = (
        spread(met, "block", "part")
        .groupBy("block", "part")
        .cogroup(spread(asked, "block", "part").groupBy("block", "part"))
        .applyInPandas(_best_in_block(k), "query_id bigint, mark bigint, check bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id", "mark", "check").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = """
WITH numbers AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM numbers
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM parts q JOIN parts c ON q.d = c.d AND q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
  GROUP BY q.vec_id, c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""
