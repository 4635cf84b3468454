"""Hard negatives by exact inner products, multiplied in tiles by Strassen's recursion.

Components are quantised to ``floor(256 * x)``.  Anchors and candidates are dealt into parts of bounded bytes, and
every anchor part meets every candidate part in one tile: the stated anchors against all rows, in blocks.  A
tile's scores are a product of int64 matrices, padded with zeros to even sides and halved until the pieces are
small; the seven products and eighteen sums of each step are exact.

Two passes go over the tiles.  The first fills a heap per anchor with its best rows of the same label, its
positives.  These set score windows, and the second pass fills a heap per anchor and positive with the best rows
of other labels inside the window.  A heap has a fixed number of places, so a tile returns a few rows per anchor
whatever its size, and heaps of different tiles merge in any order.

Work is the number of anchors times the number of rows; rows moved are the rows times the anchor parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonepoint.session import spread, written

SCALE = 256
#: Bytes of vectors in one part, and of the matrices multiplied at once.
PART_BYTES = 1 << 24
CHUNK_BYTES = 1 << 21
#: Rows of one product: anchors and candidates.
CHUNK_ROWS = (512, 4096)
#: A side of this length or less is not halved any more.
LEAF = 32

#: No score, and scores beyond 64 bits.
NONE, TOO_LOW, TOO_HIGH = -(1 << 63), 1 - (1 << 63), (1 << 63) - 1
_LAST = (1 << 63) - 1


def quantised(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """``vec_id, label, values`` of the rows that take part; an error where a number leaves 64 bits."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    error = F.raise_error(F.lit("a quantised component does not fit into 64 bits")).cast("bigint")

    def whole(x: Column) -> Column:
        return F.when(F.abs(x) < F.lit(2.0**63), F.floor(x)).otherwise(error)

    return rows.where(
        F.col("vec_id").isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & fits
    ).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col(label).cast("string").alias("label"),
        F.transform(vector, lambda x: whole(x.cast("double") * SCALE)).alias("values"),
    )


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of int64 matrices modulo 2**64, so exact wherever it fits into 64 bits.

    Odd sides are padded with zeros.  The smallest products go through floating point where it is exact.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        if a.size == 0 or b.size == 0:
            return np.zeros((m, n), np.int64)
        # Python's whole numbers: the absolute value of -2**63 does not fit into 64 bits.
        largest = [max(-int(x.min()), int(x.max())) for x in (a, b)]
        if k * largest[0] * largest[1] < 1 << 53:
            return (a.astype(float) @ b.astype(float)).astype(np.int64)
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``; ``TOO_LOW`` or ``TOO_HIGH`` beyond 64 bits."""
    found = strassen(a, np.ascontiguousarray(b.T))
    lengths = [np.sqrt((x.astype(float) ** 2).sum(1)) for x in (a, b)]
    if lengths[0].max(initial=0) * lengths[1].max(initial=0) < 2.0**62:
        return found
    slack = a.shape[1] * 2.0**-50 * lengths[0][:, None] * lengths[1]
    rough = np.abs(a.astype(float) @ b.astype(float).T) + slack
    for i, j in np.argwhere(rough >= 2.0**62):
        exact = sum(x * y for x, y in zip(a[i].tolist(), b[j].tolist()))
        found[i, j] = min(max(exact, TOO_LOW), TOO_HIGH)
    return found


class Vectors:
    """Lists of whole numbers from an Arrow column, taken out as matrices; short ones end in zeros."""

    def __init__(self, column: pa.ChunkedArray, order: np.ndarray | None = None):
        lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        at = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat = lists.values.to_numpy(zero_copy_only=False)
        order = np.arange(len(lists)) if order is None else order
        self.start, self.size = at[:-1][order], np.diff(at)[order]

    def chunks(self, rows: int) -> list[tuple[int, int]]:
        """Spans of rows whose matrices have a bounded number of rows and bytes, one row at least."""
        spans, begin, width = [], 0, 0
        for i, size in enumerate(self.size.tolist()):
            width = max(width, size)
            if i > begin and (i - begin >= rows or (i - begin + 1) * width * 8 > CHUNK_BYTES):
                spans.append((begin, i))
                begin, width = i, size
        return spans + [(begin, len(self.size))] * (begin < len(self.size))

    def matrix(self, begin: int, end: int) -> np.ndarray:
        size = self.size[begin:end]
        out = np.zeros((end - begin, size.max(initial=0)), np.int64)
        inside = np.arange(out.shape[1]) < size[:, None]
        place = self.start[begin:end, None] + np.arange(out.shape[1])
        out[inside] = self.flat[place[inside]]
        return out


class Heaps:
    """The best ``k`` scores of each slot, ties to the smaller id."""

    def __init__(self, slots: int, k: int):
        self.score = np.full((slots, k), NONE, np.int64)
        self.ident = np.full((slots, k), _LAST, np.int64)

    def floor(self) -> np.ndarray:
        """What a score has to reach to enter a slot."""
        return np.maximum(self.score[:, -1], NONE + 1)

    def push(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        touched, local = np.unique(slot, return_inverse=True)
        k = self.score.shape[1]
        group = np.concatenate([np.repeat(np.arange(len(touched)), k), local])
        score = np.concatenate([self.score[touched].ravel(), score])
        ident = np.concatenate([self.ident[touched].ravel(), ident])
        # The complement orders like the negative, which 64 bits may not hold.
        order = np.lexsort((ident, ~score, group))
        place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
        best = order[place < k]
        self.score[touched] = score[best].reshape(-1, k)
        self.ident[touched] = ident[best].reshape(-1, k)

    def offer(self, slot: np.ndarray, found: np.ndarray, ident: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Push those of the scores ``found[i, j]`` between ``low[i]`` and ``high[i]`` to ``slot[i]`` that can enter."""
        low = np.maximum(low, self.floor()[slot])
        inside = (found >= low[:, None]) & (found <= high[:, None])
        k = self.score.shape[1]
        if inside.sum() > 8 * k * len(slot) and found.shape[1] > k:
            kept = np.where(inside, found, NONE)
            inside &= found >= np.partition(kept, -k, axis=1)[:, -k][:, None]
        row, column = np.nonzero(inside)
        if len(row):
            self.push(slot[row], found[row, column], ident[column])

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score != NONE)
        score = self.score[slot, place]
        if ((score == TOO_LOW) | (score == TOO_HIGH)).any():
            raise OverflowError("a score among the best does not fit into 64 bits")
        return slot, score, self.ident[slot, place]


def _label_codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    codes = pa.chunked_array([c for col in columns for c in col.chunks], pa.string()).combine_chunks().dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    return np.split(codes, [len(columns[0])])


def _products(anchors: pa.Table, rows: pa.Table):
    """Chunks of a tile: anchor span, candidate ids and labels, scores; candidates go by label."""
    anchor_label, row_label = _label_codes(anchors["label"], rows["label"])
    ids = rows["vec_id"].to_numpy()
    order = np.lexsort((ids, row_label))
    ids, row_label = ids[order], row_label[order]
    left, right = Vectors(anchors["values"]), Vectors(rows["values"], order)
    for c, d in right.chunks(CHUNK_ROWS[1]):
        block = right.matrix(c, d)
        for a, b in left.chunks(CHUNK_ROWS[0]):
            part = left.matrix(a, b)
            width = min(part.shape[1], block.shape[1])
            same = anchor_label[a:b, None] == row_label[c:d]
            yield a, b, ids[c:d], same, scores(part[:, :width], block[:, :width])


def _positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["anchor", "anchor_id", "positive_id", "positive_score"]
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        heaps, own = Heaps(anchors.num_rows, k), anchors["anchor_id"].to_numpy()
        for a, b, ids, same, found in _products(anchors, rows):
            found[~same | (own[a:b, None] == ids)] = NONE
            any_score = np.full(b - a, NONE + 1), np.full(b - a, _LAST)
            heaps.offer(np.arange(a, b), found, ids, *any_score)
        slot, score, ident = heaps.entries()
        return pa.table([anchors["anchor"].to_numpy()[slot], own[slot], ident, score], names)

    return run


def windows(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest whole number between ``low`` and ``high`` hundredths of each positive score."""
    # In two parts, since 64 bits may not hold a hundred times a score.
    whole, rest = positive // 100, positive % 100
    return whole * low - (-(rest * low) // 100), whole * high + rest * high // 100


def _negatives(k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        lists = pa.concat_arrays(anchors["positives"].chunks)
        count = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        place, ident, positive = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("place", "positive_id", "positive_score"))
        owner = np.repeat(np.arange(len(count)), count)
        least, most = windows(positive, low, high)
        heaps = Heaps(len(owner), k)
        for a, b, ids, same, found in _products(anchors, rows):
            found[same] = NONE
            for p in np.unique(place):
                # One window of each anchor at a time: as many comparisons as scores.
                slot = np.flatnonzero((owner >= a) & (owner < b) & (place == p))
                heaps.offer(slot, found[owner[slot] - a], ids, least[slot], most[slot])
        slot, score, negative = heaps.entries()
        anchor, own = anchors["anchor"].to_numpy(), anchors["anchor_id"].to_numpy()
        of = owner[slot]
        return pa.table([anchor[of], own[of], place[slot], ident[slot], positive[slot], negative, score], names)

    return run


def _tiles(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int):
    """Each part of the anchors beside each block of the rows."""
    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    right = rows.select(
        "vec_id", "label", "values", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part")
    )
    grouped = [spread(x, "block", "part").groupBy("block", "part") for x in (left, right)]
    return grouped[0].cogroup(grouped[1])


def _parts(rows: DataFrame) -> int:
    size = rows.agg(F.sum(8 * F.size("values") + 64)).first()[0]
    return max(1, -(-(size or 0) // PART_BYTES))


def hard_negatives(
    rows: DataFrame,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``.  An anchor's positives are its best ``positives``
    rows of the same label under other ids; for each of them, the negatives are the best ``negatives`` rows of
    other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``.  ``rank`` counts
    them from 1.  Higher scores come first, ties go to the smaller id.

    Rows without id, label or vector, or with a null or non-finite component, take no part.  Vectors of
    different lengths are compared as if the shorter one ended in zeros; an empty vector scores 0.  Rows that
    repeat an id are separate candidates; anchors that agree in id, label and vector are one anchor.  A
    component that leaves 64 bits when quantised is an error, and so is such a score among an anchor's best of a
    tile.  Negative positive scores have an empty window.  An empty table, or one without anchors, gives no rows.
    Only ``vec_id``, the vector and the label are read.
    """
    numbers = quantised(rows, vector, label).withColumn("row", F.monotonically_increasing_id())
    numbers = written(numbers, "hard-negatives-rows")
    anchors = numbers.where(F.col("vec_id") % every == 0).select("vec_id", "label", "values").distinct()
    anchors = written(
        anchors.select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "values"),
        "hard-negatives-anchors",
    )
    blocks, parts = _parts(numbers), _parts(anchors)
    found = _tiles(anchors, numbers, blocks, parts).applyInArrow(
        _positives(positives), "anchor bigint, anchor_id bigint, positive_id bigint, positive_score bigint"
    )
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    entry = F.struct(F.col("place").cast("bigint").alias("place"), "positive_id", "positive_score")
    asked = best.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(entry)).alias("positives"))
    asked = written(anchors.join(asked, "anchor"), "hard-negatives-windows")
    found = _tiles(asked, numbers, blocks, parts).applyInArrow(
        _negatives(negatives, low, high),
        "anchor bigint, anchor_id bigint, place bigint, positive_id bigint, positive_score bigint, "
        "negative_id bigint, negative_score bigint",
    )
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def shifted_labels(rows: DataFrame) -> DataFrame:
    """Rows whose id is divisible by 7 get the next of ten labels."""
    return rows.withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    )


ORACLE = """
WITH numbers AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS d FROM numbers
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, sum(a.x * c.x)::BIGINT AS score
  FROM parts a JOIN parts c ON a.d = c.d AND a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
  GROUP BY a.vec_id, c.vec_id, a.label, c.label
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
