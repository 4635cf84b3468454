"""Near duplicates by circulant MinHash, with links confirmed on full shingle sets.

1. One pass over the texts hashes every five-word shingle and computes all signature coordinates from
   two permutations of a 32-bit circle: the first places the shingles, the second, shifted by ``k``
   places, ranks them for coordinate ``k``.
2. Copies of a set collapse to one node by a digest, before anything is banded.
3. In each bucket the smallest node is compared with the others, a number of pairs linear in the bucket,
   and confirmed links give first components.
4. Buckets that still hold several components are searched whole.  In small ones the pairs across
   components go to the comparison if their 128 sketch bits allow the similarity.  Large ones make up
   crowds, which are compared block against block inside the tasks: only links leave a task, at most as
   many as it has nodes.

All comparisons end in an exact count on the full sets.  With 48 bands of 5, two sets of similarity 0.75
meet in no band with a chance of 2e-6, and the sketch hides them with one of 1e-7.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonepoint.llm.components import components
from lonepoint.llm.words import Words, map_texts, mix, powers, span_hashes, window_hashes
from lonepoint.session import written

SHINGLE = 5
PERCENT = 75
BANDS = 48
ROWS = 5
SKETCH_BITS = 128
#: Buckets up to this size make pairs, at most half as many for each node; larger ones make crowds.
SMALL_BUCKET = 32
#: Nodes of one block of a crowd, and shingles counted at once.
BLOCK = 512
COLUMNS = 4096

_CHUNK = 256


def _circle(shingles: np.ndarray) -> np.ndarray:
    """First permutation: a shingle's place on the circle of 2**32 places."""
    return (mix(shingles) >> np.uint64(32)).astype(np.uint32)


def _rank(places: np.ndarray) -> np.ndarray:
    """Second permutation, of the places; changes its argument."""
    places ^= places >> np.uint32(16)
    places *= np.uint32(0x7FEB352D)
    places ^= places >> np.uint32(15)
    places *= np.uint32(0x846CA68B)
    places ^= places >> np.uint32(16)
    return places


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates: coordinate ``k`` is the least rank after a shift by ``k`` places."""
    places = _circle(shingles)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, 2**32 - 1, np.uint32)
    for at in range(0, len(places), _CHUNK):
        np.minimum(least, _rank(places[None, at : at + _CHUNK] + shifts).min(1), out=least)
    return least


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    at = words.windows(width)
    shingles = window_hashes(hashes, width)[at]
    cut = np.searchsorted(words.doc[at], np.arange(len(column) + 1))
    found = []
    for d, n in enumerate(words.count.tolist()):
        if 0 < n < width:
            low = words.first[d : d + 1]
            found.append(span_hashes(hashes, low, low + n))
        else:
            found.append(np.unique(shingles[cut[d] : cut[d + 1]]))
    return found


def shingle_sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``shingles``: the set of every text as sorted hashes; no words, an empty set."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        sets = [x.view(np.int64) for x in _sets(piece.column(1), width)]
        at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))
        return pa.RecordBatch.from_arrays([piece.column(0), values], ["doc_id", "shingles"])

    return map_texts(docs.select("doc_id", "text"), "text", run, "doc_id bigint, shingles array<bigint>")


def fingerprints(docs: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set (null if empty), a key for each band, sketch bits."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, keys, sketches = [], [], [], []
        weights = powers(0x9E3779B97F4A7C15, rows + 1)[1 : rows + 1]
        for found in _sets(piece.column(1), width):
            counts.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            if len(found):
                least = signature(found, max(bands * rows, SKETCH_BITS))
                bits = np.packbits((least[:SKETCH_BITS] >> np.uint32(7) & np.uint32(1)).astype(np.uint8))
                sketches.append(bits.view(np.int64))
                least = least[: bands * rows].reshape(bands, rows).astype(np.uint64)
                number = np.arange(bands, dtype=np.uint64) << np.uint64(32)
                keys.append(mix((least * weights).sum(1) + number).view(np.int64))
            else:
                sketches.append(np.zeros(2, np.int64))
                keys.append(np.zeros(0, np.int64))
        at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                piece.column(0),
                pa.array(counts, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys))),
                *[pa.array(x) for x in np.array(sketches).T],
            ],
            ["doc_id", "n_shingles", "digest", "bands", "s1", "s2"],
        )

    return map_texts(
        docs.select("doc_id", "text"),
        "text",
        run,
        "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, s1 bigint, s2 bigint",
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return both.withColumn("common", common).where(F.lit(100) * F.col("common") >= F.lit(percent) * union).select("a", "b")


def _similar_sizes(percent: int):
    return F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")


def sketch_limit(percent: int) -> int:
    """Different sketch bits that a pair of the wanted similarity stays within: mean and 5.5 deviations."""
    share = (100 - percent) / 200
    return math.floor(SKETCH_BITS * share + 5.5 * math.sqrt(SKETCH_BITS * share * (1 - share)))


def _links_in_block(percent: int):
    """Exact links between nodes of different components among the rows of one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        nodes, parts, sides = (group[c].to_numpy() for c in ("node", "component", "side"))
        found: list[tuple[int, int]] = []
        if len(set(parts)) > 1:
            sizes = group["shingles"].map(len).to_numpy()
            row = np.repeat(np.arange(len(nodes)), sizes)
            values, column, holders = np.unique(
                np.concatenate(group["shingles"].tolist()), return_inverse=True, return_counts=True
            )
            place = np.cumsum(holders > 1) - 1
            shared = holders[column] > 1
            row, column = row[shared], place[column[shared]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            common = np.zeros((len(nodes), len(nodes)), np.float32)
            for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
                part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
                held = np.zeros((len(nodes), COLUMNS), np.float32)
                held[row[part], column[part] - low] = 1
                common += held @ held.T
            near = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
            near &= parts[:, None] != parts[None, :]
            if len(set(sides)) > 1:
                near &= sides[:, None] != sides[None, :]
            # One link for each pair of components is enough.
            told = set()
            for i, j in zip(*np.nonzero(np.triu(near, 1))):
                pair = min(parts[i], parts[j]), max(parts[i], parts[j])
                if pair not in told:
                    told.add(pair)
                    found.append((nodes[i], nodes[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _crowd_links(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components inside each crowd, by blocks of at most about ``BLOCK`` nodes.

    Nodes of one large component share blocks, so that blocks without anything to find end at once.
    """
    by_part = crowds.groupBy("crowd", "component").agg(F.count("*").alias("size"))
    by_part = by_part.withColumn("own", F.col("size") >= BLOCK)
    pool = F.when(F.col("own"), F.col("component")).otherwise(F.lit(-1)).alias("pool")
    pools = by_part.select("crowd", "size", pool).groupBy("crowd", "pool").agg(F.sum("size").alias("size"))
    pools = pools.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    w = Window.partitionBy("crowd").orderBy("pool").rowsBetween(Window.unboundedPreceding, -1)
    pools = pools.withColumn("first", F.coalesce(F.sum("blocks").over(w), F.lit(0)))
    total = Window.partitionBy("crowd")
    pools = pools.withColumn("all", F.sum("blocks").over(total)).drop("size")
    placed = (
        crowds.join(by_part.select("crowd", "component", pool), ["crowd", "component"])
        .join(pools, ["crowd", "pool"])
        .withColumn("side", F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.expr("sequence(0, all - 1)")))
        .select("crowd", "node", "component", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    )
    blocks = placed.join(sets.select("node", "shingles"), "node")
    return blocks.groupBy("crowd", "low", "high").applyInPandas(_links_in_block(percent), "a bigint, b bigint")


def _rest(shared: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components in buckets that hold several."""
    named = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "named")
    several = (
        named.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
        .where("low <> high")
        .select("bucket", "size")
    )
    mixed = written(named.join(several, "bucket"), "mixed")
    large = mixed.where(F.col("size") > SMALL_BUCKET)
    crowds = components(large.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    crowds = written(
        crowds.withColumnRenamed("component", "crowd").join(mixed.select("node", "component").distinct(), "node"), "crowds"
    )
    rows = mixed.join(crowds.select("node", "crowd"), "node", "left")
    side = lambda x: rows.where(F.col("size") <= SMALL_BUCKET).select(
        "bucket",
        F.col("node").alias(x),
        *[F.col(c).alias(f"{n}{x}") for c, n in (("n", "n"), ("component", "c"), ("crowd", "g"), ("s1", "s"), ("s2", "t"))],
    )
    apart = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) + F.bit_count(F.col("ta").bitwiseXOR(F.col("tb")))
    pairs = (
        side("a")
        .join(side("b"), "bucket")
        .where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _similar_sizes(percent))
        .where((apart <= sketch_limit(percent)) & ~F.coalesce(F.col("ga") == F.col("gb"), F.lit(False)))
        .select("a", "b")
        .distinct()
    )
    return _confirmed(pairs, sets, percent).union(_crowd_links(crowds, sets, percent))


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Group documents whose shingle sets are similar: one row for every row of ``docs``.

    Returns ``doc_id, n_shingles, component_id, kept``.  A null text or one without words has an empty
    set and no links.  Rows that share a ``doc_id`` are one document for linking and each keep their row;
    a null ``doc_id`` links with nothing and is kept, as its own document.  An empty table gives no rows.
    Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
    """
    prints = written(fingerprints(docs, width, bands, rows), "fingerprints")
    whole = prints.where("digest is not null and doc_id is not null")
    first = [F.first(c).alias(a) for c, a in (("n_shingles", "n"), ("bands", "bands"), ("s1", "s1"), ("s2", "s2"))]
    nodes = written(whole.groupBy("digest").agg(F.min("doc_id").alias("node"), *first), "nodes")
    members = nodes.select("node", "n", "s1", "s2", F.explode("bands").alias("bucket"))
    hubs = (
        members.groupBy("bucket")
        .agg(F.min("node").alias("hub"), F.min_by("n", "node").alias("hub_n"), F.count("*").alias("met"))
        .where("met > 1")
        .drop("met")
    )
    shared = written(members.join(hubs, "bucket"), "shared")
    asked = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = written(
        shingle_sets(docs.select("doc_id", "text").join(asked, "doc_id", "left_semi"), width)
        .groupBy(F.col("doc_id").alias("node"), F.xxhash64("shingles").alias("set"))
        .agg(F.first("shingles").alias("shingles")),
        "sets",
    )
    met = shared.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hub").alias("b"), F.col("hub_n").alias("nb"))
    star = met.where("a <> b").where(_similar_sizes(percent)).select("a", "b").distinct()
    links = written(_confirmed(star, sets, percent), "links")
    labels = written(components(links), "labels")
    more = _rest(shared, labels, sets, percent)
    # Different texts under one doc_id tie their nodes together.
    several = whole.groupBy("doc_id").agg(F.count_distinct("digest").alias("texts")).where("texts > 1")
    same = (
        whole.join(several, "doc_id", "left_semi")
        .join(nodes.select("digest", "node"), "digest")
        .select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    )
    labels = written(components(links.union(more).union(same)), "labels")
    home = nodes.select("digest", F.col("node").alias("home"))
    own = F.coalesce("home", "doc_id")
    return (
        prints.join(home, "digest", "left")
        .withColumn("node", own)
        .join(labels, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("digest").isNull() | F.col("doc_id").isNull(), F.col("doc_id"))
            .otherwise(F.coalesce("component", "node"))
            .alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that near-duplicate removal keeps, with all their columns.

    Of each group the document with the smallest id stays.  Rows without id are documents of their own and all
    stay, also those without text.  Rows that repeat an id and its text are one document.  Other texts under a
    repeated id are documents of their own, which go only as near copies.  An empty table stays empty.
    """
    # The row travels as one column, so that none of its own can clash.
    named = docs.where("doc_id is not null").select(
        "doc_id", "text", F.xxhash64("text").alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    ends = named.groupBy("doc_id").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    if ends.where("low <> high").isEmpty():
        kept = near_duplicates(named).where("kept").select("doc_id")
        left = named.select("doc_id", "row").dropDuplicates(["doc_id"]).join(kept, "doc_id", "left_semi")
    else:
        # Written, so that the numbers stay what they are.
        rows = named.dropDuplicates(["doc_id", "mark"]).withColumn("number", F.monotonically_increasing_id())
        rows = written(rows, "near-dedup-rows")
        groups = near_duplicates(rows.select(F.col("number").alias("doc_id"), "text"))
        groups = groups.select(F.col("doc_id").alias("number"), "component_id")
        first = F.min(F.struct("doc_id", "mark", "number")).alias("first")
        kept = rows.select("doc_id", "mark", "number").join(groups, "number").groupBy("component_id").agg(first)
        left = rows.join(kept.select("first.number"), "number", "left_semi")
    return left.select("row.*").union(docs.where("doc_id is null"))


ORACLE = """
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(list_transform(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END),
                                              lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS shingles
  FROM texts
), parts AS (
  SELECT doc_id, len(shingles) AS n, unnest(list_transform(shingles, lambda s: hash(s))) AS shingle FROM sets
), common AS (
  SELECT * FROM parts QUALIFY count(*) OVER (PARTITION BY shingle) > 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS same
  FROM common a JOIN common b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
), one_way AS (
  SELECT a, b FROM pairs WHERE 100 * same >= 75 * (na + nb - same)
), links AS (
  SELECT a, b FROM one_way UNION ALL SELECT b, a FROM one_way
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM texts
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reached r ON r.a = s.doc_id GROUP BY s.doc_id, s.shingles
"""
