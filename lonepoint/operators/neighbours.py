"""Bounded neighbour lists: most recent, per band, skyband.

The pair forms return the neighbours themselves, the histogram forms trim the
per-slide counts of earlier neighbours.  Trimming keeps ``min(count, k)`` for
every radius and window, so the answers to all queries up to k are unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import distance_band
from .line import Recent, with_nearest


def predecessors(pairs: DataFrame) -> DataFrame:
    """Pairs whose neighbour arrived in an earlier slide."""
    return pairs.where(F.col("nsl") < F.col("sl"))


def others(pairs: DataFrame) -> DataFrame:
    """Pairs without the probe's pair with itself."""
    return pairs.where(F.col("nid") != F.col("id"))


def most_recent(pairs: DataFrame, k: int) -> DataFrame:
    """The k most recent neighbours of each point, numbered from 1."""
    order = Window.partitionBy("id").orderBy(F.desc("nsl"), F.desc("nid"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def most_recent_per_band(pairs: DataFrame, radii: Sequence[float], k: int) -> DataFrame:
    """The k most recent neighbours of each point and distance band."""
    order = Window.partitionBy("id", "band").orderBy(F.desc("nsl"), F.desc("nid"))
    return (
        pairs.withColumn("band", distance_band(F.col("d"), radii))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def banded(radii: Sequence[float], k: int) -> Recent:
    """What ``most_recent_per_band`` and ``layered_skyband`` need of a point's earlier neighbours."""
    bounds = np.array(sorted(set(float(r) for r in radii)))
    return Recent(k, len(bounds) + 1, lambda nid, d: np.searchsorted(bounds, d))


def parted(parts: int, k: int) -> Recent:
    """What ``merge_recent`` needs of them if lists are held by id modulo ``parts``."""
    return Recent(k, parts, lambda nid, d: nid % parts)


def layered_skyband(pairs: DataFrame, radii: Sequence[float], k: int) -> DataFrame:
    """Neighbours with fewer than k newer ones in their own or a nearer band.

    Only the k most recent of each band are looked at: an older one has k newer
    ones in its own band, and where it would count, they count as well.  Then
    one running count per band over a single sort; no neighbour is compared
    with another.
    """
    newer = (
        Window.partitionBy("id").orderBy(F.desc("nsl"), F.desc("nid")).rowsBetween(Window.unboundedPreceding, -1)
    )
    banded = most_recent_per_band(pairs, radii, k).drop("rank")
    counts = [F.count_if(F.col("band") <= b).over(newer) for b in range(len(set(radii)))]
    return (
        banded.withColumn("_newer", F.array(*counts))
        .withColumn("newer", F.get("_newer", F.col("band")))
        .where(F.col("newer") < k)
        .drop("_newer")
    )


def k_skyband(pairs: DataFrame, limit: int, span: int) -> DataFrame:
    """Earlier neighbours with at most ``limit`` others no farther and strictly later.

    One walk per point over its slides, newest first, carries the ``limit + 1`` smallest distances so far; a neighbour's
    dominators are those that are no larger.  Pairs are sent once, to their point.
    """
    early = pairs.where((F.col("sl") - F.col("nsl")).between(1, span - 1) & F.col("id").isNotNull())
    schema = T.StructType([*early.schema.fields, T.StructField("dominators", T.LongType())])
    walks = early.repartition("id").sortWithinPartitions("id", F.desc("nsl"))
    return walks.mapInArrow(lambda batches: _undominated(batches, limit), schema)


def _undominated(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The walks of sorted batches; what may go on in the next batch is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(ids, ids[-1]))
        if cut:
            yield from _walks([*held, batch.slice(0, cut)], limit)
            held = []
        elif held and held[-1].column("id")[-1].as_py() != ids[0]:
            yield from _walks(held, limit)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _walks(held, limit)


def _walks(batches: list[pa.RecordBatch], limit: int) -> list[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    ids, nsl, d = (table.column(c).to_numpy() for c in ("id", "nsl", "d"))
    other = np.append(True, ids[1:] != ids[:-1])
    slide = np.cumsum(other | np.append(True, nsl[1:] != nsl[:-1]))
    probe, starts = np.cumsum(other) - 1, np.flatnonzero(other)
    step = slide - slide[starts][probe]
    order = np.argsort(step, kind="stable")
    dominators = np.zeros(len(ids), np.int64)
    nearest = np.full((len(starts), limit + 1), np.inf)
    for at in np.split(order, np.flatnonzero(np.diff(step[order])) + 1):
        dominators[at] = (nearest[probe[at]] <= d[at, None]).sum(axis=1)
        with_nearest(nearest, probe[at], d[at])
    kept = np.flatnonzero(dominators <= limit)
    return table.take(kept).append_column("dominators", pa.array(dominators[kept])).to_batches()


def trim_histogram(histogram: DataFrame, n_radii: int, k: int, rule: str) -> DataFrame:
    """Drop what k newer neighbours make irrelevant from a slide histogram.

    Rules: ``band`` keeps the k most recent per distance band, ``layer`` the k
    most recent within each radius, ``skyband`` whole entries as long as fewer
    than k are no farther and strictly later.  Same-slide and later neighbours
    are kept as they are.
    """
    names = [f"c{i}" for i in range(n_radii)]
    early = F.col("nsl") < F.col("sl")
    newer = (
        Window.partitionBy("id", "sl").orderBy(F.desc("nsl")).rowsBetween(Window.unboundedPreceding, -1)
    )
    exact = [F.col("c0")] + [F.col(f"c{i}") - F.col(f"c{i - 1}") for i in range(1, n_radii)]

    def ahead(amount):
        return F.coalesce(F.sum(F.when(early, amount).otherwise(0)).over(newer), F.lit(0))

    if rule == "layer":
        kept = [F.least(F.col(c), F.greatest(F.lit(k) - ahead(F.col(c)), F.lit(0))) for c in names]
    elif rule == "band":
        bands = [F.least(b, F.greatest(F.lit(k) - ahead(b), F.lit(0))) for b in exact]
        kept = _cumulative(bands)
    elif rule == "skyband":
        bands = [F.when(ahead(F.col(c)) < k, b).otherwise(0) for c, b in zip(names, exact)]
        kept = _cumulative(bands)
    else:
        raise ValueError(f"unknown trimming rule {rule!r}")
    return histogram.select(
        "id", "sl", "nsl", *[F.when(early, x).otherwise(F.col(c)).alias(c) for c, x in zip(names, kept)]
    )


def _cumulative(bands: list) -> list:
    total, out = None, []
    for b in bands:
        total = b if total is None else total + b
        out.append(total)
    return out


def merge_recent(partial: DataFrame, k: int) -> DataFrame:
    """Lists per point and partition ``(id, part, nid, nsl)`` merged to one of length k.

    Each partial list is cut to k first; a neighbour in several lists counts once.  Rows are sent once, to their point.
    """
    order = Window.partitionBy("id", "part").orderBy(F.desc("nsl"), F.desc("nid"))
    lists = partial.select("id", "part", "nid", "nsl").repartition("id").withColumn("rank", F.row_number().over(order))
    # Copies of a neighbour share their place.
    order = Window.partitionBy("id").orderBy(F.desc("nsl"), F.desc("nid"))
    merged = lists.where(F.col("rank") <= k).withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return merged.select("id", "nid", "nsl", "rank").distinct()


def before_after_counts(histogram: DataFrame, count: str = "c0") -> DataFrame:
    """Per point: neighbours of earlier slides, and of the same or later ones."""
    early = F.col("nsl") < F.col("sl")
    return histogram.groupBy("id", "sl").agg(
        F.sum(F.when(early, F.col(count)).otherwise(0)).alias("n_before"),
        F.sum(F.when(early, 0).otherwise(F.col(count))).alias("n_after"),
    )


def earliest_expiring(histogram: DataFrame, span: int, count: str = "c0") -> DataFrame:
    """Per point and window: the oldest slide with an earlier neighbour still inside."""
    inside = (F.col(count) > 0) & (F.col("nsl") - F.col("sl")).between(1 - span, -1)
    # An earlier slide is the oldest one from the expiry of the one before it to its own.
    by_age = Window.partitionBy("id").orderBy("nsl")
    held = histogram.where(inside).select("id", "sl", "nsl", (F.lag("nsl").over(by_age) + span).alias("since"))
    start = F.greatest("sl", F.coalesce("since", "sl"))
    named = held.select(
        F.explode(F.sequence(start, F.col("nsl") + (span - 1))).alias("e"), "id", F.col("nsl").alias("first_nsl")
    )
    newest = histogram.groupBy("id", "sl").agg(F.max(F.when(inside, F.col("nsl"))).alias("newest"))
    start = F.coalesce(F.col("newest") + span, F.col("sl"))
    without = newest.select(
        F.explode(F.sequence(start, F.col("sl") + (span - 1))).alias("e"), "id", F.lit(None).cast("bigint").alias("first_nsl")
    )
    return named.unionByName(without)
