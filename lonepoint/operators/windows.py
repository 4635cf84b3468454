"""From pairs to per-window neighbour counts.

Counts are taken per probe for each window it lives in; only points are
expanded to windows, never pairs.  All counts include the probe itself, so
"fewer than k others" reads ``n <= k``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.slides import is_expiring, is_new

# Above this many count columns the windows are computed as intervals instead.
MAX_COLUMNS = 128


def slide_histogram(pairs: DataFrame, radii: Sequence[float]) -> DataFrame:
    """Neighbours per probe, slide and radius: ``(id, sl, nsl, c0, c1, ..)``.

    ``c<i>`` counts the pairs within ``radii[i]``.
    """
    return pairs.groupBy("id", "sl", "nsl").agg(
        *[F.count_if(F.col("d") <= F.lit(float(r))).alias(f"c{i}") for i, r in enumerate(radii)]
    )


def window_counts(pairs: DataFrame, radii: Sequence[float], spans: Sequence[int]) -> DataFrame:
    """Per probe, window length and window: ``(wi, e, id, sl, n0, n1, ..)``."""
    if len(radii) * sum(spans) > MAX_COLUMNS:
        return interval_counts(slide_histogram(pairs, radii), len(radii), spans)
    weights = [f"if(d <= double({float(r)!r}), 1, 0)" for r in radii[:-1]] + ["1"]
    within = pairs.where(F.col("d") <= F.lit(float(radii[-1])))
    return _column_counts(within, weights, spans)


def histogram_counts(histogram: DataFrame, n_radii: int, spans: Sequence[int]) -> DataFrame:
    """The same as ``window_counts``, from a (possibly trimmed) slide histogram."""
    if n_radii * sum(spans) > MAX_COLUMNS:
        return interval_counts(histogram, n_radii, spans)
    return _column_counts(histogram, [f"c{i}" for i in range(n_radii)], spans)


def _column_counts(df: DataFrame, weights: list[str], spans: Sequence[int]) -> DataFrame:
    """One sum per window and radius; one shuffle, however many windows there are."""
    sums, rows = [], []
    for wi, m in enumerate(spans):
        for j in range(m):
            names = [f"c{wi}_{j}_{i}" for i in range(len(weights))]
            sums += [
                F.expr(f"sum(if(nsl - sl between {j - m + 1} and {j}, {w}, 0)) as {name}")
                for w, name in zip(weights, names)
            ]
            counts = ", ".join(f"'n{i}', {name}" for i, name in enumerate(names))
            rows.append(f"named_struct('wi', {wi}, 'e', sl + {j}, {counts})")
    return (
        df.groupBy("id", "sl")
        .agg(*sums)
        .selectExpr("id", "sl", f"inline(array({', '.join(rows)}))")
        .select("wi", "e", "id", "sl", *[f"n{i}" for i in range(len(weights))])
    )


def interval_counts(histogram: DataFrame, n_radii: int, spans: Sequence[int]) -> DataFrame:
    """Window counts for long windows, in time linear in the window length.

    A histogram entry counts from the window in which the later of its two
    slides arrives until the earlier one expires.  Running sums over these
    changes give the counts of whole intervals of windows.
    """
    names = [f"c{i}" for i in range(n_radii)]
    lengths = F.array(*[F.struct(F.lit(i).alias("wi"), F.lit(m).cast("bigint").alias("m")) for i, m in enumerate(spans)])
    first, last = F.greatest("sl", "nsl"), F.least("sl", "nsl") + F.col("m")
    change = lambda at, sign: F.struct(at.alias("at"), *[(F.col(c) * sign).alias(c) for c in names])
    changes = (
        histogram.withColumn("w", F.explode_outer(lengths))
        .select("id", "sl", "nsl", *names, "w.wi", "w.m")
        .where(F.abs(F.col("nsl") - F.col("sl")) < F.col("m"))
        .select("id", "sl", "wi", "m", F.explode_outer(F.array(change(first, 1), change(last, -1))).alias("x"))
        .select("id", "sl", "wi", "m", "x.*")
        .where(F.col("at") < F.col("sl") + F.col("m"))
    )
    by_time = Window.partitionBy("id", "wi").orderBy("at")
    so_far = by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = by_time.rangeBetween(1, Window.unboundedFollowing)
    return (
        changes.select(
            "id", "sl", "wi", "at",
            F.coalesce(F.min("at").over(later), F.col("sl") + F.col("m")).alias("until"),
            F.lag("at").over(by_time).alias("prev"),
            *[F.sum(c).over(so_far).alias(f"n{i}") for i, c in enumerate(names)],
        )
        .where(F.col("prev").isNull() | (F.col("prev") != F.col("at")))
        .select(
            "wi", F.explode_outer(F.sequence(F.col("at"), F.col("until") - 1)).alias("e"), "id", "sl",
            *[f"n{i}" for i in range(n_radii)],
        )
    )


def occupied_windows(pts: DataFrame, spans: Sequence[int]) -> DataFrame:
    """Windows that hold at least one point: ``(wi, e)``, not yet without repeats."""
    lengths = F.array(*[F.struct(F.lit(i).alias("wi"), F.lit(m).cast("bigint").alias("m")) for i, m in enumerate(spans)])
    return (
        pts.select("sl")
        .distinct()
        .select("sl", F.explode_outer(lengths).alias("w"))
        .select(F.col("w.wi").alias("wi"), F.explode_outer(F.sequence(F.col("sl"), F.col("sl") + F.col("w.m") - 1)).alias("e"))
    )


def window_population(pts: DataFrame, span: int) -> DataFrame:
    """Per window: points, newly arrived points, points about to expire."""
    sl, e = F.col("sl"), F.col("e")
    return (
        pts.groupBy("sl")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("e", F.explode_outer(F.sequence(F.col("sl"), F.col("sl") + (span - 1))))
        .groupBy("e")
        .agg(
            F.sum("n").alias("n_points"),
            F.coalesce(F.sum(F.when(is_new(sl, e), F.col("n"))), F.lit(0)).alias("n_new"),
            F.coalesce(F.sum(F.when(is_expiring(sl, e, span), F.col("n"))), F.lit(0)).alias("n_expiring"),
        )
    )
