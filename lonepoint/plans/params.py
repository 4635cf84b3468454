"""Query parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gcd_of(values: Sequence[int]) -> int:
    return reduce(math.gcd, values)


@dataclass(frozen=True)
class QuerySet:
    """All combinations of window, slide, radius and k, answered in one pass.

    ``unit`` is the greatest common divisor of the slides: points are bucketed
    by it, and a query with slide S reports every ``S / unit`` buckets.
    """

    windows: Sequence[int]
    slides: Sequence[int]
    radii: Sequence[float]
    ks: Sequence[int]
    unit: int = field(init=False)

    def __post_init__(self):
        for name, cast in (("windows", int), ("slides", int), ("radii", float), ("ks", int)):
            values = tuple(sorted({cast(v) for v in getattr(self, name)}))
            if not values:
                raise ValueError(f"no {name} given")
            object.__setattr__(self, name, values)
        if self.windows[0] <= 0 or self.slides[0] <= 0:
            raise ValueError("windows and slides must be positive")
        if self.radii[0] < 0 or self.ks[0] < 0 or not all(math.isfinite(r) for r in self.radii):
            raise ValueError("radii and ks must not be negative")
        object.__setattr__(self, "unit", gcd_of(self.slides))
        for w in self.windows:
            if w % self.unit:
                raise ValueError(f"window {w} is not a multiple of the slide unit {self.unit}")

    @property
    def spans(self) -> list[int]:
        return [w // self.unit for w in self.windows]

    @property
    def steps(self) -> list[int]:
        return [s // self.unit for s in self.slides]


def parse_rk(text: str) -> list[tuple[int, float]]:
    """``"k;R,k;R"`` as a list of (k, R)."""
    queries = []
    for part in text.split(","):
        k, r = part.split(";")[:2]
        queries.append((int(k), float(r)))
    return queries


def query_column(queries: QuerySet) -> Column:
    """The queries as an array column, to be exploded next to the points."""
    return F.array(
        *[
            F.struct(F.lit(w).alias("w"), F.lit(s).alias("s"), F.lit(r).alias("r"), F.lit(k).alias("k"))
            for w in queries.windows
            for s in queries.slides
            for r in queries.radii
            for k in queries.ks
        ]
    )


def with_queries(df: DataFrame, queries: QuerySet) -> DataFrame:
    """Each row once per query, without a join."""
    return df.withColumn("q", F.explode_outer(query_column(queries))).select(
        *df.columns, "q.w", "q.s", "q.r", "q.k"
    )


def reporting_windows(windows: DataFrame, queries: QuerySet) -> DataFrame:
    """Windows ``(wi, e, ..)`` once per query window and slide that reports them."""
    rest = [c for c in windows.columns if c not in ("wi", "e")]
    lengths = F.array(*[F.lit(w) for w in queries.windows])
    due = F.filter(
        F.array(*[F.struct(F.lit(s).alias("s"), F.lit(s // queries.unit).alias("step")) for s in queries.slides]),
        lambda x: (F.col("e") + 1) % x["step"] == 0,
    )
    return windows.withColumn("x", F.explode(due)).select(
        "e", F.get(lengths, F.col("wi")).alias("w"), F.col("x.s").alias("s"), *rest
    )
