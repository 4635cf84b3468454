"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.session import written

#: Parts into which the neighbours of a node are dealt.
SALTS = 16


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """The edges ``(a, b)`` with ``low`` of ``a``; a node with very many edges is joined in parts."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    copies = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["a", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of an edge ``(a, b)``; the component is its smallest node.

    Alternates two rewritings of the edge list until it stands still: every node hands its larger
    neighbours to its smallest one, then its smaller ones.  An edge stays one row, so nothing grows with
    a node's degree; the smallest neighbour is a pre-aggregated minimum.  No edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = written(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = (
            _with_low(both, low)
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            _with_low(large, low)
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = written(small, "edges")
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = tuple(after.agg(F.count("*"), total).first())
        if now == before:
            break
        edges, before = after, now
    tops = after.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
