"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should have.  The whole part
is given to all; the fraction is a probability, and rounding the probabilities must keep the words of the
source.  So documents are paired: words are moved at random from one's probability to the other's until
one of them is 0 or 1, and the other goes on.  Sums of words never change, expectations neither, and one
fractional document is left.

While all probabilities are equal, a document can be paired with all that are still open at once: they share
what is moved in proportion to their sizes and stay equal.  So the heaviest documents of a source, of which there
can be few, go first, each against all lighter ones, and do not end as the residual.  The others are dealt out to many
small groups, each again from heavy to light; each group leaves one residual, and the residuals meet in
larger groups, level by level, down to one light document per source.

All random draws are hashes of ids, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import hashlib
import math
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lonepoint.session import shuffle_width, written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of one pairing group, and residuals that meet in one group.
GROUP_ROWS = 4_096
#: A document is heavy if so many of its size are more than its source; a source has fewer of them than that.
HEAVY = 1_024

_EPSILON = 1e-9


def word_count(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame) -> DataFrame:
    """``goal_source, source_size, target, ratio, groups``: one row per source, as a written table.

    Sources in order of code points, null last, weigh 5, 2, 1, repeating, and share all words; what exceeds
    ``MOST_COPIES`` times a size is shared again among the others until none does.  Each round of sharing is an
    aggregate over the sources, of which the driver sees sums alone.
    """
    spark, order = sized.sparkSession, F.col("source").asc_nulls_last()
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    # Numbered by range and place within it; the ranges' lengths make ranks of them.
    ranged = found.repartitionByRange(shuffle_width(spark), order).sortWithinPartitions(order)
    numbered = written(ranged.withColumn("number", F.monotonically_increasing_id()), "mixing-sources")
    part = F.shiftright("number", 33).alias("part")
    counts = sorted((r["part"], r["count"]) for r in numbered.groupBy(part).count().collect())
    starts = [(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)]
    starts = spark.createDataFrame(starts, "part bigint, before bigint")
    rank = F.col("before") + F.col("number").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    sources = numbered.withColumn("part", part).join(starts, "part").withColumn("weight", weight)
    sources = written(sources.select("source", "size", "rows", "weight"), "mixing-weights")

    total = sources.agg(F.sum("size")).first()[0] or 0
    rest, open_weight, capped = float(total), sources.agg(F.sum("weight")).first()[0] or 1, -1
    most = MOST_COPIES * F.col("size")
    while True:
        goal = F.lit(rest) * F.col("weight") / F.lit(open_weight)
        over = goal > most
        row = sources.agg(
            F.count_if(over).alias("n"),
            F.sum(F.when(over, most).otherwise(0)).alias("words"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if row["n"] in (0, capped):
            break
        rest, open_weight, capped = float(total - row["words"]), row["weight"] or 1, row["n"]
    target = F.when(over, most.cast("double")).otherwise(goal)
    return written(
        sources.select(
            F.col("source").alias("goal_source"),
            F.col("size").alias("source_size"),
            target.alias("target"),
            F.when(F.col("size") > 0, target / F.col("size")).otherwise(0.0).alias("ratio"),
            F.ceil(F.col("rows") / GROUP_ROWS).alias("groups"),
        ),
        "mixing-goals",
    )


def _draw(*parts) -> float:
    digest = hashlib.blake2b(repr(parts).encode(), digest_size=8).digest()
    return struct.unpack("<Q", digest)[0] / 2**64


def _integral(share: float) -> bool:
    return not _EPSILON < share < 1 - _EPSILON


def settle(weights: list[float], names: list, share: float, others: float, seed: int) -> tuple[list[float], float]:
    """Shares of documents from heavy to light that all begin with ``share``, and the share of the rest.

    Each is paired with all after it and ``others`` words of lighter documents, which stay alike.  All but one at
    most get 0 or 1, and none but that one keeps a fraction if there are no others.
    """
    shares, pool = [], sum(weights) + others
    for weight, name in zip(weights, names):
        pool -= weight
        mine = share
        if not _integral(share) and pool > 0:
            # Words that can go from this document to the others, and back.
            there, back = min(share * weight, (1 - share) * pool), min((1 - share) * weight, share * pool)
            moved = -there if _draw(seed, "settle", name) * (there + back) < back else back
            mine, share = share + moved / weight, share - moved / pool
        shares.append(float(round(mine)) if _integral(mine) else mine)
    return shares, float(round(share)) if _integral(share) else share


def _settled(seed: int, heavy: bool):
    """``settle`` for one group of rows; with ``heavy``, the rest of the source comes along as ``pool``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["weight", *_NAME], ascending=[False, *[True] * len(_NAME)], kind="stable")
        weights = group["weight"].tolist()
        others = float(group["source_size"].iloc[0]) - sum(weights) if heavy else 0.0
        names = list(zip(*[group[c].tolist() for c in _NAME]))
        group["share"], group["pool"] = settle(weights, names, float(group["share"].iloc[0]), others, seed)
        return group

    return run


def _pivot(level: int, seed: int):
    """Pair the rows of one group, which differ in share, one after the other."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["weight", *_NAME], ascending=[False, *[True] * len(_NAME)], kind="stable")
        weight, share = group["weight"].tolist(), group["share"].tolist()
        ids = list(zip(*[group[c].tolist() for c in _NAME]))
        at = 0
        for i in range(1, len(share)):
            wa, wb, pa, pb = weight[at], weight[i], share[at], share[i]
            if not _integral(pa) and not _integral(pb):
                # Words that can go from a to b, and from b to a.
                there, back = min(pa * wa, (1 - pb) * wb), min((1 - pa) * wa, pb * wb)
                moved = -there if _draw(seed, level, ids[at], ids[i]) * (there + back) < back else back
                share[at], share[i] = pa + moved / wa, pb - moved / wb
            if _integral(share[at]):
                share[at] = float(round(share[at]))
                at = i
        group["share"] = share
        return group

    return run


#: What names a row of the mix: rows that agree in all but ``copy`` are alike.
_NAME = ["doc_id", "size", "mark", "copy"]


def copies_by_document(sized: DataFrame, goals: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, mark, copy, alike, source_size, target, copies``: one row for each of ``sized``.

    ``mark`` is a hash of the text.  Of ``alike`` rows that agree in id, source, size and mark, ``copy`` counts from
    1; each is rounded for itself.
    """
    alike = sized.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("alike"))
    units = alike.join(goals, F.expr("source <=> goal_source")).select(
        "doc_id", "source", "size", "mark", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("alike"))).alias("copy"), "alike",
        "source_size", "target",
        F.col("size").cast("double").alias("weight"),
        F.floor("ratio").cast("int").alias("whole"),
        # A document without words weighs nothing and takes no part in the pairing.
        F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0).alias("share"),
        F.lit(0.0).alias("pool"),
        "groups",
    )
    units = written(units.withColumn("bin", F.pmod(F.xxhash64(F.lit(seed), *_NAME), F.col("groups"))), "mixing-units")
    is_heavy = F.col("size") * HEAVY > F.col("source_size")
    heavy = units.where((F.col("size") > 0) & is_heavy).groupBy("source").applyInPandas(_settled(seed, True), units.schema)
    heavy = written(heavy, "mixing-heavy")
    # The heavy ones leave the light ones of their source with a share of their own.
    pools = heavy.groupBy(F.col("source").alias("pool_source")).agg(F.max("pool").alias("left"))
    light = units.where((F.col("size") > 0) & ~is_heavy).join(pools, F.expr("source <=> pool_source"), "left")
    light = light.withColumn("share", F.coalesce("left", "share")).select(*units.columns)
    rounded = written(light.groupBy("source", "bin").applyInPandas(_settled(seed, False), units.schema), "mixing-0")

    whole = (F.col("share") <= _EPSILON) | (F.col("share") >= 1 - _EPSILON)
    settled = units.where("size = 0").union(heavy.where(whole)).union(rounded.where(whole))
    residual = heavy.union(rounded).where(~whole)
    groups, level = goals.agg(F.max("groups")).first()[0] or 1, 0
    while True:
        groups, level = math.ceil(groups / GROUP_ROWS), level + 1
        binned = residual.withColumn("bin", F.floor(F.col("bin") / GROUP_ROWS).cast("long"))
        rounded = written(binned.groupBy("source", "bin").applyInPandas(_pivot(level, seed), units.schema), f"mixing-{level}")
        settled, residual = settled.union(rounded.where(whole)), rounded.where(~whole)
        if groups == 1:
            # The one residual of a source goes to the nearer whole number.
            settled = settled.union(residual)
            break
    return settled.select(
        "doc_id", "source", "size", "mark", "copy", "alike", "source_size", "target",
        (F.col("whole") + F.round("share").cast("int")).alias("copies"),
    )


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")
    )


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    ``taken`` is the row's size times its copies, 0 to 3.  A null text has size 0 and takes nothing, a null
    source is a source of its own, a null ``doc_id`` is an id like any other.  Rows that are alike are rounded each
    for itself.  Empty tables and tables without words take nothing.  Only ``doc_id``, ``text`` and ``source`` are
    read.
    """
    sized = written(_sized(docs), "mixing-sizes")
    made = copies_by_document(sized, source_targets(sized), seed)
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns.

    Rows without words go, since the mix takes nothing of them; nulls, repeated rows and empty tables are as in
    ``mix``.
    """
    sized = written(_sized(docs), "mixing-sizes")
    made = copies_by_document(sized, source_targets(sized), seed)
    made = written(made.select(*[F.col(c).alias(f"its_{c}") for c in made.columns]), "mixing-copies")
    # The row travels as one column, so that none of its own can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = {
        "doc_id": F.col("row.doc_id"), "source": F.col("row.source"),
        "size": word_count(F.col("row.text")), "mark": F.xxhash64("row.text"),
    }
    rows = rows.select("row", *[v.alias(k) for k, v in named.items()])
    same = " AND ".join(f"{c} <=> its_{c}" for c in ("doc_id", "source", "size", "mark"))
    single = rows.join(made.where("its_alike = 1 and its_copies > 0"), F.expr(same))
    # Rows that are alike are numbered, which for all others needs no sorting.
    several = made.where("its_alike > 1")
    keys = several.select("its_doc_id", "its_source", "its_size", "its_mark").distinct()
    order = Window.partitionBy("doc_id", "source", "size", "mark").orderBy(F.xxhash64("row"))
    numbered = rows.join(keys, F.expr(same), "left_semi").withColumn("copy", F.row_number().over(order))
    repeated = numbered.join(several.where("its_copies > 0"), F.expr(f"{same} AND copy = its_copy"))
    taken = single.select("row", "its_copies").union(repeated.select("row", "its_copies"))
    return taken.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("its_copies")))).select("row.*")
