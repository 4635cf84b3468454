"""Chat formatting after collapsing cumulative snapshots.

A log that stores a conversation after every turn holds each of its prefixes too.  A rolling hash over the
turns gives every prefix of every conversation a name; a conversation whose whole is a proper prefix of
another, or which equals one with a smaller id, is dropped by anti-joins on these names.  What remains
is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the rendered form; fixed values.
START, STOP = "<|im_start|>", "<|im_end|>"

_NO_ID = -(1 << 63)


def _turn_hash(seed: int) -> Column:
    """Hash of a turn's role and text; null and empty differ."""
    shown = [F.coalesce(F.length(c), F.lit(-1)) for c in ("role", "text")]
    return F.xxhash64(F.lit(seed), "role", "text", *shown)


def prefix_names(turns: DataFrame) -> DataFrame:
    """``conv_id, place, name_a, name_b``: the name of the conversation up to each turn.

    The rolling hash of a prefix is the sum of its turns' hashes, each mixed with its place, so a prefix is
    a running sum and no conversation is held whole.  Two sums make 128 bits.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    placed = turns.select(
        "conv_id",
        _turn_hash(1).alias("a"),
        _turn_hash(2).alias("b"),
        F.row_number().over(order).alias("place"),
        "turn",
        "role",
        "text",
    )
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mixed = [F.xxhash64(x, "place").cast("decimal(38,0)") for x in ("a", "b")]
    return placed.select(
        "conv_id",
        "place",
        *[F.sum(m).over(so_far).alias(f"name_{x}") for m, x in zip(mixed, ("a", "b"))],
    )


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that are no prefix or later copy of another."""
    names = prefix_names(turns)
    length = names.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    joined = names.join(length, "conv_id")
    whole = joined.where("place = n_turns").select("conv_id", "n_turns", "name_a", "name_b")
    # Names of proper prefixes, each once: many conversations may share one.
    inner = joined.where("place < n_turns").select("name_a", "name_b", F.col("place").alias("n_turns")).distinct()
    longest = whole.join(inner, ["name_a", "name_b", "n_turns"], "left_anti")
    smallest = longest.groupBy("name_a", "name_b", "n_turns").agg(F.min("conv_id").alias("conv_id"))
    return smallest.select("conv_id", "n_turns")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, rendered`` of the maximal conversations.

    Turns go by ``turn``, then role, then text, null turns last; a null role or text is rendered empty.
    Rows without ``conv_id`` are one conversation, before all others.  Of equal conversations the smallest
    id stays; rows that repeat a turn count as turns.  An empty table gives no rows.  Only ``conv_id``,
    ``turn``, ``role`` and ``text`` are read.
    """
    turns = turns.select(F.coalesce("conv_id", F.lit(_NO_ID)).alias("conv_id"), "turn", "role", "text")
    kept = maximal(turns)
    line = F.concat(
        F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(STOP), F.lit("\n")
    )
    rows = turns.join(kept.select("conv_id"), "conv_id", "left_semi").select(
        "conv_id",
        F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text", line.alias("line")).alias("t"),
    )
    rendered = rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["line"]), "").alias("rendered"),
    )
    return rendered.withColumn("conv_id", F.nullif("conv_id", F.lit(_NO_ID)))


ORACLE = """
WITH t AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY turn, role, text) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                    ORDER BY turn, role, text) AS rendered
  FROM conversations GROUP BY conv_id
), prefixes AS (
  SELECT DISTINCT turns[1:n] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS n FROM t)
)
SELECT min(conv_id) AS conv_id, n_turns, rendered FROM t
WHERE turns NOT IN (SELECT turns FROM prefixes)
GROUP BY turns, n_turns, rendered
"""
