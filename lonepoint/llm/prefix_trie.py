"""Z-fast trie of conversations, built and searched by joins.

A conversation is the list of hashes of its prefixes, a hash of 128 bits per turn.  The trie is compacted: an
edge (above, below] holds the depths at which no other conversation branches off or ends.  Its owner is the
conversation that brought it in, so an edge is a span of the owner's prefixes.  Two tables make up the trie:

* handles: the prefix hash of every edge at its two-fattest depth, the number in (above, below] that most powers
  of two divide,
* children: the prefix hash of every edge at its first depth.

Conversations are inserted in batches.  A round locates all that remain: a fat binary search looks up a prefix at
the two-fattest depth of the open span, in as many joins as the longest conversation's length has bits, and ends
at the exit node; the edges of the exit node and the conversation are compared to find where it leaves.  Of those
that leave at one place with one next turn, the first by a hash of the id is inserted, the others go to the next
round, where their exit lies deeper.  The choice being random, rounds grow with the logarithm of the
conversations.

A conversation hangs on an owner at the depth where it left, and that owner on another: these chains, as
long as rounds at most, carry counts to all edges in one aggregate.  At last edges are expanded to their depths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonepoint.llm.mixing import word_count
from lonepoint.llm.words import mix
from lonepoint.session import shuffle_width, written

#: Characters of a text by which turns of one number are ordered, before its hash.
TIE_CHARACTERS = 64
#: Ids whose digits are joined before the chunks of a group meet.
CHUNK_IDS = 4096


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns in order, each ``x, y, words``, two hashes and a number of words."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    lengths = [F.length(role), F.length(text)]
    entry = F.struct(
        F.col("turn").isNotNull().alias("numbered"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.substring(text, 1, TIE_CHARACTERS).alias("begin"),
        F.xxhash64(F.lit(1), role, text, *lengths).alias("x"),
        F.xxhash64(F.lit(2), role, text, *lengths).alias("y"),
        word_count(text).alias("words"),
    )
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), entry.alias("turn"))
    parts = ("x", "y", "words")
    return rows.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(*[t[p].alias(p) for p in parts])).alias("turns")
    )


def regrafted(chats: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """Each conversation with its first turns replaced by those of the first of its family of ids.

    A checksum of the id, modulo ``most + 1``, says how many turns go and how many of the other's come, if it
    has as many; where there is no such conversation, none come.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = chats.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head")
    )
    cut = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), cut), F.slice("turns", 1, 0))
    tail = F.slice("turns", cut + 1, F.greatest(F.size("turns") - cut, F.lit(0)))
    return chats.withColumn("base", base).join(heads, "base", "left").select("conv_id", F.concat(head, tail).alias("turns"))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all prefixes, and words up to each turn.

    A turn's hash is mixed with its depth; the hash of a prefix is the exclusive or of its turns'.
    """
    for batch in batches:
        lists = batch["turns"]
        at = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        at -= at[0]
        size = np.diff(at)
        depth = np.arange(len(flat)) - np.repeat(at[:-1], size) + 1
        made = []
        for name, seed in (("x", 1), ("y", 2)):
            turn = flat.field(name).to_numpy().view(np.uint64)
            mixed = mix(turn + mix(depth.astype(np.uint64) * np.uint64(2) + np.uint64(seed << 40)))
            total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(mixed)])
            made.append((total[1:] ^ np.repeat(total[at[:-1]], size)).view(np.int64))
        words = np.concatenate([[0], np.cumsum(flat.field("words").to_numpy())])
        made.append(words[1:] - np.repeat(words[at[:-1]], size))
        columns = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(m, pa.int64())) for m in made]
        yield pa.record_batch([batch["conv_id"], *columns], ["conv_id", "hx", "hy", "words"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one group, as the digits of their ids."""
    for batch in batches:
        x, y, ids = (batch[c].to_numpy() for c in ("x", "y", "conv_id"))
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        begin = np.flatnonzero(new)
        begin = np.concatenate([np.arange(b, e, CHUNK_IDS) for b, e in zip(begin, np.append(begin[1:], len(ids)))])
        texts = [",".join(map(str, ids[b:e].tolist())) for b, e in zip(begin, np.append(begin[1:], len(ids)))]
        yield pa.record_batch([x[begin], y[begin], ids[begin], pa.array(texts, pa.string())], ["x", "y", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per group, whose chunks come one after another."""
    names, key, state = ["x", "y", "ends_sha256"], None, None
    for batch in batches:
        done = []
        for x, y, ids in zip(*(batch[c].to_pylist() for c in ("x", "y", "ids"))):
            if (x, y) == key:
                state.update(b"," + ids.encode())
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (x, y), hashlib.sha256(ids.encode())
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], names)
    if key is not None:
        yield pa.record_batch([pa.array([v]) for v in (*key, state.hexdigest())], names)


def id_digests(groups: DataFrame) -> DataFrame:
    """``x, y, ends_sha256`` of rows ``x, y, conv_id``: SHA-256 of a group's ids, ascending, joined by commas.

    Ids are joined to chunks where they lie, in ranges, so that a large group is dealt over many tasks; the
    one task that a digest needs reads its chunks one by one.
    """
    width, key = shuffle_width(groups.sparkSession), ["x", "y"]
    chunks = (
        groups.repartitionByRange(width, *key, "conv_id")
        .sortWithinPartitions(*key, "conv_id")
        .mapInArrow(_chunks, "x bigint, y bigint, first bigint, ids string")
    )
    ordered = chunks.repartition(width, *key).sortWithinPartitions(*key, "first")
    return ordered.mapInArrow(_digests, "x bigint, y bigint, ends_sha256 string")


def two_fattest(low: str, high: str) -> Column:
    """The number in (low, high] that most powers of two divide."""
    return F.expr(f"{high} & shiftleft(-1, length(bin({low} ^ {high})) - 1)")


def _edges(inserted: DataFrame) -> DataFrame:
    """``owner, above, below`` of all edges: owners' spans cut where others left them."""
    owned = inserted.where("length > top").select(F.col("id").alias("owner"), F.col("length").alias("below"))
    cuts = inserted.where("top > 0").select(F.col("host").alias("owner"), F.col("top").alias("below"))
    order = Window.partitionBy("owner").orderBy("below")
    edges = owned.union(cuts).distinct().withColumn("before", F.lag("below").over(order))
    own = inserted.select(F.col("id").alias("owner"), "top", "length", "hx", "hy", "chain")
    return edges.join(own, "owner").select(
        "owner", F.coalesce("before", "top").alias("above"), "below", "length", "hx", "hy", "chain"
    )


def _locate(rest: DataFrame, inserted: DataFrame, longest: int) -> DataFrame:
    """Where each conversation of ``rest`` leaves the trie: ``host, top``, and the chain up to there."""
    edges = _edges(inserted).withColumn("handle", two_fattest("above", "below"))
    at = lambda array, depth: F.get(array, F.col(depth).cast("int") - 1)
    chain = F.array_append("chain", F.struct(F.col("owner").alias("host"), F.col("below").alias("top")))
    handles = edges.select(
        F.col("handle").alias("depth"), at("hx", "handle").alias("x"), at("hy", "handle").alias("y"),
        "owner", "above", "below", at("hx", "below").alias("bx"), at("hy", "below").alias("by"),
        F.col("chain").alias("found_chain"),
    )
    state = rest.select("id", "n", "length", "hx", "hy", "words").withColumns({
        "low": F.lit(0), "high": F.col("length"), "at_owner": F.lit(None).cast("bigint"),
        "at_chain": F.lit(None).cast(inserted.schema["chain"].dataType),
    })
    for _ in range(longest.bit_length()):
        # Searches that have ended ask for a depth that no handle has, spread by their own hashes.
        state = state.withColumn("probe", F.when(F.expr("low < high"), two_fattest("low", "high")).otherwise(-1))
        ask = F.when(F.col("probe") > 0, F.col("probe")).otherwise(F.col("length"))
        state = state.withColumns({"px": F.get("hx", ask.cast("int") - 1), "py": F.get("hy", ask.cast("int") - 1)})
        found = state.join(handles, F.expr("probe = depth and px = x and py = y"), "left")
        whole = F.expr("below <= length and get(hx, below - 1) = bx and get(hy, below - 1) = by")
        hit = F.col("owner").isNotNull()
        state = found.select(
            "id", "n", "length", "hx", "hy", "words",
            F.when(hit & whole, F.col("below")).when(hit, F.col("above")).otherwise(F.col("low")).alias("low"),
            F.when(hit & ~whole, F.col("above")).when(hit | (F.col("probe") < 0), F.col("high"))
            .otherwise(F.col("probe") - 1).alias("high"),
            F.when(hit & whole, F.col("owner")).otherwise(F.col("at_owner")).alias("at_owner"),
            F.when(hit & whole, F.col("found_chain")).otherwise(F.col("at_chain")).alias("at_chain"),
        )
    children = edges.withColumn("first", F.expr("above + 1")).select(
        F.col("first").alias("depth"), at("hx", "first").alias("x"), at("hy", "first").alias("y"), "owner", "below",
        F.expr("slice(hx, first, below - above)").alias("ex"), F.expr("slice(hy, first, below - above)").alias("ey"),
        F.col("chain").alias("found_chain"),
    )
    # The edge below the last whole node, if there is one; a conversation that ends at a node asks for no edge.
    state = state.withColumn("probe", F.expr("if(low < length, low + 1, -1)"))
    ask = F.when(F.col("probe") > 0, F.col("probe")).otherwise(F.col("length"))
    state = state.withColumns({"px": F.get("hx", ask.cast("int") - 1), "py": F.get("hy", ask.cast("int") - 1)})
    found = state.join(children, F.expr("probe = depth and px = x and py = y"), "left")
    common = F.expr(
        "size(filter(sequence(0, least(below, length) - low - 1), i -> get(hx, low + i) = get(ex, i) and get(hy, low + i) = get(ey, i)))"
    )
    hit = F.col("owner").isNotNull()
    found = found.select(
        "id", "n", "length", "hx", "hy", "words",
        F.when(hit, F.col("owner")).otherwise(F.col("at_owner")).alias("host"),
        F.when(hit, F.col("low") + common).otherwise(F.col("low")).alias("top"),
        F.when(hit, F.col("found_chain")).otherwise(F.col("at_chain")).alias("chain"),
    )
    return _linked(found)


def _linked(found: DataFrame) -> DataFrame:
    """The chain of the host, and the place on the host itself; the root is the host without id."""
    link = F.struct("host", "top")
    return found.withColumn("chain", F.when(F.col("top") > 0, F.array_append("chain", link)).otherwise(F.array(link)))


def build(sequences: DataFrame) -> DataFrame:
    """The trie of distinct prefix lists ``id, n, length, hx, hy, words``, none of them empty.

    Adds to each row where it hangs: ``host`` and ``top``, the owner it left and the depth of that, and ``chain``,
    the same for the host and its hosts.  The root is the host null at depth 0.
    """
    longest = sequences.agg(F.max("length")).first()[0] or 0
    chain = "array<struct<host:bigint,top:int>>"
    rest = _linked(sequences.select(
        "id", "n", "length", "hx", "hy", "words",
        F.lit(None).cast("bigint").alias("host"), F.lit(0).alias("top"), F.lit(None).cast(chain).alias("chain"),
    ))
    inserted, step = None, 0
    while True:
        # Those that end inside the trie go in; of the others, one for each place and next turn.
        onward = rest.where("top < length")
        first = onward.groupBy("top", F.expr("get(hx, top)").alias("x"), F.expr("get(hy, top)").alias("y")).agg(
            F.min_by("id", F.struct(F.xxhash64("id"), "id")).alias("id")
        )
        marked = rest.join(first.select("id", F.lit(True).alias("goes")), "id", "left")
        marked = written(marked.withColumn("goes", F.expr("goes is not null or top = length")), f"trie-{step}")
        batch = marked.where("goes").drop("goes")
        inserted = batch if inserted is None else inserted.union(batch)
        left = marked.where("not goes")
        if left.isEmpty():
            return inserted
        rest = written(_locate(left, inserted, longest), f"trie-located-{step}")
        step += 1


def _root(hung: DataFrame, empty: DataFrame) -> list[dict]:
    """The root's row, if there is any conversation: what hangs on it, and conversations without turns."""
    on = hung.agg(F.min("id").alias("id"), *[F.sum(c).alias(c) for c in ("n", "leaves", "shared", "children")]).first()
    bare = empty.agg(F.min("conv_id").alias("id"), F.count("*").alias("n")).first()
    ids = [r["id"] for r in (on, bare) if r["id"] is not None]
    if not ids:
        return []
    zero = F.lit(0).cast("bigint")
    ends = id_digests(empty.select(zero.alias("x"), zero.alias("y"), "conv_id")).first()
    return [{
        "conv_id": min(ids),
        "depth": 0,
        "parent_conv_id": None,
        "n_convs": (on["n"] or 0) + bare["n"],
        "n_children": on["children"] or 0,
        "n_leaves": on["leaves"] or 1,
        "saved_tokens": on["shared"] or 0,
        "ends_sha256": ends["ends_sha256"] if ends else hashlib.sha256().hexdigest(),
    }]


def trie_nodes(chats: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns among the conversations ``conv_id, turns``.

    ``conv_id`` is the smallest id of those that begin so, ``depth`` the number of turns, ``parent_conv_id`` the
    ``conv_id`` of the sequence less its last turn, null for the root at depth 0.  ``n_convs`` counts those that begin
    so, ``n_children`` the distinct next turns, ``n_leaves`` the sequences in the subtree that nothing follows,
    and ``saved_tokens`` sums over the subtree, its top included, the words of a sequence's last turn times
    ``n_convs - 1``.  ``ends_sha256`` digests the ids that end there.

    Ids are distinct.  Conversations without turns belong to the root alone.  Equal conversations share all their nodes.
    Without conversations there is no row.  A conversation is one row, 24 bytes a turn; two prefixes are
    equal if their 128-bit hashes are.
    """
    whole = chats.mapInArrow(_prefixes, "conv_id bigint, hx array<bigint>, hy array<bigint>, words array<bigint>")
    whole = written(whole.withColumn("length", F.size("hx")), "trie-prefixes")
    empty = whole.where("length = 0").select("conv_id")
    last = [F.expr("get(hx, length - 1)").alias("x"), F.expr("get(hy, length - 1)").alias("y")]
    full = whole.where("length > 0").select("*", *last)
    distinct = full.groupBy("x", "y").agg(
        F.min("conv_id").alias("id"), F.count("*").alias("n"),
        *[F.first(c).alias(c) for c in ("length", "hx", "hy", "words")],
    )
    rows = build(written(distinct, "trie-sequences"))

    # What a conversation adds to the subtrees above it, besides one more member for each copy: the words that
    # it shares with the owners it left, and all words of its further copies.
    extended = rows.where("top > 0 and length > top").select(F.col("host").alias("id"), F.col("top").alias("length")).distinct()
    rows = rows.join(extended.withColumn("goes_on", F.lit(True)), ["id", "length"], "left").select(
        "id", "n", "length", "words", "host", "top", "chain",
        F.expr("get(hx, length - 1)").alias("x"), F.expr("get(hy, length - 1)").alias("y"),
        F.expr("int(goes_on is null and length > top)").alias("leaf"),
        F.expr("if(top > 0, get(words, top - 1), 0) + (n - 1) * get(words, length - 1)").alias("shared"),
    )
    rows = written(rows, "trie-rows")
    hung = rows.select(
        "id", "n", "leaf", "shared", "top", "length", F.explode("chain").alias("link"),
    ).select(
        "id", "n", "leaf", "shared", F.col("link.host").alias("owner"), F.col("link.top").alias("below"),
        F.expr("int(link.top = top and length > top)").alias("child"),
    )
    sums = {"n": F.sum("n"), "id": F.min("id"), "leaves": F.sum("leaf"), "shared": F.sum("shared"), "children": F.sum("child")}
    hung = written(hung.groupBy("owner", "below").agg(*[v.alias(k) for k, v in sums.items()]), "trie-hung")

    ends = id_digests(full.select("x", "y", "conv_id").join(rows.where("n > 1").select("x", "y"), ["x", "y"], "left_semi"))
    place = [F.expr("if(length > top, id, host)").alias("owner"), F.expr("if(length > top, length, top)").alias("below")]
    single = F.sha2(F.col("id").cast("string"), 256)
    ends = rows.join(ends, ["x", "y"], "left").select(*place, F.coalesce("ends_sha256", single).alias("ends_sha256"))

    bottoms = rows.where("length > top").select(
        F.col("id").alias("owner"), F.col("length").alias("below"), F.lit(0).cast("bigint").alias("n"), "id",
        F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("shared"), F.lit(0).cast("bigint").alias("children"),
    )
    cuts = hung.where("below > 0").unionByName(bottoms).groupBy("owner", "below").agg(
        F.min("id").alias("id"), *[F.sum(c).alias(c) for c in ("n", "leaves", "shared", "children")]
    )
    upward = Window.partitionBy("owner").orderBy(F.desc("below"))
    so_far = upward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = cuts.select(
        "owner", "below", "children", F.least("owner", F.min("id").over(so_far)).alias("conv_id"),
        *[F.sum(c).over(so_far).alias(c) for c in ("n", "leaves", "shared")],
        F.lead("below").over(upward).alias("next"),
    )
    own = rows.select(F.col("id").alias("owner"), F.col("n").alias("copies"), "leaf", "length", "top", "host", "words")
    edges = cuts.join(own, "owner").withColumn("above", F.coalesce("next", "top"))
    edges = edges.select(
        "owner", "above", "below", "conv_id", "top", "host", "leaves", "leaf", "length",
        F.col("n").alias("others"), "copies", "shared",
        (F.col("children") + F.expr("int(below < length)")).alias("children"),
        F.expr("get(words, length - 1)").alias("all_words"),
        # Words up to the depth before each of the edge's.
        F.expr("if(above > 0, slice(words, above, below - above), concat(array(0L), slice(words, 1, below - 1)))").alias("before"),
    ).join(ends, ["owner", "below"], "left")
    edges = written(edges, "trie-edges")

    root = _root(hung.where("below = 0"), empty)

    blank = F.sha2(F.lit(""), 256)
    # The node above an edge: the edge before on the same owner, or the place where the owner hangs.
    bottoms = edges.select(F.col("owner").alias("up_owner"), F.col("below").alias("up_below"), F.col("conv_id").alias("up_id"))
    edges = edges.withColumn("up_owner", F.expr("if(above > top, owner, host)")).withColumn("up_below", F.col("above"))
    hanging = edges.where("above > 0").join(bottoms, ["up_owner", "up_below"])
    edges = hanging.unionByName(edges.where("above = 0").withColumn("up_id", F.lit(root[0]["conv_id"] if root else None).cast("bigint")))
    nodes = edges.select("*", F.posexplode("before").alias("place", "up_to")).withColumn("depth", F.expr("above + 1 + place"))
    last = F.col("depth") == F.col("below")
    nodes = nodes.select(
        "conv_id",
        F.col("depth").cast("bigint").alias("depth"),
        F.when(F.col("place") > 0, F.col("conv_id")).otherwise(F.col("up_id")).alias("parent_conv_id"),
        (F.col("others") + F.col("copies")).alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        (F.col("leaves") + F.col("leaf")).cast("bigint").alias("n_leaves"),
        F.expr("(copies - 1) * (all_words - up_to) + shared - others * up_to").cast("bigint").alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", blank)).otherwise(blank).alias("ends_sha256"),
    )
    return nodes.unionByName(chats.sparkSession.createDataFrame(root, nodes.schema))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of all regrafted conversations; see ``trie_nodes`` and ``regrafted``.

    Turns go by ``turn``, null first, then role, then text (its first characters, then its hash).  A null role or
    text is empty; rows without ``conv_id`` take no part; rows that repeat a turn are turns.  An empty table
    gives no rows.  Only ``conv_id``, ``turn``, ``role`` and ``text`` are read.
    """
    return trie_nodes(regrafted(sequences(turns)))


ORACLE = """
WITH original AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), chats AS (
  -- The checksum by its bits: crc32 of the digits, byte for byte.
  SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
      lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) AS crc
  FROM (SELECT DISTINCT c FROM original)
), cut AS (
  SELECT c, xor(crc, 4294967295::BIGINT) % 4 AS h FROM chats
), pieces AS (
  SELECT cut.c, 0 AS own, o.p, o.r, o.t FROM cut JOIN original o ON o.c = cut.c - cut.c % 20 AND o.p <= h
  UNION ALL
  SELECT cut.c, 1, o.p, o.r, o.t FROM cut JOIN original o ON o.c = cut.c AND o.p > h
), placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d,
         len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w,
         list({'r': r, 't': t}) OVER (PARTITION BY c ORDER BY own, p) AS path
  FROM pieces
), members AS (
  SELECT c, d, w, path, max(d) OVER (PARTITION BY c) AS len FROM placed
  UNION ALL SELECT c, 0, 0, [], (SELECT count(*) FROM pieces x WHERE x.c = cut.c) FROM cut
), nodes AS (
  SELECT path, d, min(c) AS c, count(*) AS n, any_value(w) AS w,
         string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len = d) AS ends, max(len) = d AS leaf
  FROM members GROUP BY path, d
), subtrees AS (
  -- A node's ancestors are the prefixes of its smallest member.
  SELECT m.path, m.d, sum((n.n - 1) * n.w) AS saved, count(*) FILTER (WHERE n.leaf) AS leaves,
         count(*) FILTER (WHERE n.d = m.d + 1) AS children
  FROM nodes n JOIN members m ON m.c = n.c AND m.d <= n.d GROUP BY m.path, m.d
)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, p.c AS parent_conv_id, n.n::BIGINT AS n_convs, children::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN subtrees s ON s.path = n.path AND s.d = n.d
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.path[1 : n.d - 1]
"""
