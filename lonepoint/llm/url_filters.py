"""URL rules and block lists through a blocked Bloom filter and an exact join, in DataFrame functions only.

A list entry is one key: ``host + path`` of a rule, or a canonical URL.  A URL is looked up under every
key that could fit it: its host suffixes, of as many labels as the list uses, with its path prefixes of
the lengths the list uses, and its own canonical form.  The filter has blocks of four 64-bit words, a key
sets one bit in each word of its block, so a look-up touches one row.  Keys that pass go to an exact join
with the list, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict).  Fixed values of the query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

BITS_PER_KEY = 16
#: A filter or list of at most this many entries (about 8 MB) is broadcast; a larger one is shuffled.
BROADCAST_KEYS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; null or without ``://``, both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One spelling of a URL: no ``www.`` or ``m.``, no page ending, no slash at the end."""
    return F.concat(F.regexp_replace(host, "^(www|m)\\.", ""), F.regexp_replace(path, "(\\.html)?/*$", ""))


def repeated_urls(pages: DataFrame) -> DataFrame:
    """``entry``: canonical URLs that more than one page has."""
    host, path = url_parts(F.col("url"))
    return (
        pages.select(canonical(host, path).alias("entry"))
        .where("entry <> ''")
        .groupBy("entry")
        .count()
        .where("count > 1")
        .select("entry")
    )


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bit in each of the four words."""
    spread = F.xxhash64(F.lit(1), key)
    words = []
    for i in range(4):
        place = F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        words.append(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return F.pmod(F.xxhash64(F.lit(2), key), F.lit(blocks)), words


def bloom_filter(keys: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks ``(block, w0..w3)`` of the column ``key``, and the number of blocks."""
    blocks = max(1, -(-size * BITS_PER_KEY // 256))
    block, words = _bits(F.col("key"), blocks)
    cells = keys.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return cells.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def possible(looked: DataFrame, filter_blocks: DataFrame, blocks: int, small: bool) -> DataFrame:
    """The rows whose column ``key`` may be in the filter."""
    block, words = _bits(F.col("key"), blocks)
    passes = F.lit(True)
    for i, w in enumerate(words):
        passes = passes & (F.col(f"w{i}").bitwiseAND(w) == w)
    right = F.broadcast(filter_blocks) if small else filter_blocks
    return looked.withColumn("block", block).join(right, "block").where(passes).select(*looked.columns)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """Judge every page's URL.

    ``rules`` are ``(host, path, verdict)``: a rule fits its host and all subdomains if the URL's path
    starts with its path, and the longest fitting one decides.  Without one, a URL whose canonical form
    is in ``listed`` (column ``entry``) is blocked and any other is allowed.

    Returns ``page_id, host, path, rule, verdict``, one row per row of ``pages``.  A null URL or one without
    ``://`` has empty host and path, fits no rule and is allowed; repeated rows and null ids keep their
    rows.  Only ``page_id`` and ``url`` are read.  A URL that many pages share is judged once.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule_rows = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f"r {h}{p}").alias("key"), F.lit(f"{h}{p}").alias("rule"), F.lit(v).alias("verdict"))
                    for h, p, v in rules
                ]
            )
        )
    )
    entries = rule_rows.union(
        listed.select(
            F.concat(F.lit("u "), "entry").alias("key"), F.lit(None).cast("string"), F.lit("block")
        ).distinct()
    )
    size = entries.count()
    small = size <= BROADCAST_KEYS
    filter_blocks, blocks = bloom_filter(entries, size)

    labels = max((h.count(".") + 1 for h, _, _ in rules), default=0)
    lengths = sorted({len(p) for _, p, _ in rules})
    asked = parts.select("host", "path").where("host <> '' or path <> ''").distinct()
    cut = F.split("host", "\\.")
    suffixes = F.filter(
        F.array(
            *[
                F.when(F.size(cut) >= n, F.array_join(F.slice(cut, F.size(cut) - n + 1, n), "."))
                for n in range(1, labels + 1)
            ]
        ),
        lambda x: x.isNotNull(),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.left(F.col("path"), F.lit(n))) for n in lengths]),
        lambda x: x.isNotNull(),
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("r "), s, p))))
    own = F.array(F.concat(F.lit("u "), canonical(F.col("host"), F.col("path"))))
    looked = asked.select("host", "path", F.explode(F.concat(keys, own)).alias("key"))
    hits = possible(looked, filter_blocks, blocks, small)
    exact = hits.join(F.broadcast(entries) if small else entries, "key")
    best = exact.groupBy("host", "path").agg(
        F.max(F.struct(F.coalesce(F.length("rule"), F.lit(-1)).alias("length"), "rule", "verdict")).alias("best")
    )
    return parts.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
    )


ORACLE = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), forms AS (
  SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html)?/*$', '') AS entry FROM cut
), listed AS (
  SELECT entry FROM forms WHERE entry <> '' GROUP BY entry HAVING count(*) > 1
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT DISTINCT host, path, rule_host || rule_path AS rule, rule_verdict
  FROM (SELECT DISTINCT host, path FROM forms), rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM fits GROUP BY host, path
)
SELECT f.page_id, f.host, f.path, b.rule,
       CASE WHEN b.rule IS NOT NULL THEN b.rule_verdict
            WHEN f.entry IN (SELECT entry FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM forms f LEFT JOIN best b ON f.host = b.host AND f.path = b.path
"""
