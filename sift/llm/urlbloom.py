"""URL rules by a blocked Bloom filter before an exact hash join.

A rule is a (host, path) pair with a verdict.  It fits its host and all
subdomains when the url's path starts with the rule's path.  The listed keys
(host, path) are put into a blocked Bloom filter: a key's hash picks one block
of eight 64-bit words and sets one bit in each word, so a probe reads one row.
Every distinct (host, path) of the pages yields its host suffixes x path
prefixes of listed lengths as probes; probes whose eight bits are set go on to
the exact hash join, which removes the false positives; the longest rule wins.

Only DataFrame functions are used.  The filter and the rules are broadcast when
they hold at most ``broadcast_keys`` keys, and are joined by shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
BITS_PER_KEY = 24
BROADCAST_KEYS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """(block, eight one-bit masks) of a key."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    masks = F.array(*[F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                      F.shiftrightunsigned(g, 6 * i).bitwiseAND(63).cast("int"))
                      for i in range(WORDS)])
    return F.pmod(h, F.lit(blocks)), masks


def bloom_filter(rules: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """``rules(host, path)`` -> (block, words) rows of the filter, and its number of blocks."""
    blocks = max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))
    block, masks = _bits(_key(F.col("host"), F.col("path")), blocks)
    rows = rules.select(block.alias("block"), masks.alias("m"))
    return (rows.groupBy("block")
            .agg(F.array(*[F.bit_or(F.col("m")[i]) for i in range(WORDS)]).alias("words")), blocks)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow",
          broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``pages(page_id, url)`` x ``rules(host, path, verdict)`` ->
    ``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    No rule: ``rule`` is null and the verdict is ``default`` (the url is not
    listed).  A null or empty url, or one without ``://``, has an empty host and
    path and fits no rule, as does any url when the list is empty.  Rules of
    equal length: the longer host wins.  A rule listed twice blocks if either
    says block.  Rules with a null part or an empty host are ignored.  Repeated
    pages give repeated rows.  Other columns are not read.
    """
    listed = (rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
              .filter("host <> '' and path is not null and verdict is not null")
              .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    shape = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("path")).alias("lengths"),
                       F.collect_set(F.size(F.split("host", "\\."))).alias("labels")).first()
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shape.n:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    small = shape.n <= broadcast_keys
    side = F.broadcast if small else (lambda df: df)
    bloom, blocks = bloom_filter(listed, shape.n)

    parts = F.split("host", "\\.")
    suffixes = F.filter(F.array(*[
        F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in sorted(shape.labels)]),
        lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[
        F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape.lengths)]),
        lambda x: x.isNotNull())
    # one probe set per distinct (host, path): copies of a url are probed once
    distinct = urls.select("host", "path").filter("host <> ''").distinct()
    probes = (distinct.select("host", "path", F.explode(suffixes).alias("at_host"), prefixes.alias("p"))
              .select("host", "path", "at_host", F.explode("p").alias("at_path")))
    block, masks = _bits(_key(F.col("at_host"), F.col("at_path")), blocks)
    # all eight words must hold their mask
    passes = None
    for i in range(WORDS):
        one = F.col("words")[i].bitwiseAND(F.col("m")[i]) == F.col("m")[i]
        passes = one if passes is None else passes & one
    maybe = (probes.withColumn("block", block).withColumn("m", masks)
             .join(side(bloom), "block").filter(passes).drop("block", "m", "words"))
    exact = maybe.join(side(listed.select(F.col("host").alias("at_host"), F.col("path").alias("at_path"), "verdict")),
                       ["at_host", "at_path"])
    best = (exact.groupBy("host", "path")
            .agg(F.max(F.struct((F.length("at_host") + F.length("at_path")).alias("n"),
                                F.length("at_host").alias("h"), F.concat("at_host", "at_path").alias("rule"),
                                "verdict")).alias("best")))
    return (urls.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
