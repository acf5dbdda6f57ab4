"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring.  A row's hash is its place on the
ring; its shards of preference are the distinct shards met clockwise from
there.  A shard takes rows in the order of their hashes up to its load bound; a
row that meets a full shard goes on clockwise.  The bounds are floor(n / shards)
or one more and add up to n, so the law ``rows`` holds exactly: shard counts are
at most one apart.  Rows that never meet a full shard stay where plain
consistent hashing puts them, so a change of the shard count moves few others.

Only DataFrame functions are used.  The order of acceptance makes the state of
a round two numbers per shard, so the placement of a row is a function of its
hash and a table of (round, shard) thresholds: each round counts the waiting
rows by (shard, hash bucket) - at most ``shards * BUCKETS`` rows come to the
driver, whatever the input - and looks up the one row at the bound.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sift.llm.common import cut_lineage

CELL_BITS = 14
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS


def ring_cells(shards: int, vnodes: int) -> list[list[int]]:
    """For each of 2**CELL_BITS ring cells, the shards in clockwise order of first meeting.

    A point is the first bytes of md5("shard/copy"); points of one cell are in
    order of their hash, then shard.
    """
    points = sorted((hashlib.md5(f"{s}/{v}".encode()).digest(), s) for s in range(shards) for v in range(vnodes))
    cells = [(int.from_bytes(d[:4], "big") >> (32 - CELL_BITS), s) for d, s in points]
    after: list[list[int]] = [[] for _ in cells]
    order: list[int] = []  # met clockwise from the point at hand
    for i in range(2 * len(cells) - 1, -1, -1):
        s = cells[i % len(cells)][1]
        order = [s] + [x for x in order if x != s]
        if i < len(cells):
            after[i] = order
    out, i = [], 0
    for c in range(1 << CELL_BITS):
        while i < len(cells) and cells[i][0] < c:
            i += 1
        out.append(after[i % len(cells)])
    return out


def _placement(limits: list[dict[int, tuple | None]], shards: int) -> Column:
    """Index in ``prefs`` of the shard that takes the row, null while it waits.

    limits[r][s]: None if shard s takes every row that comes in round r, else
    the (h, doc_id, crc, size, occ) of the last one taken, or () for none.
    """
    taken = F.lit(None).cast("int")
    for r in reversed(range(len(limits))):
        s = F.col("prefs")[r]
        ok = F.lit(False)
        for shard, last in limits[r].items():
            if last is None:
                ok = ok | (s == shard)
            elif last:
                ok = ok | ((s == shard) & _not_after(last))
        taken = F.when(ok, F.lit(r)).otherwise(taken)
    return taken


ORDER = ["h", "doc_id", "text_crc32", "size", "occ"]


def _not_after(last: tuple) -> Column:
    """The row is not after ``last`` in ORDER (nulls first)."""
    cond = F.lit(True)
    for name, value in reversed(list(zip(ORDER, last))):
        c = F.col(name)
        if value is None:
            cond = c.isNull() & cond
        else:
            cond = c.isNull() | (c < F.lit(value)) | ((c == F.lit(value)) & cond)
    return cond


def shard(docs: DataFrame, shards: int = 8, vnodes: int = 64) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, size, text_crc32, shard, slot)``.

    size: UTF-8 bytes of the text plus 1; a null text has no bytes and the crc32
    of none.  ``slot`` numbers the rows of a shard from 0 without gaps, in hash
    order.  Repeated rows (equal id and text) are numbered and hashed apart, so
    any number of them spreads over the ring; rows with a null id are hashed by
    their text.  An empty table gives an empty table.  Other columns are not read.
    """
    if shards < 1 or vnodes < 1:
        raise ValueError("at least one shard and one virtual node")
    text = F.coalesce("text", F.lit(""))
    rows = (docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
            .groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
            .select("doc_id", "size", "text_crc32", F.explode(F.expr("sequence(1, copies)")).alias("occ")))
    spark = docs.sparkSession
    ring = spark.createDataFrame([(c, p) for c, p in enumerate(ring_cells(shards, vnodes))], "cell int, prefs array<int>")
    h = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull() | (F.col("occ") > 1), F.col("text_crc32")), "occ")
    # a signed hash orders like the ring when its place is counted from the least value
    place = F.shiftrightunsigned(F.col("h"), 64 - CELL_BITS).cast("int")
    bucket = F.shiftright(F.col("h"), 64 - BUCKET_BITS).cast("int")
    keyed = (rows.withColumn("h", h).withColumn("cell", place).withColumn("bucket", bucket)
             .join(F.broadcast(ring), "cell").drop("cell"))
    keyed = cut_lineage(keyed)
    n = keyed.count()
    room = {s: n // shards + (s < n % shards) for s in range(shards)}
    limits: list[dict[int, tuple | None]] = []
    for r in range(shards if n else 0):
        waiting = keyed.filter(_placement(limits, shards).isNull()).withColumn("shard", F.col("prefs")[r])
        counts: dict[int, dict[int, int]] = {}
        for x in waiting.groupBy("shard", "bucket").count().collect():
            counts.setdefault(x["shard"], {})[x["bucket"]] = x["count"]
        now: dict[int, tuple | None] = {}
        cut = []
        for s in range(shards):
            come = counts.get(s, {})
            if sum(come.values()) <= room[s]:
                now[s] = None
                room[s] -= sum(come.values())
                continue
            left = room[s]
            room[s] = 0
            now[s] = ()
            for b in sorted(come):
                if left <= come[b]:
                    if left:
                        cut.append((s, b, left))
                    break
                left -= come[b]
        if cut:
            # the row at the bound: only the rows of one bucket a shard are ranked
            at = None
            for s, b, left in cut:
                one = (F.col("shard") == s) & (F.col("bucket") == b)
                at = one if at is None else at | one
            rank = F.row_number().over(Window.partitionBy("shard").orderBy(*[F.col(c).asc_nulls_first() for c in ORDER]))
            bound = None
            for s, _, left in cut:
                one = (F.col("shard") == s) & (F.col("rank") == left)
                bound = one if bound is None else bound | one
            for x in waiting.filter(at).withColumn("rank", rank).filter(bound).collect():
                now[x["shard"]] = tuple(x[c] for c in ORDER)
        limits.append(now)
        if not any(v is not None for v in now.values()):
            break
    if not n:
        limits = [{s: None for s in range(shards)}]
    placed = keyed.withColumn("shard", F.col("prefs")[_placement(limits, shards)])
    # slots: rank inside (shard, bucket) after the rows of the shard's earlier buckets
    before = (placed.groupBy("shard", "bucket").count()
              .select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("base")))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*[F.col(c).asc_nulls_first() for c in ORDER]))
    return (placed.withColumn("at", within).join(F.broadcast(before), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at") - 1).alias("slot")))
