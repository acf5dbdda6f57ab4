"""Token ids in compressed files: an adaptive context-mixing range coder.

A segment of ids is cut into blocks of ``BLOCK`` ids.  Every block starts from a
reset state, is coded by itself and has a checksum, so any block can be decoded
alone and a damaged one is noticed.  The probability of the next id mixes
* order 2: the id that followed the last two ids the last time in this block,
* order 1: the id that followed the last id,
* order 0: the frequencies of the segment (kept in its header),
with weights that adapt, per state of confidence of the prediction, to how often
it came true; where orders 1 and 2 predict the same id their weights join.  A
range coder with 64-bit state and carries codes each id in its interval.

Coding is one step after another within a block, so NumPy runs all blocks of a
segment in step.  Segments are rows of a Parquet table (the container that every
machine can write and read again), in ascending order of document id.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sift.llm.common import bounded_batches, shared_path, tidy
from sift.llm.tokens import encode_column

MAGIC = b"SIFTIDS1"
BLOCK = 2048
SEGMENT = 1 << 23
CONTEXTS = 512
NONE = 0xFFFF
BITS0 = 18
LEAST0 = 1024  # of 2**16: what order 0 keeps at least
U = np.uint64
WORD = U(32)
LOW_RANGE = U(1 << 32)


class _Mixer:
    """Predictions and weights of all blocks of a segment, one lane a block."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes, dtype=np.int64) * CONTEXTS
        self.t1 = np.full(lanes * CONTEXTS, NONE << 3, np.int32)
        self.t2 = np.full(lanes * CONTEXTS, NONE << 3, np.int32)
        self.state = np.arange(lanes, dtype=np.int64) * 16
        start = np.repeat((np.arange(8) * 6000 + 4000), 2)
        self.r2 = np.tile(start, lanes).astype(np.int32)
        self.r1 = np.tile(start, lanes).astype(np.int32)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)

    def predict(self, k: int):
        """Of the first k lanes: the predicted ids and the weights (of 2**16) of orders 2 and 1."""
        last, lane = self.last[:k], self.lane[:k]
        mixed = last * 40503
        self.i1 = lane + ((mixed >> 4) & (CONTEXTS - 1))
        self.i2 = lane + (((mixed + self.before[:k] * 60493) >> 4) & (CONTEXTS - 1))
        self.e1, self.e2 = self.t1[self.i1], self.t2[self.i2]
        p1, p2 = self.e1 >> 3, self.e2 >> 3
        agree = p1 == p2
        state = self.state[:k]
        self.s1 = state + ((self.e1 & 7) << 1)
        self.s2 = state + ((self.e2 & 7) << 1) + agree
        most = 65536 - LEAST0
        self.v1, self.v2 = self.r1[self.s1], self.r2[self.s2]
        q2 = np.minimum(self.v2, most)
        q2[p2 == NONE] = 0
        q1 = (self.v1 * (most - q2).astype(np.int64)) >> 16
        q1[agree | (p1 == NONE)] = 0
        return p1, p2, q1.astype(U), q2.astype(U)

    def update(self, k: int, ids: np.ndarray, p1, p2):
        for table, at, e, p, rate, s, r in ((self.t1, self.i1, self.e1, p1, self.r1, self.s1, self.v1),
                                            (self.t2, self.i2, self.e2, p2, self.r2, self.s2, self.v2)):
            hit = ids == p
            c = e & 7
            miss = np.where(c <= 1, ids << 3, e - c + (c >> 1))
            table[at] = np.where(hit, e + (c < 7), miss)
            rate[s] = r + ((hit.astype(np.int32) * 65536 - r) >> 5)
        self.before[:k] = self.last[:k]
        self.last[:k] = ids


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur and their shares of 2**BITS0, at least 1 each."""
    count = np.bincount(ids, minlength=1)
    seen = np.flatnonzero(count)
    if not len(seen):
        return seen, seen
    share = np.maximum(count[seen] * ((1 << BITS0) - len(seen)) // max(int(count.sum()), 1), 1).astype(np.int64)
    share[np.argmax(share)] += (1 << BITS0) - share.sum()
    return seen, share


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment of ids below 65535 as bytes."""
    ids = np.ascontiguousarray(ids, np.uint16)
    if len(ids) and int(ids.max()) >= NONE:
        raise ValueError("ids must lie below 65535")
    seen, share = _frequencies(ids)
    if len(seen) >= 1 << (BITS0 - 1) or (len(share) and share.min() < 1):
        raise ValueError("too many distinct ids")
    table = zlib.compress(seen.astype(np.uint16).tobytes() + share.astype(np.uint32).tobytes(), 6)
    lanes = -(-len(ids) // block)
    words, used = _encode_blocks(ids.astype(np.int32), lanes, block, seen, share)
    parts = [words[i, : used[i]].astype("<u4").tobytes() for i in range(lanes)]
    index = b"".join(struct.pack("<II", used[i], zlib.crc32(p)) for i, p in enumerate(parts))
    head = MAGIC + struct.pack("<IQII", block, len(ids), len(seen), len(table)) + table + index
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(parts)


def _encode_blocks(ids, lanes, block, seen, share):
    freq, cum = np.zeros(1 << 16, U), np.zeros(1 << 16, U)
    freq[seen] = share
    cum[seen] = np.cumsum(share) - share
    out = np.zeros((lanes, block + 3), np.uint32)
    used = np.zeros(lanes, np.int64)
    if not lanes:
        return out, used
    mixer = _Mixer(lanes)
    low, rng = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    rest = len(ids) - (lanes - 1) * block  # ids of the last block
    padded = np.zeros(lanes * block, np.int32)
    padded[: len(ids)] = ids
    steps = np.ascontiguousarray(padded.reshape(lanes, block).T)
    bits0, full = U(BITS0), U(65536)
    for t in range(block):
        k = lanes if t < rest else lanes - 1
        if not k:
            break
        x = steps[t, :k]
        p1, p2, q1, q2 = mixer.predict(k)
        hit2 = x == p2
        hit1 = ~hit2 & (x == p1) & (q1 > 0)
        hit2 &= q2 > 0
        both = q1 + q2
        at = np.where(hit2, U(0), np.where(hit1, q2, both))
        width = np.where(hit2, q2, np.where(hit1, q1, full - both))
        r = rng[:k] >> U(16)
        old = low[:k].copy()
        now = old + r * at
        span = r * width
        miss = np.flatnonzero(~(hit1 | hit2))
        r0, missed = span[miss] >> bits0, x[miss]
        now[miss] += r0 * cum[missed]
        span[miss] = r0 * freq[missed]
        for lane in np.flatnonzero(now < old).tolist():  # a carry runs into the words written
            i = used[lane] - 1
            while out[lane, i] == 0xFFFFFFFF:
                out[lane, i] = 0
                i -= 1
            out[lane, i] += 1
        put = np.flatnonzero(span < LOW_RANGE)
        out[put, used[put]] = (now[put] >> WORD).astype(np.uint32)
        used[put] += 1
        now[put] <<= WORD
        span[put] <<= WORD
        low[:k], rng[:k] = now, span
        mixer.update(k, x, p1, p2)
    every = np.arange(lanes)
    for shift in (WORD, U(0)):
        out[every, used] = ((low >> shift) & U(0xFFFFFFFF)).astype(np.uint32)
        used += 1
    return out, used


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError if it is damaged."""
    head = len(MAGIC) + 20
    if data[: len(MAGIC)] != MAGIC or len(data) < head:
        raise ValueError("not a segment of token ids")
    block, n, n_seen, n_table = struct.unpack("<IQII", data[len(MAGIC): head])
    lanes = -(-n // block)
    at = head + n_table + 8 * lanes
    if struct.unpack("<I", data[at: at + 4])[0] != zlib.crc32(data[:at]):
        raise ValueError("damaged header of a segment")
    table = zlib.decompress(data[head: head + n_table])
    seen = np.frombuffer(table, np.uint16, n_seen).astype(np.int64)
    share = np.frombuffer(table, np.uint32, n_seen, 2 * n_seen).astype(np.int64)
    index = np.frombuffer(data, "<u4", 2 * lanes, head + n_table).reshape(lanes, 2)
    at += 4
    words = np.zeros((lanes, int(index[:, 0].max(initial=0)) + 2), U)
    for i in range(lanes):
        size = 4 * int(index[i, 0])
        part = data[at: at + size]
        if len(part) != size or zlib.crc32(part) != index[i, 1]:
            raise ValueError(f"damaged block {i} of a segment")
        words[i, : size // 4] = np.frombuffer(part, "<u4")
        at += size
    return _decode_blocks(n, words, lanes, block, seen, share)


def _decode_blocks(n, words, lanes, block, seen, share):
    if not lanes:
        return np.zeros(0, np.uint16)
    freq, cum = np.zeros(1 << 16, U), np.zeros(1 << 16, U)
    freq[seen] = share
    cum[seen] = np.cumsum(share) - share
    owner = np.repeat(seen, share).astype(np.int32)
    mixer = _Mixer(lanes)
    code, rng = (words[:, 0] << WORD) | words[:, 1], np.full(lanes, 2**64 - 1, U)
    stride = words.shape[1]
    flat, at = words.ravel(), np.arange(lanes, dtype=np.int64) * stride + 2
    rest = n - (lanes - 1) * block
    out = np.zeros((block, lanes), np.uint16)
    bits0, full, one, most0 = U(BITS0), U(65536), U(1), U((1 << BITS0) - 1)
    for t in range(block):
        k = lanes if t < rest else lanes - 1
        if not k:
            break
        p1, p2, q1, q2 = mixer.predict(k)
        both = q1 + q2
        r = rng[:k] >> U(16)
        c = code[:k]
        v = np.minimum(c // r, full - one)
        hit2 = v < q2
        miss = v >= both
        hit1 = ~(hit2 | miss)
        at16 = np.where(hit2, U(0), np.where(hit1, q2, both))
        width = np.where(hit2, q2, np.where(hit1, q1, full - both))
        c = c - r * at16
        span = r * width
        x = np.where(hit2, p2, p1)
        miss = np.flatnonzero(miss)
        r0, c0 = span[miss] >> bits0, c[miss]
        found = owner[np.minimum(c0 // r0, most0).astype(np.int64)]
        x[miss] = found
        c[miss] = c0 - r0 * cum[found]
        span[miss] = r0 * freq[found]
        get = np.flatnonzero(span < LOW_RANGE)
        c[get] = (c[get] << WORD) | flat[at[get]]
        at[get] += 1
        span[get] <<= WORD
        code[:k], rng[:k] = c, span
        out[t, :k] = x
        mixer.update(k, x, p1, p2)
    return out.T.reshape(-1)[:n]


SEGMENTS = "part int, segment int, n_tokens bigint, doc_ids array<bigint>, counts array<bigint>, data binary"


def _encode(path: str, end_id: int, segment: int, block: int):
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("counts", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches):
        part, number = None, 0
        ids, counts, docs, held = [], [], [], 0

        def row():
            return pa.RecordBatch.from_pydict({
                "part": [part], "segment": [number], "n_tokens": [held], "doc_ids": [docs],
                "counts": [np.concatenate(counts).tolist()], "data": [encode_ids(np.concatenate(ids), block)]}, schema=schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            doc_ids = batch.column("doc_id").to_pylist()
            at = 0
            for got, count in encode_column(path, batch.column("text"), end_id):
                ids.append(got)
                counts.append(count)
                docs.extend(doc_ids[at: at + len(count)])
                at += len(count)
                held += len(got)
                if held >= segment:
                    yield row()
                    number += 1
                    ids, counts, docs, held = [], [], [], 0
        if docs:
            yield row()
    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, segment: int = SEGMENT, block: int = BLOCK) -> None:
    """Encode ``docs(doc_id, text)`` and write its ids, in ascending order of the id, as segments at ``path``.

    Ids are ordered null first; rows of one id by their text's hash.  A null text
    is empty: its only id is the end.  An empty table writes no segment.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = (docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("_h"))
            .repartitionByRange(n, *order).sortWithinPartitions(*order)
            .select("doc_id", "text", F.spark_partition_id().alias("part")))
    rows.mapInArrow(tidy(_encode(tokenizer, end_id, segment, block)), SEGMENTS).write.parquet(path)


def _decode(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ids = decode_ids(r["data"])
            counts = np.array(r["counts"], np.int64)
            stop = np.cumsum(counts)
            if int(stop[-1]) != len(ids) or len(ids) != r["n_tokens"]:
                raise ValueError("a segment's ids do not match its documents")
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((stop - counts).tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(r["doc_ids"], pa.int64()), pa.array(stop - counts + r["base"]), pa.array(counts), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digest(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files at ``path``."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    sizes = rows.select("part", "segment", "n_tokens")
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")
    # one row a part: what a window without a key sees
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    base = (sizes.select("part", "segment", inside.alias("inside")).join(before, "part")
            .select("part", "segment", (F.col("inside") + F.col("before")).alias("base")))
    if sizes.count() <= 1_000_000:
        base = F.broadcast(base)
    return rows.join(base, ["part", "segment"]).select("n_tokens", "doc_ids", "counts", "data", "base").mapInArrow(
        tidy(_decode), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` (at ``path``, or a new one in the shared folder) and read them back."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-ids")
    write_ids(docs, tokenizer, path, end_id)
    return read_digest(spark, path)
