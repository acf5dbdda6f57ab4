"""Benchmark decontamination by winnowing.

The fingerprint of a window of ``window`` words is the least hash among its
k-grams, so a span of ``window`` words or more that a document and a benchmark
item share has the same fingerprint on both sides: no shared span is missed.
Document fingerprints are looked up among the benchmark's; a hit is extended
over the words of its windows, compared word for word, and touching windows
form one span.  An item of fewer words than a window is one window of its own
length, with its whole hash as the fingerprint.

The benchmark is the stated query set: it is taken in blocks of at most
``block_words`` words, each sent to every task of a map over all documents
(no shuffle of texts); the spans that the blocks find are merged per document.
The result does not depend on the block size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType

from sift.llm.bytewords import LETTER_DIGIT, LOWER, U, chunks, gram_hashes, row_of, word_hashes, word_spans
from sift.llm.common import tidy, written

WINDOW = 10
K = 5
BLOCK_WORDS = 250_000
FILTER_BITS = 22


class BenchmarkBlock:
    """Windows of some benchmark items: fingerprints per window length, window words -> items."""

    def __init__(self, window: int, k: int):
        self.window, self.k = window, k
        self.items: dict[bytes, list[str]] = {}
        self.prints: dict[int, set[int]] = {}
        self.words = 0

    def add(self, item_id, text: str) -> None:
        buf = np.frombuffer(text.encode(), np.uint8)
        h, starts, ends, _ = word_hashes(buf, np.array([0, len(buf)]), LETTER_DIGIT)
        n = min(self.window, len(h))
        if not n:
            return
        low = LOWER[buf].tobytes()
        words = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        for i in range(len(words) - n + 1):
            ids = self.items.setdefault(b" ".join(words[i: i + n]), [])
            if not ids or ids[-1] != item_id:
                ids.append(item_id)
        self.prints.setdefault(n, set()).update(fingerprints(h, n, self.k, self.window).tolist())
        self.words += len(words)

    def ready(self):
        """Sorted fingerprints and a bit filter before them, by window length."""
        out = []
        for n, found in sorted(self.prints.items()):
            keys = np.array(sorted(found), U)
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(keys >> U(64 - FILTER_BITS)).astype(np.int64)] = True
            out.append((n, keys, bits))
        return out


def fingerprints(h: np.ndarray, n: int, k: int, window: int) -> np.ndarray:
    """Fingerprint of each n-word window of a run of words."""
    k = k if n == window and window >= k else n
    g = gram_hashes(h, k)
    low = g[: len(g) - (n - k)].copy()
    for j in range(1, n - k + 1):
        np.minimum(low, g[j: j + len(low)], out=low)
    return low


def scan(block_parts, items, k, window, buf, offs):
    """Per text: (row, word count, hit spans as [start, end) words, items)."""
    h, starts, ends, first = word_hashes(buf, offs, LETTER_DIGIT)
    rows = row_of(first)
    hits: dict[int, list] = {}
    for n, keys, bits in block_parts:
        low = fingerprints(h, n, k, window) if len(h) >= n else np.zeros(0, U)
        may = np.flatnonzero(bits[(low >> U(64 - FILTER_BITS)).astype(np.int64)])
        may = may[rows[may] == rows[may + n - 1]]  # a window lies in one text
        at = np.searchsorted(keys, low[may])
        may = may[keys[np.minimum(at, len(keys) - 1)] == low[may]]
        for i in may.tolist():
            words = b" ".join(LOWER[buf[starts[j]: ends[j]]].tobytes() for j in range(i, i + n))
            ids = items.get(words)
            if ids is not None:
                r = int(rows[i])
                spans, found = hits.setdefault(r, [[], set()])
                a = i - int(first[r])
                if spans and a <= spans[-1][1] and spans[-1][0] <= a:
                    spans[-1][1] = max(spans[-1][1], a + n)
                else:
                    spans.append([a, a + n])
                found.update(ids)
    return hits


def merge_spans(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


MATCH_SCHEMA = "doc_id bigint, row_key string, n_words bigint, spans array<array<bigint>>, items array<string>"


def _matcher(broadcast, k, window):
    def run(batches):
        block = broadcast.value
        parts = block.ready()
        for batch in batches:
            cols = {"doc_id": [], "row_key": [], "n_words": [], "spans": [], "items": []}
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist()
            for i, j, buf, offs in chunks(batch.column("text")):
                _, _, first = word_spans(buf, offs, LETTER_DIGIT)
                hits = scan(parts, block.items, k, window, buf, offs)
                for r in range(j - i):
                    spans, found = hits.get(r, ([], ()))
                    cols["doc_id"].append(ids[i + r])
                    cols["row_key"].append(keys[i + r])
                    cols["n_words"].append(int(first[r + 1] - first[r]))
                    cols["spans"].append(merge_spans(spans))
                    cols["items"].append(sorted(found))
            yield pa.RecordBatch.from_pydict(cols, schema=pa.schema([
                ("doc_id", pa.int64()), ("row_key", pa.string()), ("n_words", pa.int64()),
                ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]))
    return run


def benchmark_blocks(benchmark: DataFrame, window: int, k: int, block_words: int):
    """Blocks of the benchmark, streamed to the driver one at a time."""
    block = BenchmarkBlock(window, k)
    for item_id, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if text is not None and item_id is not None:
            block.add(item_id, text)
            if block.words >= block_words:
                yield block
                block = BenchmarkBlock(window, k)
    yield block


def contamination_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K,
                        block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` x ``benchmark(item_id, text)`` -> one row per document
    ``(doc_id, n_words, spans, items)``: hit spans as [start, end) word positions, merged,
    and the ids (as strings, sorted) of the items that have an occurring window.

    A null or empty text has no words, spans or items; an item with a null id or no
    words has no window.  Repeated rows, and rows with a null id, each give a row.
    Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and the window")
    sc = docs.sparkSession.sparkContext
    parts = []
    keyed = docs.select(F.col("doc_id").cast("bigint"), "text")
    for block in benchmark_blocks(benchmark, window, k, block_words):
        # one block needs no key to bring a document's blocks together
        key = F.lit("") if not parts and block.words < block_words else F.sha2(F.coalesce("text", F.lit("")), 256)
        found = keyed.withColumn("row_key", key).mapInArrow(tidy(_matcher(sc.broadcast(block), k, window)), MATCH_SCHEMA)
        parts.append(found)
    if len(parts) == 1:
        return parts[0].drop("row_key")
    # blocks are told apart by number; equal rows of one block are told apart by their rank
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("block", F.lit(i))
        both = p if both is None else both.unionByName(p)
    merged = (both.groupBy("doc_id", "row_key")
              .agg(F.max("n_words").alias("n_words"), F.sum(F.when(F.col("block") == 0, 1).otherwise(0)).alias("copies"),
                   F.flatten(F.collect_set("spans")).alias("spans"),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
    return (merged.select("doc_id", "n_words", F.udf(merge_spans, "array<array<bigint>>")("spans").alias("spans"),
                          "items", F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("_"))
            .drop("_"))


def report(spans: DataFrame) -> DataFrame:
    """The digest columns of ``contamination_spans``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x[1] - x[0])
    return spans.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _holds(broadcast, k, window):
    """Whether the column ``text`` holds a window of a block."""
    @arrow_udf(BooleanType())
    def holds(text: pa.Array) -> pa.Array:
        block = broadcast.value
        parts = block.ready()
        out = np.zeros(len(text), bool)
        for i, _, buf, offs in chunks(text):
            out[[i + r for r in scan(parts, block.items, k, window, buf, offs)]] = True
        return pa.array(out)
    return holds(F.col("text"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K,
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no window of the benchmark.

    Each row is judged by its own text, so null and repeated ids do not matter, and no
    text is shuffled.  After each block but the last the rows are written, so a task
    holds one block.
    """
    sc = docs.sparkSession.sparkContext
    kept = None
    for block in benchmark_blocks(benchmark, window, k, block_words):
        kept = docs if kept is None else written(kept, "clean")
        if block.items:
            kept = kept.filter(~_holds(sc.broadcast(block), k, window))
    return kept


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
