"""Periodic runs of words, from the maximal pairs of each text.

Per Arrow batch, all texts together (a word only matches words of its own text): words become ids by
an exact dictionary; suffixes that share their first words are sorted by prefix doubling, which only
handles groups that are still together; common-prefix lengths (LCP) come from the ranks of the
doublings.  The LCP-interval tree is then walked bottom-up.  Every interval holds its positions in
order, each with the class of the word on its left.  When a child joins an interval of length ``l``,
its positions meet the neighbours in the interval: two positions at distance ``d`` with unlike left words
are a maximal pair, and with ``d <= l / 3`` and ``l + d >= 6`` the stretch of ``l + d`` words from the smaller
one is a run of period ``d``; nothing has to be extended.  The pair of a run with its smallest period
lies side by side, as no occurrence of its ``l`` words starts in between.  The smaller list is merged into the
larger one.  Intervals of which all lists of positions lie too far apart for their LCPs are not walked.

Null and empty texts have no words and no run.  Repeated rows and ids are rows of their own; a null id
stays null.  Memory follows one text or ``CHUNK`` bytes of texts, whichever is more.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from sift.llm.bytewords import NOT_SPACE, chunks, row_of, word_spans
from sift.llm.common import bounded_batches, tidy

#: a run has at least LEAST words and at least TIMES periods
LEAST, TIMES = 6, 4
#: shortest common prefix of a run's pair: period 1 and LEAST words
SHORT = LEAST - 1
BLOCK = 1024
SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(SPAN)), ("collapsed", pa.string())])


class Positions:
    """Sorted positions in blocks, so that an insertion moves at most a block."""

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def around(self, x: int):
        """(neighbour before, neighbour after) of a position that is not in the list, or None."""
        b = max(bisect_left(self.heads, x) - 1, 0)
        block = self.blocks[b]
        i = bisect_left(block, x)
        before = block[i - 1] if i else None
        after = block[i] if i < len(block) else self.heads[b + 1] if b + 1 < len(self.heads) else None
        return before, after

    def add(self, x: int):
        b = max(bisect_left(self.heads, x) - 1, 0)
        block = self.blocks[b]
        insort(block, x)
        self.heads[b] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[b: b + 1] = [block[:half], block[half:]]
            self.heads[b: b + 1] = [block[0], block[half]]

    def __iter__(self):
        for block in self.blocks:
            yield from block


def _merge(a: Positions, b: Positions, l: int, left: np.ndarray, out: list) -> Positions:
    """Join two lists whose positions have ``l`` words in common, and note the runs of their pairs."""
    if a.size < b.size:
        a, b = b, a
    reach = l // (TIMES - 1)
    for x in b:
        for y in a.around(x):
            if y is not None:
                d = x - y if x > y else y - x
                if d <= reach and l + d >= LEAST and left[x] != left[y]:
                    out.append((min(x, y), l + d, d))
    for x in b:
        a.add(x)
    return a


def interval_runs(order: list[int], lcp: list[int], left, out: list) -> None:
    """Walk the LCP-interval tree of sorted suffixes ``order``; ``lcp[i]`` is that of suffixes i and i + 1."""
    stack: list[tuple[int, Positions]] = []
    for i, l in enumerate([*lcp, -1]):
        child = Positions(order[i])
        while stack and stack[-1][0] > l:
            top, open_list = stack.pop()
            child = _merge(open_list, child, top, left, out)
        if stack and stack[-1][0] == l:
            stack[-1] = (l, _merge(stack[-1][1], child, l, left, out))
        else:
            stack.append((l, child))


def _grouped(key: np.ndarray):
    """(order, start of each element's group in that order) of keys."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return order, np.repeat(starts, np.diff(np.append(starts, len(k))))


def _shared(start: np.ndarray) -> np.ndarray:
    """Mask of elements (in order) whose group has two or more."""
    size = np.bincount(start, minlength=len(start))
    return size[start] > 1


def sorted_suffixes(words: np.ndarray, doc: np.ndarray, end: np.ndarray):
    """(positions, LCPs with the next) of the suffixes that share SHORT words or more with a neighbour.

    ``doc`` and ``end`` give each word's text and that text's end.  An LCP below SHORT is given as 0.
    """
    n = len(words)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not n:
        return none
    order, start = _grouped(doc * np.int64(words.max() + 1) + words)
    rank = np.empty(n, np.int64)
    rank[order] = start
    keep = _shared(start)
    pos = order[keep]
    levels, h, wanted = [], 1, None
    while len(pos):
        levels.append((h, pos, rank[pos]))
        if h < SHORT:
            wanted = pos
        nxt = pos + h
        inside = nxt < end[pos]
        second = np.where(inside, rank[np.where(inside, nxt, 0)], -1)
        key = rank[pos] * np.int64(n + 1) + second + 1
        order, start = _grouped(key)
        pos = pos[order]
        # a group keeps its place: its first rank, plus the offset of the new group in it
        old = rank[pos]
        first = np.searchsorted(old, old)
        fresh = old + start - first
        rank[pos] = fresh
        keep = _shared(start)
        pos = pos[keep]
        h *= 2
    if h <= SHORT - 1:  # nothing shares more than h - 1 words
        return none
    sa = wanted[np.argsort(rank[wanted], kind="stable")]
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(len(a), np.int64)
    same_text = doc[a] == doc[b]
    group = np.full(n + 1, -1, np.int64)
    for h, at, g in reversed(levels):
        group[at] = g
        i, j = np.minimum(a + lcp, n), np.minimum(b + lcp, n)
        lcp[same_text & (group[i] >= 0) & (group[i] == group[j])] += h
        group[at] = -1
    lcp[lcp < SHORT] = 0
    use = np.zeros(len(sa), bool)
    use[:-1] |= lcp > 0
    use[1:] |= lcp > 0
    return sa[use], np.append(lcp, 0)[use]


def runs_of(words: np.ndarray, first: np.ndarray):
    """Runs ``(position, length, period)`` of concatenated texts; ``first`` has each text's first word and the total."""
    doc = row_of(first)
    end = first[1:][doc]
    sa, lcp = sorted_suffixes(words, doc, end)
    if not len(sa):
        return np.zeros((0, 3), np.int64)
    # blocks of suffixes that share SHORT words; a block's least distance and largest LCP rule most of them out
    block = np.cumsum(np.append(0, lcp[:-1] == 0))
    starts = np.flatnonzero(np.append(True, lcp[:-1] == 0))
    by_place = np.lexsort((sa, block))
    gap = np.append(np.iinfo(np.int64).max, np.diff(sa[by_place]))
    gap[starts] = np.iinfo(np.int64).max
    near = np.minimum.reduceat(gap, starts)
    deep = np.maximum.reduceat(lcp, starts)
    ends = np.append(starts[1:], len(sa))
    left = np.empty(len(words), np.int64)
    left[1:] = words[:-1]
    left[first[:-1][np.diff(first) > 0]] = -1
    found: list[tuple[int, int, int]] = []
    for s, e in zip(*(x[near <= deep // (TIMES - 1)].tolist() for x in (starts, ends))):
        interval_runs(sa[s:e].tolist(), lcp[s: e - 1].tolist(), left, found)
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.array(found, np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # the same stretch with a multiple of its smallest period
    once = np.ones(len(runs), bool)
    once[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[once]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _words(buf: np.ndarray, offs: np.ndarray):
    """(array of words, first word of each text and total)."""
    starts, ends, first = word_spans(buf, offs, NOT_SPACE)
    data = buf[NOT_SPACE[buf]] if len(buf) else buf
    at = np.append(0, np.cumsum(ends - starts))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))), first


def _joined(words: pa.LargeStringArray, keep: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Texts of the kept words, joined by a blank; ``kept`` has the kept words before each text, and all."""
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
    data = np.frombuffer(words.buffers()[2], np.uint8) if at[-1] else np.zeros(0, np.uint8)
    length = np.diff(at)
    size = length[keep] + 1
    size[kept[1:][np.diff(kept) > 0] - 1] -= 1  # no blank after a text's last word
    end = np.cumsum(size)
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    letter = np.ones(len(out), bool)
    letter[(end - 1)[size > length[keep]]] = False
    out[letter] = data[np.repeat(keep, length)]
    bounds = np.append(0, end)[kept]
    return pa.LargeStringArray.from_buffers(len(kept) - 1, pa.py_buffer(bounds), pa.py_buffer(out)).cast(pa.string())


def _find(batches):
    for batch in batches:
        ids = batch.column("id")
        for a, b, buf, offs in chunks(batch.column("text")):
            words, first = _words(buf, offs)
            coded = words.dictionary_encode()
            runs = runs_of(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first)
            keep = kept_words(runs, len(words))
            kept = np.append(0, np.cumsum(keep))[first]
            row = np.searchsorted(first, runs[:, 0], "right") - 1
            bounds = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[row]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(SPAN))
            yield pa.RecordBatch.from_arrays([
                ids.slice(a, b - a), pa.array(np.diff(first)),
                pa.ListArray.from_arrays(pa.array(bounds), spans).cast(pa.list_(SPAN)), _joined(words, keep, kept)], schema=RUNS)


def find_runs(docs: DataFrame) -> DataFrame:
    """``(id, n_words, runs array<struct<start, length, period>>, collapsed)`` of ``docs(id, text)``.

    Words are `[^\\x20\\x09-\\x0D]+`; runs ascend by start, then period; ``collapsed`` has the words that no run
    contains after its first period, joined by one space.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(tidy(_find), from_arrow_schema(RUNS))


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, or for ids whose ``crc32`` h is divisible by 10 its words, those from the a-th on repeating with a period.

    With n words and ``g = floor(h / 10)``: ``a = g % n``, the period is ``1 + floor((n - a) / (3 + g % 8))``.
    """
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        spelled = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p)))
        return F.array_join(spelled, " ")

    # the one-element transform evaluates the words once
    rebuilt = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))[0]
    return F.when(h % 10 == 0, rebuilt).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """Digest of the runs of ``docs(doc_id, text)`` after planting: counts, the longest run and sums over all of them."""
    rows = find_runs(docs.select(F.col("doc_id").alias("id"), with_planted_runs(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.withColumn("_b", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_b.start")).alias("start"),
        F.col("_b.length").alias("length"), (-F.col("_b.period")).alias("period"),
        F.floor(1000 * F.col("_b.length") / -F.col("_b.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
