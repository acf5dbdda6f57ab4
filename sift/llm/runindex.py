"""Exact removal of repeated byte strings with run-length compressed BWT indexes.

A byte goes if some ``length``-byte string that covers it also starts earlier in
the corpus (smaller document id, or same document, earlier start).

1. Anchors.  Every window of ``length`` bytes selects its least k-gram hash (ties
   to the right), so equal windows select the same k-gram at the same offset.  A
   run of windows that select one anchor is a region of at most 2 * length - k
   bytes.  Regions of equal bytes and offset but the first are repeated whole: a
   task resolves those of its own rows at once, so a passage of any frequency
   reaches the shuffle once a task; Spark finds the first of the rest.
2. Anchors with several different regions (edits, ends of shared passages) get an
   index.  Regions of an anchor are ranked by their place in the corpus; the
   regions of rank r make a text, whose Burrows-Wheeler transform is stored as
   runs with suffix positions sampled at both ends of each run.  The regions of
   higher rank are streamed through it from right to left, all in step: a sign
   that continues the run is an LF step, any other jumps to the nearer run of
   that sign, and the length is cut to the common extension.  The matching
   statistics of a region say which of its windows start earlier.  A match of a
   whole window lies in a region of the same anchor, so no other text is needed.
3. An anchor of more than ``RANKS`` different regions would be streamed too often;
   its windows are compared by hash instead, each at most once a task.

Strings are told by 64-bit polynomial hashes, as everywhere in this package.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sift.llm.bytewords import BYTE, U, _powers, mix, text_buffers
from sift.llm.common import bounded_batches, tidy, written

LENGTH = 100
K = 32
PIECE = 1 << 20
FLUSH = 1 << 20
RANKS = 12
INDEX_BYTES = 1 << 20
LOW20 = U((1 << 20) - 1)
_rng = np.random.Generator(np.random.PCG64(31337))
SIGN = _rng.integers(1, 2**63, 257, dtype=np.uint64) * U(2) + U(1)


def pieces(column, length: int):
    """Yield (first row, bytes, offsets, start in the text) of at most PIECE bytes; a longer text comes
    in overlapping pieces, so each of its windows lies in one."""
    buf, offs = text_buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + PIECE, "right")) - 1)
        if offs[j] - offs[i] <= PIECE:
            yield i, buf[offs[i]: offs[j]], offs[i: j + 1] - offs[i], 0
        else:
            whole = buf[offs[i]: offs[j]]
            for a in range(0, len(whole) - length + 1, PIECE - length + 1):
                part = whole[a: a + PIECE]
                yield i, part, np.array([0, len(part)]), a
        i = j


def regions(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = K):
    """(row, start, end, anchor hash, hash of bytes and anchor offset) of every region of the texts."""
    n, w = len(buf), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(U), none.astype(U)
    up, down = _powers(max(n + 1, PIECE))
    sums = np.zeros(n + 1, U)
    np.cumsum(BYTE[buf] * up[:n], out=sums[1:])
    grams = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    # of equal hashes the one to the right has the smaller key
    low = (grams & ~LOW20) | (LOW20 - np.arange(len(grams), dtype=U))
    span = 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    m = n - length + 1
    low = np.minimum(low[:m], low[w - span: w - span + m])
    anchor = (LOW20 - (low & LOW20)).astype(np.int64)
    sizes = np.diff(offs)
    long = np.flatnonzero(sizes >= length)
    step = np.zeros(m + 1, np.int32)
    step[offs[long]] += 1
    step[offs[long] + sizes[long] - length + 1] -= 1
    valid = np.cumsum(step[:m]) > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    start, end = np.flatnonzero(new), np.flatnonzero(last) + length
    at = anchor[start]
    body = (sums[end] - sums[start]) * down[start]
    region = mix(body + mix((at - start).astype(U) * U(0x9E3779B97F4A7C15) + (end - start).astype(U)))
    return np.searchsorted(offs, start, "right") - 1, start, end, grams[at], region


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Maximal runs of intervals, by row; touching intervals join."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    # ends rise along a row once they are accumulated
    base = row.astype(np.int64) << 40
    high = np.maximum.accumulate(base + end)
    new = np.append(True, base[1:] + start[1:] > high[:-1])
    first = np.flatnonzero(new)
    return row[first], start[first], (np.append(high[first[1:] - 1], high[-1]) - base[first]).astype(np.int64)


def corpus_rank(doc_id: pa.Array, th: np.ndarray) -> np.ndarray:
    """Place of each row in corpus order (id, nulls first; then text hash); equal rows share one."""
    null = np.asarray(doc_id.is_null())
    ids = np.asarray(doc_id.fill_null(0))
    order = np.lexsort((th, ids, ~null))
    i, t, z = ids[order], th[order], null[order]
    new = np.ones(len(order), np.int64)
    new[1:] = (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (z[1:] != z[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def first_of(key: np.ndarray, rank: np.ndarray, start: np.ndarray):
    """(first, repeated): masks of the earliest place of each key (once), and of all later places."""
    order = np.lexsort((start, rank, key))
    k, r, s = key[order], rank[order], start[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(k) else np.zeros(0, np.int64)
    later = (r != r[head]) | (s != s[head])
    first, repeated = np.zeros(len(k), bool), np.zeros(len(k), bool)
    first[order[new]] = True
    repeated[order[later]] = True
    return first, repeated


FOUND = "kind int, fp bigint, ctx bigint, doc_id bigint, th bigint, a bigint, b bigint"
FOUND_SCHEMA = pa.schema([("kind", pa.int32())] + [(x, pa.int64()) for x in ("fp", "ctx", "doc_id", "th", "a", "b")])
SPANS = "doc_id bigint, th bigint, a bigint, b bigint"


def _found(kind, fp, ctx, doc_id, th, a, b):
    n = len(a)
    cols = [np.full(n, kind, np.int32), fp, ctx, doc_id, th, a, b]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.asarray(x).astype(np.int32 if i == 0 else np.int64))
                                       for i, x in enumerate(cols)], schema=FOUND_SCHEMA)


class _Held:
    """Places of keys that a task has met, until they are resolved against each other."""

    def __init__(self):
        self.cols, self.docs, self.ths, self.n, self.rows = [], [], [], 0, 0

    def add(self, row, *cols):
        self.cols.append((row + self.rows, *cols))
        self.n += len(row)

    def end_batch(self, doc_id: pa.Array, th: np.ndarray):
        self.docs.append(doc_id)
        self.ths.append(th)
        self.rows += len(th)

    def resolve(self, key_at: int):
        """The held columns, their documents, and the masks of first and repeated places."""
        cols = [np.concatenate(x) for x in zip(*self.cols)]
        doc_id = pa.concat_arrays(self.docs)
        th = np.concatenate(self.ths)
        first, repeated = first_of(cols[key_at], corpus_rank(doc_id, th)[cols[0]], cols[1])
        return cols, doc_id, th, first, repeated


def _anchors(length: int, k: int):
    """kind 0: first regions of a task; kind 1: spans of repeated ones."""
    def resolved(held):
        (row, start, end, fp, region), doc_id, th, first, again = held.resolve(4)
        yield _found(0, fp[first].astype(np.int64), region[first].astype(np.int64), doc_id.take(pa.array(row[first])),
                     th[row[first]], start[first], end[first])
        r, a, b = merged(row[again], start[again], end[again])
        yield _found(1, mix(r.astype(U) * U(0x10001) + a.astype(U)), np.zeros(len(r)), doc_id.take(pa.array(r)), th[r], a, b)

    def run(batches):
        held = _Held()
        for batch in batches:
            # a text of several pieces is one row; shifts make its starts absolute
            for i, buf, offs, shift in pieces(batch.column("text"), length):
                row, start, end, fp, region = regions(buf, offs, length, k)
                held.add(row + i, start - offs[row] + shift, end - offs[row] + shift, fp, region)
            held.end_batch(batch.column("doc_id").cast(pa.int64()), np.asarray(batch.column("th")))
            if held.n >= FLUSH:
                yield from resolved(held)
                held = _Held()
        if held.n:
            yield from resolved(held)
    return run


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of some texts, with sampled run ends."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        m = len(offs) - 1
        sizes = np.diff(offs)
        n = len(data) + m
        # every text is followed by a separator (sign 0); separators order by place, so suffixes end there
        sign = np.zeros(n + 1024, np.int64)
        where = np.arange(len(data)) + np.repeat(np.arange(m), sizes)
        sign[where] = data.astype(np.int64) + 1
        rest = np.zeros(n, np.int64)
        rest[where] = np.repeat(offs[1:], sizes) - np.arange(len(data))
        key = np.zeros(n, np.int64)
        for j in range(6):
            key = (key << 9) | np.where(rest > j, sign[j: n + j], 0)
        h, longest = 6, int(sizes.max(initial=0))
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n + 1024, np.int64)
            rank[order] = np.cumsum(np.append(1, ranked[1:] != ranked[:-1]))
            if h >= longest:
                break
            key = rank[:n] * (n + 1) + np.where(rest > h, rank[np.minimum(np.arange(n) + h, n - 1)], 0)
            h *= 2
        suffix = order
        bwt = sign[suffix - 1]  # the sign before the whole text is padding, a separator
        self.start = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.size = np.diff(np.append(self.start, n))
        self.sign = bwt[self.start]
        by_sign = np.argsort(self.sign, kind="stable")
        self.lf = np.empty(len(by_sign), np.int64)
        self.lf[by_sign] = np.cumsum(self.size[by_sign]) - self.size[by_sign]
        self.runs = len(by_sign)
        self.by_sign = self.sign[by_sign] * self.runs + by_sign
        self.at_start, self.at_end = suffix[self.start], suffix[self.start + self.size - 1]
        up, self.down = _powers(max(n + 1025, PIECE))
        self.sums = np.zeros(n + 1025, U)
        np.cumsum(SIGN[sign] * up[: n + 1024], out=self.sums[1:])

    def extension(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and y, up to ``most``."""
        low, high = np.zeros_like(most), most.copy()
        sx, sy, dx, dy = self.sums[x], self.sums[y], self.down[x], self.down[y]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) >> 1
            same = (self.sums[x + mid] - sx) * dx == (self.sums[y + mid] - sy) * dy
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)

    def matching_statistics(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """For every position of the streamed texts, the length of the longest prefix of its rest that occurs."""
        out = np.zeros(len(data), np.int64)
        sizes = np.diff(offs)
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = offs[1:][order], sizes[order]
        q = np.zeros(len(order), np.int64)
        pos = np.full(len(order), self.at_start[0])
        length = np.zeros(len(order), np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            k = int(np.searchsorted(-sizes, -t, "left"))  # texts longer than t
            at = ends[:k] - 1 - t
            c = data[at].astype(np.int64) + 1
            run = np.searchsorted(self.start, q[:k], "right") - 1
            new_q = self.lf[run] + q[:k] - self.start[run]
            new_pos, new_len = pos[:k] - 1, length[:k] + 1
            off = np.flatnonzero(self.sign[run] != c)
            if len(off):
                key = c[off] * self.runs + run[off]
                x = np.searchsorted(self.by_sign, key)
                after, before = self.by_sign[np.minimum(x, self.runs - 1)], self.by_sign[np.maximum(x - 1, 0)]
                has_after = (x < self.runs) & (after // self.runs == c[off])
                has_before = (x > 0) & (before // self.runs == c[off])
                after, before = after % self.runs, before % self.runs
                p, most = pos[off], length[off]
                e_after = self.extension(p, self.at_start[after], np.where(has_after, most, 0))
                e_before = self.extension(p, self.at_end[before], np.where(has_before, most, 0))
                take = has_before & (~has_after | (e_before >= e_after))
                any_ = has_before | has_after
                new_q[off] = np.where(any_, np.where(take, self.lf[before] + self.size[before] - 1, self.lf[after]), 0)
                new_pos[off] = np.where(any_, np.where(take, self.at_end[before], self.at_start[after]) - 1, self.at_start[0])
                new_len[off] = np.where(any_, np.where(take, e_before, e_after) + 1, 0)
            q[:k], pos[:k], length[:k] = new_q, new_pos, new_len
            out[at] = new_len
        return out


def _gather(data: np.ndarray, offs: np.ndarray, which: np.ndarray):
    sizes = offs[which + 1] - offs[which]
    to = np.append(0, np.cumsum(sizes))
    return data[np.repeat(offs[which] - to[:-1], sizes) + np.arange(int(to[-1]))], to


def earlier_windows(data: np.ndarray, offs: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the regions (grouped by anchor, in corpus order) occur in an earlier region: a mask
    over ``data``, true at the start of such a window."""
    out = np.zeros(len(data), bool)
    new = np.append(True, anchor[1:] != anchor[:-1])
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.arange(len(anchor)) - head[group]
    size = np.diff(np.append(head, len(anchor)))[group]
    for r in range(int(size.max(initial=1)) - 1):
        index = RunIndex(*_gather(data, offs, np.flatnonzero((rank == r) & (size > r + 1))))
        later = np.flatnonzero(rank > r)
        streamed, to = _gather(data, offs, later)
        found = np.flatnonzero(index.matching_statistics(streamed, to) >= length)
        text = np.searchsorted(to, found, "right") - 1
        out[offs[later[text]] + found - to[text]] = True
    return out


REGION = "kind int, fp bigint, doc_id bigint, th bigint, a bigint, b bigint, data binary"
REGION_SCHEMA = pa.schema([("kind", pa.int32()), ("fp", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("a", pa.int64()),
                           ("b", pa.int64()), ("data", pa.binary())])


def _region_rows(kind, fp, doc_id, th, a, b, data=None):
    n = len(a)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(fp).astype(np.int64)), doc_id, pa.array(th), pa.array(a), pa.array(b),
        pa.nulls(n, pa.binary()) if data is None else pa.array(data, pa.binary())], schema=REGION_SCHEMA)


def _cut_out(length: int):
    """Bytes of the regions (kind 0); of anchors with many regions the first windows of a task (kind 2), and
    the spans of its repeated ones (kind 1)."""
    def resolved(held):
        (row, start, key), doc_id, th, first, again = held.resolve(2)
        yield _region_rows(2, key[first], doc_id.take(pa.array(row[first])), th[row[first]], start[first], start[first] + length)
        r, a, b = merged(row[again], start[again], start[again] + length)
        yield _region_rows(1, mix(r.astype(U) * U(0x10001) + a.astype(U)), doc_id.take(pa.array(r)), th[r], a, b)

    def run(batches):
        held = _Held()
        for batch in batches:
            buf, offs = text_buffers(batch.column("text"))
            lists = batch.column("regions")
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            fp, a, b = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("fp", "a", "b"))
            many = flat.field("many").to_numpy(zero_copy_only=False)
            doc_id, th = batch.column("doc_id"), np.asarray(batch.column("th"))
            few = np.flatnonzero(~many)
            if len(few):
                lo, hi = offs[owner[few]] + a[few], offs[owner[few]] + b[few]
                raw = memoryview(buf)
                yield _region_rows(0, fp[few], doc_id.take(pa.array(owner[few])), th[owner[few]], a[few], b[few],
                                   [bytes(raw[x:y]) for x, y in zip(lo.tolist(), hi.tolist())])
            many = np.flatnonzero(many)
            for i in range(0, len(many), 4096):
                part = many[i: i + 4096]
                lo = offs[owner[part]] + a[part]
                size = b[part] - a[part]
                to = np.append(0, np.cumsum(size))
                data = buf[np.repeat(lo - to[:-1], size) + np.arange(int(to[-1]))]
                up, down = _powers(max(len(data) + 1, PIECE))
                sums = np.append(U(0), np.cumsum(BYTE[data] * up[: len(data)]))
                n_win = size - length + 1
                win = np.repeat(to[:-1], n_win) + _within(n_win)
                held.add(np.repeat(owner[part], n_win), np.repeat(a[part], n_win) + _within(n_win), mix((sums[win + length] - sums[win]) * down[win]))
            held.end_batch(doc_id, th)
            if held.n >= FLUSH:
                yield from resolved(held)
                held = _Held()
        if held.n:
            yield from resolved(held)
    return run


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count in turn."""
    stop = np.cumsum(counts)
    return np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - counts, counts)


def _stream(length: int):
    """Sorted regions -> the spans of their windows that start earlier."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def spans(table: pa.Table):
        data, offs = _bytes_of(table["data"].combine_chunks())
        start = np.asarray(table["a"])
        mark = earlier_windows(data, offs, np.asarray(table["fp"]), length)
        at = np.flatnonzero(mark)
        text = np.searchsorted(offs, at, "right") - 1
        a = start[text] + at - offs[text]
        row, a, b = merged(text, a, a + length)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().take(take), table["th"].combine_chunks().take(take), pa.array(a), pa.array(b)],
                                          schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("data").nbytes
            if size >= INDEX_BYTES:
                table = pa.Table.from_batches(held)
                fp = np.asarray(table["fp"])
                cut = int(np.searchsorted(np.cumsum(fp[::-1] != fp[-1]) > 0, True))  # rows of the last anchor may go on
                whole = len(fp) - cut
                at = 0
                while at < whole:  # blocks of whole anchors
                    to = min(whole, at + max(1, INDEX_BYTES // 128))
                    while to < whole and fp[to] == fp[to - 1]:
                        to += 1
                    yield spans(table.slice(at, to - at))
                    at = to
                held = table.slice(whole).to_batches()
                size = sum(x.column("data").nbytes for x in held) if whole else 0
        if held:
            table = pa.Table.from_batches(held)
            fp = np.asarray(table["fp"])
            at = 0
            while at < len(fp):
                to = min(len(fp), at + max(1, INDEX_BYTES // 128))
                while to < len(fp) and fp[to] == fp[to - 1]:
                    to += 1
                yield spans(table.slice(at, to - at))
                at = to
    return run


def _bytes_of(column: pa.Array):
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0]: offs[-1]], offs - offs[0]


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """``docs(doc_id, text)`` -> spans ``(doc_id, th, a, b)``, th the text's xxhash64: bytes [a, b) of the text
    are covered by ``length``-byte strings that start earlier.  Spans may overlap and repeat.

    Texts of one id are in order of th; rows of equal id and text are one text here.
    """
    if not 1 <= k <= length <= 500:
        raise ValueError("1 <= k <= length <= 500")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("th")).filter(F.octet_length("text") >= length)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    # dealt by anchor once: that serves the windows over (anchor, region) and over the anchor
    rows = texts.mapInArrow(tidy(_anchors(length, k)), FOUND).repartition(n, "fp")
    place = [F.col("doc_id").asc_nulls_first(), F.col("th"), F.col("a")]
    ranked = (rows.withColumn("place", F.rank().over(Window.partitionBy("fp", "ctx").orderBy(*place)))
              .withColumn("different", F.sum((F.col("place") == 1).cast("int")).over(Window.partitionBy("fp")))
              .filter("kind = 1 or place > 1 or different > 1"))
    found = written(ranked.select("kind", "fp", "doc_id", "th", "a", "b", "place", "different"), "anchors")
    spans = found.filter("kind = 1 or place > 1").select("doc_id", "th", "a", "b")
    regions_of = (found.filter("kind = 0 and place = 1").groupBy("doc_id", "th")
                  .agg(F.collect_list(F.struct("fp", "a", "b", (F.col("different") > RANKS).alias("many"))).alias("regions"))
                  .withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th"))
    cut = written(texts.join(regions_of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
                   .select("doc_id", "th", "text", "regions").mapInArrow(tidy(_cut_out(length)), REGION), "regions")
    streamed = (cut.filter("kind = 0").select("fp", "doc_id", "th", "a", "data").dropDuplicates(["fp", "doc_id", "th", "a"])
                .repartition(n, "fp").sortWithinPartitions("fp", *place).mapInArrow(tidy(_stream(length)), SPANS))
    windows = (cut.filter("kind = 2").withColumn("place", F.rank().over(Window.partitionBy("fp").orderBy(*place)))
               .filter("place > 1").select("doc_id", "th", "a", "b"))
    return spans.unionByName(cut.filter("kind = 1").select("doc_id", "th", "a", "b")).unionByName(streamed).unionByName(windows)


def without(text: bytes, spans) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs)."""
    if not len(spans):
        return text, 0, 0
    row = np.zeros(len(spans), np.int64)
    _, a, b = merged(row, np.array([s["a"] for s in spans]), np.array([s["b"] for s in spans]))
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist()):
        kept.append(text[at:x])
        at = y
    kept.append(text[at:])
    return b"".join(kept), int((b - a).sum()), len(a)


def _digest(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            text = text or b""
            kept, removed, runs = without(text, spans or ())
            rows.append((len(text), removed, runs, kept, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th")]
                                         + [pa.array(c, t.type) for c, t in zip(cols, list(schema)[2:])], schema=schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256)``, one row per row
    of ``docs``; ``kept``: the bytes that remain.

    A null text is empty.  A text shorter than ``length`` loses nothing.  Rows with a null
    id come before all others.  Of rows with equal id and text, one is the first and the
    others are its copies.  An empty table gives an empty table.  Only ``doc_id`` and ``text``
    are read.
    """
    # written before the texts are shuffled to them, so the regions' shuffles are gone by then
    spans = written(repeated_spans(docs, length, k).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
                    .withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th"), "spans")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    out = (rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
           .select("doc_id", "th", "text", "spans")
           .mapInArrow(_digest, "doc_id bigint, th bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"))
    # copies of a row lose all they have
    copy = (F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("n_bytes")) > 1) & (F.col("n_bytes") >= length)
    gone = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("bigint"), "kept": F.lit(b""), "kept_sha256": F.lit(hashlib.sha256().hexdigest())}
    return (out.withColumn("copy", copy)
            .select("doc_id", "n_bytes", *[F.when(F.col("copy"), v).otherwise(F.col(c)).alias(c) for c, v in gone.items()]))
