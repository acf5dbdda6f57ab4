"""Interpolated modified Kneser-Ney model, of bigrams or any higher order, counted in Spark, memory-mapped by the workers.

Tokens are 64-bit word hashes.  Three Spark jobs build the model:

1. words -> their counts, by word bucket;
2. bigrams -> their counts, by the bucket of the context (by that of the whole
   bigram for the few contexts that hold more than a share of a bucket), pre-
   aggregated in every task before the shuffle.  The task that merges a bucket
   writes its bigrams as sorted hash arrays with counts;
3. what a word needs besides (distinct predecessors; followers seen once, twice
   and more) by word bucket, written as sorted hash arrays too.

Blocks of packed arrays are shuffled instead of single rows.  The number of
buckets follows the input, so a bucket's size does not.  Files are written under
another name and renamed, so a task that runs twice does no harm.

Scoring maps the files of the shared folder into memory and looks every chunk's
distinct words and bigrams up by binary search, in sorted order:
  p(w|h)  = max(c(hw) - D(c), 0) / c(h) + gamma(h) p1(w)
  p1(w)   = max(k(w) - D'(k), 0) / K + gamma' / (V + 1)
with k(w) the distinct predecessors of w, K their sum, and the discounts of
Chen and Goodman from the counts of counts.  An unseen context leaves p1; all
unknown words share one place of the V + 1.

Orders above 2 (``order``) recur: p_n(w|h) = max(c - D_n(c), 0) / sum c + gamma p_n-1,
with c the count at the highest order and below it the number of distinct words before
the n-gram (the count for n-grams at the start of a text, which nothing precedes).
They are counted in several passes (``WAVES``), and their keys are stored as a directory and short remainders.
N-grams are dealt by the last word of their context (for hot words by that word and the
next), so the task that merges a bucket holds all lower orders of its n-grams too, and
one shuffle serves all orders.  Only the contexts that end in a hot word are merged once more.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.llm.bytewords import NOT_SPACE, U, chunks, mix, word_hashes
from sift.llm.common import bounded_batches, cut_lineage, drop_finished, mounted, shared_path, tidy

START, END = U(0x5354415254), U(0x454E44)
PAIR = U(0xD6E8FEB86659FD93)
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 1 << 16
FLUSH = 1 << 22
#: passes over the texts that count n-grams of an order above 2: the buckets up to these shares.  A pass's shuffle
#: lies beside the files of all passes before, so the passes get smaller.
WAVES = (0.46, 0.74, 0.90, 1.0)
OPEN_BUCKETS = 2048
SCORE_CHUNK = 1 << 22
BLOCK = "bucket int, kind int, a binary, b binary, c binary, d binary"
BLOCK_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32())] + [(x, pa.binary()) for x in "abcd"])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((mix(h) >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def bigram_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * PAIR + w)


def bigram_bucket(h: np.ndarray, key: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    spread = bucket_of(h, buckets)
    if len(hot):
        at = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        spread[at] = bucket_of(key[at], buckets)
    return spread


def token_stream(buf, offs):
    """(context hash, token hash, tokens of each text) with the end token after each text."""
    h, _, _, first = word_hashes(buf, offs, NOT_SPACE)
    n = np.diff(first) + 1
    at_end = np.cumsum(n) - 1
    w = np.empty(int(n.sum()), U)
    inside = np.ones(len(w), bool)
    inside[at_end] = False
    w[inside] = h
    w[at_end] = END
    ctx = np.empty_like(w)
    ctx[1:] = w[:-1]
    if len(n):
        ctx[np.append(0, at_end[:-1] + 1)] = START
    return ctx, w, n


def _blocks(kind: int, bucket: np.ndarray, arrays: list[np.ndarray]):
    """One row per bucket of the entries, which are sorted by it."""
    if not len(bucket):
        return None
    cut = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(bucket))
    cols = [[x[s:e].tobytes() for s, e in zip(starts, ends)] for x in arrays]
    empty = pa.nulls(len(starts), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), kind, np.int32))]
        + [pa.array(c, pa.binary()) for c in cols] + [empty] * (4 - len(cols)), schema=BLOCK_SCHEMA)


def _count_words(buckets: int):
    def flush(held):
        w, c = np.unique(np.concatenate(held), return_counts=True)
        b = bucket_of(w, buckets)
        order = np.argsort(b, kind="stable")
        return _blocks(0, b[order], [w[order], c[order].astype(np.int64)])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column("text")):
                _, w, _ = token_stream(buf, offs)
                held.append(w)
                n += len(w)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)
    return run


def _column(table: pa.Table, name: str, kind: int, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for k, x in zip(table["kind"].to_pylist(), table[name].to_pylist()) if k == kind and x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _merge_words(table: pa.Table) -> pa.Table:
    words, at = np.unique(_column(table, "a", 0, U), return_inverse=True)
    count = np.bincount(at, weights=_column(table, "b", 0, np.int64), minlength=len(words)).astype(np.int64)
    bucket = table["bucket"][0].as_py()
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "kind": pa.array([0], pa.int32()),
                     "a": pa.array([words.tobytes()], pa.binary()), "b": pa.array([count.tobytes()], pa.binary()),
                     "c": pa.nulls(1, pa.binary()), "d": pa.nulls(1, pa.binary())}, schema=BLOCK_SCHEMA)


def _totals(batches):
    for batch in batches:
        b = [np.frombuffer(x, np.int64) for x in batch.column("b").to_pylist()]
        yield pa.RecordBatch.from_pydict({"v": [len(x) for x in b], "n": [int(x.sum()) for x in b]})


def _hot_words(least: float):
    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                at = np.frombuffer(b, np.int64) > least
                yield pa.RecordBatch.from_pydict({"w": np.frombuffer(a, U)[at].astype(np.int64)})
    return run


def _count_bigrams(buckets: int, hot_words):
    def flush(held):
        h, w = (np.concatenate(x) for x in zip(*held))
        key = bigram_key(h, w)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(first, len(key)))
        h, w, key = h[order[first]], w[order[first]], key[first]
        b = bigram_bucket(h, key, buckets, hot_words.value)
        order = np.lexsort((h, b))
        h, w, b, count = h[order], w[order], b[order], count[order]
        # contexts are stored once with their number of entries
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (b[1:] != b[:-1])))
        cut = np.append(0, np.flatnonzero(np.diff(b)) + 1)
        rows = {x: [] for x in ("bucket", "a", "b", "c", "d")}
        for s, e in zip(cut, np.append(cut[1:], len(b))):
            i, j = np.searchsorted(new, [s, e])
            rows["bucket"].append(int(b[s]))
            rows["a"].append(h[new[i:j]].tobytes())
            rows["b"].append(np.diff(np.append(new[i:j], e)).astype(np.uint32).tobytes())
            rows["c"].append(w[s:e].tobytes())
            rows["d"].append(_pack(count[s:e]))
        return pa.RecordBatch.from_pydict(rows | {"kind": [0] * len(cut)}, schema=pa.schema([
            ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()),
            ("kind", pa.int32())])).select(BLOCK_SCHEMA.names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column("text")):
                h, w, _ = token_stream(buf, offs)
                held.append((h, w))
                n += len(w)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)
    return run


def gram_columns(buf, offs, order: int):
    """[w, the word before, the one before that, ..]: as many as the order, 0 beyond the start of a text; tokens of each text."""
    ctx, w, n = token_stream(buf, offs)
    at = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    cols = [w, ctx]
    for j in range(2, order):
        back = np.zeros_like(ctx)
        back[j - 1:] = ctx[: len(ctx) - j + 1]
        back[at < j - 1] = 0
        cols.append(back)
    return cols, n


def context_keys(cols) -> list[np.ndarray]:
    """Keys of the contexts of 1, 2, .. words."""
    keys = [cols[1]]
    for x in cols[2:]:
        keys.append(bigram_key(keys[-1], x))
    return keys


def _summed(key: np.ndarray, count: np.ndarray):
    """(sorted distinct keys, their rows, their summed counts)."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], order[first], np.add.reduceat(count[order], first) if len(key) else count


def _count_grams(order: int, buckets: int, hot_words, low: int, high: int):
    """N-grams of the buckets from ``low`` to below ``high``, summed in the task."""
    def flush(held):
        cols = [np.concatenate(x) for x in zip(*held)]
        key = bigram_key(context_keys(cols)[-1], cols[0])
        _, rows, count = _summed(key, np.ones(len(key), np.int64))
        cols = [x[rows] for x in cols]
        b = bigram_bucket(cols[1], bigram_key(cols[1], cols[0]), buckets, hot_words.value)
        by = np.lexsort((cols[1], b))
        b, count, cols = b[by], count[by], [x[by] for x in cols]
        h = cols[1]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (b[1:] != b[:-1])))
        cut = np.append(0, np.flatnonzero(np.diff(b)) + 1)
        rows = {x: [] for x in BLOCK_SCHEMA.names}
        for s, e in zip(cut, np.append(cut[1:], len(b))):
            i, j = np.searchsorted(new, [s, e])
            rows["bucket"].append(int(b[s]))
            rows["kind"].append(0)
            rows["a"].append(h[new[i:j]].tobytes())
            rows["b"].append(np.diff(np.append(new[i:j], e)).astype(np.uint32).tobytes())
            rows["c"].append(np.concatenate([cols[0][s:e], *[x[s:e] for x in cols[2:]]]).tobytes())
            rows["d"].append(_pack(count[s:e]))
        return pa.RecordBatch.from_pydict(rows, schema=BLOCK_SCHEMA)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column("text")):
                cols, _ = gram_columns(buf, offs, order)
                b = bigram_bucket(cols[1], bigram_key(cols[1], cols[0]), buckets, hot_words.value)
                mine = (b >= low) & (b < high)
                cols = [x[mine] for x in cols]
                held.append(cols)
                n += len(cols[0])
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)
    return run


def _save_keys(path: str, key: np.ndarray) -> None:
    """Sorted keys as a directory of their first bits (about 8 keys a place, 16 bits at most) and the 40 bits after those.

    A key that is not there is taken for one that is with a probability of 2**-40 at most per key of its place.
    """
    bits = min(16, max(0, len(key).bit_length() - 4))
    top = (key >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    rest = (key << U(bits)) >> U(24)
    _save(path, "place", np.searchsorted(top, np.arange((1 << bits) + 1)).astype(np.uint32 if len(key) < 1 << 32 else np.int64))
    _save(path, "high", (rest >> U(8)).astype(np.uint32))
    _save(path, "low", (rest & U(255)).astype(np.uint8))


KEYS = ("place", "high", "low")


def _find_short(files, wanted: np.ndarray):
    """``_find`` in the arrays that ``_save_keys`` wrote: a binary search inside the key's place."""
    place, high, low = files[:3]
    bits = (len(place) - 1).bit_length() - 1
    top = (wanted >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(wanted), np.int64)
    rest = (wanted << U(bits)) >> U(24)
    at, end = place[top].astype(np.int64), place[top + 1].astype(np.int64)
    last = end.copy()
    value = lambda i: (high[i].astype(U) << U(8)) | low[i]
    while len(open_ := np.flatnonzero(at < end)):
        mid = (at[open_] + end[open_]) >> 1
        less = value(mid) < rest[open_]
        at[open_[less]] = mid[less] + 1
        end[open_[~less]] = mid[~less]
    ok = at < last
    if len(high):
        ok[ok] = value(at[ok]) == rest[ok]
    return at, ok


def _save_counts(path: str, key: np.ndarray, count: np.ndarray, bucket: int) -> None:
    small = np.minimum(count, 255).astype(np.uint8)
    large = np.flatnonzero(small == 255)
    _save_keys(f"{path}/{bucket}", key)
    _save(f"{path}/{bucket}", "count", small)
    _save(f"{path}/{bucket}", "more", np.stack([large, count[large]]))


def _save_contexts(path: str, key: np.ndarray, stats: np.ndarray, bucket: int) -> None:
    """Sorted context keys, each with the number of its row (sum, followers seen once, twice, more) among the distinct rows."""
    order = np.argsort(key)
    key, stats = key[order], stats[order]
    small = stats[:, 0] < 1 << 16  # the other numbers are no larger
    packed, at = np.unique(stats[small] @ (1 << np.array([48, 32, 16, 0], np.uint64)).astype(np.int64), return_inverse=True)
    rows = np.stack([(packed.astype(U) >> U(x)) & U(0xFFFF) for x in (48, 32, 16, 0)], axis=1).astype(np.int64)
    which = np.empty(len(key), np.int64)
    which[small] = at
    which[~small] = len(rows) + np.arange((~small).sum())
    rows = np.concatenate([rows, stats[~small]])
    _save_keys(f"{path}/{bucket}", key)
    _save(f"{path}/{bucket}", "which", which.astype(np.min_scalar_type(len(rows))))
    _save(f"{path}/{bucket}", "rows", rows)


def _context_stats(key: np.ndarray, count: np.ndarray):
    ctx, at = np.unique(key, return_inverse=True)
    return ctx, np.stack([np.bincount(at, weights=x, minlength=len(ctx)) for x in (count, count == 1, count == 2, count > 2)],
                         axis=1).astype(np.int64)


def _merge_grams(path: str, order: int, buckets: int, hot_words):
    """Writes a bucket's n-grams of all orders and their contexts; returns the distinct predecessors of words (kind 2),
    contexts that end in a hot word (kind 5) and the counts of counts of order n (kind 100 + n)."""
    def run(table: pa.Table) -> pa.Table:
        bucket, hot = table["bucket"][0].as_py(), hot_words.value
        parts, cs = [], []
        for a, b, c, d in zip(*(table[x].to_pylist() for x in "abcd")):
            h = np.repeat(np.frombuffer(a, U), np.frombuffer(b, np.uint32))
            rest = np.frombuffer(c, U).reshape(order - 1, len(h))
            parts.append([rest[0], h, *rest[1:]])
            cs.append(_unpack(d, len(h)))
        cols = [np.concatenate(x) for x in zip(*parts)]
        _, rows, c = _summed(bigram_key(context_keys(cols)[-1], cols[0]), np.concatenate(cs))
        cols = [x[rows] for x in cols]
        out, own_keys, own_stats = [], [], []
        above = np.zeros(0, np.int64)  # a row of every n-gram of the order above
        for n in range(order, 1, -1):
            raw = cols[n - 1] != 0
            if n < order:
                raw &= cols[n] == 0
            raw = np.flatnonzero(raw)
            at = np.concatenate([raw, above])
            some = [x[at] for x in cols[:n]]
            ctx = context_keys(some)[-1]
            key, first, count = _summed(bigram_key(ctx, some[0]), np.append(c[raw], np.ones(len(above), np.int64)))
            above, ctx, h = at[first], ctx[first], some[1][first]
            _save_counts(f"{path}/grams{n}", key, count, bucket)
            is_hot = np.isin(h, hot)
            keys, stats = _context_stats(ctx[~is_hot], count[~is_hot])
            own_keys.append(keys)
            own_stats.append(stats)
            keys, stats = _context_stats(ctx[is_hot], count[is_hot])
            b = bucket_of(keys, buckets)
            by = np.argsort(b, kind="stable")
            out.append(_blocks(5, b[by], [keys[by], stats[by]]))
            of = np.bincount(np.minimum(count, 5), minlength=6)[1:5].astype(np.int64)
            out.append(_blocks(100 + n, np.zeros(4, np.int64), [of]))
        _save_contexts(f"{path}/contexts", np.concatenate(own_keys), np.concatenate(own_stats), bucket)
        words, before = np.unique(cols[0][above], return_counts=True)
        b = bucket_of(words, buckets)
        by = np.argsort(b, kind="stable")
        out.append(_blocks(2, b[by], [words[by], before[by].astype(np.uint32)]))
        return pa.Table.from_batches([x for x in out if x is not None], schema=BLOCK_SCHEMA)
    return run


def _merge_words_and_contexts(path: str):
    words = _merge_stats(path)

    def run(table: pa.Table) -> pa.Table:
        keys = _column(table, "a", 5, U)
        if len(keys):
            stats = _column(table, "b", 5, np.int64).reshape(-1, 4)
            ctx, at = np.unique(keys, return_inverse=True)
            total = np.zeros((len(ctx), 4), np.int64)
            np.add.at(total, at, stats)
            _save_contexts(f"{path}/hot", ctx, total, table["bucket"][0].as_py())
        return words(table)
    return run


def _pack(count: np.ndarray) -> bytes:
    """Counts as bytes; 255 stands for one of the 64-bit counts that follow in order."""
    small = np.minimum(count, 255).astype(np.uint8)
    return small.tobytes() + count[small == 255].astype(np.int64).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    small = np.frombuffer(data, np.uint8, n)
    count = small.astype(np.int64)
    count[small == 255] = np.frombuffer(data, np.int64, offset=n)
    return count


def _save(path: str, name: str, array: np.ndarray) -> None:
    os.makedirs(path, exist_ok=True)
    tmp = f"{path}/.{name}-{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        np.save(f, array)
    os.replace(tmp, f"{path}/{name}.npy")


def _merge_bigrams(path: str, buckets: int):
    """Writes a bucket's bigrams; returns what its words and contexts need, and the counts of counts (kind 3)."""
    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        hs, ws, cs = [], [], []
        for a, b, c, d in zip(*(table[x].to_pylist() for x in "abcd")):
            hs.append(np.repeat(np.frombuffer(a, U), np.frombuffer(b, np.uint32)))
            ws.append(np.frombuffer(c, U))
            cs.append(_unpack(d, len(ws[-1])))
        h, w, c = np.concatenate(hs), np.concatenate(ws), np.concatenate(cs)
        key = bigram_key(h, w)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.add.reduceat(c[order], first)
        h, w, key = h[order[first]], w[order[first]], key[first]
        small = np.minimum(count, 255).astype(np.uint8)
        _save(f"{path}/bigrams/{bucket}", "key", key)
        _save(f"{path}/bigrams/{bucket}", "count", small)
        large = np.flatnonzero(small == 255)
        _save(f"{path}/bigrams/{bucket}", "more", np.stack([large, count[large]]))
        ctx, at = np.unique(h, return_inverse=True)
        seen = [np.bincount(at, weights=x, minlength=len(ctx)).astype(np.uint32) for x in (count == 1, count == 2, count > 2)]
        words, before = np.unique(w, return_counts=True)
        out = []
        for kind, what, values in ((1, ctx, seen), (2, words, [before.astype(np.uint32)])):
            b = bucket_of(what, buckets)
            order = np.argsort(b, kind="stable")
            out.append(_blocks(kind, b[order], [x[order] for x in [what, *values]]))
        of = np.bincount(np.minimum(count, 5), minlength=6)[1:5].astype(np.int64)
        out.append(_blocks(3, np.zeros(4, np.int64), [of]))
        return pa.Table.from_batches(out, schema=BLOCK_SCHEMA)
    return run


def _merge_stats(path: str):
    """Writes a bucket's words with all their counts; returns the counts of predecessor counts (a) and their sum (b)."""
    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        counted, ctx, after = (_column(table, "a", k, U) for k in (0, 1, 2))
        words = np.unique(np.concatenate([counted, ctx, after]))
        def spread(keys, values):
            return np.bincount(np.searchsorted(words, keys), weights=values, minlength=len(words)).astype(np.int64)
        before = spread(after, _column(table, "b", 2, np.uint32))
        _save(f"{path}/words/{bucket}", "key", words)
        _save(f"{path}/words/{bucket}", "count", spread(counted, _column(table, "b", 0, np.int64)))
        _save(f"{path}/words/{bucket}", "before", before.astype(np.uint32))
        seen = [spread(ctx, _column(table, x, 1, np.uint32)) for x in "bcd"]
        _save(f"{path}/words/{bucket}", "seen", np.stack(seen, axis=1).astype(np.uint32))
        of = np.array([(before == 1).sum(), (before == 2).sum(), (before > 2).sum(), (before == 3).sum(), (before == 4).sum()], np.int64)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "kind": pa.array([4], pa.int32()),
                         "a": pa.array([of.tobytes()], pa.binary()), "b": pa.array([before.sum(dtype=np.int64).tobytes()], pa.binary()),
                         "c": pa.nulls(1, pa.binary()), "d": pa.nulls(1, pa.binary())}, schema=BLOCK_SCHEMA)
    return run


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more; half the count where they are undefined."""
    if min(n1, n2, n3) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.0), i + 1.0) for i, x in enumerate(d))


class Model:
    """The parameters of a counted model; the arrays stay in the files of ``path``."""

    def __init__(self, path, buckets, hot, texts, tokens, types, of, of_before, before, order=2, of_order=None):
        self.order = order
        self.d_order = {n: discounts(*x) for n, x in (of_order or {}).items()}  # orders above 2
        self.path, self.buckets, self.hot = path, buckets, hot
        self.texts, self.tokens, self.types = texts, tokens, types
        self.d = discounts(*of)
        t1, t2, t3_up, t3, t4 = of_before
        self.d1 = discounts(t1, t2, t3, t4)
        self.before = before
        self.gamma1 = (self.d1[0] * t1 + self.d1[1] * t2 + self.d1[2] * t3_up) / before if before else 1.0


def train(docs: DataFrame, path: str | None = None, order: int = 2) -> Model:
    """Count the n-grams of ``docs(text)`` up to ``order`` and write the model below ``path`` (by default in the checkpoint folder)."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    path = mounted(path or shared_path(spark, "kneser-ney"))
    docs = docs.select("text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    buckets = int(min(MAX_BUCKETS, max(4, (size.b or 0) // BUCKET_BYTES)))
    words = cut_lineage(docs.mapInArrow(tidy(_count_words(buckets)), BLOCK).groupBy("bucket").applyInArrow(_merge_words, BLOCK))
    total = words.mapInArrow(_totals, "v bigint, n bigint").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    tokens, types = int(total.n or 0), int(total.v or 0)
    # at most 4 * buckets words hold more than that share of the tokens
    hot = np.array(sorted(np.array([r.w for r in words.mapInArrow(_hot_words(tokens / (4 * buckets)), "w bigint").collect()],
                                   np.int64).astype(U).tolist()), U)
    shared_hot = spark.sparkContext.broadcast(hot)
    if order == 2:
        counts, merge, merge_stats = [_count_bigrams(buckets, shared_hot)], _merge_bigrams(path, buckets), _merge_stats(path)
    else:
        # a wave's shuffle is gone before the next wave: the disk never holds that of all n-grams
        ends = [0, *(round(x * buckets) for x in WAVES)]
        counts = [_count_grams(order, buckets, shared_hot, a, b) for a, b in zip(ends[:-1], ends[1:]) if a < b]
        merge, merge_stats = _merge_grams(path, order, buckets, shared_hot), _merge_words_and_contexts(path)
    stats = None
    for count in counts:
        drop_finished(spark)
        part = cut_lineage(docs.mapInArrow(tidy(count), BLOCK).groupBy("bucket").applyInArrow(merge, BLOCK))
        stats = part if stats is None else stats.unionByName(part)
    drop_finished(spark)
    of = np.zeros(4, np.int64)
    of_order = {n: np.zeros(4, np.int64) for n in range(2, order + 1)} if order > 2 else {}
    for r in stats.filter("kind = 3 or kind > 100").select("kind", "a").collect():  # one row a bucket and order
        of_order.get(r.kind - 100, of)[:] += np.frombuffer(r.a, np.int64)
    merged = cut_lineage(words.unionByName(stats.filter("kind < 3 or kind = 5")).groupBy("bucket").applyInArrow(merge_stats, BLOCK))
    drop_finished(spark)
    of_before, before = np.zeros(5, np.int64), 0
    for r in merged.select("a", "b").collect():  # one row a bucket
        of_before += np.frombuffer(r.a, np.int64)
        before += int(np.frombuffer(r.b, np.int64)[0])
    return Model(path, buckets, hot, int(size.n), tokens, types, of.tolist(), of_before.tolist(), before, order,
                 {n: x.tolist() for n, x in of_order.items()})


class Arrays:
    """Memory-mapped files of a model, opened on demand; the longest unused are closed."""

    def __init__(self, path: str):
        self.path, self.open = path, OrderedDict()

    def get(self, kind: str, bucket: int, names: tuple[str, ...]):
        at = (kind, bucket)
        if at in self.open:
            self.open.move_to_end(at)
            return self.open[at]
        where = f"{self.path}/{kind}/{bucket}"
        found = tuple(np.load(f"{where}/{x}.npy", mmap_mode="r") for x in names) if os.path.exists(f"{where}/{names[0]}.npy") else None
        self.open[at] = found
        if len(self.open) > OPEN_BUCKETS:
            self.open.popitem(last=False)
        return found


def _find(keys, wanted: np.ndarray):
    """(positions, found) of sorted ``wanted`` in sorted ``keys``."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _by_bucket(bucket: np.ndarray, key: np.ndarray):
    order = np.lexsort((key, bucket))
    b = bucket[order]
    cut = np.append(0, np.flatnonzero(np.diff(b)) + 1) if len(b) else np.zeros(0, np.int64)
    for s, e in zip(cut, np.append(cut[1:], len(b))):
        yield int(b[s]), order[s:e]


def score_tokens(m: Model, arrays: Arrays, h: np.ndarray, w: np.ndarray):
    """(log10 model probability, training count) of every token."""
    words, at = np.unique(np.concatenate([w, h]), return_inverse=True)
    count, before = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    seen = np.zeros((len(words), 3))
    for b, rows in _by_bucket(bucket_of(words, m.buckets), words):
        files = arrays.get("words", b, ("key", "count", "before", "seen"))
        if files:
            pos, ok = _find(files[0], words[rows])
            pos, rows = pos[ok], rows[ok]
            count[rows], before[rows], seen[rows] = files[1][pos], files[2][pos], files[3][pos]
    w_at, h_at = at[: len(w)], at[len(w):]
    key, first, back = np.unique(bigram_key(h, w), return_index=True, return_inverse=True)
    pair = np.zeros(len(key), np.int64)
    for b, rows in _by_bucket(bigram_bucket(h[first], key, m.buckets, m.hot), key):
        files = arrays.get("bigrams", b, ("key", "count", "more"))
        if files:
            pos, ok = _find(files[0], key[rows])
            pos, rows = pos[ok], rows[ok]
            got = files[1][pos].astype(np.int64)
            big = got == 255
            if big.any():
                at_large, large = files[2]
                got[big] = large[np.searchsorted(at_large, pos[big])]
            pair[rows] = got
    # the context count of a word is its count; the start of a text is one for each text
    ctx = count.astype(np.float64)
    ctx[words == START] = m.texts
    d, d1 = np.array([0.0, *m.d]), np.array([0.0, *m.d1])
    with np.errstate(divide="ignore", invalid="ignore"):
        gamma = np.where(ctx > 0, seen @ d[1:] / ctx, 1.0)
    p1 = m.gamma1 / (m.types + 1) + np.maximum(before - d1[np.minimum(before, 3)], 0) / max(m.before, 1)
    f_h, f_w = h_at[first], w_at[first]
    p = gamma[f_h] * p1[f_w]
    own = pair > 0
    p[own] += (pair[own] - d[np.minimum(pair[own], 3)]) / ctx[f_h[own]]
    return np.log10(p)[back], count[w_at]


def score_grams(m: Model, arrays: Arrays, cols: list[np.ndarray]):
    """``score_tokens`` for a model of an order above 2."""
    words, at = np.unique(cols[0], return_inverse=True)
    count, before = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for b, rows in _by_bucket(bucket_of(words, m.buckets), words):
        files = arrays.get("words", b, ("key", "count", "before", "seen"))
        if files:
            pos, ok = _find(files[0], words[rows])
            count[rows[ok]], before[rows[ok]] = files[1][pos[ok]], files[2][pos[ok]]
    d1 = np.array([0.0, *m.d1])
    p = (m.gamma1 / (m.types + 1) + np.maximum(before - d1[np.minimum(before, 3)], 0) / max(m.before, 1))[at]
    for n, ctx in enumerate(context_keys(cols), 2):
        there = np.flatnonzero(cols[n - 1] != 0)
        d = np.array([0.0, *m.d_order[n]])
        keys, first, back = np.unique(ctx[there], return_index=True, return_inverse=True)
        h = cols[1][there][first]
        is_hot = np.isin(h, m.hot)
        stats = np.zeros((len(keys), 4))
        for kind, of in (("contexts", ~is_hot), ("hot", is_hot)):
            of = np.flatnonzero(of)
            for b, rows in _by_bucket(bucket_of(h[of] if kind == "contexts" else keys[of], m.buckets), keys[of]):
                files = arrays.get(kind, b, (*KEYS, "which", "rows"))
                if files:
                    pos, ok = _find_short(files, keys[of[rows]])
                    stats[of[rows[ok]]] = files[4][files[3][pos[ok]]]
        stats = stats[back]
        there, stats = there[stats[:, 0] > 0], stats[stats[:, 0] > 0]
        keys, first, back = np.unique(bigram_key(ctx[there], cols[0][there]), return_index=True, return_inverse=True)
        h, w = cols[1][there][first], cols[0][there][first]
        seen = np.zeros(len(keys), np.int64)
        for b, rows in _by_bucket(bigram_bucket(h, bigram_key(h, w), m.buckets, m.hot), keys):
            files = arrays.get(f"grams{n}", b, (*KEYS, "count", "more"))
            if files:
                pos, ok = _find_short(files, keys[rows])
                pos, rows = pos[ok], rows[ok]
                got = files[3][pos].astype(np.int64)
                big = got == 255
                if big.any():
                    got[big] = files[4][1][np.searchsorted(files[4][0], pos[big])]
                seen[rows] = got
        seen = seen[back]
        p[there] = (np.maximum(seen - d[np.minimum(seen, 3)], 0) + stats[:, 1:] @ d[1:] * p[there]) / stats[:, 0]
    return np.log10(p), count[at]


_arrays: dict[str, Arrays] = {}


def _score(model):
    def run(batches):
        m = model.value
        arrays = _arrays.setdefault(m.path, Arrays(m.path))
        for batch in batches:
            out = {x: np.zeros(batch.num_rows) for x in ("score", "base_score", "n_tokens", "n_known")}
            for i, j, buf, offs in chunks(batch.column("text"), SCORE_CHUNK):
                cols, n = gram_columns(buf, offs, m.order)
                logp, c = score_tokens(m, arrays, cols[1], cols[0]) if m.order == 2 else score_grams(m, arrays, cols)
                first = np.cumsum(n) - n
                out["score"][i:j] = np.add.reduceat(logp, first)
                out["base_score"][i:j] = np.add.reduceat(np.log10((c + 1) / (m.tokens + m.types + 1)), first)
                out["n_known"][i:j] = np.add.reduceat((c > 0).astype(np.int64), first)
                out["n_tokens"][i:j] = n
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(out["n_tokens"].astype(np.int64)),
                pa.array(out["n_known"].astype(np.int64)), pa.array(out["base_score"]), pa.array(out["score"])],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return run


def held_out_column():
    """True for the documents that are scored but not learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def score(docs: DataFrame, held_out=None, order: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.

    The model learns from the rows that are not held out and scores all rows;
    scores are log10 probabilities of whole texts.  A null or empty text is the
    end token alone.  Repeated rows count, and are scored, each.  If no row is
    learnt from, every token has the probability 1 of the one unknown place.  An
    empty table gives an empty table.  Only ``doc_id`` and ``text`` are read.
    The rows are written before the model's files are removed.
    """
    held = held_out_column() if held_out is None else held_out
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    m = train(rows.filter(~F.col("held_out")), order=order)
    model = docs.sparkSession.sparkContext.broadcast(m)
    scored = cut_lineage(rows.mapInArrow(
        tidy(_score(model)), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"))
    shutil.rmtree(m.path, ignore_errors=True)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.tokens).cast("bigint").alias("train_tokens"),
                         "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of held-out and learnt rows, by the model and by the base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
