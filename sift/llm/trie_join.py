"""N-gram Jaccard join over prefix trees, and the components of its links.

A document is the set of its distinct word shingles (64-bit hashes), globally
ordered: shingles seen often last, then by hash.  Equal sets are one class, and
only classes are joined; class and set are told by 64-bit hashes.

1. Two sets of Jaccard >= t share one of their first n - ceil(t n) + 1 shingles.
   Those shingles are grouped in Spark; a shingle of one class links nothing.
2. In every group each class is paired with the group's hub, the class with the
   fewest rarer shingles (of edited copies, the original): as many pairs as rows,
   whatever the group's size.  The pairs are verified.
3. Verified links make components.  Pairs of one component need no check: they
   add nothing to reachability.  Groups of one hub that hold two components are
   joined to one, and their pairs across components are tested in blocks of
   about ``BLOCK_ROWS`` rows a side against length and position bounds and a
   parity sketch (which never rejects a link); only those that pass leave the
   task, and are verified too.  So no link that joins two
   components is lost, and a group of thousands of near copies costs pairs in
   proportion to its size.
4. The links themselves, and their number per document, are asked for apart: every
   link lies within a component, so the sets of a component meet in blocks, dealt
   out by pairs of blocks, and all pairs of a block pair are counted exactly, as
   products of the blocks' incidence matrices.  Numbers of links leave a task as
   one row a class; the pairs only if they are wanted.

Verification stores the partners of a class in a trie over the reversed global
order (frequent shingles first, so near copies share long paths), with edges of
up to ``EDGE`` shingles.  It walks the trie against the class level by level:
partners below a node share its partial overlap, and a subtree is pruned when
the shingles that remain cannot reach the overlap its sets need.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sift.llm.bytewords import NOT_SPACE, U, chunks, gram_hashes, mix, word_hashes
from sift.llm.common import bounded_batches, cut_lineage, drop_finished, tidy, written
from sift.operators.graph import connected_components

SHINGLE = 5
PERCENT = 75
EDGE = 64
LOCAL_FREQUENT = 4
FREQUENT = 16
MAX_FREQUENT = 100_000  # of the shingles that the order puts last; others are ordered by hash
FLUSH = 1 << 21
BLOCK_VALUES = 1 << 21
BLOCK_ROWS = 4096
BROADCAST_IDS = 500_000
LINK_ROWS = 1024  # classes of a component in a block, about
LINK_VALUES = 1 << 22  # and their shingles
LINK_CELLS = 1 << 22  # cells of an incidence matrix at a time


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int):
    """The sorted distinct shingle hashes of every text of a chunk."""
    h, _, _, first = word_hashes(buf, offs, NOT_SPACE)
    grams = gram_hashes(h, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(grams[a: b - size + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        elif b > a:
            yield mix(gram_hashes(h[a:b], b - a) + U(b - a))
        else:
            yield np.zeros(0, U)


def signature(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=U) + U(len(s))], U)).astype(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's shingles over 2**m bits: sets with d differing shingles differ in at most d bits."""
    m = min(16, max(6, (2 * len(s)).bit_length()))
    return np.packbits(np.bincount((mix(s) >> U(64 - m)).astype(np.int64), minlength=1 << m) & 1).tobytes()


def _fold(a: np.ndarray, bits: int) -> np.ndarray:
    return a.reshape(bits, -1).sum(axis=1) & 1


def sketch_distance(x: bytes, y: bytes) -> int:
    a, b = np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))
    bits = min(len(a), len(b))
    return int((_fold(a, bits) ^ _fold(b, bits)).sum())


PROFILE = "kind int, doc_id bigint, n bigint, sig bigint, sketch binary"


def _profiles(size: int):
    """kind 0: a document's set size, signature and sketch; kind 1: a locally frequent shingle (sig) and count (n)."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("sketch", pa.binary())])

    def frequent(held):
        values, count = np.unique(np.concatenate(held), return_counts=True)
        at = np.flatnonzero(count >= LOCAL_FREQUENT)
        return pa.RecordBatch.from_arrays([
            pa.array(np.ones(len(at), np.int32)), pa.nulls(len(at), pa.int64()), pa.array(count[at].astype(np.int64)),
            pa.array(values[at].astype(np.int64)), pa.nulls(len(at), pa.binary())], schema=schema)

    def run(batches):
        held, n_held, seen = [], 0, {}
        for batch in batches:
            ns, sigs, sketches = [], [], []
            for _, _, buf, offs in chunks(batch.column("text")):
                for s in shingle_sets(buf, offs, size):
                    sig = signature(s)
                    ns.append(len(s))
                    sigs.append(sig)
                    if sig in seen:  # one sketch, and one count of its shingles, for the copies in a partition
                        sketches.append(None)
                        continue
                    seen[sig] = True
                    if len(seen) > FLUSH:
                        seen.clear()
                    sketches.append(sketch(s))
                    held.append(s)
                    n_held += len(s)
                    if n_held > FLUSH:
                        yield frequent(held)
                        held, n_held = [], 0
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(len(ns), np.int32)), batch.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int64()),
                pa.array(sigs, pa.int64()), pa.array(sketches, pa.binary())], schema=schema)
        if held:
            yield frequent(held)
    return run


def ordered(s: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A sorted set in global order: shingles not listed as frequent first, by hash; then by rising count."""
    if not len(often) or not len(s):
        return s
    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
    listed = often[at] == s
    tail = s[listed]
    return np.concatenate([s[~listed], tail[np.lexsort((tail, rank[at[listed]]))]])


def _prefixes(size: int, percent: int, broadcast):
    schema = pa.schema([("token", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])

    def run(batches):
        often, rank = broadcast.value
        seen = set()
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column("text")):
                tokens, sigs, ns, ps = [], [], [], []
                for s in shingle_sets(buf, offs, size):
                    n = len(s)
                    sig = signature(s)
                    if not n or sig in seen:
                        continue
                    seen.add(sig)
                    p = n - -(-percent * n // 100) + 1
                    tokens.append(ordered(s, often, rank)[:p].astype(np.int64))
                    sigs.append(sig)
                    ns.append(n)
                    ps.append(p)
                if len(seen) > FLUSH:  # a copy that comes again is only a repeated row
                    seen.clear()
                if tokens:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(sigs, np.int64), ps)),
                        pa.array(np.repeat(np.array(ns, np.int64), ps)),
                        pa.array(np.concatenate([np.arange(p, dtype=np.int64) for p in ps]))], schema=schema)
    return run


def _set_rows(size: int, broadcast):
    """(sig, the set in reversed global order: frequent shingles first)."""
    def run(batches):
        often, rank = broadcast.value
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column("text")):
                rows = [(signature(s), ordered(s, often, rank)[::-1].tobytes()) for s in shingle_sets(buf, offs, size) if len(s)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.large_binary())],
                    names=["sig", "shingles"])
    return run


_EDGE_COEF = mix(np.arange(1, EDGE + 1, dtype=np.uint64)) | U(1)


def trie_overlaps(probe: np.ndarray, partners: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Overlap of ``probe`` (sorted) with every partner (in trie order), or -1 if it was pruned below ``need``.

    The partners are stored in a trie whose edges hold up to EDGE shingles; a
    node's overlap is worked out once for all partners below it.
    """
    m = len(partners)
    size = np.array([len(x) for x in partners])
    result = np.full(m, -1, np.int64)
    live = np.arange(m)
    node_of = np.zeros(m, np.int64)  # node of each live partner, at the current depth
    overlap = np.zeros(1, np.int64)  # of each node
    depth = 0
    while len(live):
        ended = size[live] <= depth
        if ended.any():
            result[live[ended]] = overlap[node_of[ended]]
            live, node_of = live[~ended], node_of[~ended]
            if not len(live):
                break
        block = np.zeros((len(live), EDGE), U)
        for i, x in enumerate(live.tolist()):
            piece = partners[x][depth: depth + EDGE]
            block[i, : len(piece)] = piece
        lens = np.minimum(size[live] - depth, EDGE)
        label = mix((block * _EDGE_COEF).sum(axis=1, dtype=U) + lens.astype(U)) ^ mix(node_of.astype(U))
        _, first, child = np.unique(label, return_index=True, return_inverse=True)
        tokens = block[first]
        inside = np.arange(EDGE) < lens[first][:, None]
        at = np.minimum(np.searchsorted(probe, tokens), len(probe) - 1)
        shared = ((probe[at] == tokens) & inside).sum(axis=1)
        overlap = overlap[node_of[first]] + shared
        depth += EDGE
        # bounds of a subtree: its longest remainder, its least needed overlap
        rest = np.zeros(len(first), np.int64)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.maximum.at(rest, child, np.maximum(size[live] - depth, 0))
        np.minimum.at(least, child, need[live])
        grows = np.minimum(rest, len(probe) - overlap)
        alive = (overlap + grows >= least)[child]
        live, node_of = live[alive], child[alive]
    result[result < need] = -1
    return result


def _verify(percent: int):
    """Rows (a, b, set of a, set of b) -> the pairs that link."""
    def run(batches):
        for batch in batches:
            a = batch.column("a").to_numpy()
            b = batch.column("b").to_numpy()
            sa, sb = batch.column("set_a"), batch.column("set_b")
            out_a, out_b = [], []
            order = np.argsort(a, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else ():
                probe = np.sort(np.frombuffer(sa[int(rows[0])].as_py(), U))
                i = 0
                while i < len(rows):  # a trie of bounded size
                    partners, values = [], 0
                    while i < len(rows) and (not partners or values < BLOCK_VALUES):
                        partners.append(np.frombuffer(sb[int(rows[i])].as_py(), U))
                        values += max(len(partners[-1]), EDGE)
                        i += 1
                    sizes = np.array([len(x) for x in partners])
                    need = -(-percent * (len(probe) + sizes) // (100 + percent))
                    ok = trie_overlaps(probe, partners, need) >= 0
                    at = rows[i - len(partners): i][ok]
                    out_a.append(a[at])
                    out_b.append(b[at])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(out_a) if out_a else np.zeros(0, np.int64)),
                pa.array(np.concatenate(out_b) if out_b else np.zeros(0, np.int64))], names=["a", "b"])
    return run


def _may_link(percent: int, na: str, nb: str, pa_: str, pb: str):
    """Length and position bounds of a pair that shares a shingle at these positions first."""
    fits = (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
    reach = F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb))
    return fits & (reach * (100 + percent) >= (F.col(na) + F.col(nb)) * percent)


def _folded(sketches: list[bytes], bits: int) -> np.ndarray:
    """Sketches of at least that many bits, folded to ``bits`` and packed, a row each."""
    out = np.empty((len(sketches), max(bits // 8, 1)), np.uint8)
    for i, x in enumerate(sketches):
        x = np.frombuffer(x, np.uint8)
        out[i] = x if len(x) * 8 == bits else np.packbits(_fold(np.unpackbits(x), bits))
    return out


def _pairs_of_group(left, right, same: bool, percent: int):
    """Class pairs of two blocks of a group that are in two components and may link."""
    (sa, na, pa_, ca, ka), (sb, nb, pb, cb, kb) = left, right
    big, small = np.maximum(na[:, None], nb[None, :]), np.minimum(na[:, None], nb[None, :])
    ok = (ca[:, None] != cb[None, :]) & (small * 100 >= big * percent)
    reach = np.minimum((na - pa_)[:, None], (nb - pb)[None, :])
    ok &= reach * (100 + percent) >= (big + small) * percent
    if same:
        ok &= np.tri(len(sa), k=-1, dtype=bool).T
    i, j = np.nonzero(ok)
    if not len(i):
        return i, j
    size_a, size_b = np.array([len(x) * 8 for x in ka]), np.array([len(x) * 8 for x in kb])
    most = (na[i] + nb[j]) * (100 - percent) // (100 + percent)  # of differing shingles
    bits = np.minimum(size_a[i], size_b[j])
    keep = np.zeros(len(i), bool)
    for m in np.unique(bits).tolist():
        at = np.flatnonzero(bits == m)
        rows_a, ia = np.unique(i[at], return_inverse=True)
        rows_b, ib = np.unique(j[at], return_inverse=True)
        x, y = _folded([ka[r] for r in rows_a], m), _folded([kb[r] for r in rows_b], m)
        step = max(1, (1 << 24) // x.shape[1])
        for s in range(0, len(at), step):
            part = slice(s, s + step)
            keep[at[part]] = np.bitwise_count(x[ia[part]] ^ y[ib[part]]).sum(axis=1) <= most[at[part]]
    return i[keep], j[keep]


def _across(percent: int):
    """Rows sorted by (token, bi, bj) -> distinct pairs that may link; a group has at most two blocks of rows."""
    def pairs(held):
        table = pa.Table.from_batches(held).combine_chunks()
        col = {x: table[x].to_numpy() for x in ("sig", "n", "pos", "component", "block", "bi", "bj")}
        sketches = table["sketch"].to_pylist()

        def side(at):
            return col["sig"][at], col["n"][at], col["pos"][at], col["component"][at], [sketches[r] for r in at.tolist()]
        same = col["bi"][0] == col["bj"][0]
        left = np.flatnonzero(col["block"] == col["bi"][0])
        right = left if same else np.flatnonzero(col["block"] == col["bj"][0])
        i, j = _pairs_of_group(side(left), side(right), same, percent)
        return col["sig"][left[i]], col["sig"][right[j]]

    def run(batches):
        held, key, found = [], None, set()
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in ("token", "bi", "bj")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                now = tuple(keys[s].tolist())
                if held and now != key:
                    found.update(zip(*(x.tolist() for x in pairs(held))))
                    held = []
                key = now
                held.append(batch.slice(s, e - s))
            if len(found) > FLUSH // 8:
                yield _pair_batch(found)
                found = set()
        if held:
            found.update(zip(*(x.tolist() for x in pairs(held))))
        if found:
            yield _pair_batch(found)
    return run


def _pair_batch(found: set) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def block_overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of every set of ``left`` with every set of ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    values = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    mine = row < len(left)
    n = int(column[-1]) + 1
    both = (np.bincount(column[mine], minlength=n) > 0) & (np.bincount(column[~mine], minlength=n) > 0)
    at = both[column]
    row, mine, column = row[at], mine[at], (np.cumsum(both) - 1)[column[at]]
    width = max(1, LINK_CELLS // max(len(left), len(right)))
    for s in range(0, int(both.sum()), width):
        i, j = np.searchsorted(column, [s, s + width])
        r, c, m = row[i:j], column[i:j] - s, mine[i:j]
        wide = int(c[-1]) + 1
        a, b = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        a[r[m], c[m]] = 1
        b[r[~m] - len(left), c[~m]] = 1
        out += (a @ b.T).astype(np.int64)
    return out


def _linked(percent: int, pairs: bool):
    """Rows sorted by (component, bi, bj) -> (a, b) of all links, or (sig, linked rows) of the block pair."""
    names = ["a", "b"] if pairs else ["sig", "n_links"]

    def found(held):
        table = pa.Table.from_batches(held).combine_chunks()
        sig, size, block, bi, bj = (table[x].to_numpy() for x in ("sig", "size", "block", "bi", "bj"))
        sets = [np.frombuffer(x, U) for x in table["shingles"].to_pylist()]
        same = bi[0] == bj[0]
        left = np.flatnonzero(block == bi[0])
        right = left if same else np.flatnonzero(block == bj[0])
        if not len(left) or not len(right):
            return None
        shared = block_overlaps([sets[i] for i in left], [sets[j] for j in right])
        n = np.array([len(x) for x in sets])
        ok = shared * (100 + percent) >= percent * (n[left][:, None] + n[right][None, :])
        if same:
            np.fill_diagonal(ok, False)
        if pairs:
            i, j = np.nonzero(np.triu(ok) if same else ok)
            x, y = sig[left[i]], sig[right[j]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=names)
        who, count = sig[left], ok @ size[right]
        if not same:
            who, count = np.append(who, sig[right]), np.append(count, ok.T @ size[left])
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(count.astype(np.int64))], names=names)

    def run(batches):
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in ("component", "bi", "bj")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                now = tuple(keys[s].tolist())
                if held and now != key:
                    out = found(held)
                    held = []
                    if out is not None:
                        yield out
                key = now
                held.append(batch.slice(s, e - s))
        out = found(held) if held else None
        if out is not None:
            yield out
    return run


class TrieJoin:
    """One run of the join over ``docs(doc_id, text)``.

    ``classes``: ``(doc_id, sig)``, the class of every row that has words.  ``joining``:
    the verified pairs that make the components.  ``links``: all pairs ``(a, b)`` of
    classes that link, as many as there are; rows of one class link besides.
    """

    def __init__(self, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, max_frequent: int = MAX_FREQUENT):
        if size < 1 or not 0 < percent <= 100:
            raise ValueError("a shingle has a word at least, and the percentage lies in 1..100")
        spark = docs.sparkSession
        bounded_batches(spark)
        self.docs, self.size, self.percent, self.spark = docs.select(F.col("doc_id").cast("bigint"), "text"), size, percent, spark
        found = cut_lineage(self.docs.mapInArrow(tidy(_profiles(size)), PROFILE))
        self.profiles = found.filter("kind = 0").select("doc_id", "n", "sig")
        self.sketches = found.filter("kind = 0 and sketch is not null").select("sig", "sketch").dropDuplicates(["sig"])
        often = (found.filter("kind = 1").groupBy("sig").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
                 .orderBy(F.desc("n"), "sig").limit(max_frequent).collect())
        keys = np.array([r.sig for r in often], np.int64).astype(U)
        order = np.argsort(keys)
        self.order = spark.sparkContext.broadcast((keys[order], np.array([r.n for r in often], np.int64)[order]))
        self.classes = self.profiles.filter("n > 0").select("doc_id", "sig")
        self.joining = self._joining()

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """``(sig, shingles)`` of the classes in ``wanted(sig)``."""
        one = cut_lineage(self.profiles.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("rep"))
                          .select("rep").distinct())
        one = _small(one)
        rows = self.docs.join(one, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        return (rows.mapInArrow(tidy(_set_rows(self.size, self.order)), "sig bigint, shingles binary").dropDuplicates(["sig"]))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs)
        sets = self._sets(pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct())
        both = (pairs.join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("set_b")), "b")
                .join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("set_a")), "a")
                .select("a", "b", "set_a", "set_b"))
        links = cut_lineage(both.mapInArrow(tidy(_verify(self.percent)), "a bigint, b bigint"))
        del sets, both
        drop_finished(self.spark)
        return links

    def _sketched(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``(a, b, na, nb)`` whose sketches do not differ in more bits than a link allows."""
        percent = self.percent
        both = (pairs.join(self.sketches.select(F.col("sig").alias("a"), F.col("sketch").alias("sa")), "a")
                .join(self.sketches.select(F.col("sig").alias("b"), F.col("sketch").alias("sb")), "b"))

        def run(batches):
            for batch in batches:
                na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                most = (na + nb) * (100 - percent) // (100 + percent)  # of differing shingles
                sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
                ok = np.array([sketch_distance(x, y) <= d for x, y, d in zip(sa, sb, most.tolist())], bool)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))],
                                                 names=["a", "b"])
        return both.mapInArrow(run, "a bigint, b bigint")

    def _joining(self) -> DataFrame:
        rows = self.docs.mapInArrow(tidy(_prefixes(self.size, self.percent, self.order)), "token bigint, sig bigint, n bigint, pos bigint")
        w = Window.partitionBy("token")
        hub = F.min(F.struct("pos", "sig", "n")).over(w)
        shared = written(rows.withColumn("hub", hub).withColumn("low", F.min("sig").over(w)).withColumn("high", F.max("sig").over(w))
                         .filter("low <> high").drop("low", "high").distinct(), "shared")
        stars = (shared.select(F.col("hub.sig").alias("a"), F.col("hub.n").alias("na"), F.col("hub.pos").alias("pa"),
                               F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
                 .filter("a <> b").filter(_may_link(self.percent, "na", "nb", "pa", "pb")))
        first = cut_lineage(stars.select("a", "b", "na", "nb").distinct())
        links = self._verified(self._sketched(first))
        self.labels = connected_components(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(),
                                           links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        # the pairs of a shingle's classes that are not in one component yet
        marked = (shared.join(self.labels.withColumnRenamed("id", "sig"), "sig", "left")
                  .withColumn("component", F.coalesce("component", "sig")))
        apart = (marked.withColumn("low", F.min("component").over(w)).withColumn("high", F.max("component").over(w))
                 .filter("low <> high")
                 # shingles of one hub are one group: a class comes in once, with its widest reach
                 .groupBy(F.col("hub.sig").alias("token"), "sig")
                 .agg(F.max("n").alias("n"), F.min("pos").alias("pos"), F.max("component").alias("component")))
        apart = written(apart, "apart")
        sizes = apart.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        blocks = (apart.join(sizes, "token").join(self.sketches, "sig")
                  .withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
                  .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
                  .select("token", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block",
                          "sig", "n", "pos", "component", "sketch"))
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        across = (blocks.repartition(n, "token", "bi", "bj").sortWithinPartitions("token", "bi", "bj")
                  .mapInArrow(tidy(_across(self.percent)), "a bigint, b bigint").distinct())
        more = self._verified(across)
        self.labels = _joined(self.labels, more)
        return links.unionByName(more)

    def _within(self, pairs: bool, schema: str) -> DataFrame:
        """What ``_linked`` finds in the pairs of blocks of every component."""
        sizes = self.profiles.filter("n > 0").groupBy("sig").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("size"))
        members = cut_lineage(self.labels.withColumnRenamed("id", "sig").join(sizes, "sig"))
        most = members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / LINK_ROWS), F.ceil(F.sum("n") / LINK_VALUES))
                                                .cast("int").alias("blocks"))
        blocks = (members.join(most, "component").join(self._sets(members.select("sig")), "sig")
                  .withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
                  .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
                  .select("component", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block",
                          "sig", "size", "shingles"))
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        found = cut_lineage(blocks.repartition(n, "component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
                            .mapInArrow(tidy(_linked(self.percent, pairs)), schema))
        drop_finished(self.spark)
        return found

    @functools.cached_property
    def links(self) -> DataFrame:
        return self._within(True, "a bigint, b bigint")

    def _per_class(self, links: bool) -> DataFrame:
        """``(sig, component_id, n_links)`` of the classes of several rows or with links; a class without either is its row alone."""
        own = self.profiles.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
        own = cut_lineage(own.join(self.labels.withColumnRenamed("id", "sig"), "sig", "left").filter("rows > 1 or component is not null"))
        # least ids class by class first: one row a class meets in a component
        least = _small(cut_lineage(own.filter("component is not null").groupBy("component").agg(F.min("first").alias("component_id"))))
        own = own.join(least, "component", "left").select("sig", "rows", F.coalesce("component_id", "first").alias("component_id"))
        if not links:
            return own.select("sig", "component_id")
        other = self._within(False, "sig bigint, n_links bigint").groupBy("sig").agg(F.sum("n_links").alias("other"))
        return own.join(other, "sig", "left").select("sig", "component_id", (F.col("rows") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"))

    def components(self, links: bool = False) -> DataFrame:
        """``(doc_id, n_shingles, component_id)``, with ``links`` also ``n_links``, one row per row of the documents."""
        more = [F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")] if links else []
        per = _small(cut_lineage(self._per_class(links)))
        rows = self.profiles.withColumn("sig", F.when(F.col("n") > 0, F.col("sig")))
        return rows.join(per, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"),
                                                    F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def _small(ids: DataFrame) -> DataFrame:
    """The ids marked for a broadcast if there are at most ``BROADCAST_IDS``; beyond that texts are shuffled to them."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: the old components are the vertices."""
    if links.isEmpty():
        return labels
    to = labels.select(F.col("id"), "component")
    ends = links
    for c in ("a", "b"):
        ends = (ends.join(to.withColumnRenamed("id", c), c, "left")
                .withColumn(c, F.coalesce("component", c)).drop("component"))
    ends = cut_lineage(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    above = connected_components(ends.select(F.col("src").alias("id")).union(ends.select("dst")).distinct(), ends)
    above = above.select(F.col("id").alias("component"), F.col("component").alias("top"))
    moved = labels.join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    new = above.join(labels.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), F.col("top").alias("component"))
    return cut_lineage(moved.unionByName(new))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    Two documents link when their shingle sets have a Jaccard similarity of
    ``percent`` / 100 or more; ``component_id`` is the smallest id reachable by
    links.  A text of fewer words than a shingle is one shingle of its own; a null
    text, or one without words, has an empty set, links with nothing and is its
    own component.  Rows with a null id are compared like others; a component of
    such rows alone has a null id.  Repeated rows link with each other.  An empty
    table gives an empty table.  Only ``doc_id`` and ``text`` are read.
    """
    return TrieJoin(docs, size, percent).components()


def near_duplicate_links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``near_duplicates`` with ``n_links``, the number of other rows that link with a row.  All pairs of a component are verified."""
    return TrieJoin(docs, size, percent).components(links=True)


def first_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all columns, that come first in their component.

    Rows without an id, and all rows of an id that is repeated, stay if the id is the component's."""
    kept = cut_lineage(near_duplicates(docs, size, percent).filter("doc_id = component_id or component_id is null")
                       .select(F.col("doc_id").alias("_id")).distinct())
    kept = _small(kept)
    drop_finished(docs.sparkSession)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi").select(*docs.columns)
