"""The trie join against brute force, and its parts."""

import random
import re

import numpy as np
import pytest

from sift.llm import trie_join
from sift.llm.bytewords import U

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, sig string, n string, component string"


def shingles(t, size=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def brute(docs, percent=75, size=5):
    sets = [shingles(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(d if not sets[i] else least.get(find(i)))) for i, (d, _) in enumerate(docs))


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)] + ["É", "A|b"]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    docs = [text(r.choice([1, 3, 4, 5, 6, 20, 60, 200])) for _ in range(n)]
    common = text(40)
    for _ in range(n):  # near copies by some edits, chains of them, and shared passages
        base = list(r.choice(docs))
        for _ in range(r.randint(0, 3)):
            base[r.randrange(len(base))] = r.choice(vocab)
        docs.append(base + text(r.randint(0, 3)))
    docs += [common + text(r.randint(0, 30)) for _ in range(40)]
    rows = [(i, "  ".join(d)) for i, d in enumerate(docs)]
    r.shuffle(rows)
    rows += [(900 + i, None) for i in range(2)] + [(910, ""), (911, " \t\n"), (None, rows[0][1]), (None, "only here"), (None, None),
                                                   (7, "two texts of id seven here"), (7, "two texts of id seven here")]
    return rows


@pytest.mark.parametrize("seed,percent,size", [(0, 75, 5), (1, 75, 5), (2, 75, 5), (3, 50, 2), (4, 90, 1), (5, 100, 5)])
def test_components(spark, seed, percent, size):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = trie_join.near_duplicates(df, size, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, percent, size)


def test_blocks_of_a_hot_shingle(spark, monkeypatch):
    monkeypatch.setattr(trie_join, "BLOCK_ROWS", 3)
    monkeypatch.setattr(trie_join, "BROADCAST_IDS", 0)
    rows = corpus(21)
    got = trie_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 60).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 60)


def test_frequent_order_does_not_change_the_result(spark, monkeypatch):
    rows = corpus(11)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(trie_join, "FREQUENT", 2)
    monkeypatch.setattr(trie_join, "LOCAL_FREQUENT", 1)
    for most in (0, 7, 10**6):
        got = trie_join.TrieJoin(df, max_frequent=most).components().collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_large_groups_and_long_text(spark):
    r = random.Random(4)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 500):
        d = list(base)
        d[r.randrange(300)] = f"edit{i}"
        rows.append((i, " ".join(d)))
    rows.append((999, " ".join(f"l{i}" for i in range(100_000))))
    rows.append((500, " ".join(f"l{i}" for i in range(90_000))))
    got = {x.doc_id: x.component_id for x in trie_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == 0 for i in range(500)) and got[999] == 500


def test_links_are_links(spark):
    rows = [r for r in corpus(6) if r[0] is not None]
    run = trie_join.TrieJoin(spark.createDataFrame(rows, "doc_id bigint, text string"))
    by = {}
    for r in run.profiles.collect():
        by.setdefault(r.sig, r.doc_id)
    text = dict(rows)
    links = run.links.collect()
    assert links
    for x in links:
        a, b = shingles(text[by[x.a]]), shingles(text[by[x.b]])
        assert 100 * len(a & b) >= 75 * len(a | b)


def all_links(rows, percent=75, size=5):
    sets = [shingles(t, size) for _, t in rows]
    return [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
            and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


@pytest.mark.parametrize("seed,percent,size,block", [(6, 75, 5, 1024), (7, 50, 2, 3), (8, 75, 5, 4)])
def test_all_links_and_their_numbers(spark, monkeypatch, seed, percent, size, block):
    monkeypatch.setattr(trie_join, "LINK_ROWS", block)
    monkeypatch.setattr(trie_join, "LINK_CELLS", 64 * block)
    rows = corpus(seed)
    base = [f"b{i}" for i in range(90)]  # a group of near copies: nearly all pairs link
    rows += [(2000 + i, " ".join(base[:k] + [f"edit{i}"] + base[k:])) for i, k in enumerate(range(3, 90, 3))]
    run = trie_join.TrieJoin(spark.createDataFrame(rows, "doc_id bigint, text string"), size, percent)
    true = all_links(rows, percent, size)
    count = [0] * len(rows)
    for pair in true:
        for i in pair:
            count[i] += 1
    got = run.components(links=True).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == sorted((str(d), c) for (d, _), c in zip(rows, count))
    assert sorted(map(str, map(tuple, run.components().collect()))) == sorted(str(tuple(r)[:3]) for r in got)
    sets = [shingles(t, size) for _, t in rows]
    pairs = {(frozenset(sets[i]), frozenset(sets[j])) for i, j in true if sets[i] != sets[j]}
    links = run.links.collect()
    assert len(links) == len({(r.a, r.b) for r in links}) == len({frozenset(x) for x in pairs}) > 0


def test_block_overlaps_against_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n, dtype=np.uint64)) for n in (1, 5, 200, 200, 90)]
    got = trie_join.block_overlaps(sets[:3], sets[2:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:3]]


def test_trie_overlaps_against_sets():
    rng = np.random.default_rng(0)
    for _ in range(30):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        probe = np.unique(rng.choice(pool, 250))
        partners = []
        for _ in range(20):
            keep = list(rng.choice(pool, rng.integers(1, 300), replace=False))
            partners.append(np.array(sorted(keep), U)[::-1])
        partners += [partners[0], partners[0][:70]]
        need = rng.integers(0, 200, len(partners))
        got = trie_join.trie_overlaps(probe, partners, need)
        for p, n, g in zip(partners, need, got):
            true = len(set(p.tolist()) & set(probe.tolist()))
            assert g == (true if true >= n else -1)


def test_sketch_never_rejects():
    rng = np.random.default_rng(1)
    for n in (1, 5, 100, 3000, 60_000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(0.9 * len(a)) + 1], rng.integers(0, 2**63, n // 10, dtype=np.uint64)]))
        assert trie_join.sketch_distance(trie_join.sketch(a), trie_join.sketch(b)) <= len(np.setxor1d(a, b))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie_join.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(3, "a b c d e f", "", "", ""), (1, "A  b\tc d e f", "", "", ""), (2, None, "", "", ""),
                                (None, "a b c d e f", "", "", ""), (None, "lone", "", "", "")], SCHEMA)
    kept = trie_join.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None", "None"]
    assert trie_join.first_of_each(empty).count() == 0


def test_words_that_cancel_in_sums_are_told_apart(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    pairs = [(word[:n], word[:n].translate(str.maketrans("ab", "ba"))) for n in (8, 64, 1024, 2048, 4096)]
    rows = [(2 * i + j, f"{w} one two three four five") for i, p in enumerate(pairs) for j, w in enumerate(p)]
    rows += [(100, rows[0][1])]
    got = {r.doc_id: r.component_id for r in trie_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 75).collect()}
    assert got == {i: 0 if i == 100 else i for i in got}
