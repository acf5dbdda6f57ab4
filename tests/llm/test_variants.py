"""Spelling variants: the trie frontier against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from sift.llm import variants
from sift.llm.variants import edges, group_variants, misspelt_words, near_words, spelling_variants

DOCS = "doc_id bigint, text string, word string, n string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if v != w and one_edit(w, v)]
        best = min(near, default=None)
        takes = best is not None and -best[0] >= ratio * n
        out[w] = (best[1] if takes else None, n, len(near), -best[0] if takes else None)
    rows = []
    for w, (form, n, near, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, near, form_n))
    return sorted(rows, key=str)


def some_words(r, k, alphabet, shortest, longest):
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(shortest, longest))) for _ in range(k)]
    out = set(base)
    for w in base:
        for _ in range(3):
            i = r.randrange(len(w))
            out.add(r.choice([w[:i] + w[i + 1:], w[:i] + r.choice(alphabet) + w[i:], w[:i] + r.choice(alphabet) + w[i + 1:], w + "x", w[:3]]))
    return sorted(out - {""})


@pytest.mark.parametrize("bound", [100_000, 5])
def test_frontier_against_all_pairs(spark, monkeypatch, bound):
    monkeypatch.setattr(variants, "BROADCAST_EDGES", bound)
    r = random.Random(bound)
    words = some_words(r, 60, "abé", 1, 7) + some_words(r, 20, "abcdefghß", 5, 12)
    counts = {w: r.choice([2, 2, 3, 20, 30, 200, 2000]) for w in words}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(4)
    got = sorted((tuple(x) for x in group_variants(vocab).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == brute(counts)


def test_chain_of_forms_and_ties(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "tttttta": 3, "ttttttb": 30, "ttttttc": 30, "lonely": 5}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {x.word: x for x in group_variants(vocab).collect()}
    assert got["abcdefg"].root == "abcdefghij" and got["abcdefg"].form == "abcdefgh"
    assert got["tttttta"].form == "ttttttb" and got["lonely"].root == "lonely" and got["lonely"].n_near == 0


def test_long_words_and_shared_prefixes(spark):
    long = "ab" * 1500
    words = [long, long + "c", long[:-1], "x" + long, long[:700] + "q" + long[700:], "prefix", "prefixe", "prefixes", "prefixed"]
    vocab = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    got = {(x.word, x.near) for x in near_words(vocab).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def test_tree_spells_its_words(spark):
    words = ["to", "tea", "ted", "ten", "inn", "i"]
    rows = edges(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")).collect()
    below = {}
    for r in rows:
        below.setdefault(r.node, []).append(r)
    found, todo = [], [(next(r.node for r in rows if r.depth == 0), "")]
    while todo:
        node, text = todo.pop()
        assert len({r.ch for r in below.get(node, [])}) == len(below.get(node, []))
        for r in below.get(node, []):
            todo.append((r.child, text + r.label))
            if r.child_word:
                assert r.child_word == text + r.label
                found.append(r.child_word)
    assert sorted(found) == sorted(words)


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def planted(docs):
    out = Counter()
    for i, text, *_ in docs:
        for w in RUN.findall(text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            if len(w) >= 7:
                out[w] += 1
    return out


def test_documents_against_brute_force(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdeÀéÿ") for _ in range(r.randint(6, 10))) for _ in range(60)]
    docs = [(i, r.choice([" ", ", ", "1"]).join(r.choice(base).title() if r.random() < 0.2 else r.choice(base) for _ in range(40)), "c", "d")
            for i in range(150)]
    docs += [(None, docs[0][1], None, None), (7, docs[7][1], "", ""), (8, None, "", ""), (9, "", "", ""), (10, "×÷" * 4, "", "")]
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    counts = planted(docs)
    assert Counter(r.word for r in misspelt_words(frame).collect()) == counts
    got = sorted((tuple(x) for x in spelling_variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == brute({w: n for w, n in counts.items() if n >= 2}) and any(x[1] for x in got)


def test_empty_tables(spark):
    assert spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert group_variants(spark.createDataFrame([("alone", 3)], "word string, n bigint")).collect()[0].root == "alone"
