"""Spelling variants: words one edit apart, found by walking a distributed prefix tree level by level.

The tree is a table of edges ``(depth, node, ch, label, child, child_word, child_n, child_wide)``: its nodes
are the prefixes where words branch or end, so a chain without branches is one edge with a longer label
(``child_wide`` is the longest label below the child).
The frontier holds states ``(word, pos, node, edits)``: ``pos`` code points of ``word`` are read and
``node`` is the prefix reached.  A level joins the states with the edges below their nodes.  A state
without edits follows the edge that spells its word, and at the first unlike code point turns into a
one-edit state on the other edges; a one-edit state must spell the edge.  A one-edit state that ends
at a word is a neighbour.  The tree is searched for differences in the second half of a word; a tree of the
reversed words has those in the first half, so no state branches where every letter follows.  Each pair is found once, from the longer word or, of a replaced code point,
from the smaller word; both directions are counted.

The frontier is written level by level.  Edges of a level are broadcast behind a check of their number
and shuffled beyond it.  Node ids are
64-bit hashes; two prefixes with one id only share their edges, and every pair is checked by its
edit distance at the end.

Nulls: a null text has no words, a null id counts as the empty string.  Empty tables give no rows.
A word is told by its letters alone, so ties of the counts go to the smaller word in code-point order.
The longest word costs the square of its length when the tree is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.llm.common import bounded_batches, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: maximal runs of these letters are words
LETTERS = r"[A-Za-zÀ-ÿ]"
BROADCAST_EDGES = 100_000


def misspelt_words(docs: DataFrame, min_length: int = 7, one_in: int = 31) -> DataFrame:
    """``(word)`` per occurrence in ``docs(doc_id, text)``: words with planted deletions.

    A word whose ``crc32("<doc_id>:<word>")`` is divisible by ``one_in`` loses the code point
    ``crc32 % length``.  Results of under ``min_length`` code points are left out.
    """
    runs = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("_id"), F.explode(runs).alias("_w"))
    # only A-Z change: ``lower`` does that where all letters are ASCII, and much faster
    ascii_only = F.octet_length("_w") == F.char_length("_w")
    rows = rows.withColumn("_w", F.when(ascii_only, F.lower("_w")).otherwise(F.translate("_w", UPPER, LOWER)))
    rows = rows.select("_w", F.crc32(F.concat("_id", "_w")).alias("_h"))
    at = (F.col("_h") % F.char_length("_w")).cast("int")
    word = F.when(F.col("_h") % one_in == 0, F.concat(F.col("_w").substr(F.lit(1), at), F.col("_w").substr(at + 2, F.lit(2**30)))
                  ).otherwise(F.col("_w"))
    return rows.select(word.alias("word")).filter(F.char_length("word") >= min_length)


def vocabulary(words: DataFrame, min_count: int = 2) -> DataFrame:
    """``(word, n)`` of the words that occur ``min_count`` times or more."""
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def prefix_node(k, word="word"):
    return F.xxhash64(k, F.col(word).substr(F.lit(1), k))


def edges(vocab: DataFrame, start: int = 0) -> DataFrame:
    """Edge table of the prefix tree of ``vocab(word, n)`` from the prefixes of length ``start`` on; all words are longer."""
    size = F.char_length("word")
    rows = vocab.select("word", "n", F.explode(F.sequence(F.lit(start + 1), size)).alias("k"))
    # the code point that follows; 0 at the end of a word
    rows = rows.select("word", "n", "k", prefix_node(F.col("k")).alias("node"), F.ascii(F.col("word").substr(F.col("k") + 1, F.lit(1))).alias("next"))
    # a prefix is a node if words end there or branch there
    nodes = rows.groupBy("node").agg(F.min("next").alias("lo"), F.max("next").alias("hi")).filter("lo = 0 or lo <> hi").select("node")
    path = (rows.select("word", "n", "k", "node").join(nodes, "node").groupBy("word", "n")
            .agg(F.sort_array(F.collect_list(F.struct("k", "node"))).alias("path")))
    step = F.posexplode(F.transform("path", lambda x, i: F.struct(
        F.when(i > 0, F.col("path")[i - 1]["k"]).otherwise(start).alias("a"), x["k"].alias("b"),
        F.when(i > 0, F.col("path")[i - 1]["node"]).otherwise(prefix_node(F.lit(start))).alias("node"), x["node"].alias("child"))))
    e = path.select("word", "n", step.alias("depth", "s"))
    label = F.col("word").substr(F.col("s.a") + 1, F.col("s.b") - F.col("s.a"))
    ends = F.col("s.b") == size
    e = e.select("depth", "s.node", label.substr(1, 1).alias("ch"), label.alias("label"), "s.child",
                 F.when(ends, F.struct("word", "n")).alias("end"))
    # one row an edge, with the word that ends below it if one does
    e = e.groupBy("depth", "node", "ch", "label", "child").agg(F.collect_set("end").alias("end"))
    e = e.select("depth", "node", "ch", "label", "child", F.explode_outer("end").alias("end")).select(
        "depth", "node", "ch", "label", "child", F.col("end.word").alias("child_word"), F.col("end.n").alias("child_n"))
    wide = e.groupBy(F.col("node").alias("child")).agg(F.max(F.char_length("label")).alias("child_wide"))
    return e.join(wide, "child", "left").withColumn("child_wide", F.coalesce("child_wide", F.lit(0)))


def _rest(n):
    return F.col("word").substr(F.col("pos") + 1, n)


def _level(states: DataFrame, e: DataFrame) -> DataFrame:
    """The next frontier of ``states(word, n, pos, node, since, wide)`` over the edges below their nodes.

    ``since`` is null in a state with an edit; ``near`` and ``near_n`` are filled where such a state ends at a word.
    """
    size, m = F.char_length("word"), F.char_length("label")
    same = _rest(m) == F.col("label")
    # along the edge that begins as the word goes on: without an edit to the next node, with one on its way to a word
    exact = states.withColumn("ch", _rest(F.lit(1))).join(e, ["node", "ch"]).filter(same)
    plain = exact.filter(F.col("since").isNotNull() & (F.col("pos") + m < size)).select(
        "word", "n", (F.col("pos") + m).alias("pos"), F.col("child").alias("node"), "since", F.col("child_wide").alias("wide"),
        F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n"))
    moved = _open_or_near(exact.filter(F.col("since").isNull()), F.col("pos") + m)
    # the last code point of the word is one too many
    last = _open_or_near(exact.filter(F.col("since").isNotNull() & (F.col("pos") + m == size - 1)), size)
    # edits at ``since`` or later: edges that reach so far, alike up to there
    free = F.col("since") - F.col("pos")
    met = (states.filter(F.col("wide") > free).drop("wide").join(e.drop("ch"), "node")
           .filter((m > free) & ((free <= 0) | (_rest(free) == F.col("label").substr(F.lit(1), free)))).filter(~same))
    near = lambda x: F.levenshtein(x, F.col("label"), 1) == 1
    replaced = (F.char_length(_rest(m)) == m) & (_rest(m) < F.col("label")) & (
        F.when(m == 1, F.lit(True)).otherwise(near(_rest(m))))
    dropped = (F.char_length(_rest(m + 1)) == m + 1) & F.when(m == 1, _rest(F.lit(2)).substr(2, 1) == F.col("label")).otherwise(near(_rest(m + 1)))
    steps = F.array(F.when(replaced, F.col("pos") + m), F.when(dropped, F.col("pos") + m + 1))
    edited = _open_or_near(met.select(*met.columns, F.explode(steps).alias("to")).filter("to is not null"), F.col("to"))
    return plain.unionByName(moved).unionByName(last).unionByName(edited)


def _open_or_near(df: DataFrame, pos) -> DataFrame:
    """One-edit states after an edge: those that end at a word become neighbours, those that have read
    all of their word elsewhere vanish."""
    size = F.char_length("word")
    end = pos == size
    return df.filter((pos < size) | (end & F.col("child_word").isNotNull())).select(
        "word", "n", pos.alias("pos"), F.col("child").alias("node"), F.lit(None).cast("int").alias("since"), F.lit(None).cast("int").alias("wide"),
        F.when(end, F.col("child_word")).alias("near"), F.when(end, F.col("child_n")).alias("near_n"))


def _walk(vocab: DataFrame, since) -> DataFrame:
    """Pairs ``(word, n, near, near_n)`` whose first difference is at ``since`` or later, each from one side."""
    shortest = vocab.agg(F.min(F.char_length("word")), F.min(since)).first()
    # above the first place of an edit a word only follows its own letters
    start = max(0, min(shortest[0] - 1, shortest[1])) if shortest[0] else 0
    e = written(edges(vocab, start), "variant-edges")
    # one row a level
    levels = {r.depth: r for r in e.groupBy("depth").agg(F.count("*").alias("n"), F.max(F.char_length("label")).alias("wide")).collect()}
    found = vocab.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).filter("false")
    if not levels:
        return found
    states = vocab.select("word", "n", F.lit(start).alias("pos"), prefix_node(F.lit(start)).alias("node"), since.alias("since"),
                          F.lit(levels[0].wide).alias("wide"))
    for depth in range(len(levels)):
        here = e.filter(F.col("depth") == depth).drop("depth")
        states = written(_level(states, F.broadcast(here) if levels[depth].n <= BROADCAST_EDGES else here), "variant-states")
        found = found.unionByName(states.filter("near is not null").select("word", "n", "near", "near_n"))
        states = states.filter("near is null").drop("near", "near_n")
    return found.filter(F.levenshtein("word", "near", 1) == 1)


def near_words(vocab: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: all pairs of words one edit apart, in both directions.

    Near the root a node has every letter below it.  So the tree is only searched for differences in the second half of
    a word, and a tree of the reversed words for those in the first half.
    """
    vocab = written(vocab.select("word", "n"), "variant-words")
    half, size = F.floor(F.char_length("word") / 2).cast("int"), F.char_length("word")
    back = _walk(vocab.select(F.reverse("word").alias("word"), "n"), size - half)
    pairs = _walk(vocab, half).unionByName(back.withColumn("word", F.reverse("word")).withColumn("near", F.reverse("near")))
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*").distinct()


def group_variants(vocab: DataFrame, ratio: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``vocab(word, n)``.

    ``form`` is the near word of the largest count, ties to the smaller word, if that count is at
    least ``ratio`` times the word's; ``root`` is where following the forms ends.
    """
    vocab = written(vocab.select("word", "n"), "variant-vocabulary")
    best = (near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("c"), "near")).alias("b"))
            .select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.c")).alias("near_n")))
    takes = F.col("near_n") >= ratio * F.col("n")
    rows = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n"))
    rows = written(rows, "variant-forms")
    forms = rows.filter("form is not null")
    # counts grow by the ratio along a chain, so its length is bounded by the largest and the least count
    ends = vocab.agg(F.max("n"), F.min("n")).first()
    steps, reach = 0, (ends[1] or 1) * ratio
    while ratio > 1 and ends[0] is not None and reach <= ends[0]:
        steps, reach = steps + 1, reach * ratio
    chain = forms.select("word", F.col("form").alias("root"))
    link = forms.select(F.col("word").alias("root"), F.col("form").alias("further"))
    for _ in range(steps - 1):
        chain = chain.join(link, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return rows.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of the words of ``docs(doc_id, text)`` after planted deletions, as the registered query takes them."""
    bounded_batches(docs.sparkSession)
    return group_variants(vocabulary(misspelt_words(docs)))
