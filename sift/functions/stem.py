"""Porter (1980) stemmer as Spark column expressions.

Applied to the distinct vocabulary (a vocabulary job) and joined back to the
long token table, so each word is stemmed once per corpus, in the JVM.

Notation of the algorithm: a word is ``[C](VC)^m[V]``; ``y`` is a vowel when it
follows a consonant.  The consonant/vowel mask of a word is built with an
``aggregate`` over its characters; the mask of a stem is a prefix of the
word's mask.  In every step the longest matching suffix is chosen and, if
its condition fails, no shorter suffix of that step is tried.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: suffix rules of the published algorithm -------------------
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
         ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
         "ism", "ate", "iti", "ous", "ive", "ize"]
# -----------------------------------------------------------------------------


def mask(w: Column) -> Column:
    """'c'/'v' per character; y is a vowel after a consonant, a consonant first."""
    def step(acc, ch):
        last = F.substring(acc, -1, 1)
        kind = (F.when(ch.isin("a", "e", "i", "o", "u"), F.lit("v"))
                 .when(ch == "y", F.when((acc == "") | (last == "v"), F.lit("c")).otherwise(F.lit("v")))
                 .otherwise(F.lit("c")))
        return F.concat(acc, kind)
    return F.aggregate(F.split(w, ""), F.lit(""), step)


def measure(m: Column) -> Column:
    """m of a mask: number of 'vc' after collapsing runs."""
    col = F.regexp_replace(F.regexp_replace(m, "c+", "c"), "v+", "v")
    return ((F.length(col) - F.length(F.replace(col, F.lit("vc"), F.lit("")))) / 2).cast("int")


def _prefix(m: Column, n: Column) -> Column:
    return m.substr(F.lit(1), n)


def _has_vowel(m: Column) -> Column:
    return F.instr(m, "v") > 0


def _ends_double_cons(w: Column, m: Column) -> Column:
    n = F.length(w)
    return (n >= 2) & (F.substring(w, -1, 1) == F.substring(w, -2, 1)) & (F.substring(m, -1, 1) == "c")


def _ends_cvc(w: Column, m: Column) -> Column:
    return (F.length(w) >= 3) & m.endswith("cvc") & ~F.substring(w, -1, 1).isin("w", "x", "y")


def _rules(w: Column, m: Column, rules, cond) -> Column:
    """Longest matching suffix wins; replace only when ``cond(stem, stem_mask, suffix)`` holds."""
    expr = None
    for suf, rep in sorted(rules, key=lambda r: -len(r[0])):
        stem = w.substr(F.lit(1), F.length(w) - len(suf))
        sm = _prefix(m, F.length(w) - len(suf))
        val = F.when(cond(stem, sm, suf), F.concat(stem, F.lit(rep))).otherwise(w)
        hit = w.endswith(suf)
        expr = F.when(hit, val) if expr is None else expr.when(hit, val)
    return expr.otherwise(w)


def step1a(w: Column, m: Column) -> Column:
    return (F.when(w.endswith("sses"), w.substr(F.lit(1), F.length(w) - 2))
             .when(w.endswith("ies"), w.substr(F.lit(1), F.length(w) - 2))
             .when(w.endswith("ss"), w)
             .when(w.endswith("s"), w.substr(F.lit(1), F.length(w) - 1))
             .otherwise(w))


def _step1b_fix(s: Column, sm: Column) -> Column:
    return (F.when(s.endswith("at") | s.endswith("bl") | s.endswith("iz"), F.concat(s, F.lit("e")))
             .when(_ends_double_cons(s, sm) & ~F.substring(s, -1, 1).isin("l", "s", "z"),
                   s.substr(F.lit(1), F.length(s) - 1))
             .when((measure(sm) == 1) & _ends_cvc(s, sm), F.concat(s, F.lit("e")))
             .otherwise(s))


def step1b(w: Column, m: Column) -> Column:
    def cut(n):
        return w.substr(F.lit(1), F.length(w) - n), _prefix(m, F.length(w) - n)
    eed, eed_m = cut(3)
    ed, ed_m = cut(2)
    ing, ing_m = cut(3)
    return (F.when(w.endswith("eed"), F.when(measure(eed_m) > 0, w.substr(F.lit(1), F.length(w) - 1)).otherwise(w))
             .when(w.endswith("ed"), F.when(_has_vowel(ed_m), _step1b_fix(ed, ed_m)).otherwise(w))
             .when(w.endswith("ing"), F.when(_has_vowel(ing_m), _step1b_fix(ing, ing_m)).otherwise(w))
             .otherwise(w))


def step1c(w: Column, m: Column) -> Column:
    return F.when(w.endswith("y") & _has_vowel(_prefix(m, F.length(w) - 1)),
                  F.concat(w.substr(F.lit(1), F.length(w) - 1), F.lit("i"))).otherwise(w)


def step2(w: Column, m: Column) -> Column:
    return _rules(w, m, STEP2, lambda s, sm, suf: measure(sm) > 0)


def step3(w: Column, m: Column) -> Column:
    return _rules(w, m, STEP3, lambda s, sm, suf: measure(sm) > 0)


def step4(w: Column, m: Column) -> Column:
    def cond(s, sm, suf):
        c = measure(sm) > 1
        if suf == "ion":
            c = c & (s.endswith("s") | s.endswith("t"))
        return c
    return _rules(w, m, [(s, "") for s in STEP4], cond)


def step5a(w: Column, m: Column) -> Column:
    stem = w.substr(F.lit(1), F.length(w) - 1)
    sm = _prefix(m, F.length(w) - 1)
    ms = measure(sm)
    return F.when(w.endswith("e") & ((ms > 1) | ((ms == 1) & ~_ends_cvc(stem, sm))), stem).otherwise(w)


def step5b(w: Column, m: Column) -> Column:
    return F.when((measure(m) > 1) & _ends_double_cons(w, m) & w.endswith("l"),
                  w.substr(F.lit(1), F.length(w) - 1)).otherwise(w)


STEPS = [step1a, step1b, step1c, step2, step3, step4, step5a, step5b]


def stem_column(df, col: str, out: str = "stem"):
    """Add ``out`` = Porter stem of the lowercase word in ``col``.

    Every step is its own projection over column references (the mask is
    computed once per step), so expressions stay small; Catalyst keeps the
    projections apart because each step reads its input several times.
    Words of length <= 2 are unchanged.
    """
    d = df.withColumn("_w", F.col(col))
    for step in STEPS:
        d = d.withColumn("_m", mask(F.col("_w"))).withColumn("_w", step(F.col("_w"), F.col("_m")))
    return d.withColumn(out, F.when(F.length(col) <= 2, F.col(col)).otherwise(F.col("_w"))).drop("_w", "_m")
