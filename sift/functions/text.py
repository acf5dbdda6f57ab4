"""Text cleaning as Spark column expressions.

Every function takes and returns a ``Column``; nothing here runs Python per
row.  String-level steps work on ``string`` columns, token-level steps on
``array<string>`` columns, so a cleaning pipeline is one projection that
Catalyst keeps inside the scan stage (filters and column pruning still reach
the Parquet reader).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from sift.functions import resources as R

# --- fixed patterns ----------------------------------------------------------
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
HTML_STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
HTML_TAG = r"<[^>]*>"
HTML_OPEN_TAIL = r"<[a-zA-Z/!][^>]*\z"
# Named and numeric entities decoded after tags are gone; '&amp;' goes last so
# that '&amp;lt;' becomes the text '&lt;' and not '<'.
WHITESPACE = r"\s+"
NON_ALNUM = r"[^a-zA-Z0-9]"
NON_ALPHA = r"[^a-zA-Z]"
URL = r"https?://\S+"
MENTION = r"@\w+"
# --- end of fixed patterns ---------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def explode_nonempty(df, keep: list, arr, value: str, pos: str | None = None):
    """Rows of ``arr`` elements (with their 0-based position when ``pos`` is set).

    Same rows as ``explode``; written as an outer explode plus a filter on the
    generated column so that the optimizer does not infer ``size(arr) > 0``
    and push a second copy of the (expensive) array expression below the
    projection, where it would be evaluated twice.  Null elements are dropped.
    """
    gen = (F.posexplode_outer(_c(arr)).alias(pos, value) if pos else F.explode_outer(_c(arr)).alias(value))
    return df.select(*keep, gen).filter(F.col(value).isNotNull())


# ---------------------------------------------------------------- strings ---

def strip_html(c) -> Column:
    """Drop comments, script/style bodies and tags; decode entities.

    A tag becomes one space (the text nodes are not fused), then whitespace is
    collapsed and the result trimmed.
    """
    text = s = _c(c)
    for pat in (HTML_COMMENT, HTML_SCRIPT, HTML_STYLE):
        s = F.regexp_replace(s, pat, " ")
    s = F.regexp_replace(s, HTML_TAG, " ")
    s = F.regexp_replace(s, HTML_OPEN_TAIL, " ")
    # each pattern needs a "<"; the tests read the text itself, so nothing is replaced twice inside a lambda function
    s = F.when(text.contains("<"), s).otherwise(text)
    s = F.when(text.contains("&"), decode_entities(s)).otherwise(s)
    return F.trim(F.regexp_replace(s, WHITESPACE, " "))


def decode_entities(c) -> Column:
    """Named (HTML 4 and ``apos``), decimal and hexadecimal character references, in one pass;
    a no-break space becomes a space, an unknown reference stays as it is."""
    from html.entities import name2codepoint
    names = {**{k: chr(v) for k, v in name2codepoint.items()}, "apos": "'", "nbsp": " "}
    known = F.create_map(*[F.lit(x) for k in sorted(names) for x in (k, names[k])])
    parts = F.split(_c(c), r"&(?=#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]{1,31};)")

    def decoded(part):
        name = F.substring_index(part, ";", 1)
        digits = F.when(name.rlike(r"^#[0-9]+\z"), F.conv(F.substring(name, 2, 10), 10, 16)) \
                  .when(name.rlike(r"^#[xX][0-9a-fA-F]+\z"), F.substring(name, 3, 10))
        code = F.conv(digits, 16, 10).cast("bigint")
        ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(code == 160, F.lit(" ")).when(ok, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
        value = F.coalesce(F.when(name.startswith("#"), char).otherwise(F.element_at(known, name)), F.concat(F.lit("&"), name, F.lit(";")))
        return F.concat(value, F.substring(part, F.length(name) + 2, F.length(part)))
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decoded)
    return F.concat(parts[0], F.array_join(rest, ""))


def remove_punctuation(c) -> Column:
    """Delete the 32 ASCII punctuation characters (no space inserted)."""
    return F.translate(_c(c), R.PUNCTUATION, "")


def replace_non_alnum(c) -> Column:
    """Every character outside [a-zA-Z0-9] becomes a space."""
    return F.regexp_replace(_c(c), NON_ALNUM, " ")


def replace_non_alpha(c) -> Column:
    """Every character outside [a-zA-Z] becomes a space."""
    return F.regexp_replace(_c(c), NON_ALPHA, " ")


def drop_single_chars_text(c) -> Column:
    """T9 on a string: keep words longer than one character, single-spaced."""
    return F.array_join(F.filter(F.split(_c(c), WHITESPACE), lambda w: F.length(w) > 1), " ")


def collapse_whitespace_comma(c) -> Column:
    """Two or more whitespace characters become ', '."""
    return F.regexp_replace(_c(c), r"\s{2,}", ", ")


def remove_chars(c, chars: str) -> Column:
    """Delete every listed character."""
    return F.translate(_c(c), chars, "")


def remove_urls_mentions(c) -> Column:
    """Drop URLs and @mentions."""
    return F.regexp_replace(F.regexp_replace(_c(c), URL, " "), MENTION, " ")


# --- fixed patterns (survey predicates) -------------------------------------
# Containment test of "[a-z ]+[A-Z]{4,}" written without the backtracking run:
# a match exists iff one [a-z ] char is directly followed by 4 capitals.
UPPER_RUN = r"[a-z ][A-Z]{4}"
# explicit ASCII word boundaries: Java's \b is Unicode-aware while \w is not
ACRONYM = r"(^|[^A-Za-z0-9_])[A-Z]{2,3}([^A-Za-z0-9_]|$)"
PUNCT_RUN3 = r"[^\w\s^(.)]{3}"
PUNCT_RUN2 = r"[^\w\s^(.)]{2}"
SENTENCE_END = r"([.!?])\s+"
SENT_MARK = "\u0001"
NUMERIC = r"^[0-9]+$"
CAPITALISED = r"^[A-Z][a-z]+$"
NOUN_SUFFIX = r"(tion|ment|ness|ity|ance|ence|ship|ism)$"
# --- end of fixed patterns ---------------------------------------------------


def split_sentences(c) -> Column:
    """A sentence ends at . ! or ? followed by whitespace; pieces trimmed, empty dropped."""
    marked = F.regexp_replace(_c(c), SENTENCE_END, "$1" + SENT_MARK)
    return F.filter(F.transform(F.split(marked, SENT_MARK), lambda x: F.trim(x)), lambda x: x != "")


def count_words_single_space(c) -> Column:
    """Pieces of a split on single spaces (empty pieces count)."""
    return F.size(F.split(_c(c), " ", -1))


def count_if(tokens, pred) -> Column:
    return F.size(F.filter(_c(tokens), pred))


def is_punct_token(t) -> Column:
    """A non-empty token that is a contiguous piece of the punctuation string."""
    return (t != "") & (F.position(t, F.lit(R.PUNCTUATION)) > 0)


def is_all_upper(c) -> Column:
    """At least one cased character and no lowercase one."""
    s = _c(c)
    return (F.upper(s) == s) & (F.lower(s) != s)


# ----------------------------------------------------------------- tokens ---

def tokenize(c) -> Column:
    """Lowercase, split on whitespace, drop empty pieces."""
    return F.filter(F.split(F.lower(_c(c)), WHITESPACE), lambda t: t != "")


def split_words(c) -> Column:
    """Whitespace split without lowercasing (drop empty pieces)."""
    return F.filter(F.split(_c(c), WHITESPACE), lambda t: t != "")


def remove_stopwords(tokens, words=None) -> Column:
    """T4: case-sensitive NOT IN; duplicates of kept words stay."""
    words = list(R.STOP_WORDS if words is None else words)
    return F.filter(_c(tokens), lambda t: ~t.isin(words))


def map_literal(mapping: dict) -> Column:
    items = []
    for k in sorted(mapping):
        items += [F.lit(k), F.lit(mapping[k])]
    return F.create_map(*items)


def expand_tokens(tokens, mapping: dict, case_insensitive: bool = False) -> Column:
    """Replace whole tokens by their expansion and re-split.

    Intended semantics: only a token equal to a key is rewritten; words that
    merely contain a key stay untouched.  For dictionaries beyond a few
    hundred entries use :func:`sift.operators.tokens.expand_with_table`
    (a join on the long token table) instead of a map literal.
    """
    m = map_literal(mapping)
    key = (lambda t: F.lower(t)) if case_insensitive else (lambda t: t)
    keys = list(mapping)
    # a hash lookup for every token; the map is searched for the keys alone
    return F.flatten(F.transform(_c(tokens), lambda t: F.when(key(t).isin(keys), F.split(F.coalesce(m[key(t)], t), " "))
                                 .when(t.contains(" "), F.split(t, " ")).otherwise(F.when(t.isNotNull(), F.array(t)))))


def strip_punct_tokens(tokens) -> Column:
    """T2 per token, dropping tokens that become empty."""
    return F.filter(F.transform(_c(tokens), lambda t: F.translate(t, R.PUNCTUATION, "")),
                    lambda t: t != "")


def resplit_tokens(tokens, pattern: str) -> Column:
    """T7/T8 per token: characters matching ``pattern`` split the token."""
    return F.filter(F.split(F.array_join(_c(tokens), " "), f"(?:{pattern}| )+"), lambda t: t != "")


def drop_short_tokens(tokens, min_len: int = 2) -> Column:
    """T9 per token."""
    return F.filter(_c(tokens), lambda t: F.length(t) >= min_len)


def lemmatize_rules(tokens) -> Column:
    """T10 rule part: plural suffix rules on tokens longer than 3 characters.

    A user lemma table is applied with
    :func:`sift.operators.tokens.lemmatize_with_table` (vocabulary join).
    """
    def one(t):
        keep = None
        for suf in R.PLURAL_KEEP:
            cond = t.endswith(suf)
            keep = cond if keep is None else (keep | cond)
        expr = None
        for suf, rep in R.PLURAL_RULES:
            cond = t.endswith(suf) & (F.length(t) > 3)
            if suf == "s":
                cond = cond & ~keep
            val = F.concat(t.substr(F.lit(1), F.length(t) - len(suf)), F.lit(rep))
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        return expr.otherwise(t)
    return F.transform(_c(tokens), one)


def ngrams(tokens, n: int = 3) -> Column:
    """Space-joined n-grams in order; empty when fewer than n tokens.

    Built from ``n`` shifted slices zipped together, so the token array is
    referenced ``n`` times (Catalyst then computes it once in a child
    projection) and never from inside a per-element lambda, which would
    re-evaluate the whole cleaning expression for every position.
    """
    t = _c(tokens)
    if n == 1:
        return t
    shifted = [F.slice(t, k + 1, F.greatest(F.size(t) - k, F.lit(1))) for k in range(n)]
    zipped = F.arrays_zip(*shifted)
    grams = F.transform(F.slice(zipped, 1, F.greatest(F.size(t) - n + 1, F.lit(1))),
                        lambda s: F.concat_ws(" ", *[s[str(k)] for k in range(n)]))
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


# ------------------------------------------------------------ composition ---

@dataclass
class CleanOptions:
    """Steps of the comment cleaner; the order of application is fixed.

    html (always) -> contractions -> abbreviations -> punctuation ->
    stop words -> special characters -> digits -> single characters ->
    lemma rules.  Unlike the original flags, every step can be switched off.
    """
    contractions: bool = True
    abbreviations: bool = True
    punctuation: bool = True
    stopwords: bool = True
    special_characters: bool = True
    numbers: bool = True
    single_chars: bool = True
    lemmatize: bool = False
    stop_words: list = field(default_factory=lambda: list(R.STOP_WORDS))
    contraction_map: dict = field(default_factory=lambda: dict(R.CONTRACTIONS))
    abbreviation_map: dict = field(default_factory=lambda: dict(R.ABBREVIATIONS))


def clean_tokens(text, opts: CleanOptions | None = None) -> Column:
    """Comment -> cleaned token array (T1..T10 in fixed order)."""
    o = opts or CleanOptions()
    toks = tokenize(strip_html(text))
    if o.contractions:
        toks = expand_tokens(toks, o.contraction_map)
    if o.abbreviations:
        toks = expand_tokens(toks, o.abbreviation_map)
    if o.punctuation:
        toks = strip_punct_tokens(toks)
    if o.stopwords:
        toks = remove_stopwords(toks, o.stop_words)
    if o.special_characters and not o.numbers:  # NON_ALPHA splits at all of them
        toks = resplit_tokens(toks, NON_ALNUM)
    if o.numbers:
        toks = resplit_tokens(toks, NON_ALPHA)
    if o.single_chars:
        toks = drop_short_tokens(toks, 2)
    if o.lemmatize:
        toks = lemmatize_rules(toks)
    return toks


def keyword_tokens(text, stop_words=None) -> Column:
    """Keyword cleaning: T2 -> T3 -> T4 -> T7/T8 -> T9 (no HTML, no expansions)."""
    toks = remove_stopwords(tokenize(remove_punctuation(text)), stop_words)
    return drop_short_tokens(resplit_tokens(toks, NON_ALPHA), 2)
