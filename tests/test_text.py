"""Golden rows for the cleaning expressions (quirk decisions of SURVEY §2.4)."""

from pyspark.sql import functions as F

from sift.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("o")).first()["o"]


def test_punctuation_no_space(spark):
    assert one(spark, T.remove_punctuation, "a,b! c...") == "ab c"


def test_readme_cleaning_example(spark):
    # tokenise + stop words + punctuation on two documented-style sentences
    toks = one(spark, lambda c: T.remove_stopwords(T.tokenize(T.remove_punctuation(c))),
               "This is a sentence, with some stop words!!")
    assert toks == ["sentence", "stop", "words"]


def test_contractions_whole_tokens_only(spark):
    out = one(spark, lambda c: T.expand_tokens(T.tokenize(c), {"don't": "do not", "u": "you"}),
              "Don't you use U? u unusual don't")
    # 'u' expands only as a whole token; 'unusual' and 'U?' (punctuated) stay
    assert out == ["do", "not", "you", "use", "u?", "you", "unusual", "do", "not"]


def test_html_strip(spark):
    html = "<p>Hi<b>there</b> &amp; <!-- c --><script>var x='<p>';</script>bye &lt;3</p><div"
    assert one(spark, T.strip_html, html) == "Hi there & bye <3"
    assert one(spark, T.strip_html, "no tags at all") == "no tags at all"


def test_clean_tokens_pipeline(spark):
    out = one(spark, T.clean_tokens, "I can't believe   the café's 2nd   floor!! <br> gr8 x")
    assert out == ["believe", "caf", "nd", "floor", "great"]


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None,), ("",), ("!!!",), ("the a of",)], "s string")
    got = [r["o"] for r in df.select(T.clean_tokens(F.col("s")).alias("o")).collect()]
    assert got[0] is None
    assert got[1:] == [[], [], []]


def test_all_upper(spark):
    df = spark.createDataFrame([("ABC DEF",), ("ABC d",), ("123 !",), ("ÉCOLE",)], "s string")
    got = [r[0] for r in df.select(T.is_all_upper("s")).collect()]
    assert got == [True, False, False, True]


def test_ngrams(spark):
    assert one(spark, lambda c: T.ngrams(T.tokenize(c), 3), "a b c d") == ["a b c", "b c d"]
    assert one(spark, lambda c: T.ngrams(T.tokenize(c), 3), "a b") == []


def test_lemma_rules(spark):
    out = one(spark, lambda c: T.lemmatize_rules(T.tokenize(c)),
              "classes stories boxes churches dishes cats bus analysis is")
    assert out == ["class", "story", "box", "church", "dish", "cat", "bus", "analysis", "is"]


def test_entities_in_one_pass(spark):
    cases = {"caf&eacute; &#8217;s &euro;5 &#x20AC;": "café ’s €5 €", "&amp;lt; &lt;b&gt;": "&lt; <b>", "a&nbsp;b&#160;c": "a b c",
             "&unknown; &#0; &#xD800; &#9999999; & &;": "&unknown; &#0; &#xD800; &#9999999; & &;", "": "", "&apos;&quot;": "'\"", "x &": "x &"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string")
    got = {r.s: r.t for r in df.select("s", T.decode_entities("s").alias("t")).collect()}
    assert got == {**cases, None: None}


def test_whitespace_and_url_helpers(spark):
    df = spark.createDataFrame([("a  b\t\tc d", "see http://x.y/z now @me ok")], "a string, b string")
    r = df.select(T.collapse_whitespace_comma("a").alias("a"), T.remove_urls_mentions("b").alias("b")).first()
    assert r.a == "a, b, c d" and r.b.split() == ["see", "now", "ok"]


def test_whole_cleaner_against_plain_python(spark):
    import html
    import re
    from sift.functions import resources as R
    texts = ["It's gr8 w/o x1y a-b", "no markup  at all, I'm here", "<p>a &lt;b&gt; c4t</p> r u\tOK", "a < b & c", "<!-- x --> y&nbsp;z <b", "é-ü B4 u", "", None]

    def plain(t):
        if t is None:
            return None
        for p in (r"(?s)<!--.*?-->", r"<[^>]*>", r"<[a-zA-Z/!][^>]*\Z"):
            t = re.sub(p, " ", t)
        words = html.unescape(t).replace(" ", " ").lower().split()
        for m in (R.CONTRACTIONS, R.ABBREVIATIONS):
            words = [w for x in words for w in m.get(x, x).split(" ")]
        words = [w.translate({ord(c): None for c in R.PUNCTUATION}) for w in words]
        return [w for w in re.split("[^a-zA-Z]+", " ".join(words)) if len(w) > 1]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", T.clean_tokens("t", T.CleanOptions(stopwords=False)).alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == [plain(t) for t in texts]
    digits = df.select("i", T.clean_tokens("t", T.CleanOptions(stopwords=False, numbers=False)).alias("w")).orderBy("i").collect()
    assert "x1y" in digits[0].w and "c4t" in digits[2].w
    odd = spark.createDataFrame([(["b4 it", "u"],), (["a", None],)], "w array<string>").select(T.expand_tokens("w", R.ABBREVIATIONS).alias("w")).collect()
    assert [r.w for r in odd] == [["b4", "it", "you"], None]
