"""Readers and writers on small files in a private temporary folder (tests only)."""

import os
import tempfile

from pyspark.sql import functions as F

from sift.sources import readers as RD
from sift.sources import sinks as SK


def tmp():
    return tempfile.mkdtemp(prefix="sift-test-")


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_survey_csv_optional_columns(spark):
    d = tmp()
    p = write(os.path.join(d, "s.csv"), "Report Grouping;Question Text;Comments\nA;Q1;Good support\nB;Q2;Too slow\n")
    df = RD.read_survey(spark, p)
    assert df.columns == ["doc_id", "comment_raw", "report_grouping", "question_text"]
    rows = sorted((r.comment_raw, r.report_grouping, r.question_text) for r in df.collect())
    assert rows == [("Good support", "A", "Q1"), ("Too slow", "B", "Q2")]
    p2 = write(os.path.join(d, "c.csv"), "Comments\nonly text\n")
    r = RD.read_survey(spark, p2).first()
    assert r.comment_raw == "only text" and r.report_grouping is None and r.question_text is None


def test_corpora_and_encodings(spark):
    d = tmp()
    p = write(os.path.join(d, "a.csv"), "text,airline_sentiment\nnice flight,positive\n")
    assert RD.read_labelled_corpus(spark, p, "airline").first().asDict() == {"text": "nice flight", "label": "positive"}
    p = write(os.path.join(d, "t.csv"), "Text,Rating\ncafé ok,4\n", encoding="latin-1")
    assert RD.read_labelled_corpus(spark, p, "tomatoes").first().text == "café ok"
    p = write(os.path.join(d, "t140.csv"), '"0","1","d","q","u","süper"\n', encoding="latin-1")
    assert RD.read_twitter140(spark, p).first().asDict() == {"text": "süper", "label": "0"}
    p = write(os.path.join(d, "a.tsv"), "great product\t1\nbad\t0\n")
    assert RD.read_headerless_tsv(spark, p).count() == 2


def test_xml_documents(spark):
    d = tmp()
    p = write(os.path.join(d, "g.xml"),
              "<Documents><Document><text>gut</text><sentiment>positive</sentiment></Document>"
              "<Document><text>schlecht</text><sentiment>negative</sentiment></Document></Documents>")
    got = sorted((r.text, r.label) for r in RD.read_xml_documents(spark, p).collect())
    assert got == [("gut", "positive"), ("schlecht", "negative")]


def test_lexicon_skip_and_first_wins(spark):
    from sift.operators.sentiment import first_per_word
    d = tmp()
    header = "".join(f"comment line {i}\n" for i in range(30))
    body = "good#a\t0.5\nbad#a\t-0.7\ngood#n\t0.9\nzero\t0.0\n"
    lex = RD.read_lexicon(spark, write(os.path.join(d, "lex.tsv"), header + body))
    got = {r.word: r.score for r in first_per_word(lex).collect()}
    assert got == {"good": 0.5, "bad": -0.7, "zero": 0.0}


def test_vector_text_file(spark):
    d = tmp()
    p = write(os.path.join(d, "v.vec"), "2 3\nhello 0.1 0.2 0.3\nworld 1 2 3\n")
    got = {r.token: [round(x, 3) for x in r.vec] for r in RD.read_token_vectors(spark, p, "text").collect()}
    assert got == {"hello": [0.1, 0.2, 0.3], "world": [1.0, 2.0, 3.0]}


def test_run_table_append_delete_and_next_id(spark):
    from sift.operators.runs import next_grid_id, best_config
    d = tmp()
    path = os.path.join(d, "runs")
    assert next_grid_id(RD.read_runs(spark, path)).first()[0] == 0
    rows = [(0, 0, "kmeans", "bert", {"cluster": {"k": "8"}}, 0.2, 8, 0),
            (0, 1, "kmeans", "bert", {"cluster": {"k": "10"}}, 0.3, 10, 0),
            (0, 2, "kmeans", "bert", {"cluster": {"k": "12"}}, 0.3, 12, 0),
            (1, 0, "kmeans", "bert", {"cluster": {"k": "8"}}, None, 8, 0)]
    from sift.operators.runs import RUN_SCHEMA
    SK.append_runs(spark.createDataFrame(rows, RUN_SCHEMA), path)
    runs = RD.read_runs(spark, path)
    assert next_grid_id(runs).first()[0] == 2
    best = {(r.mode, r.grid_id): r.best_node for r in best_config(runs).collect()}
    assert best == {("kmeans", 0): 1}  # tie 0.3: first inserted; grid 1 has no score
    SK.delete_grid(spark, path, 0)
    assert RD.read_runs(spark, path).count() == 1


def test_embedding_cache_reuses_hits(spark):
    d = tmp()
    cache = os.path.join(d, "cache")
    calls = []

    def embed(df):
        calls.append(1)
        return df.withColumn("embedding", F.array(F.length("text").cast("float")))
    a = spark.createDataFrame([("aa",), ("bbb",)], "text string")
    assert sorted(r.embedding[0] for r in SK.cached_embeddings(a, "text", embed, cache).collect()) == [2.0, 3.0]
    b = spark.createDataFrame([("aa",), ("cccc",)], "text string")
    out = SK.cached_embeddings(b, "text", embed, cache)
    assert sorted(r.embedding[0] for r in out.collect()) == [2.0, 4.0]
    assert spark.read.parquet(cache).count() == 3


def test_sinks_and_model_roundtrip(spark):
    from sift.operators import sentiment as S
    d = tmp()
    df = spark.createDataFrame([(1, ["a", "b"], "x")], "cluster int, keywords array<string>, label string")
    SK.write_annotated(df, d, csv=True)
    assert spark.read.option("header", True).csv(f"{d}/data.csv").first().keywords == "a b"
    SK.write_clusters(df, d)
    assert spark.read.json(f"{d}/clusters.json").first().label == "x"
    assert SK.output_path("/out").startswith("/out/output-")
    train = spark.createDataFrame(
        [(i, ["good"] if i % 3 == 0 else ["bad"] if i % 3 == 1 else ["meh"], 0.0, 0.0, 0.0, 0.0, float(i % 3))
         for i in range(30)], "doc_id int, tokens array<string>, neg_sum double, pos_sum double, "
                              "neg_share double, pos_share double, label double")
    m = S.train(train)
    SK.save_model(m, f"{d}/model")
    m2 = SK.load_model(f"{d}/model")
    assert [r.sentiment for r in S.predict(m2, train).orderBy("doc_id").limit(3).collect()] == [-1, 0, 1]


def test_survey_ids_do_not_depend_on_layout(spark):
    d = tmp()
    head, rows = "Report Grouping;Question Text;Comments\n", [f"A;Q{i % 2};text {i % 7}\n" for i in range(30)]
    one = write(os.path.join(d, "one.csv"), head + "".join(rows))
    os.mkdir(os.path.join(d, "many"))
    for k in range(3):
        write(os.path.join(d, "many", f"p{k}.csv"), head + "".join(reversed(rows[k::3])))
    got = [sorted((r.doc_id, r.comment_raw, r.question_text) for r in RD.read_survey(spark, p).collect())
           for p in (one, os.path.join(d, "many"))]
    assert got[0] == got[1] and len({x[0] for x in got[0]}) == 30


def test_multi_line_is_an_option(spark):
    d = tmp()
    p = write(os.path.join(d, "m.csv"), 'answers\n"first\nsecond"\nplain\n')
    assert RD.read_answers(spark, p, multi_line=True).count() == 2
    assert {r.text for r in RD.read_answers(spark, p, multi_line=True).collect()} == {"first\nsecond", "plain"}


def test_column_readers_and_names(spark):
    d = tmp()
    p = write(os.path.join(d, "q.csv"), "Question,Comment,x\nQ1,a,1\nQ1,a,2\nQ2,b,3\n")
    got = RD.read_columns(spark, p, ["Question", "Comment"])
    assert sorted(map(tuple, got.collect())) == [("Q1", "a"), ("Q2", "b")]
    assert RD.split_by_question(got, "Question", ["Q2"]).collect() == [("Q2", "b")]
    assert RD.normalise_names(spark.createDataFrame([(1, 2)], "` My Col` int, `B` int")).columns == ["my_col", "b"]


def test_sinks_k9_k11_k12(spark):
    d = tmp()
    df = spark.createDataFrame([("a", "1", "Q 1"), ("b", "-1", "Q2")], "comment string, label string, question_text string")
    SK.write_predictions(df.select("comment", "label"), f"{d}/pred")
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{d}/pred").collect())) == [("a", "1"), ("b", "-1")]
    SK.write_stage(df.withColumn("v", F.array(F.lit(1.0))), d, 2)
    assert spark.read.parquet(f"{d}/stage2.parquet").first().v == [1.0]
    SK.write_keywords_by_question(df, f"{d}/kw")
    assert {r.question_text for r in spark.read.parquet(f"{d}/kw").collect()} == {"Q 1", "Q2"}
    SK.write_changed_pairs(spark.createDataFrame([("a b", "a c")], "original string, corrected string"), f"{d}/pairs")
    assert spark.read.option("sep", "\t").csv(f"{d}/pairs").first()[1] == "a c"


def test_cache_keeps_null_texts_and_store_errors(spark):
    import pytest
    d = tmp()
    rows = spark.createDataFrame([("x",), (None,)], "text string")
    out = SK.cached_embeddings(rows, "text", lambda f: f.withColumn("embedding", F.array(F.length("text").cast("float"))), f"{d}/c")
    assert sorted(str(r.text) for r in out.collect()) == ["None", "x"]
    write(os.path.join(d, "runs"), "not a table")
    with pytest.raises(Exception):  # noqa: B017 - an unreadable run table is an error, not an empty one
        RD.read_runs(spark, os.path.join(d, "runs")).count()


def test_grid_frame(spark):
    from sift.operators import runs as RN
    grid = RN.build_grid({"reduce": {"k": [2, 3]}, "cluster": {"k": [8]}})
    got = RN.grid_frame(spark, grid, 4).orderBy("node").collect()
    assert [(r.grid_id, r.node, r.parameters["reduce"]["k"]) for r in got] == [(4, 0, "2"), (4, 1, "3")]


def test_the_fit_hashes_once_and_sums_one_gradient_a_core(spark, monkeypatch):
    from pyspark.ml.feature import HashingTF
    from sift.operators import sentiment as S
    rows = [(i, ["good", "fine"] if i % 2 else ["bad", "poor"], 0.0, 0.0, 0.0, 0.0, float(2 * (i % 2))) for i in range(80)]
    parts = 3 * spark.sparkContext.defaultParallelism
    data = spark.createDataFrame(rows, "doc_id long, tokens array<string>, neg_sum double, pos_sum double, neg_share double, pos_share double, label double")
    seen, hashed = [], HashingTF._transform
    monkeypatch.setattr(HashingTF, "_transform", lambda self, df: seen.append(df.rdd.getNumPartitions()) or hashed(self, df))
    model = S.train(data.repartition(parts))
    assert len(seen) == 1 and seen[0] <= spark.sparkContext.defaultParallelism
    assert {r.sentiment for r in S.predict(model, data.filter("label = 0")).collect()} == {-1}
    assert model.stages[-1].numFeatures == 4 + 4  # the buckets of four words and the lexicon's


def test_class_counts_clean_only_the_labelled_comments(spark, tmp_path, monkeypatch):
    import sift.session
    from sift.plans.queries import QUERIES
    docs = [(i, ("good fine <b>day</b> isn&apos;t it" if i % 2 else "bad poor b4 w/o 7x") + f" w{chr(97 + i % 26)}x", "en", "src1", 10) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, None if i < 4 else 1 - i % 2) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, stored = [], sift.session.stored
    monkeypatch.setattr(sift.session, "stored", lambda df, *a: kept.append(stored(df, *a)) or kept[-1])
    rows = QUERIES["class_counts"](spark, str(tmp_path)).collect()
    assert max(k.count() for k in kept) == 56
    assert sum(r.n_actual for r in rows) == sum(r.n_predicted for r in rows) > 0
