"""The pipeline against a plain version of its stages on a small fixture; guards of the registration."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from sift.llm import mixing, quality
from tests.conftest import SF001
from tests.llm.test_trie_join import brute as brute_components
from tests.llm.test_winnow_topk import brute as brute_leaks

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    out = str(tmp_path_factory.mktemp("tables"))
    vocab = {"en": [f"en{i}" for i in range(200)], "de": [f"ß{i}" for i in range(200)], "fr": [f"é{i}" for i in range(200)],
             "es": [f"ñ{i}" for i in range(200)]}
    text = lambda lang, n: [r.choice(vocab[lang]) for _ in range(n)]
    bench = [(i, " ".join(text("en", 15))) for i in range(4)]
    docs, labels = [], []
    for i in range(900):
        lang = r.choices(list(vocab), [6, 2, 2, 1])[0]
        words = text(lang, r.randint(15, 80))
        kind = r.random()
        if kind < 0.1:
            words[4:4] = ["vilest", "nastiest"]
        elif kind < 0.2:
            words = [w + "!!" for w in words]
        elif kind < 0.25:
            words += bench[i % 4][1].split()
        docs.append((i, " ".join(words), lang, f"src{i % 3}", 0))
        if i % 5 < 3:
            labels.append((i, int(not 0.1 <= kind < 0.2), int(kind < 0.1)))
    for i in range(900, 960):
        words = docs[r.randrange(900)][1].split()
        words[-1] = "edited"
        docs.append((i, " ".join(words), "en", "src0", 0))
    docs += [(1000, None, None, None, None), (1001, "", "en", "src1", 0), (1002, docs[1][1], "en", None, 0)]
    spark.createDataFrame(docs, DOCS).repartition(4).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, docs, labels, bench


def test_stages_against_plain_versions(spark, tables):
    sf, docs, labels, bench = tables
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    now = frame
    rows = {d[0]: d[1] for d in docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = spark.createDataFrame(stage(spark, now, sf).collect(), frame.schema)
        kept = {r.doc_id: r.text for r in now.collect()}
        assert now.columns == frame.columns and all(rows[i] == t for i, t in kept.items())
        items = sorted(before.items())
        if name == "quality classifier":
            bad = {i for i, t in items if not t or "vilest" in t or "!!" in t}
            wrong = set(kept) ^ (set(before) - bad)
            assert len(wrong) <= 0.02 * len(before)
        elif name == "n-gram Jaccard join":
            first = {int(i) for i, _, c in brute_components(items) if i == c}
            assert set(kept) == first and len(kept) < len(before)
        elif name == "benchmark decontamination":
            leaks = {int(x[0]) for x in brute_leaks(items, bench) if x[-1]}
            assert leaks and set(kept) == set(before) - leaks
        else:
            drawn = mixing.mix(spark.createDataFrame(items, "doc_id bigint, text string"),
                               corpus_pipeline.domain_table(spark, sf), corpus_pipeline.MIX_TARGETS).filter("kept").collect()
            assert set(kept) == {r.doc_id for r in drawn} and len(kept) > 0.5 * len(before)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want, start = [], 0
    for i, t in sorted(kept.items()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_run_on_an_empty_table(spark, tables, tmp_path):
    sf = tables[0]
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered(spark):
    names = E.queries()
    assert names["pipeline"] is corpus_pipeline.run
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert len(corpus_pipeline.STAGES) == 5 and quality.MAX_LABELLED
    assert corpus_pipeline.run(spark, SF001).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
