"""Token ids and their range-coded files: equal to the tokenizers library, exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sift.llm import rangecoder, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, start string, part int"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def ids_of(texts):
    got = list(tokens.encode_column(PATH, pa.array(texts, pa.string()), 2))
    ids, count = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


TEXTS = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "\n\n a", "a\t\tb ", "it's we'll 'S ' s", "12 ab3c 4", "x--y !! ##",
         "é Été ß ñandú", "naïve 日本語 text", "ɏ ɐ", "<|endoftext|> and <|endoftext|>", "²³ ½ ª", "a b \u0085c", "a b",
         "emoji 🙂🙂 end", "word " * 3000, "\x00\x1c\x1f a", "a" * 5000, " \t \n \r\n  x", "'", "a '", "x" + " " * 40]


def test_ids_equal_the_library(library):
    assert ids_of(TEXTS) == [[*library(t), 2] for t in TEXTS]


def test_long_patterned_words_are_told_apart(library):
    """Thue-Morse words and their complements cancel in sums modulo 2**64."""
    word = "a"
    while len(word) < 65_536:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [x for n in (1024, 2048, 4096, 65_536) for x in (word[:n], word[:n].translate(str.maketrans("ab", "ba")))]
    assert ids_of(texts) == [[*library(t), 2] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab A1 \n\t.,!'é²ɏɐ|   世"), max_size=30), min_size=1, max_size=6))
def test_ids_equal_the_library_on_any_text(texts):
    t = Tokenizer.from_file(PATH) if not hasattr(test_ids_equal_the_library_on_any_text, "t") else test_ids_equal_the_library_on_any_text.t
    test_ids_equal_the_library_on_any_text.t = t
    t.encode_special_tokens = True
    assert ids_of(texts) == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def sequences():
    rng = np.random.default_rng(0)
    zipf = np.minimum(rng.zipf(1.3, 30_000), 50_000).astype(np.uint16)
    yield np.zeros(0, np.uint16)
    yield np.array([65534], np.uint16)
    yield np.zeros(5000, np.uint16)
    yield np.tile(np.arange(700, dtype=np.uint16), 20)
    yield zipf
    yield rng.integers(0, 65535, 20_000).astype(np.uint16)
    yield np.repeat(zipf[:500], 9)
    yield np.concatenate([np.full(4096, 7, np.uint16), zipf[:2048]])


@pytest.mark.parametrize("block", [1, 100, 2048])
def test_round_trip(block):
    for ids in sequences():
        ids = ids[:300] if block == 1 else ids
        data = rangecoder.encode_ids(ids, block)
        assert np.array_equal(rangecoder.decode_ids(data), ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=600), st.integers(1, 64))
def test_round_trip_of_any_ids(ids, block):
    assert rangecoder.decode_ids(rangecoder.encode_ids(np.array(ids, np.uint16), block)).tolist() == ids


def test_blocks_are_independent_and_compress():
    ids = np.tile(np.random.default_rng(1).integers(0, 50_000, 50).astype(np.uint16), 400)
    data = rangecoder.encode_ids(ids)
    assert len(data) < 0.25 * 2 * len(ids)
    half = rangecoder.encode_ids(ids[: 4 * 2048])  # the same table, so the same first blocks
    assert rangecoder.decode_ids(half).tolist() == ids[: 4 * 2048].tolist()


def test_damage_is_noticed():
    data = rangecoder.encode_ids(np.arange(9000, dtype=np.uint16))
    for at in (0, 30, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            rangecoder.decode_ids(bytes(bad))
    with pytest.raises(ValueError):
        rangecoder.decode_ids(data[:-9])


def test_files(spark, library, tmp_path, monkeypatch):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "Été", "12", "\n", "don't", "x,"]) for _ in range(r.randint(0, 80)))) for i in range(200)]
    r.shuffle(rows)
    rows += [(None, None), (None, "null id"), (500, None), (501, ""), (7, "again"), (7, "again"), (900, "long " * 50_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    rangecoder.write_ids(df, PATH, str(tmp_path / "ids"), segment=1500, block=64)
    got = rangecoder.read_digest(spark, str(tmp_path / "ids")).collect()
    want = sorted((str(i), len(library(t)) + 1, zlib.crc32(np.array([*library(t), 2], "<u4").tobytes())) for i, t in rows)
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_crc32) for x in got) == want
    got.sort(key=lambda x: x.start)
    assert [x.start for x in got] == (np.cumsum([0] + [x.n_tokens for x in got[:-1]])).tolist()
    assert [-1 if x.doc_id is None else x.doc_id for x in got] == sorted(-1 if i is None else i for i, _ in rows)


def test_empty_table(spark):
    assert rangecoder.token_files(spark.createDataFrame([], SCHEMA), PATH).count() == 0
