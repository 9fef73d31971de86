"""Token files: exact round trips, ids as the tokenizer gives them, order and offsets."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slate.llm import token_files as tf
from slate.llm.common import read

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = ["", " ", "\n\n", "A B  c", "don't we'll 'S x's", "é ́x 가", " a b　c\x1cd\x85e", "x<|endoftext|>y <|startoftext|>", "x<|ENDOFTEXT|>y <|StartOfText|>", "<|endoftext|", "Été <|EndOfText|>", "ΑΣ ΟΔΟΣ ΣΑΣ.",
           "İstanbul ẞ ﬁ Å", "123 4५६ ½", "🙂👩‍👩‍👧 ok", "a\tb\rc\r\nd\x00e", "= ̸ < ̸", "!!!...,,,   ---", "ZWJ‍ ​ end"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return tf.Encoder(VOCABULARY)


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def expected(tokenizer, rows):
    """Sorted (doc_id, n_tokens, crc32), and all ids in order of (id, ...) for unique ids."""
    return sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows for x in [ids(tokenizer, t)]), key=str)


def check(got, rows, tokenizer):
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == expected(tokenizer, rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))


@pytest.mark.parametrize("text", AWKWARD)
def test_runs_encode_like_the_whole_text(text, tokenizer, encoder):
    assert np.frombuffer(*encoder([text]), "<u4").tolist() == ids(tokenizer, text)[:-1]


def test_every_latin_character_in_any_place(tokenizer, encoder):
    for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x180)]):
        for text in (c, c * 3, f"a{c}B", f"{c}1{c}", f"'{c}", f"X{c} {c}y"):
            assert np.frombuffer(*encoder([text]), "<u4").tolist() == ids(tokenizer, text)[:-1], (c, text)


def test_a_vocabulary_without_such_rules_encodes_runs_whole(tokenizer, monkeypatch):
    monkeypatch.setattr(tf.Encoder, "_word_pattern", staticmethod(lambda rules: None))
    assert [np.frombuffer(x, "<u4").tolist() for x in tf.Encoder(VOCABULARY)(AWKWARD)] == [ids(tokenizer, t)[:-1] for t in AWKWARD]


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'aAzs1.,<|>́éÉß²ª"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text_encodes_like_the_whole_text(text):
    tokenizer, encoder = _shared()
    assert np.frombuffer(*encoder([text]), "<u4").tolist() == ids(tokenizer, text)[:-1]


def _shared(made=[]):
    if not made:
        made.append((Tokenizer.from_file(VOCABULARY), tf.Encoder(VOCABULARY)))
    return made[0]


def test_groups_of_texts_give_one_result_each(tokenizer, monkeypatch):
    monkeypatch.setattr(tf, "LONG_TEXT", 100)
    monkeypatch.setattr(tf, "REMEMBERED", 30)
    monkeypatch.setattr(tf, "TOGETHER", 7)
    texts = [*AWKWARD, None, "long " * 90, *AWKWARD, "a", ""] * 2
    assert [np.frombuffer(x, "<u4").tolist() for x in tf.Encoder(VOCABULARY)(texts)] == [ids(tokenizer, t)[:-1] for t in texts]


def test_long_texts_are_cut_at_blanks_only(tokenizer, encoder, monkeypatch):
    monkeypatch.setattr(tf, "LONG_TEXT", 50)
    monkeypatch.setattr(tf, "REMEMBERED", 40)
    rng = random.Random(4)
    text = "".join(rng.choices("ab c\nd'1 é", k=3000)) + "x" * 200
    own = tf.Encoder(VOCABULARY)
    assert np.frombuffer(*own([text]), "<u4").tolist() == ids(tokenizer, text)[:-1]
    assert len(list(own._pieces(text))) > 10 and "".join(own._pieces(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["byte", "bit"]))
def test_planes_come_back(values, kind):
    a = np.array(values, "<u4")
    planes = tf.to_planes(a, kind)
    assert len(planes) == 32 // tf.PLANES[kind] and (tf.from_planes(planes, len(a), kind) == a).all()


def test_bit_planes_hold_one_bit_of_each_id():
    planes = tf.to_planes(np.array([1, 0, 3, 1, 0, 0, 0, 0, 2], "<u4"), "bit")
    assert planes[0] == bytes([0b10110000, 0]) and planes[1] == bytes([0b00100000, 0b10000000]) and planes[31] == bytes(2)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_a_reader_seeks_to_the_blocks_of_a_range(tmp_path, kind):
    path, a = str(tmp_path / "x.tok"), np.arange(1000, dtype="<u4") * 37
    with open(path, "wb") as f:
        w = tf.FileWriter(f, kind, block=64)
        for k in range(0, 1000, 125):
            w.add(k, a[k : k + 125].tobytes())
        assert w.close(pa.int64()) == len(open(path, "rb").read())
    found = tf.TokenFile(path)
    assert found.n_ids == 1000 and len(found.blocks) == 16 and len(found.blocks[0]["planes"]) == 32 // tf.PLANES[kind]
    for start, stop in [(0, 1000), (63, 65), (64, 128), (999, 2000), (5, 5), (-3, 2)]:
        assert found.ids(start, stop).tolist() == a[max(0, start):stop].tolist()
    read_blocks = []
    found.ids_of_block = lambda k: read_blocks.append(k) or tf.TokenFile.ids_of_block(found, k)
    found.ids(130, 190)
    assert read_blocks == [2]


def test_damage_is_noticed(tmp_path):
    path = tmp_path / "x.tok"
    out = io.FileIO(path, "wb")
    w = tf.FileWriter(out)
    w.add(1, np.random.default_rng(1).integers(0, 49408, 5000).astype("<u4").tobytes())
    w.close(pa.int64())
    raw = bytearray(path.read_bytes())
    raw[40] ^= 255
    path.write_bytes(raw)
    with pytest.raises(Exception, match="damaged|decompress"):
        tf.TokenFile(str(path)).ids(0, 10)
    path.write_bytes(raw[:-1])
    with pytest.raises(ValueError, match="no token file"):
        tf.TokenFile(str(path))


def corpus():
    rng = random.Random(8)
    texts = AWKWARD + [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    rows = [(7 * i % 1000, t) for i, t in enumerate(texts)]
    return rows + [(5000, None), (5001, "word " * 50_000), (None, "no id"), (None, None), (21, "again"), (21, "again"), (21, "again\n")]


@pytest.mark.parametrize("options", [{}, {"kind": "bit", "block": 128, "file_ids": 5000, "part_bytes": 1}, {"file_ids": 1}])
def test_round_trip(spark, tmp_path, tokenizer, options):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.select("*", *(F.lit(1).alias(c) for c in ("tie", "row", "file", "start")))
    files = tf.write_tokens(df, str(tmp_path / "out"), **options).orderBy("start").collect()
    got = tf.read_documents(spark, str(tmp_path / "out")).collect()
    check(got, rows, tokenizer)
    assert sum(f.n_docs for f in files) == len(rows) and sum(f.n_ids for f in files) == sum(r.n_tokens for r in got)
    if options.get("file_ids") == 1:
        assert len(files) == len(rows)
    # ids by way of the files, in order
    flat = np.concatenate([tf.TokenFile(str(tmp_path / "out" / "data" / f.file)).ids(0, f.n_ids) for f in files])
    for r in got:
        assert zlib.crc32(flat[r.start : r.start + r.n_tokens].astype("<u4").tobytes()) == r.ids_crc32


def test_copies_of_one_row_are_spread(spark, tmp_path):
    df = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    files = tf.write_tokens(df, str(tmp_path / "out"), part_bytes=1 << 8)
    docs = [r.n_docs for r in files.collect()]
    assert sum(docs) == 3000 and len(docs) > 4 and max(docs) < 1500
    assert tf.read_documents(spark, str(tmp_path / "out")).select("start").distinct().count() == 3000


def test_files_that_no_task_reported_are_not_read(spark, tmp_path):
    """What a lost or repeated attempt leaves behind stays out."""
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    tf.write_tokens(df, str(tmp_path / "out"))
    stray = io.FileIO(tmp_path / "out" / "data" / "stray.tok", "wb")
    w = tf.FileWriter(stray)
    w.add(99, b"\1\0\0\0")
    w.close(pa.int64())
    assert sorted(r.doc_id for r in tf.read_documents(spark, str(tmp_path / "out")).collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)exist"):
        tf.write_tokens(df, str(tmp_path / "out"))


def test_empty_table_and_text_ids(spark, tmp_path, tokenizer):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tf.round_trip(empty, str(tmp_path / "none")).collect() == []
    df = spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string")
    got = tf.round_trip(df, f"file:{tmp_path}/named").collect()
    assert sorted((r.doc_id, r.start) for r in got) == [("a", 0), ("b", len(ids(tokenizer, "y z")))]
    with pytest.raises(ValueError, match="kind"):
        tf.write_tokens(empty, str(tmp_path / "bad"), kind="nibble")


def test_query_over_whole_table(spark, tokenizer):
    from slate.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    check(QUERIES["op12_token_files"](spark, sf).collect(), rows, tokenizer)
