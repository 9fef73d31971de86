"""Fill-in-middle transformation against a plain Python form."""

import random

import brute
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slate.llm import fill_middle

TEXTS = ["", None, "one line", "ends\n", "\n", "\n\n\n", "a\nb\nc", "a\nb\nc\n", "\n\nx\n\ny", "é\nß\n漢字\n🙂 x\n", "has <M> inside\nx", "<P>", "<S", "S>\n<P\n>",
         "<\n<S\n>M>\n<", "tab\t\r\n\x0b\x0cx\r", "x" * 10 + "\n" * 40]


def rows():
    rng = random.Random(11)
    texts = TEXTS + ["\n".join("".join(rng.choices("ab <>PSMé", k=rng.randint(0, 12))) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    texts.append("\n".join(f"line {i}" for i in range(200_000)))
    return list(enumerate(texts)) + [(3, "same id\nother text\n"), (3, "same id\nother text\n"), (None, "no id\nat all"), (None, None)]


def check(got, rows, **options):
    want = sorted([(i, *brute.fill_in_middle(i, t, **options)) for i, t in rows], key=str)
    assert sorted([tuple(r) for r in got.collect()], key=str) == want


def test_equals_the_plain_form(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    got = fill_middle.fill_in_middle(df)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    check(got, rows())
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    check(fill_middle.fill_in_middle(df, rate=40, suffix_first=10, seed=99), rows(), rate=40, suffix_first=10, seed=99)


def test_texts_come_back_from_output_and_form(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    got = fill_middle.report(df).collect()
    want = sorted((str(i), brute.sha(t or "")) for i, t in rows())
    assert sorted((str(r.doc_id), r.restored_sha256) for r in got) == want
    outputs = {(r.doc_id, r.n): r.output_sha256 for r in got}
    for i, t in rows():
        n, *_, output = brute.fill_in_middle(i, t)
        assert outputs[i, n] == brute.sha(output) or (i, n) in [(3, 2), (None, 0), (None, 2)]


def test_empty_tables_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.report(empty).collect() == []
    df = spark.createDataFrame([("a", "x\ny\n")], "doc_id string, text string").select(
        "*", *(F.lit(1).alias(c) for c in ("h1", "n", "form", "output", "tie")))
    assert [tuple(r) for r in fill_middle.fill_in_middle(df).collect()] == [("a", *brute.fill_in_middle("a", "x\ny\n"))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab\n<>PSMé\U0001f642", max_size=20), max_size=8), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_batches_of_any_texts(texts, h1, h2):
    draws = [pa.array([h] * len(texts), pa.int64()) for h in (h1, h2, 0, 50)]
    made = fill_middle.transform_batch(pa.array(texts, pa.string()), draws, 100, 50)
    for k, t in enumerate(texts):
        units = fill_middle.lines(pa.array([t]))[0].as_py()
        assert "".join(units) == t and all(u.find("\n") in (-1, len(u) - 1) and u for u in units)
        low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        if made["form"][k].as_py() == "psm":
            assert made["output"][k].as_py() == "<P>" + "".join(units[:low]) + "<S>" + "".join(units[high:]) + "<M>" + "".join(units[low:high])
        else:
            assert not t or any(m in t for m in ("<P>", "<S>", "<M>"))


def test_a_slice_of_a_batch_is_worked_on_like_a_batch():
    texts = pa.array(["x\n", "a\nb", "", "c\n\nd\n"]).slice(1)
    assert fill_middle.lines(texts).to_pylist() == [["a\n", "b"], [], ["c\n", "\n", "d\n"]]


def test_restoring_is_an_error_for_no_row(spark):
    with pytest.raises(Exception, match="doc_id"):
        fill_middle.fill_in_middle(spark.createDataFrame([("x",)], "text string"))
