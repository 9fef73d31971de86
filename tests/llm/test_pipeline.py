"""The pipeline's stages on sf0.001, each against what it must keep of its input."""

import brute
import pytest

import corpus_pipeline
from slate.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    out, docs = [], read(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_rows_and_columns(results):
    for name, (before, after) in results.items():
        if name != "shard":
            assert after.columns == before.columns
            assert set(texts(after).items()) <= set(texts(before).items())
    before, after = results["shard"]
    assert texts(after) == texts(before) and after.columns == [*before.columns, "shard"]


def test_language_stage_keeps_all_texts_with_letters(results):
    before, after = (texts(x) for x in results["identify_language"])
    assert {i for i, t in before.items() if any(c.isalpha() for c in t or "")} == set(after)


def test_near_duplicate_stage(results):
    before, after = (texts(x) for x in results["near_dedup"])
    groups = brute.near_duplicates(list(before.items()), width=5)
    assert set(after) == {i for i, (_, group) in groups.items() if i == group}


def test_decontamination_stage(spark, results):
    before, after = (texts(x) for x in results["remove_benchmark"])
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    hits = brute.contamination(list(before.items()), items)
    assert set(after) == {i for i, r in hits.items() if r[1] == 0}


def test_run_is_the_stages_in_order(spark, results):
    assert texts(corpus_pipeline.run(spark, SF)) == texts(results["shard"][1])
