"""Keyed loads whose cost follows the load: Bloom filters (S10, J4) and merge on read."""

import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from slate.operators.dedup import insert_or_ignore, upsert
from slate.session import scratch_path
from slate.sources import keyed_loads as kl
from slate.sources import sinks

SCHEMA = "seq long, a long, b string, v string"
KEY = ["a", "b"]


def local(path):
    return path[5:] if path.startswith("file:") else path


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(local(path)) for f in files if f.endswith(".parquet"))


def batches(spark, n, per_load, keys, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        data = [(i * per_load + j, rng.choice([None, *range(keys)]) if rng.random() < 0.1 else rng.randrange(keys), rng.choice(["x", "y", None]), f"v{i}-{j}")
                for j in range(per_load)]
        out.append(spark.createDataFrame(data, SCHEMA))
    return out


def scanned_loads(df):
    return sorted({f.split("/load=")[1].split("/")[0] for f in df.inputFiles()})


def test_loads_equal_one_after_the_other(spark):
    table, want = scratch_path(spark, "loads"), None
    for i, batch in enumerate(batches(spark, 4, 60, 40)):
        kl.insert_or_ignore_load(spark, table, batch, i, KEY, ["seq"], ["v"])
        want = insert_or_ignore(want, batch, KEY, ["seq"], ["v"])
    assert rows(kl.read_loads(spark, table)) == rows(want)


def test_a_small_load_opens_only_loads_that_may_hold_its_keys(spark):
    table = scratch_path(spark, "loads")
    for i in range(6):  # keys 1000 i .. 1000 i + 999
        kl.insert_or_ignore_load(spark, table, spark.range(1000 * i, 1000 * i + 1000).select(
            F.col("id").alias("seq"), F.col("id").alias("a"), F.lit("x").alias("b"), F.lit("old").alias("v")), i, KEY, ["seq"])
    small = spark.createDataFrame([(1, 4200, "x", "new"), (2, 9999, "x", "new"), (3, None, "x", "new")], SCHEMA)
    found = kl.loads_that_may_hold(spark, table, small, KEY)
    assert 4 in found and len(found) <= 2  # of six
    opened = kl.insert_or_ignore_load(spark, table, small, 6, KEY, ["seq"])
    assert opened == found
    assert scanned_loads(kl.read_some_loads(spark, table, opened)) == [str(n) for n in opened]
    got = rows(kl.read_loads(spark, table).where("v = 'new'").select("a"))
    assert got == [(9999,), (None,)] or got == [(None,), (9999,)]
    # a new key that no load holds opens none at all, or by rare chance one
    assert len(kl.loads_that_may_hold(spark, table, spark.createDataFrame([(1, -5, "q", "z")], SCHEMA), KEY)) <= 1


def test_a_filter_never_denies_a_key(spark):
    table = scratch_path(spark, "loads")
    for i, batch in enumerate(batches(spark, 3, 200, 5000)):
        kl.insert_or_ignore_load(spark, table, batch, i, KEY, ["seq"])
    for i in range(3):
        stored = spark.read.parquet(f"{table}/load={i}").where("a is not null and b is not null")
        for r in stored.limit(8).collect():
            assert i in kl.loads_that_may_hold(spark, table, spark.createDataFrame([r], SCHEMA), KEY)


def test_loads_without_a_filter_are_opened(spark, monkeypatch):
    table = scratch_path(spark, "loads")
    first, second, third = batches(spark, 3, 20, 1000)
    kl.insert_or_ignore_load(spark, table, first, 0, KEY, ["seq"])
    sinks.append_insert_or_ignore(spark, table, second, 1, KEY, ["seq"])  # writes no filter
    probe = spark.createDataFrame([(1, -1, "none", "z")], SCHEMA)
    assert 1 in kl.loads_that_may_hold(spark, table, probe, KEY)
    monkeypatch.setattr(kl, "MOST_PROBED_KEYS", 5)  # a large load opens all
    assert kl.loads_that_may_hold(spark, table, third, KEY) == [0, 1]
    empty = spark.createDataFrame([], SCHEMA)
    assert kl.loads_that_may_hold(spark, table, empty, KEY) == [1]


def test_a_repeated_load_replaces_its_rows_and_filter(spark):
    table = scratch_path(spark, "loads")
    one, two = (spark.createDataFrame([(1, k, "x", "v")], SCHEMA) for k in (10, 20))
    kl.insert_or_ignore_load(spark, table, one, 0, KEY, ["seq"])
    kl.insert_or_ignore_load(spark, table, two, 0, KEY, ["seq"])
    assert rows(kl.read_loads(spark, table).select("a")) == [(20,)]
    kl.insert_or_ignore_load(spark, table, two, 1, KEY, ["seq"])
    assert rows(kl.read_loads(spark, table).select("a")) == [(20,)]


def test_a_load_that_fails_leaves_no_wrong_filter(spark):
    table = scratch_path(spark, "loads")
    kl.insert_or_ignore_load(spark, table, spark.createDataFrame([(1, 10, "x", "v")], SCHEMA), 0, KEY, ["seq"])
    broken = spark.createDataFrame([(1, 77, "x", "v")], SCHEMA).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        kl.insert_or_ignore_load(spark, table, broken, 0, KEY, ["seq"])
    assert sinks.table_versions(spark, f"{table}/_bloom", "load=") == []


def merged(spark, table):
    return rows(kl.read_upserted(spark, table, KEY).select("seq", "a", "b", "v"))


@pytest.mark.parametrize("compact_after", [(), (0,), (1, 3), (0, 1, 2, 3, 4)])
def test_upserts_merged_on_read_equal_upserts_in_place(spark, compact_after):
    table, want = scratch_path(spark, "deltas"), None
    assert kl.read_upserted(spark, table, KEY) is None and kl.compact(spark, table, KEY) is None
    for i, batch in enumerate(batches(spark, 5, 50, 25, seed=7)):
        kl.upsert_load(spark, table, batch, i, KEY, ["seq"])
        want = upsert(want, batch, KEY, ["seq"])
        if i in compact_after:
            kl.compact(spark, table, KEY)
        assert merged(spark, table) == rows(want)
    kl.compact(spark, table, KEY)
    assert kl.compact(spark, table, KEY) is None and kl.drop_compacted(spark, table) >= 5
    assert merged(spark, table) == rows(want)
    assert sinks.table_versions(spark, table, "load=") == [] and len(sinks.table_versions(spark, table)) == 1


def test_bytes_of_a_small_load_do_not_grow_with_the_table(spark):
    written = []
    for n in (100, 100_000):
        table = scratch_path(spark, "deltas")
        big = spark.range(n).select(F.col("id").alias("seq"), F.col("id").alias("a"), F.lit("x").alias("b"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        kl.upsert_load(spark, table, big, 0, KEY, ["seq"])
        kl.compact(spark, table, KEY)
        path = kl.upsert_load(spark, table, spark.createDataFrame([(1, 5, "x", "new")], SCHEMA), 1, KEY, ["seq"])
        written.append(size_of(path))
        assert rows(kl.read_upserted(spark, table, KEY).where("v = 'new'").select("a")) == [(5,)]
        assert kl.read_upserted(spark, table, KEY).count() == n
    assert written[1] <= 1.1 * written[0]


def test_a_small_delta_does_not_shuffle_the_version(spark):
    table = scratch_path(spark, "deltas")
    kl.upsert_load(spark, table, spark.range(1000).select(F.col("id").alias("seq"), F.col("id").alias("a"), F.lit("x").alias("b"), F.lit("o").alias("v")), 0, KEY, ["seq"])
    kl.compact(spark, table, KEY)
    kl.upsert_load(spark, table, spark.createDataFrame([(1, 5, "x", "n")], SCHEMA), 1, KEY, ["seq"])
    plan = kl.read_upserted(spark, table, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan


def test_a_repeated_upsert_load_counts_once_and_a_lost_compaction_changes_nothing(spark):
    table = scratch_path(spark, "deltas")
    first, second = batches(spark, 2, 30, 10, seed=3)
    kl.upsert_load(spark, table, first, 0, KEY, ["seq"])
    kl.upsert_load(spark, table, second, 1, KEY, ["seq"])
    once = merged(spark, table)
    kl.upsert_load(spark, table, second, 1, KEY, ["seq"])
    assert merged(spark, table) == once
    os.makedirs(local(f"{table}/version=1"))  # begun, never ended: no _SUCCESS
    assert merged(spark, table) == once


def test_upsert_delta_stream(spark, tmp_path):
    from slate.streaming.incremental import BATCH_COL, upsert_delta_stream

    src, target, want = f"{tmp_path}/src", f"{tmp_path}/target", None
    for i, batch in enumerate(batches(spark, 3, 40, 15, seed=5)):
        batch.coalesce(1).write.parquet(f"{src}/part={i}")
        q = upsert_delta_stream(spark.readStream.schema(SCHEMA).parquet(f"{src}/*"), target, f"{tmp_path}/ck", KEY, ["seq"], compact_every=2)
        q.awaitTermination()
        assert q.exception() is None
        want = upsert(want, batch, KEY, ["seq"])
    assert sinks.table_versions(spark, target) == [1]
    assert rows(kl.read_upserted(spark, target, KEY, BATCH_COL).select("seq", "a", "b", "v")) == rows(want)
