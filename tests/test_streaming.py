import tempfile

from pyspark.sql import functions as F

from conftest import SF001, rows
from slate.operators.dedup import insert_or_ignore, upsert
from slate.sources.tables import read_table
from slate.streaming.incremental import insert_or_ignore_stream, read_appended, read_snapshot, upsert_stream

COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
KEY = ["o_custkey", "o_orderstatus", "o_orderpriority"]


def _batches(spark):
    o = read_table(spark, SF001, "orders").select(*COLS)
    return o.where(F.col("o_orderkey") < 3000), o.where(F.col("o_orderkey") >= 3000)


def _run(q):
    q.awaitTermination()
    assert q.exception() is None


def test_insert_or_ignore_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="slate-stream-")
    src, tgt, ck = f"{base}/src", f"{base}/tgt", f"{base}/ck"
    first, second = _batches(spark)
    schema = first.schema
    first.coalesce(1).write.parquet(f"{src}/part=1")
    stream = spark.readStream.schema(schema).parquet(f"{src}/*")
    _run(insert_or_ignore_stream(stream, tgt, ck, KEY, ["o_orderkey"]))
    second.coalesce(1).write.parquet(f"{src}/part=2")
    stream = spark.readStream.schema(schema).parquet(f"{src}/*")
    _run(insert_or_ignore_stream(stream, tgt, ck, KEY, ["o_orderkey"]))   # restarts from the checkpoint
    expected = insert_or_ignore(insert_or_ignore(None, first, KEY, ["o_orderkey"]), second, KEY, ["o_orderkey"])
    got = read_appended(spark, tgt)
    assert rows(got.select(*COLS)) == rows(expected)
    # replaying a batch id overwrites its own output: no duplicates
    assert got.count() == got.distinct().count()


def test_upsert_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="slate-stream-")
    src, tgt, ck = f"{base}/src", f"{base}/tgt", f"{base}/ck"
    first, second = _batches(spark)
    first.coalesce(1).write.parquet(f"{src}/part=1")
    _run(upsert_stream(spark.readStream.schema(first.schema).parquet(f"{src}/*"), tgt, ck, ["o_custkey"],
                       ["o_orderkey"]))
    second.coalesce(1).write.parquet(f"{src}/part=2")
    _run(upsert_stream(spark.readStream.schema(first.schema).parquet(f"{src}/*"), tgt, ck, ["o_custkey"],
                       ["o_orderkey"]))
    expected = upsert(upsert(None, first, ["o_custkey"], ["o_orderkey"]), second, ["o_custkey"], ["o_orderkey"])
    assert rows(read_snapshot(spark, tgt).select(*COLS)) == rows(expected.select(*COLS))
