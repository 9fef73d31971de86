"""Atomic publication (R15, S9), skipping inside files (S3, P11), rejects (S5), counts (S14), lifetime."""

import datetime as dt
import os
import shutil

import pytest
from conftest import SF001, rows
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slate.operators.schema import enforce_schema
from slate.plans import build as build_module
from slate.plans.build import TABLES, VIEWS, Warehouse, build_from_driver_tables
from slate.session import scratch_path
from slate.sources import feeds, manifest, sinks, tables


def local(path):
    return path[5:] if path.startswith("file:") else path


@pytest.fixture(scope="module")
def built(spark):
    root = scratch_path(spark, "wh")
    build_from_driver_tables(spark, SF001, root)
    return root


@pytest.mark.parametrize("step", ["player_schedule_mart", "horizon_slim", "schedule", "task"])
def test_a_failed_step_leaves_the_published_tables(spark, built, monkeypatch, step):
    wh = Warehouse(built)
    before = {t: rows(wh.read(spark, t).drop("created_at", "modified_at")) for t in ("proj_player_points", "player", "player_points_slim", "team")}
    number = wh.manifest(spark).number

    def lost(*_, **__):
        raise RuntimeError("lost")

    if step == "player_schedule_mart":
        monkeypatch.setattr(build_module.reports, step, lost)
    elif step == "horizon_slim":
        monkeypatch.setattr(build_module, step, lost)
    elif step == "schedule":
        monkeypatch.setattr(build_module.adapters, step, lost)
    else:  # tasks of the mart fail while other tables of the build are already written
        mart = build_module.reports.player_schedule_mart
        monkeypatch.setattr(build_module.reports, "player_schedule_mart", lambda p, s: mart(p, s).withColumn(
            "week", F.when(F.rand() < 2, F.raise_error(F.lit("lost")).cast("int"))))
    with pytest.raises(Exception, match="lost"):
        build_from_driver_tables(spark, SF001, built)
    monkeypatch.undo()
    assert wh.manifest(spark).number == number
    assert {t: rows(wh.read(spark, t).drop("created_at", "modified_at")) for t in before} == before


def test_all_tables_change_at_once(spark, monkeypatch):
    """Readers in the middle of a build see the old tables, all of them."""
    root, seen = scratch_path(spark, "wh"), []
    build_from_driver_tables(spark, SF001, root, dt.date(1998, 1, 1))
    old = dict(Warehouse(root).manifest(spark).tables)
    publish = build_module.publish
    monkeypatch.setattr(build_module, "publish", lambda *a: seen.append(Warehouse(root).manifest(spark).tables) or publish(*a))
    build_from_driver_tables(spark, SF001, root, dt.date(1998, 2, 1))
    new = Warehouse(root).manifest(spark).tables
    assert seen == [old] and set(new) == set(old) and all(new[t] != old[t] for t in [*TABLES, *VIEWS])


def test_two_builds_cannot_both_publish(spark):
    root = scratch_path(spark, "wh")
    wh = Warehouse(root)
    first, second = wh.begin(spark), wh.begin(spark)
    for b, n in ((first, 3), (second, 5)):
        b.write(spark.range(n), "team")
    second.publish()
    with pytest.raises(manifest.PublishConflict):
        first.publish()
    assert wh.read(spark, "team").count() == 5 and wh.manifest(spark).number == 1
    assert not [f for f in os.listdir(local(f"{root}/_manifests")) if f.startswith(".1-") and not f.endswith(".crc")]


def test_unpublished_folders_are_dropped(spark):
    root = scratch_path(spark, "wh")
    wh = Warehouse(root)
    for n in range(1, 5):
        b = wh.begin(spark)
        b.write(spark.range(n), "team")
        b.publish()
    wh.begin(spark).write(spark.range(9), "team")  # a build that failed
    assert wh.drop_old(spark, keep=2) == 3
    assert manifest.manifest_numbers(spark, root) == [3, 4]
    assert [spark.read.parquet(wh.path(manifest.read_manifest(spark, root, n).tables["team"])).count() for n in (3, 4)] == [3, 4]
    assert wh.read(spark, "team").count() == 4 and wh.create(spark) and wh.read(spark, "league").count() == 0
    with pytest.raises(FileNotFoundError):
        Warehouse(scratch_path(spark, "none")).read(spark, "team")


def scan_rows(df):
    """Rows that the file scan handed on."""
    df._jdf.queryExecution().toRdd().count()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()


def test_sorted_files_are_skipped_inside(spark):
    """A week's file in the order of dates: a day's scan reads a part of its row groups."""
    start = dt.date(2024, 1, 1)
    df = spark.range(0, 70_000, 1, 4).select(F.lit(1).alias("week"), F.date_add(F.lit(start), F.pmod(F.xxhash64("id"), F.lit(7)).cast("int")).alias("date"), "id")
    found = {}
    for name, sort_by in (("sorted", ["date"]), ("plain", [])):
        path = sinks.write_table(df, scratch_path(spark, name), partition_by=["week"], sort_by=sort_by, options={"parquet.block.size": "65536", "parquet.page.size": "8192"})
        scan = tables.date_range_scan(spark.read.parquet(path), start, 0, week_col="week")
        found[name] = scan_rows(scan), scan.count()
    assert found["sorted"][1] == found["plain"][1]
    assert found["sorted"][0] < 2 * found["sorted"][1] < found["plain"][0]


FEED = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.IntegerType()))])
GOOD = ['{"id": 1, "name": "a", "tags": [1, 2]}', '{"id": 2}', "{}", '{"id": null, "name": "é"}', '{"id": 3, "extra": {"x": 1}}']
BAD = ['{"id": 4, "name": "cut', "no json", '{"id": "five", "name": "b"}', '{"id": 6, "tags": [1, "x"]}', "[1, 2"]


def test_records_that_do_not_fit_go_to_a_side_table(spark):
    path, rejects = scratch_path(spark, "feed"), scratch_path(spark, "rejects")
    spark.createDataFrame([(x,) for x in [*GOOD, *BAD, "", "   "]], "value string").repartition(3).write.text(path)
    good = feeds.load_feed(spark, path, rejects, FEED)
    assert good.schema.names == FEED.names
    assert rows(good.select("id", "name")) == [(1, "a"), (2, None), (3, None), (None, "é"), (None, None)]
    side = spark.read.parquet(rejects)
    assert sorted(r.record for r in side.collect()) == sorted(BAD) and all("part-" in r.file for r in side.collect())
    # bad whichever columns a query reads
    assert good.select("name").count() == good.count() == 5 and good.select("tags").where("tags is not null").count() == 1
    feeds.load_feed(spark, path, rejects, FEED)
    assert spark.read.parquet(rejects).count() == 2 * len(BAD)  # each load appends its own


def test_dropped_rows_are_counted_in_the_same_pass(spark):
    schema = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.StringType(), False), T.StructField("c", T.DoubleType())])
    df = spark.createDataFrame([(1, "x", 1.0), (None, "y", None), (None, None, 2.0), (4, None, None), (5, "z", None)], "a long, b string, c double")
    counts = Observation()
    kept = enforce_schema(df, schema, counts=counts)
    assert rows(kept) == [(1, "x", 1.0), (5, "z", None)]
    assert counts.get == {"rows": 5, "rejected": 3, "null_a": 2, "null_b": 2}
    all_null = T.StructType([T.StructField("c", T.DoubleType())])
    none = Observation()
    assert enforce_schema(df, all_null, counts=none).count() == 5 and none.get == {"rows": 5, "rejected": 0}
    empty = Observation()
    assert enforce_schema(df.limit(0), schema, counts=empty).collect() == [] and empty.get["rows"] == 0


def test_shared_tables_of_changed_inputs_are_deleted(spark, tmp_path, monkeypatch):
    sf = str(tmp_path)
    spark.range(5).write.parquet(f"{sf}/orders.parquet")
    made = []

    def get(name="t", **layout):
        return tables.shared_table(spark, sf, name, ["orders"], lambda: made.append(name) or spark.read.parquet(f"{sf}/orders.parquet").withColumn("day", F.col("id") % 2), **layout)

    first = get()
    assert get() is first and made == ["t"]
    old_files = [f.removeprefix("file://") for f in first.inputFiles()]
    spark.range(7).write.mode("overwrite").parquet(f"{sf}/orders.parquet")
    second = get()
    assert second.count() == 7 and not any(map(os.path.exists, old_files))
    monkeypatch.setattr(tables, "MOST_SHARED", 2)
    get("u", partition_by=["day"], sort_by=["id"])
    assert get().count() == 7  # used again, so "u" is the older one
    get("v")
    kept = [k[1] for k in tables._SHARED if k[0] == spark.sparkContext.applicationId and k[2] == sf]
    assert "u" not in kept and set(kept) <= {"t", "v"}
    assert tables.release_shared(spark, "v") == 1 and tables.release_shared(spark, "v") == 0
    shutil.rmtree(tmp_path / "orders.parquet")
