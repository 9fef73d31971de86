"""Physical plan checks: the plans we want at scale, not just correct answers."""

import pytest

from slate.plans.catalog import QUERIES
from conftest import SF01
from slate.plans import adapters
from plan_summary import executed_plans, last_execution

PYTHON_OK = {"html_table_rows", "schedule_from_pages", "schedule_raw_csv"}
#: Reports and marts: the player side must stay where it is.
TEAM_JOINS = ["player_schedule_mart", "window_aggregate", "horizon_detailed", "horizon_slim", "free_agent_report",
              "rising_stars", "roster_report", "matchup_report", "matchup_totals"]


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_nested_loop_or_cartesian_or_python(spark, key):
    """In every plan that ran, also in those that wrote tables before the last read."""
    spark.conf.set("spark.sql.ui.explainMode", "extended")
    seen = last_execution(spark)
    QUERIES[key](spark, SF01).write.format("noop").mode("overwrite").save()
    plans = executed_plans(spark, seen)
    assert plans
    for p in plans:
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
        if key not in PYTHON_OK:
            assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p


def test_plans_are_found_when_spark_forgets_older_executions(spark):
    """The list of remembered executions is full: new ones take the place of old ones."""
    limit = "spark.sql.ui.retainedExecutions"
    store = spark._jsparkSession.sharedState().statusStore()
    for _ in range(3):
        spark.range(3).count()
    first = last_execution(spark)
    spark.range(7).write.format("noop").mode("overwrite").save()
    found = executed_plans(spark, first)
    assert len(found) == 1 and "Range (0, 7" in found[0]
    assert last_execution(spark) == first + 1 and executed_plans(spark, first + 1) == []
    # what a full list looks like: as long as before, but with later ids
    assert store.executionsCount() <= int(spark.conf.get(limit, "1000")) + 100


def test_filters_and_pruning_reach_the_lineitem_scan(spark):
    p = plan_text(adapters.games(spark, SF01))
    scan = [line for line in p.splitlines() if "lineitem" in line and "FileScan" in line][0]
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate,1997-10-01T00:00)" in scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_shipdate:timestamp_ntz>" in scan


def final_plan(df) -> str:
    df._jdf.queryExecution().toRdd().count()
    return plan_text(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", TEAM_JOINS)
def test_players_are_not_shuffled_on_teams(spark, key):
    """With default settings: the team side is finished first and is the build side."""
    p = final_plan(QUERIES[key](spark, SF01))
    assert "hashpartitioning(team_abbrev" not in p and "SortMergeJoin [team_abbrev" not in p
    joins = [line for line in p.splitlines() if "BroadcastHashJoin [team_abbrev" in line]
    assert joins and all("BuildRight" in line for line in joins)


@pytest.mark.parametrize("key", ["free_agent_report", "roster_report", "matchup_report"])
def test_reports_scan_the_stored_player_table_pruned(spark, key):
    p = plan_text(QUERIES[key](spark, SF01))
    scans = [line for line in p.splitlines() if "FileScan parquet" in line and "projected_avg_points" in line]
    assert len(scans) == 2 and "Scan ExistingRDD" not in p
    assert sum("avg_last_7" not in line for line in scans) == 1 and all("lineup_slot" not in line for line in scans)


def test_reports_of_a_session_share_the_player_table(spark):
    found = [{f for f in QUERIES[key](spark, SF01).inputFiles() if "slate-player-" in f} for key in ("free_agent_report", "roster_report")]
    assert found[0] and found[0] == found[1]


def test_date_range_scan_prunes_the_stored_mart(spark):
    p = plan_text(QUERIES["date_range_scan"](spark, SF01))
    assert "PartitionFilters: [week" in p


def test_small_upsert_does_not_shuffle_the_target(spark):
    from pyspark.sql import functions as F

    from slate.operators.dedup import replace_keys
    from slate.session import store

    target = store(spark.range(1000).select("id", F.lit("old").alias("v")), "target")
    batch = store(spark.range(5).select("id", F.lit("new").alias("v")), "batch")
    df = replace_keys(target, batch, F.broadcast(batch.select("id")), ["id"])
    p = final_plan(df)
    assert "Exchange hashpartitioning" not in p and "Sort [" not in p
    assert df.where("v = 'new'").count() == 5 and df.count() == 1000


def test_no_game_is_dropped(spark):
    sf = "/root/testdata/sf0.1"
    assert adapters.schedule(spark, sf).count() == 2 * adapters.games(spark, sf).count()


def test_pivot_runs_without_value_discovery_job(spark):
    # explicit pivot values: building the plan must not launch a job
    sc = spark.sparkContext
    tracker = sc.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    QUERIES["week_grid"](spark, SF01)
    assert len(tracker.getJobIdsForGroup(None)) == before


SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_hot_team_is_split_when_the_mart_join_shuffles(spark, monkeypatch):
    """One team holds a third of all players and nothing is broadcast (the
    schedule side past the threshold): the player x game join is salted, and AQE
    splits what is still uneven.  The
    result equals the brute-force count (every player x each of the team's
    games).  Thresholds are scaled down to the fixture's size."""
    import datetime as dt

    from pyspark.sql import functions as F

    from slate.operators import joins
    from slate.plans import reports

    n, days = 30000, 30
    pid = F.col("id")
    players = spark.range(0, n, 1, 8).select(
        pid.alias("player_id"), F.concat(F.lit("p"), pid.cast("string")).alias("name"),
        F.when(pid % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("T"), (pid % 50).cast("string")))
        .alias("team_abbrev"),
        F.lit("R").alias("fantasy_roster_name"), F.lit(0).alias("is_free_agent"), F.lit("G").alias("position"),
        F.lit(None).cast("string").alias("injury_status"), F.lit(0).alias("injured"),
        (pid % 7).cast("double").alias("total_points"), (pid % 11).cast("double").alias("avg_points"),
        F.lit(1.0).alias("projected_total_points"), F.lit(1.0).alias("projected_avg_points"))
    teams = spark.createDataFrame([(f"T{i}",) for i in range(50)] + [("HOT",)], "team_abbrev string")
    sched = teams.select("team_abbrev", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("id")).select(
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("date"), F.lit("19:30").alias("time"),
        F.lit(1).alias("week"), F.lit(1).alias("day_of_year"), F.lit(0).alias("day_of_week"),
        F.lit("X").alias("opponent_abbrev"), "team_abbrev", F.lit(0).alias("is_visitor"))
    saved = {k: spark.conf.get(k) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(reports, "join_small", lambda a, b, on: joins.salted_join(a, b, [on], salts=4))
        mart = reports.player_schedule_mart(players, sched)
        agg = mart.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("player_id").alias("s"))
        got = agg.collect()[0]
        plan = agg._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert got.n == n * days and got.s == days * (n * (n - 1) // 2)
    assert "SortMergeJoin(skew=true)" in plan and "AQEShuffleRead skewed" in plan


def test_orders_are_pruned_by_a_runtime_bloom_filter_before_the_game_join(spark):
    """Past the broadcast threshold the games join shuffles orders; Spark's runtime
    filter builds a bloom filter from the (selective) filtered lineitem keys and
    applies it to the orders scan, so only orders of season games are shuffled.
    The scan-size threshold is scaled down to the fixture."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1k"}
    saved = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        g = adapters.games(spark, SF01)
        plan = plan_text(g)
        n = g.count()
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    orders_filter = [line for line in plan.splitlines() if "o_orderkey" in line and "might_contain" in line]
    assert orders_filter and "bloom_filter_agg(xxhash64(l_orderkey" in plan
    assert n == 4781


def test_player_snapshots_read_lineitem_once_and_equal_single_snapshots(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from conftest import rows

    dates = [dt.date(1998, 1, 1), dt.date(1998, 1, 8), dt.date(1998, 3, 1)]
    snaps = adapters.player_snapshots(spark, SF01, dates)
    assert plan_text(snaps).count("lineitem.parquet") == 1
    for i, d in enumerate(dates):
        one = snaps.where(F.col("snapshot") == i).drop("snapshot")
        assert rows(one) == rows(adapters.player(spark, SF01, d))
