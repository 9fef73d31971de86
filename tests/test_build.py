from conftest import SF01, rows
from slate.operators.filters import ReportParams
from slate.plans import adapters, reports
from slate.constants import DEFAULT_AS_OF
from slate.plans.build import TABLES, VIEWS, Warehouse, build_from_driver_tables, build_from_feeds
from slate.session import scratch_path
from test_sources import _feed, _pages
from slate.sources.feeds import ROSTER_FEED
from slate.sources.tables import date_range_scan


def test_build_from_driver_tables_and_reports_on_it(spark):
    root = scratch_path(spark, "wh")
    build_from_driver_tables(spark, SF01, root)
    wh = Warehouse(root)
    p, s = wh.read(spark, "player"), wh.read(spark, "schedule")
    a = rows(reports.free_agent_report(p, s, ReportParams(as_of=DEFAULT_AS_OF), sort=False))
    b = rows(reports.free_agent_report(adapters.player(spark, SF01), adapters.schedule(spark, SF01),
                                       ReportParams(as_of=DEFAULT_AS_OF), sort=False))
    assert a == b and len(a) == 20
    mart = wh.read(spark, "proj_player_points")
    assert mart.count() == 42919
    plan = date_range_scan(mart, DEFAULT_AS_OF, 7, week_col="week")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [week" in plan and "PushedFilters: [IsNotNull(date)" in plan
    assert {t: wh.read(spark, t).count() for t in ("fantasy_roster", "player_points_slim")} == {"fantasy_roster": 5, "player_points_slim": 700}
    assert all(wh.read_or_none(spark, t) is not None for t in [*TABLES, *VIEWS, "league", "player_stats"])
    assert set(wh.clear(spark)) == {*TABLES, *VIEWS} and wh.read_or_none(spark, "player") is None
    # a second build gives the same content
    build_from_driver_tables(spark, SF01, root)
    assert wh.read(spark, "proj_player_points").count() == 42919


def test_build_from_feeds_is_idempotent(spark):
    root = scratch_path(spark, "wh")
    rosters = spark.createDataFrame([(7, "T1", "Team One", "1", "East", 1, None, 1)], ROSTER_FEED)
    build_from_feeds(spark, root, _pages(spark), rosters, _feed(spark))
    wh = Warehouse(root)
    first = {t: wh.read(spark, t).count() for t in ("player", "schedule", "fantasy_roster", "proj_player_points")}
    build_from_feeds(spark, root, _pages(spark), rosters, _feed(spark))
    second = {t: wh.read(spark, t).count() for t in first}
    assert first == second
    assert first["player"] == 5 and first["schedule"] == 6 and first["fantasy_roster"] == 2


def test_mart_rows_are_made_by_week_and_part_in_order(spark):
    """The fan-out is spread over weeks and parts of the players, however few files the players come in; a stored mart
    is written by these tasks, one file each, without a shuffle or sort of its rows.  Repeated rows, players
    without a team and games without a date are as in the plain join."""
    import datetime as dt

    from pyspark.sql import functions as F

    from slate.constants import MART_COLS
    from slate.sources import sinks

    n, days = 200, 21
    pid = F.col("id")
    players = spark.range(0, n, 1, 1).select(
        pid.alias("player_id"), F.concat(F.lit("p"), pid.cast("string")).alias("name"),
        F.when(pid % 9 != 0, F.concat(F.lit("T"), (pid % 4).cast("string"))).alias("team_abbrev"),
        F.lit("R").alias("fantasy_roster_name"), F.lit(0).alias("is_free_agent"), F.lit("G").alias("position"),
        F.lit(None).cast("string").alias("injury_status"), F.lit(0).alias("injured"), (pid % 7).cast("double").alias("total_points"),
        F.lit(None).cast("double").alias("avg_points"), F.lit(1.0).alias("projected_total_points"), F.lit(1.0).alias("projected_avg_points"))
    players = players.union(players.where("player_id < 20")).coalesce(1)
    date = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % days).cast("int"))
    games = spark.range(0, 4 * 2 * days, 1, 1).select(
        date.alias("date"), F.lit("19:30").alias("time"), F.weekofyear(date).alias("week"), F.dayofyear(date).alias("day_of_year"),
        F.weekday(date).alias("day_of_week"), F.col("id").cast("string").alias("opponent_abbrev"),
        F.concat(F.lit("T"), (pid % 4).cast("string")).alias("team_abbrev"), F.lit(0).alias("is_visitor"))
    games = games.union(games.where("day_of_year < 3"))
    undated = games.limit(3).select(*[F.lit(None).cast(t).alias(c) if c in ("date", "week") else F.col(c) for c, t in games.dtypes])

    mart = reports.player_schedule_mart(players, games, task_rows=1000)
    by_task = {}
    for r in mart.select("week", "date", F.spark_partition_id().alias("task")).collect():
        by_task.setdefault(r.task, []).append((r.week, r.date))
    assert len(by_task) >= 6 and all(x == sorted(x) and x[0][0] == x[-1][0] for x in by_task.values())
    plain = players.join(games, "team_abbrev").select(*MART_COLS)
    assert rows(mart) == rows(plain) and len(rows(mart)) > 6000

    path = sinks.write_table(mart, scratch_path(spark, "mart"), "error", ["week"], sort_by=["date"], rebalance=False)
    stored = spark.read.parquet(path)
    assert len(stored.inputFiles()) == len(by_task) and rows(stored.select(*MART_COLS)) == rows(plain)
    ordered = mart.sortWithinPartitions("week", "date")
    ordered._jdf.queryExecution().toRdd().count()
    final = ordered._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not any(x in final.split("SortMergeJoin")[0] for x in ("Sort [", "Exchange"))

    both = games.union(undated)
    assert rows(reports.player_schedule_mart(players, both, task_rows=1000)) == rows(players.join(both, "team_abbrev").select(*MART_COLS))
    assert rows(reports.player_schedule_mart(players.limit(0), games)) == []


def _mart_sides(spark):
    """Players (some repeated, some without a team) and games of 21 days (some repeated, some without a date or week)."""
    import datetime as dt

    from pyspark.sql import functions as F

    pid = F.col("id")
    players = spark.range(0, 300, 1, 2).select(
        pid.alias("player_id"), F.when(pid % 11 != 0, F.concat(F.lit("p"), (pid % 50).cast("string"))).alias("name"),
        F.when(pid % 9 != 0, F.concat(F.lit("T"), (pid % 5).cast("string"))).alias("team_abbrev"),
        F.lit("R").alias("fantasy_roster_name"), F.lit(0).alias("is_free_agent"), F.lit("é").alias("position"),
        F.lit(None).cast("string").alias("injury_status"), F.when(pid % 2 == 0, F.lit(1)).alias("injured"),
        F.when(pid % 3 != 0, F.when(pid % 7 == 0, F.lit(float("nan"))).otherwise(pid / 7)).alias("total_points"),
        F.lit(None).cast("double").alias("avg_points"), F.lit(-0.5).alias("projected_total_points"), F.lit(1.0).alias("projected_avg_points"))
    date = F.date_add(F.lit(dt.date(2024, 12, 20)), (pid % 21).cast("int"))
    games = spark.range(0, 4 * 8 * 21, 1, 2).select(
        date.alias("date"), F.lit("19:30").alias("time"), F.weekofyear(date).alias("week"), F.dayofyear(date).alias("day_of_year"),
        F.weekday(date).alias("day_of_week"), F.when(pid % 13 != 0, pid.cast("string")).alias("opponent_abbrev"),
        F.when(pid % 17 != 0, F.concat(F.lit("T"), (pid % 4).cast("string"))).alias("team_abbrev"), F.lit(0).alias("is_visitor"))
    games = games.union(games.where("day_of_year < 3"))
    undated = games.limit(5).select(*[F.lit(None).cast(t).alias(c) if c == "date" else F.col(c) for c, t in games.dtypes])
    weekless = games.limit(5).select(*[F.lit(None).cast(t).alias(c) if c == "week" else F.col(c) for c, t in games.dtypes])
    return players.union(players.where("player_id < 20")), games, undated.union(weekless)


def _same_rows(a, b):
    """Compared as text: NaN is not equal to itself."""
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_stored_mart_rows_are_made_where_they_are_written(spark):
    """The stored mart's rows do not pass the row-based writer: its Arrow tasks get players and games, pair them, and write files
    in the order of dates; rows are those of the plain join, with what is repeated, null or without a date."""
    import datetime as dt

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from slate.constants import MART_COLS
    from slate.sources import sinks

    players, games, undated = _mart_sides(spark)
    plain = players.join(games, "team_abbrev").select(*MART_COLS)
    mart = reports.player_schedule_mart(players, games, task_rows=2000)
    path = sinks.write_table(mart, scratch_path(spark, "mart"), "error", ["week"], sort_by=["date"], rebalance=False)
    stored = spark.read.parquet(path)
    assert _same_rows(stored.select(*MART_COLS), plain) and stored.count() > 20_000
    assert stored.select(*MART_COLS).dtypes == plain.dtypes
    files = [f.removeprefix("file://") for f in stored.inputFiles()]
    assert len(files) > 8
    for f in files:
        meta = pq.ParquetFile(f).metadata
        assert "arrow" in meta.created_by and meta.num_rows < 6000
        dates = pq.read_table(f, partitioning=None).column("date").to_pylist()
        assert dates == sorted(dates)
    day = dt.date(2024, 12, 31)
    assert _same_rows(date_range_scan(stored, day, 1, week_col="week").select(*MART_COLS), plain.where(F.col("date").between(day, day + dt.timedelta(days=1))))

    # rows without a date or a week are stored beside them
    both = games.union(undated)
    mart = reports.player_schedule_mart(players, both, task_rows=2000)
    path = sinks.write_table(mart, scratch_path(spark, "mart"), "error", ["week"], sort_by=["date"], rebalance=False)
    assert _same_rows(spark.read.parquet(path).select(*MART_COLS), players.join(both, "team_abbrev").select(*MART_COLS))

    # another layout, or a frame derived from the mart, is written from its own rows
    late = mart.withColumn("week", F.col("week") + 1)
    path = sinks.write_table(late, scratch_path(spark, "mart"), "error", ["week"], sort_by=["date"], rebalance=False)
    assert _same_rows(spark.read.parquet(path).select(*MART_COLS), late)


def test_pairs_come_in_bounded_groups_by_date():
    import random

    import pyarrow as pa

    from slate.sources.fan_out import pairs

    draw = random.Random(3)
    left = [draw.choice("abcx") for _ in range(40)]
    right = [(draw.choice("abcy"), draw.randrange(5)) for _ in range(60)]
    groups = list(pairs(pa.array(left), pa.array([k for k, _ in right]), pa.array([d for _, d in right]), rows=50))
    assert len(groups) > 5 and all(0 < len(p) == len(g) <= 50 for p, g in groups)
    found = [(int(p), int(g)) for ps, gs in groups for p, g in zip(ps, gs)]
    assert sorted(found) == [(p, g) for p, k in enumerate(left) for g, (r, _) in enumerate(right) if k == r]
    dates = [right[g][1] for _, g in found]
    assert dates == sorted(dates)
    assert not list(pairs(pa.array(["a"]), pa.array(["b"]), pa.array([1])))


def test_failed_mart_tasks_leave_no_rows(spark):
    """A task attempt that fails, or whose result is not counted, leaves nothing that a reader finds."""
    import dataclasses

    import pytest
    from pyspark.sql import functions as F

    from slate.sources.fan_out import write_fan_out

    players, games, _ = _mart_sides(spark)
    fan = reports.player_schedule_mart(players, games, task_rows=2000).fan_out()
    lost = F.when(F.col("player_id") < 290, F.col("player_id")).otherwise(F.raise_error(F.lit("lost")).cast("long"))
    path = scratch_path(spark, "mart")
    with pytest.raises(Exception, match="lost"):
        write_fan_out(dataclasses.replace(fan, left=fan.left.withColumn("player_id", lost)), path)
    assert spark.read.schema("player_id long").parquet(path).count() == 0
    with pytest.raises(FileExistsError):
        write_fan_out(fan, path)


def test_a_mart_task_holds_a_part_of_the_players(spark, monkeypatch):
    """Players with few games: a task's rows are few, but its players are bounded too."""
    players, games, _ = _mart_sides(spark)
    whole = reports.player_schedule_mart(players, games).fan_out().left.groupBy("cell").count()
    monkeypatch.setattr(reports, "MART_TASK_PLAYERS", 60)
    dealt = reports.player_schedule_mart(players, games).fan_out().left.groupBy("cell").count()
    assert max(r["count"] for r in whole.collect()) > 200 and max(r["count"] for r in dealt.collect()) < 100
    assert sum(r["count"] for r in whole.collect()) == sum(r["count"] for r in dealt.collect())
