import datetime as dt
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF01, rows
from slate.constants import WEEKDAY_NAMES
from slate.operators import joins
from slate.operators.aggregates import distinct_options, sum_all, window_aggregate, window_aggregate_from_mart
from slate.operators.dedup import insert_or_ignore, upsert
from slate.operators.filters import ReportParams, day_window
from slate.operators.horizon import horizon_detailed, horizon_slim, horizon_sums
from slate.operators.reshape import games_played, unpivot_games, weekday_pivot
from slate.operators.schema import SCHEDULE, enforce_schema
from slate.operators.windows import rest_days
from slate.plans import adapters, reports
from slate.session import remove_stored, store
from slate.sources.feeds import top_n

D = dt.date


def test_unpivot_doubles_rows_symmetrically(spark):
    g = spark.createDataFrame([(D(2024, 1, 1), "V", "H"), (D(2024, 1, 2), "A", None)],
                              "date date, visitor string, home string")
    out = rows(unpivot_games(g), "date", "team_abbrev", "opponent_abbrev", "matchup", "is_visitor")
    assert out[:2] == [(D(2024, 1, 1), "H", "V", "V@H", 0), (D(2024, 1, 1), "V", "H", "V@H", 1)]
    assert len(out) == 4 and all(r[3] is None for r in out[2:])  # NULL side -> NULL matchup


def test_rest_days(spark):
    s = spark.createDataFrame([("A", D(2024, 1, 1)), ("A", D(2024, 1, 2)), ("A", D(2024, 1, 5)),
                               ("B", D(2024, 1, 3))], "team_abbrev string, date date")
    got = rows(rest_days(s), "team_abbrev", "date", "no_game_days_following")
    assert [r[2] for r in got] == [0, 2, 0, 0]


def test_weekday_pivot_always_seven_columns(spark):
    s = spark.createDataFrame([("A", 1, 0, "X"), ("A", 1, 2, "Y")],
                              "team_abbrev string, week int, day_of_week int, opponent_abbrev string")
    g = games_played(weekday_pivot(s, "opponent_abbrev"))
    assert g.columns == ["team_abbrev", "week", *WEEKDAY_NAMES, "Games"]
    r = g.first()
    assert (r.Monday, r.Tuesday, r.Wednesday, r.Sunday, r.Games) == ("X", None, "Y", None, 2)


def _toy(spark):
    player = spark.createDataFrame(
        [(1, "p1", "T", "R1", "G", 5.0, 1.0), (2, "p2", "U", "R1", "F", 7.0, 2.0)],
        "player_id long, name string, team_abbrev string, fantasy_roster_name string, position string, "
        "avg_points double, projected_avg_points double")
    sched = spark.createDataFrame([("T", D(2024, 1, 1)), ("T", D(2024, 1, 4)), ("U", D(2024, 1, 4))],
                                  "team_abbrev string, date date")
    return player, sched


def test_horizon_fixture(spark):
    player, sched = _toy(spark)
    out = {(r.player_id, r.days): r.avg_points for r in horizon_sums(player, sched, D(2024, 1, 1), 4).collect()}
    # p1: games on day 0 and day 3 -> 5, 5, 10, 10 ; p2: only day 3 -> rows for 3 and 4 only
    assert out == {(1, 1): 5.0, (1, 2): 5.0, (1, 3): 10.0, (1, 4): 10.0, (2, 3): 7.0, (2, 4): 7.0}


def test_horizon_ids_are_a_set(spark):
    player, sched = _toy(spark)
    a = rows(horizon_slim(player, sched, D(2024, 1, 1), 4, player_ids=[1, 1, 2]))
    b = rows(horizon_slim(player, sched, D(2024, 1, 1), 4))
    assert a == b


def _mart(spark):
    p, s = adapters.player(spark, SF01), adapters.schedule(spark, SF01)
    return p, s, reports.player_schedule_mart(p, s)


def test_horizon_equals_brute_force_loop(spark):
    """A3 against the original's loop: one filter-and-group per horizon, unioned."""
    p, s, mart = _mart(spark)
    start, days = D(1998, 1, 1), 7
    keys = ["player_id", "name", "team_abbrev", "fantasy_roster_name", "position"]
    parts = []
    for i in range(1, days + 1):
        f = mart.where(F.col("date").between(F.lit(start), F.date_add(F.lit(start), i)))
        parts.append(sum_all(f.select(*keys, "avg_points", "projected_avg_points"), keys)
                     .withColumn("days", F.lit(i)))
    brute = {tuple(r[k] for k in keys) + (r.days,): (r.avg_points, r.projected_avg_points)
             for part in parts for r in part.collect()}
    fast = {tuple(r[k] for k in keys) + (r.days,): (r.avg_points, r.projected_avg_points)
            for r in horizon_detailed(p, s, start, days).collect()}
    assert brute.keys() == fast.keys() and len(fast) > 0
    for k, (a, b) in brute.items():
        assert fast[k][0] == pytest.approx(a, rel=1e-12) and fast[k][1] == pytest.approx(b, rel=1e-12)


def test_window_aggregate_equals_mart_grouping(spark):
    p, s, mart = _mart(spark)
    for params in (ReportParams(as_of=D(1998, 1, 1)), ReportParams(as_of=D(1998, 1, 1), day_offset=(0, 119)),
                   ReportParams(as_of=D(1998, 1, 1), window_by="date")):
        a = {r.name: tuple(r)[1:] for r in window_aggregate(p, s, params).collect()}
        b = {r.name: tuple(r)[1:] for r in window_aggregate_from_mart(mart, params).collect()}
        assert a.keys() == b.keys()
        for k in a:
            assert a[k][0] == b[k][0]
            assert a[k][1] == pytest.approx(b[k][1], rel=1e-12)


def test_mart_fan_out_count(spark):
    p, s, mart = _mart(spark)
    players = {r.team_abbrev: r["count"] for r in p.groupBy("team_abbrev").count().collect()}
    games = {r.team_abbrev: r["count"] for r in s.groupBy("team_abbrev").count().collect()}
    assert mart.count() == sum(n * games.get(t, 0) for t, n in players.items())


def test_insert_or_ignore_semantics(spark):
    schema = "seq int, k1 string, k2 double, v string, req string"
    batch = spark.createDataFrame([
        (1, "a", 1.0, "first", "x"), (2, "a", 1.0, "second", "x"),   # same key: first wins
        (3, "b", None, "n1", "x"), (4, "b", None, "n2", "x"),        # NULL in key: both kept
        (5, "c", 2.0, "dropped", None),                               # NULL required column: skipped
    ], schema)
    once = insert_or_ignore(None, batch, ["k1", "k2"], ["seq"], ["req"])
    assert sorted(r.v for r in once.collect()) == ["first", "n1", "n2"]
    again = insert_or_ignore(once, batch.where(F.col("k2").isNotNull()), ["k1", "k2"], ["seq"], ["req"])
    assert rows(again) == rows(once)  # idempotent for keyed rows


def test_upsert_last_wins_and_idempotent(spark):
    target = spark.createDataFrame([(1, "old", 0), (2, "keep", 0)], "id int, v string, seq int")
    batch = spark.createDataFrame([(1, "mid", 1), (1, "new", 2), (3, "add", 1), (None, "bad", 3)],
                                  "id int, v string, seq int")
    once = upsert(target, batch, ["id"], ["seq"])
    assert rows(once, "id", "v") == [(1, "new"), (2, "keep"), (3, "add")]
    assert rows(upsert(once, batch, ["id"], ["seq"]), "id", "v") == rows(once, "id", "v")


def test_salted_join_equals_plain_join(spark):
    big = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "zero"), (1, "one")], "k long, name string")
    for how in ("inner", "left"):
        assert rows(joins.salted_join(big, small, ["k"], how, salts=7)) == rows(big.join(small, "k", how))


def test_join_small_broadcasts_by_size_and_salts_beyond(spark):
    big = spark.range(100).select((F.col("id") % 5).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        near = joins.join_small(big, small, "k", how)
        assert "BroadcastHashJoin" in near._jdf.queryExecution().executedPlan().toString()
        far = joins.join_small(big, small, "k", how, max_bytes=0)
        assert rows(near) == rows(far) == rows(big.join(small, "k", how))


def test_stored_tables_are_removed_on_request(spark):
    df = store(spark.range(10), "gone")
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert os.path.isdir(folder) and df.count() == 10
    assert remove_stored(df) == 1 and not os.path.exists(folder)
    assert remove_stored(spark.read.parquet(f"{SF01}/nation.parquet")) == 0 and os.path.exists(f"{SF01}/nation.parquet")


def test_rest_days_with_several_games_a_day(spark):
    s = spark.createDataFrame([("A", D(2024, 1, 1), "X"), ("A", D(2024, 1, 1), "Y"), ("A", D(2024, 1, 4), "X")],
                              "team_abbrev string, date date, opponent_abbrev string")
    assert rows(rest_days(s), "date", "no_game_days_following") == [(D(2024, 1, 1), 2), (D(2024, 1, 4), 0)]


def test_week_grid_lists_all_opponents_of_a_day(spark):
    s = spark.createDataFrame([("A", 1, 0, "Y"), ("A", 1, 0, "X"), ("A", 1, 0, "X"), ("A", 1, 3, "Z")],
                              "team_abbrev string, week int, day_of_week int, opponent_abbrev string")
    r = reports.week_grid(s).first()
    assert (r.Monday, r.Tuesday, r.Thursday, r.Games) == ("X,Y", None, "Z", 2)


@pytest.mark.parametrize("window_by", ["date", "day_of_year"])
def test_no_as_of_means_today_in_the_east(spark, window_by):
    east = spark.sql("SELECT to_date(from_utc_timestamp(current_timestamp(), 'America/New_York')) AS d").first().d
    sched = spark.createDataFrame([("T", east + dt.timedelta(days=i)) for i in range(-1, 3)], "team_abbrev string, date date")
    sched = sched.withColumn("day_of_year", F.dayofyear("date"))
    got = sched.where(day_window(ReportParams(day_offset=(0, 1), window_by=window_by)))
    assert rows(got, "date") == rows(sched.where(F.col("date").between(F.lit(east), F.date_add(F.lit(east), 1))
                                                 & ((F.lit(window_by) == "date") | (F.col("day_of_year") >= F.dayofyear(F.lit(east))))), "date")


def test_lookup_passthrough(spark):
    df = spark.createDataFrame([("Atlanta Hawks",), ("Nowhere FC",), (None,)], "t string")
    d = spark.createDataFrame([("Atlanta Hawks", "ATL")], "name string, abbrev string")
    assert rows(joins.lookup_passthrough(df, "t", d, "name", "abbrev")) == [("ATL",), ("Nowhere FC",), (None,)]


def test_existing_new_orphan_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    tgt = spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(joins.existing_keys(df, tgt, "k")) == [(2,)]
    assert len(rows(joins.new_keys(df, tgt, "k"))) == 2
    assert rows(joins.orphan_keys(df, "k", tgt, "k")) == [(1,)]
    # a key that is not the first column keeps its place
    wide = spark.createDataFrame([("a", 1), ("b", 2)], "v string, k int")
    assert joins.existing_keys(wide, tgt, "k").columns == ["v", "k"]
    assert joins.new_keys(wide, tgt, "k").columns == ["v", "k"]


def test_top_n_per_group_matches_row_number(spark):
    df = spark.range(3000).select((F.col("id") % 4).alias("g"), ((F.col("id") * 7919) % 1000).alias("v"),
                                  F.col("id"))
    got = rows(top_n(df, 5, [F.col("v").desc(), F.col("id")], ["g"], salts=8))
    from pyspark.sql import Window
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id"))
    exp = rows(df.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn"))
    assert got == exp


def test_enforce_schema(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), "7", "A"), (None, "7", "B")], "date date, week string, team_abbrev string")
    partial = df.withColumns({c: F.lit(1) for c in ("day_of_year", "day_of_week", "is_visitor")}).withColumns(
        {c: F.lit("x") for c in ("time", "opponent_abbrev", "matchup")})
    out = enforce_schema(partial, SCHEDULE)
    assert out.columns == SCHEDULE.names
    assert out.count() == 1 and dict(out.dtypes)["week"] == "int"
    with pytest.raises(Exception):
        enforce_schema(partial, SCHEDULE, on_null="raise").collect()
    with pytest.raises(ValueError):
        enforce_schema(df.select("date"), SCHEDULE)


def test_distinct_options(spark):
    df = spark.createDataFrame([("a", "T"), ("a", "U"), ("b", "T")], "name string, team string")
    assert rows(distinct_options(df, ["name", "team"])) == [("name", "a"), ("name", "b"), ("team", "T"), ("team", "U")]


def _ignore_loop(target, batch, key_idx, req_idx):
    """Brute force: the original's row-by-row INSERT OR IGNORE (arrival order = list order)."""
    out = list(target)
    seen = {tuple(r[i] for i in key_idx) for r in target if all(r[i] is not None for i in key_idx)}
    for r in batch:
        if any(r[i] is None for i in req_idx):
            continue
        key = tuple(r[i] for i in key_idx)
        if all(k is not None for k in key):
            if key in seen:
                continue
            seen.add(key)
        out.append(r)
    return out


def _upsert_loop(target, batch, key_idx):
    """Brute force: row-by-row INSERT OR REPLACE on the key (the last row wins)."""
    table = {tuple(r[i] for i in key_idx): r for r in target}
    for r in batch:
        key = tuple(r[i] for i in key_idx)
        if all(k is not None for k in key):
            table[key] = r
    return list(table.values())


_ROW = st.tuples(st.sampled_from(["a", "b", "c", None]), st.sampled_from([1.0, 2.0, None]),
                 st.sampled_from(["x", "y", None]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(target=st.lists(_ROW, max_size=6), batch=st.lists(_ROW, max_size=12))
def test_keyed_loads_equal_row_by_row_loops(spark, target, batch):
    """Insert-or-ignore and upsert against the row-by-row forms, on random rows with
    duplicate keys, NULL keys and NULL required values."""
    schema = "seq int, k1 string, k2 double, req string"
    t_rows = [(-1 - i, *r) for i, r in enumerate(target) if r[2] is not None]  # the target satisfies NOT NULL
    b_rows = [(i, *r) for i, r in enumerate(batch)]
    b_df = spark.createDataFrame(b_rows, schema)

    t_loaded = _ignore_loop([], t_rows, (1, 2), (3,))
    got = insert_or_ignore(spark.createDataFrame(t_loaded, schema), b_df, ["k1", "k2"], ["seq"], ["req"])
    assert rows(got) == rows(spark.createDataFrame(_ignore_loop(t_loaded, b_rows, (1, 2), (3,)), schema))

    t_up = _upsert_loop([], t_rows, (1,))
    got = upsert(spark.createDataFrame(t_up, schema), b_df, ["k1"], ["seq"])
    assert rows(got) == rows(spark.createDataFrame(_upsert_loop(t_up, b_rows, (1,)), schema))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(games=st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(0, 40)), max_size=30, unique=True))
def test_rest_days_equal_a_sorted_loop(spark, games):
    """W1/W2 against the plain loop: per team, days to the next game minus one (0 after the last game)."""
    base = D(2024, 1, 1)
    rows_ = [(t, base + dt.timedelta(days=d)) for t, d in games]
    expected = []
    for team in {t for t, _ in rows_}:
        days = sorted(d for t, d in rows_ if t == team)
        for cur, nxt in zip(days, days[1:] + [None]):
            gap = (nxt - cur).days if nxt else None
            expected.append((team, cur, gap - 1 if gap and gap > 1 else 0))
    df = spark.createDataFrame(rows_, "team_abbrev string, date date")
    assert rows(rest_days(df), "team_abbrev", "date", "no_game_days_following") == sorted(expected)


def test_grids_keep_seasons_apart(spark):
    """ISO week 1 of two seasons; without a season column the cells would merge."""
    sched = spark.createDataFrame([
        ("2023", D(2023, 1, 2), 1, 0, "AAA", "BBB"), ("2023", D(2023, 1, 4), 1, 2, "AAA", "CCC"),
        ("2024", D(2024, 1, 1), 1, 0, "AAA", "DDD"), ("2024", D(2024, 1, 2), 1, 1, "AAA", "EEE"),
    ], "season string, date date, week int, day_of_week int, team_abbrev string, opponent_abbrev string")
    grid = reports.week_grid(sched, season_col="season")
    got = rows(grid, "season", "Monday", "Tuesday", "Wednesday", "Games")
    assert got == [("2023", "BBB", None, "CCC", 2), ("2024", "DDD", "EEE", None, 2)]
    rest = rows(reports.rest_grid(sched, season_col="season"), "season", "Monday", "Wednesday")
    # the last game of the 2023 season is followed by no game within the season
    assert rest == [("2023", 1, 0), ("2024", 0, None)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]), st.integers(0, 5)),
                       max_size=60),
       n=st.integers(1, 4))
def test_top_n_per_group_equals_sort_and_slice(spark, values, n):
    """Two salted rounds against sorting each group (many ties, one hot group); the
    unique id makes the order total."""
    data = [(g, v, i) for i, (g, v) in enumerate(values)]
    expected = []
    for g in {g for g, _, _ in data}:
        expected += sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))[:n]
    df = spark.createDataFrame(data, "g string, v int, id int")
    got = top_n(df, n, [F.col("v").desc(), F.col("id")], partition_by=["g"], salts=4)
    assert rows(got) == sorted(expected)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells=st.lists(st.tuples(st.sampled_from(["A", "B"]), st.integers(1, 2), st.integers(0, 6),
                                st.integers(0, 9)), max_size=30))
def test_weekday_pivot_equals_a_dict_pivot(spark, cells):
    """(team, week) x weekday -> min value; always seven weekday columns."""
    expected = {}
    for t, w, d, v in cells:
        row = expected.setdefault((t, w), [None] * 7)
        row[d] = v if row[d] is None else min(row[d], v)
    df = spark.createDataFrame(cells, "team_abbrev string, week int, day_of_week int, v int")
    got = weekday_pivot(df, "v")
    assert got.columns == ["team_abbrev", "week", *WEEKDAY_NAMES]
    assert rows(got) == sorted((t, w, *vals) for (t, w), vals in expected.items())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names=st.lists(st.sampled_from(["x", "y", "z", None]), max_size=20),
       entries=st.lists(st.tuples(st.sampled_from(["x", "y"]), st.sampled_from(["X1", "X2", "Y1"])), max_size=6))
def test_lookup_passthrough_equals_a_dict_lookup(spark, names, entries):
    """A dictionary value replaces the name (smallest value for a duplicated key);
    names without an entry, and NULL, pass through; rows are never multiplied."""
    table = {}
    for k, v in entries:
        table[k] = min(table.get(k, v), v)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    dictionary = spark.createDataFrame(entries, "k string, v string")
    got = joins.lookup_passthrough(df, "name", dictionary, "k", "v", out_col="abbrev")
    assert rows(got, "i", "abbrev") == sorted((i, table.get(n, n)) for i, n in enumerate(names))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(players=st.lists(st.tuples(st.sampled_from(["ann", "bob", "cid"]), st.sampled_from(["A", "B", "C"]),
                                  st.sampled_from([None, 1.0, 2.0, 5.0]), st.sampled_from([None, 3.0, 4.0])),
                        max_size=10),
       games=st.lists(st.tuples(st.sampled_from(["A", "B", "D"]), st.integers(1, 12)), max_size=15))
def test_window_aggregate_equals_grouping_the_mart(spark, players, games):
    """A1 through per-team game counts against building the player x game mart in
    Python and grouping it by name (same-name players merge; NULL averages are
    skipped; a player without a game in the window adds nothing)."""
    lo, hi = 1, 7  # as_of = Jan 1 (day 1), offsets (0, 6)
    mart = [(name, avg, proj) for name, team, avg, proj in players
            for g_team, day in games if g_team == team and lo <= day <= hi]
    expected = {}
    for name, avg, proj in mart:
        n, a, p = expected.get(name, (0, None, None))
        expected[name] = (n + 1, a if avg is None else (a or 0.0) + avg, p if proj is None else (p or 0.0) + proj)
    pdf = spark.createDataFrame([(i, *p) for i, p in enumerate(players)],
                                "player_id int, name string, team_abbrev string, avg_points double, "
                                "projected_avg_points double")
    sdf = spark.createDataFrame(games, "team_abbrev string, day_of_year int")
    got = window_aggregate(pdf, sdf, ReportParams(as_of=D(1998, 1, 1), day_offset=(0, 6)))
    assert rows(got, "name", "games", "sum_avg_points", "sum_proj_avg_points") == sorted(
        (name, *vals) for name, vals in expected.items())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(players=st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.sampled_from([None, 1.0, 2.0, 4.0])),
                        min_size=1, max_size=6),
       games=st.lists(st.tuples(st.sampled_from(["A", "B"]), st.integers(-2, 9)), max_size=15),
       days=st.integers(1, 6))
def test_horizon_sums_equal_the_python_loop(spark, players, games, days):
    """A3 against the original's loop in plain Python: for each player and horizon i,
    the sum over the team's games dated start .. start + i; no row without a game."""
    start = D(2024, 1, 1)
    expected = {}
    for pid, (team, avg) in enumerate(players):
        for i in range(1, days + 1):
            hits = [avg for t, d in games if t == team and 0 <= d <= i]
            if hits:
                expected[(pid, i)] = None if avg is None else avg * len(hits)
    pdf = spark.createDataFrame([(pid, f"p{pid}", t, a, a) for pid, (t, a) in enumerate(players)],
                                "player_id long, name string, team_abbrev string, avg_points double, "
                                "projected_avg_points double")
    sdf = spark.createDataFrame([(t, start + dt.timedelta(days=d)) for t, d in games], "team_abbrev string, date date")
    got = {(r.player_id, r.days): r.avg_points
           for r in horizon_sums(pdf, sdf, start, days, keys=["player_id", "name"]).collect()}
    assert got == expected
