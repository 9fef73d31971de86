"""Composite reports (R1-R9): each is ``DataFrame(s) + params -> DataFrame``.

Reports take the ``player`` and ``schedule`` tables rather than the stored mart:
the per-player window totals are derived from games counted per team
(see :mod:`slate.operators.aggregates`), so the player x game fan-out is only
materialised when the mart itself is asked for (R1).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.constants import MART_COLS, PLAYER_POINTS_COLS, WEEKDAY_NAMES
from slate.functions.scoring import product, rising_predicate, truncate_to_long
from slate.operators import filters as flt
from slate.operators.aggregates import window_aggregate
from slate.operators.filters import ReportParams
from slate.operators.joins import join_small
from slate.operators.reshape import games_played, listed, weekday_pivot
from slate.operators.windows import rest_days
from slate.session import store
from slate.sources.fan_out import FanOut


#: Mart rows of a week that one task makes (about; a file of the stored mart).
MART_TASK_ROWS = 2_000_000
#: Players that one task holds at most (about), however few games they have.
MART_TASK_PLAYERS = 500_000
#: ISO weeks are numbered 1 to 53.
WEEK_NUMBERS = 54


def player_schedule_mart(player: DataFrame, schedule: DataFrame, task_rows: int = MART_TASK_ROWS) -> DataFrame:
    """R1 (J1 + P1): one row per player and game of the player's team.

    Many-to-many fan-out on ``team_abbrev``.  Only the needed columns of each
    side are read.  A task makes the rows of one week and one part of the
    players, in the order of the dates, so a mart laid out by week is written
    from there, without a shuffle or sort of its rows:

    1. Both sides are finished first, and the rows and players of the largest week counted;
       the players are dealt into as many parts as bring its tasks to about ``task_rows``
       rows and at most ``MART_TASK_PLAYERS`` players.
    2. Players meet the days on which their team plays.  That side (teams x days)
       is broadcast if its size allows, so a team holding many players does no harm;
       beyond that size the join is salted.  These rows, a fraction of the mart's,
       are dealt by week and part.
    3. There they meet the day's games in a merge join, which keeps its rows in the
       order of its keys: week and date.

    The frame carries the sides of a task's rows (``fan_out``): players by week and
    part, and the week's games.  Stored by week and date, the rows are made from
    them where they are written (:mod:`slate.sources.fan_out`).
    """
    p_cols = [c for c in MART_COLS if c in player.columns and c not in ("team_abbrev",)]
    s_cols = ["date", "time", "week", "day_of_year", "day_of_week", "opponent_abbrev", "is_visitor"]
    player = store(player.select("team_abbrev", *p_cols), "mart-player")
    schedule = store(schedule.select("team_abbrev", *s_cols), "mart-schedule")

    games = schedule.groupBy("team_abbrev", "week").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("date").isNull() | F.col("week").isNull()).alias("undated"))
    weeks = (player.groupBy("team_abbrev").agg(F.count(F.lit(1)).alias("players")).join(games, "team_abbrev")
             .groupBy("week").agg(F.sum(F.col("players") * F.col("games")).alias("rows"), F.sum("players").alias("players"), F.sum("undated").alias("undated")))
    most = weeks.agg(F.max("rows").alias("rows"), F.max("players").alias("players"), F.sum("undated").alias("undated")).first()
    parts = max(1, math.ceil((most.rows or 0) / task_rows), math.ceil((most.players or 0) / MART_TASK_PLAYERS))

    cell = F.col("week") * parts + F.col("part")
    dealt = player.withColumn("part", F.pmod(F.xxhash64(*player.columns), F.lit(parts)).cast("int"))
    if parts > 1:
        dealt = dealt.repartitionById(parts, "part")
    days = schedule.select("team_abbrev", "week", "date").distinct()
    playing = join_small(dealt, days, "team_abbrev").withColumn("cell", cell).drop("part")
    games = schedule.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("cell", cell).drop("part")
    cells = WEEK_NUMBERS * parts
    joined = playing.repartitionById(cells, "cell").hint("merge").join(
        games.repartitionById(cells, "cell"), ["week", "date", "team_abbrev", "cell"]).select(*MART_COLS)
    rest = None
    if most.undated:  # games without a date or week are on no day's list
        undated = schedule.where(F.col("date").isNull() | F.col("week").isNull())
        rest = join_small(player, undated, "team_abbrev").select(*MART_COLS)
        joined = joined.union(rest)

    def sides() -> FanOut:
        dated = games.where(F.col("date").isNotNull() & F.col("week").isNotNull() & F.col("team_abbrev").isNotNull())
        weeks = schedule.where(F.col("date").isNotNull() & F.col("week").isNotNull()).select("team_abbrev", "week").distinct()
        left = join_small(dealt, weeks, "team_abbrev").withColumn("cell", cell).drop("part", "week")
        return FanOut(left.repartitionById(cells, "cell"), dated.repartitionById(cells, "cell"), "cell", "team_abbrev", "week", "date", MART_COLS, rest)

    joined.fan_out = sides
    return joined


def _with_totals(base: DataFrame, agg: DataFrame, key: str) -> DataFrame:
    """J2 + F17: left join the window totals and derive ``sum_fantasy_points``."""
    return (
        base.join(agg, key, "left")
        .withColumn("sum_fantasy_points", product("fantasy_points", "games"))
    )


def _finish(df: DataFrame, sort: bool) -> DataFrame:
    out = df.select(*PLAYER_POINTS_COLS)
    return out.orderBy(F.col("sum_avg_points").desc_nulls_last(), F.col("name")) if sort else out


def free_agent_report(player: DataFrame, schedule: DataFrame, params: ReportParams = ReportParams(),
                      sort: bool = True) -> DataFrame:
    """R2: unowned players with their projected totals in the window.

    Players without a game in the window (NULL total) are dropped.
    """
    agg = window_aggregate(player, schedule, params)
    base = player.where(flt.free_agent_filters(params))
    out = _with_totals(base, agg, params.key).where(flt.not_null("sum_fantasy_points"))
    return _finish(out, sort)


def rising_stars(player: DataFrame, schedule: DataFrame, params: ReportParams = ReportParams(),
                 sort: bool = True, min_recent: float | None = None, ratio: float | None = None) -> DataFrame:
    """Free agents (R2) whose recent form passes the trend rule."""
    kwargs = {k: v for k, v in (("min_recent", min_recent), ("ratio", ratio)) if v is not None}
    out = free_agent_report(player, schedule, params, sort=False).where(rising_predicate(**kwargs))
    return _finish(out, sort)


def roster_report(player: DataFrame, schedule: DataFrame, params: ReportParams = ReportParams(),
                  sort: bool = True) -> DataFrame:
    """Owned players (optionally one roster); NULL totals are kept."""
    agg = window_aggregate(player, schedule, params)
    base = player.where(flt.roster_filters(params))
    return _finish(_with_totals(base, agg, params.key), sort)


def matchup_report(player: DataFrame, schedule: DataFrame, params: ReportParams = ReportParams(),
                   sort: bool = True) -> DataFrame:
    """Two rosters side by side, tagged ``side`` 1 and 2.

    One scan of ``player``: each row is tagged with every side whose filter
    it passes (a player may sit on both sides when the names coincide), and
    one join attaches the window totals to both sides.
    """
    r1, r2 = params.roster_names
    sides = F.filter(
        F.array(F.when(flt.side_filters(r1, params), F.lit(1)), F.when(flt.side_filters(r2, params), F.lit(2))),
        lambda x: x.isNotNull())
    agg = window_aggregate(player, schedule, params)
    tagged = player.withColumn("side", F.explode(sides))
    out = _with_totals(tagged, agg, params.key).select("side", *PLAYER_POINTS_COLS)
    if sort:
        out = out.orderBy("side", F.col("sum_avg_points").desc_nulls_last(), F.col("name"))
    return out


def matchup_totals(report: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    """A4 + F21: truncated total of ``sum_fantasy_points`` per side (0 when empty).

    A single global aggregate (always one row, even on empty input) split into
    the two sides, so both sides are present without a join.
    """
    r1, r2 = params.roster_names
    one = report.agg(*[
        truncated_total_when(s).alias(f"t{s}") for s in (1, 2)])
    return one.select(F.inline(F.array(
        F.struct(F.lit(1).alias("side"), F.lit(r1).cast("string").alias("fantasy_roster_name"),
                 F.col("t1").alias("total_fantasy_points")),
        F.struct(F.lit(2).alias("side"), F.lit(r2).cast("string").alias("fantasy_roster_name"),
                 F.col("t2").alias("total_fantasy_points")),
    )))


def truncated_total_when(side: int):
    return truncate_to_long(F.coalesce(
        F.sum(F.when(F.col("side") == side, F.col("sum_fantasy_points"))), F.lit(0.0)))


def _grid_index(season_col: str | None) -> tuple[str, ...]:
    """Rows of a weekday grid: (team, ISO week), plus the season when given (N7:
    ISO weeks carry no year, so two seasons would share a row)."""
    return ("team_abbrev", "week") if season_col is None else (season_col, "team_abbrev", "week")


def week_grid(schedule: DataFrame, week: int | None = None, teams: Sequence[str] | None = None,
              season_col: str | None = None) -> DataFrame:
    """R6 (A6, A8): opponent per weekday for each (team, week), plus ``Games``.

    A day with several games lists all opponents, sorted (a cell is bounded by
    the number of teams); ``Games`` counts the days with a game.  The week/team filter is applied before the pivot (and reaches the scan).
    """
    s = schedule.where(flt.conjunction([flt.equals("week", week), flt.member_of("team_abbrev", teams)]))
    grid = weekday_pivot(s, "opponent_abbrev", index=_grid_index(season_col), agg=listed)
    grid = grid.withColumns({d: F.when(F.col(d) != "", F.col(d)) for d in WEEKDAY_NAMES})
    return games_played(grid)


def rest_grid(schedule: DataFrame, week: int | None = None, teams: Sequence[str] | None = None,
              season_col: str | None = None) -> DataFrame:
    """R7 (W1, W2, A7): rest days after each game laid out by weekday.

    Rest days are computed over each team's whole schedule first (the next game
    may fall in the next week), then the optional team/week filter applies.
    With ``season_col`` the next game is looked for within the same season.
    """
    partition = ("team_abbrev",) if season_col is None else ("team_abbrev", season_col)
    r = rest_days(schedule, partition=partition)
    r = r.where(flt.conjunction([flt.equals("week", week), flt.member_of("team_abbrev", teams)]))
    return weekday_pivot(r, "no_game_days_following", index=_grid_index(season_col))


__all__ = [
    "free_agent_report",
    "matchup_report",
    "matchup_totals",
    "player_schedule_mart",
    "rest_grid",
    "rising_stars",
    "roster_report",
    "week_grid",
]
