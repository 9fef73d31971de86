"""Cumulative horizon aggregation (A3, with P5, F9, U3).

For every player and every horizon ``i`` in ``1..days`` the original summed
the player's mart rows dated in ``[start, start + i]`` (both ends inclusive),
one filter-and-group pass per player and horizon, then unioned the passes.

Here it is one plan with no loops and no range join:

1. On the schedule side (teams x days, small): games per team and day offset
   ``d = datediff(date, start)``, expanded to the horizons that contain them
   with ``explode(sequence(greatest(1, d), days))`` and counted per
   (team, horizon).  A game on day ``d`` belongs to every horizon ``i >= d``.
2. Players join that table on team (it is finished first and broadcast by its
   size: teams x days), each row contributing ``value x games`` to its horizon.
3. One aggregate per (keys, horizon): A2, the sum of every value column.

A horizon with no game yields no row, as before.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.functions import calendar as cal
from slate.operators.aggregates import sum_all
from slate.operators.joins import join_small

DETAILED_KEYS = ["player_id", "name", "team_abbrev", "fantasy_roster_name", "position"]
SLIM_KEYS = ["player_id", "name"]
VALUES = ["avg_points", "projected_avg_points"]


def team_horizons(schedule: DataFrame, start: dt.date, days: int) -> DataFrame:
    """(team_abbrev, days=i, games_i): games of the team in ``[start, start + i]``."""
    s = F.lit(start)
    d = F.datediff(F.col("date"), s)
    per_day = (
        schedule.where(F.col("date").between(s, F.date_add(s, int(days))))
        .groupBy("team_abbrev", d.alias("d"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_day.withColumn("days", F.explode(F.sequence(F.greatest(F.lit(1), F.col("d")), F.lit(int(days)))))
        .groupBy("team_abbrev", "days")
        .agg(F.sum("n").alias("games"))
    )


def horizon_sums(
    player: DataFrame,
    schedule: DataFrame,
    start: dt.date,
    days: int,
    keys: Sequence[str] = DETAILED_KEYS,
    player_ids: Sequence[int] | DataFrame | None = None,
    values: Sequence[str] = VALUES,
) -> DataFrame:
    """A3: per (keys, horizon) sums of ``values`` over the player's games in the horizon.

    ``player_ids`` (a list, treated as a set, or a one-column DataFrame) limits
    the players; ``None`` means all of them.
    """
    p = player
    if isinstance(player_ids, DataFrame):
        p = p.join(player_ids.select(F.col(player_ids.columns[0]).alias("player_id")).distinct(),
                   "player_id", "left_semi")
    elif player_ids is not None:
        p = p.where(F.col("player_id").isin(sorted(set(player_ids))))
    cols = list(dict.fromkeys([*keys, "team_abbrev", *values]))
    th = team_horizons(schedule, start, days)
    joined = join_small(p.select(*cols), th, "team_abbrev")
    # A2: group by the identity columns and the horizon, sum every other column
    weighted = joined.select(*keys, "days", *[(F.col(v) * F.col("games")).alias(v) for v in values])
    return sum_all(weighted, [*keys, "days"])


def horizon_detailed(player: DataFrame, schedule: DataFrame, start: dt.date, days: int,
                     player_ids=None) -> DataFrame:
    """5 keys, sums, start/end dates with their days of the year, horizon length."""
    s = F.lit(start)
    end = F.date_add(s, F.col("days"))
    return (
        horizon_sums(player, schedule, start, days, DETAILED_KEYS, player_ids)
        .select(*DETAILED_KEYS, *VALUES,
                s.alias("start_date"), cal.day_of_year(s).alias("start_day_of_year"),
                end.alias("end_date"), cal.day_of_year(end).alias("end_day_of_year"),
                F.col("days").cast("int").alias("days"))
    )


def horizon_slim(player: DataFrame, schedule: DataFrame, start: dt.date, days: int,
                 player_ids=None) -> DataFrame:
    """2 keys, sums, start/end dates, horizon length."""
    s = F.lit(start)
    return (
        horizon_sums(player, schedule, start, days, SLIM_KEYS, player_ids)
        .select(*SLIM_KEYS, *VALUES, s.alias("start_date"),
                F.date_add(s, F.col("days")).alias("end_date"), F.col("days").cast("int").alias("days"))
    )
