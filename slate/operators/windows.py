"""Window operators: next game per team (W1) and rest days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rest_days(
    schedule: DataFrame,
    partition: Sequence[str] = ("team_abbrev",),
    date_col: str = "date",
    out: str = "no_game_days_following",
) -> DataFrame:
    """W1 + W2: days without a game after each day on which a team plays.

    One row per distinct (team, date), with the calendar columns that follow
    from the date.  ``next = lead(date)`` per team; ``gap = datediff(next,
    date)``; rest days are ``gap - 1`` when ``gap > 1`` else 0, and 0 after a
    team's last game.  Pass ``partition=("team_abbrev", "season")`` to keep
    seasons apart.

    Several games of a team on one day are collapsed (map-side first) before
    the window, which then sorts at most as many rows per team as the calendar
    has days, however many games a team has.
    """
    of_date = [c for c in ("week", "day_of_week", "day_of_year") if c in schedule.columns]
    days = schedule.select(*partition, date_col, *of_date).distinct()
    w = Window.partitionBy(*partition).orderBy(F.col(date_col))
    gap = F.datediff(F.lead(F.col(date_col)).over(w), F.col(date_col))
    return days.withColumn(out, F.when(gap > 1, gap - 1).otherwise(F.lit(0)).cast("int"))
