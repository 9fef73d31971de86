"""Aggregations: window totals (A1), sum of all columns (A2), roster totals (A4),
distinct filter options (A5).

The window aggregate is written for a fan-out that can be enormous: the mart
(player x team game) is never built.  Games are counted per team on the small
schedule side, joined to players, and the per-player sums follow from that
count.  This equals grouping the mart, because every mart row of a player
carries the player's own averages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.operators.filters import ReportParams, day_window
from slate.operators.joins import join_small


def team_games(schedule: DataFrame, window: Column) -> DataFrame:
    """Games per team inside the window (one schedule row per team game)."""
    return (
        schedule.where(window)
        .groupBy("team_abbrev")
        .agg(F.count(F.lit(1)).alias("team_games"))
    )


def window_aggregate(player: DataFrame, schedule: DataFrame, params: ReportParams) -> DataFrame:
    """A1 over the P12 window: per ``params.key`` -> games, sum_avg_points, sum_proj_avg_points.

    Players whose team has no game in the window get no row (as when grouping
    the mart).  Same-name players are merged when the key is ``name`` (parity).
    """
    key = params.key
    tg = team_games(schedule, day_window(params))
    per_player = join_small(
        player.select(key, "team_abbrev", "avg_points", "projected_avg_points"), tg, "team_abbrev")
    g = F.col("team_games")
    return per_player.groupBy(key).agg(
        F.sum(g).cast("long").alias("games"),
        F.sum(F.col("avg_points") * g).alias("sum_avg_points"),
        F.sum(F.col("projected_avg_points") * g).alias("sum_proj_avg_points"),
    )


def window_aggregate_from_mart(mart: DataFrame, params: ReportParams) -> DataFrame:
    """A1 on a stored mart table (the original's formulation; same result)."""
    return (
        mart.where(day_window(params))
        .groupBy(params.key)
        .agg(
            F.count(F.lit(1)).alias("games"),
            F.sum("avg_points").alias("sum_avg_points"),
            F.sum("projected_avg_points").alias("sum_proj_avg_points"),
        )
    )


def sum_all(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A2: group by ``keys`` and sum every other column (names kept)."""
    values = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


def distinct_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A5: distinct values of several columns in one pass -> (option, value).

    One scan and one shuffle: each row is unpivoted into (column, value)
    pairs, then de-duplicated (with a map-side partial distinct).
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("option"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    return df.select(F.inline(pairs)).distinct()
