"""Reshaping operators: unpivot (U2), weekday pivots (A6-A8), unions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.constants import WEEKDAY_NAMES

WEEKDAYS = list(range(7))


def matchup(visitor: str | Column, home: str | Column) -> Column:
    """``visitor@home`` (NULL when either side is NULL)."""
    v = F.col(visitor) if isinstance(visitor, str) else visitor
    h = F.col(home) if isinstance(home, str) else home
    return F.concat(v, F.lit("@"), h)


def unpivot_games(
    games: DataFrame,
    visitor_col: str = "visitor",
    home_col: str = "home",
    date_col: str = "date",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One game row -> a home row (is_visitor 0) and a visitor row (is_visitor 1).

    Done in a single pass with ``inline(array(struct, struct))``: no union, no
    second scan, the partitioning of the input is kept.
    """
    home_row = F.struct(
        F.col(home_col).alias("team_abbrev"), F.col(visitor_col).alias("opponent_abbrev"),
        F.lit(0).alias("is_visitor"))
    away_row = F.struct(
        F.col(visitor_col).alias("team_abbrev"), F.col(home_col).alias("opponent_abbrev"),
        F.lit(1).alias("is_visitor"))
    return games.select(
        F.col(date_col),
        *[F.col(c) for c in keep],
        matchup(visitor_col, home_col).alias("matchup"),
        F.inline(F.array(home_row, away_row)),
    )


def weekday_pivot(
    df: DataFrame,
    value_col: str,
    index: Sequence[str] = ("team_abbrev", "week"),
    day_col: str = "day_of_week",
    agg=F.min,
) -> DataFrame:
    """(index) x weekday -> value, always 7 columns named Monday..Sunday.

    The pivot values are given, so Spark plans one aggregation and runs no
    extra job to discover them.  ``agg`` decides what a cell with several values
    shows (see :func:`duplicate_cells`).
    """
    pivoted = df.groupBy(*index).pivot(day_col, WEEKDAYS).agg(agg(value_col))
    return pivoted.withColumnsRenamed({str(d): WEEKDAY_NAMES[d] for d in WEEKDAYS})


def listed(column: str) -> Column:
    """Distinct values of a cell, sorted and joined by commas; empty if there is none."""
    return F.array_join(F.sort_array(F.collect_set(column)), ",")


def duplicate_cells(df: DataFrame, index: Sequence[str] = ("team_abbrev", "week"),
                    day_col: str = "day_of_week") -> DataFrame:
    """Cells of a weekday pivot that would receive more than one value (N11 check)."""
    return df.groupBy(*index, day_col).count().where(F.col("count") > 1)


def games_played(df: DataFrame, day_cols: Iterable[str] = WEEKDAY_NAMES, out: str = "Games") -> DataFrame:
    """Row-wise count of non-NULL weekday cells."""
    total: Column = F.lit(0)
    for c in day_cols:
        total = total + F.col(c).isNotNull().cast("int")
    return df.withColumn(out, total.cast("int"))


def lower_case_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name; columns missing in a frame become NULL."""
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to union")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
