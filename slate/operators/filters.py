"""Predicates and optional filter bundles."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from slate.constants import DEFAULT_DAY_OFFSET, FREE_AGENT
from slate.functions import calendar as cal


@dataclass(frozen=True)
class ReportParams:
    """Parameters of the player reports (the sidebar of the original app).

    ``as_of`` is the report's "today"; ``None`` means the current day in
    US/Eastern.  Every list filter is skipped when ``None`` or empty.  ``day_offset`` is an
    inclusive (lo, hi) pair of day offsets from ``as_of``.  ``window_by`` is
    ``"day_of_year"`` (parity: compares day-of-year numbers, ignoring the year)
    or ``"date"`` (compares real dates, correct across a year end).
    ``key`` is the column the per-player aggregate is keyed and joined on.
    """

    as_of: dt.date | None = None
    day_offset: tuple[int, int] = DEFAULT_DAY_OFFSET
    roster_name: str | None = None
    roster_names: tuple[str | None, str | None] = (None, None)
    injury_status: Sequence[str] | None = None
    names: Sequence[str] | None = None
    teams: Sequence[str] | None = None
    positions: Sequence[str] | None = None
    window_by: str = "day_of_year"
    key: str = "name"


def conjunction(predicates: Sequence[Column | None]) -> Column:
    """AND of the present predicates; TRUE when there are none."""
    present = [p for p in predicates if p is not None]
    out: Column = F.lit(True)
    for p in present:
        out = out & p
    return out


def equals(column: str, value) -> Column | None:
    """``column = value``; skipped (None) when the value is None/empty."""
    if value is None or value == "":
        return None
    return F.col(column) == F.lit(value)


def member_of(column: str, values: Sequence | None) -> Column | None:
    """``column IN (values)``; skipped when the list is None or empty."""
    if not values:
        return None
    return F.col(column).isin(list(values))


def not_equal(column: str, value) -> Column:
    """``column <> value`` (NULL rows drop out, as in SQL)."""
    return F.col(column) != F.lit(value)


def free_agent_filters(params: ReportParams) -> Column:
    """Unowned players, plus optional team / position / name / injury lists."""
    return conjunction([
        F.col("is_free_agent") == F.lit(1),
        member_of("team_abbrev", params.teams),
        member_of("position", params.positions),
        member_of("name", params.names),
        member_of("injury_status", params.injury_status),
    ])


def roster_filters(params: ReportParams) -> Column:
    """Owned players, optional roster name and injury list."""
    return conjunction([
        F.col("is_free_agent") == F.lit(0),
        equals("fantasy_roster_name", params.roster_name),
        member_of("injury_status", params.injury_status),
    ])


def side_filters(roster_name: str | None, params: ReportParams) -> Column:
    """P10: one side of a matchup: optional roster name and injury list only."""
    return conjunction([
        equals("fantasy_roster_name", roster_name),
        member_of("injury_status", params.injury_status),
    ])


def date_range(column: str, start: dt.date | Column, days: int) -> Column:
    """Inclusive ``[start, start + days]`` on a DATE column."""
    s = start if isinstance(start, Column) else F.lit(start)
    return F.col(column).between(s, F.date_add(s, int(days)))


def day_window(params: ReportParams) -> Column:
    """The report window ``as_of + lo ... as_of + hi``, both ends inclusive.

    ``window_by="day_of_year"`` compares day-of-year numbers like the original
    (no year, no wrap at year end); ``"date"`` compares real dates.
    """
    lo, hi = params.day_offset
    if params.window_by == "date":
        return date_range("date", F.date_add(cal.as_of_date(params.as_of), int(lo)), int(hi) - int(lo))
    today = cal.day_of_year(cal.as_of_date(params.as_of))
    return F.col("day_of_year").between(today + F.lit(int(lo)), today + F.lit(int(hi)))


def not_null(column: str) -> Column:
    """P13."""
    return F.col(column).isNotNull()


__all__ = [
    "FREE_AGENT",
    "ReportParams",
    "conjunction",
    "date_range",
    "day_window",
    "equals",
    "free_agent_filters",
    "member_of",
    "not_equal",
    "not_null",
    "roster_filters",
    "side_filters",
]
