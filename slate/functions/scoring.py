"""Player scoring expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from slate.constants import BLEND_WEIGHTS, FREE_AGENT, RISING_MIN_RECENT, RISING_RATIO


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blended_score(weights: Mapping[str, float] = BLEND_WEIGHTS) -> Column:
    """weighted sum of the season and trailing averages.

    A NULL average contributes nothing (the original intent); the terms are
    added left to right starting from 0.0.
    """
    total: Column = F.lit(0.0)
    for column, weight in weights.items():
        total = total + F.coalesce(F.col(column) * F.lit(float(weight)), F.lit(0.0))
    return total


def flag(condition: Column) -> Column:
    """boolean -> 0/1 integer (NULL -> NULL)."""
    return condition.cast("int")


def free_agent_flag(roster_name: str | Column) -> Column:
    """1 when the roster is the free-agent pool, else 0."""
    return flag(_col(roster_name) == F.lit(FREE_AGENT))


def empty_to_null(value: str | Column) -> Column:
    """a feed value that is an empty list (or empty text) becomes NULL.

    For string columns: a JSON reader with a declared string type keeps a
    non-string token as its text, so ``[]`` arrives as ``'[]'``.
    """
    v = _col(value)
    return F.when(F.trim(v).isin("", "[]"), F.lit(None).cast("string")).otherwise(v)


def empty_array_to_null(value: str | Column) -> Column:
    """F15 for array-typed feed fields: ``[]`` -> NULL, else the first element."""
    v = _col(value)
    return F.when(F.size(v) > 0, F.element_at(v, 1))


def stat_lookup(stats: str | Column, year: int | str | Column, period_suffix: str) -> Column:
    """F16: ``stats["{year}{suffix}"].applied_avg``; a missing key yields NULL."""
    y = year if isinstance(year, Column) else F.lit(str(year))
    key = F.concat(y.cast("string"), F.lit(period_suffix))
    return F.try_element_at(_col(stats), key).getField("applied_avg")


def product(a: str | Column, b: str | Column) -> Column:
    """NULL-propagating product, e.g. ``fantasy_points * games``."""
    return _col(a) * _col(b)


def truncate_to_long(value: str | Column) -> Column:
    """truncate toward zero to a 64-bit integer."""
    return _col(value).cast("long")


def rising_predicate(
    min_recent: float = RISING_MIN_RECENT,
    ratio: float = RISING_RATIO,
    recent: str = "avg_last_7",
    baseline: str = "avg_last_30",
) -> Column:
    """Recent average strictly above ``min_recent`` and above ``ratio`` x baseline."""
    r = F.col(recent)
    return (r > F.lit(min_recent)) & (r > F.col(baseline) * F.lit(ratio))
