"""Declared table schemas (S14), schema enforcement and dimension rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slate.constants import STAT_AGGREGATIONS, STAT_PERIODS, STAT_TYPES, TEAMS

I, L, S, D, TS, DT = (T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType(),
                      T.TimestampType(), T.DateType())


def _f(name: str, dtype: T.DataType, required: bool = False) -> T.StructField:
    return T.StructField(name, dtype, nullable=not required)


AUDIT = [_f("created_at", TS), _f("modified_at", TS)]

SCHEDULE = T.StructType([
    _f("date", DT, True), _f("day_of_year", I, True), _f("week", I, True), _f("day_of_week", I, True),
    _f("time", S, True), _f("opponent_abbrev", S, True), _f("team_abbrev", S, True), _f("matchup", S, True),
    _f("is_visitor", I, True),
])

PLAYER = T.StructType([
    _f("player_id", L, True), _f("name", S, True), _f("team_abbrev", S), _f("fantasy_roster_name", S),
    _f("is_free_agent", I, True), _f("position", S), _f("injury_status", S), _f("injured", I),
    _f("lineup_slot", S), _f("total_points", D), _f("fantasy_points", D), _f("avg_points", D),
    _f("avg_last_7", D), _f("avg_last_15", D), _f("avg_last_30", D), _f("projected_total_points", D),
    _f("projected_avg_points", D), *AUDIT,
])

FANTASY_ROSTER = T.StructType([
    _f("id", I, True), _f("abbrev", S), _f("name", S), _f("division_id", S), _f("division_name", S),
    _f("owner", S), _f("standing", I), _f("final_standing", I), *AUDIT,
])

TEAM = T.StructType([_f("id", I, True), _f("abbrev", S), _f("name", S), *AUDIT])
DIMENSION = T.StructType([_f("id", I, True), _f("name", S, True)])

PLAYER_STATS = T.StructType([
    _f("id", I, True), _f("player_id", I, True), _f("team_id", I), _f("roster_id", I, True),
    _f("stat_period_id", I, True), _f("stat_aggregation_id", I, True), _f("is_free_agent", I),
    _f("applied_value", D), *[_f(name.lower(), D) for name in STAT_TYPES], *AUDIT,
])

LEAGUE = T.StructType([_f("id", I, True), _f("league_id", I, True), _f("year", I, True), *AUDIT])

CATALOG: dict[str, T.StructType] = {
    "schedule": SCHEDULE,
    "player": PLAYER,
    "fantasy_roster": FANTASY_ROSTER,
    "team": TEAM,
    "stat_period": DIMENSION,
    "stat_type": DIMENSION,
    "stat_aggregation": DIMENSION,
    "player_stats": PLAYER_STATS,
    "league": LEAGUE,
}


def required_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not f.nullable]


def enforce_schema(df: DataFrame, schema: T.StructType, on_null: str = "drop", counts: Observation | None = None) -> DataFrame:
    """Project to the declared columns, cast to the declared types, check NOT NULL.

    Missing nullable columns are added as NULL; a missing required column is an
    error.  Rows with NULL in a required column are dropped (``on_null="drop"``,
    as an ignoring insert does) or make the job fail (``"raise"``).

    With ``counts`` the pass that reads the result also counts ``rows`` (all),
    ``rejected`` (rows with any NULL) and per required column the rows in which it is
    NULL (``null_<column>``); ``counts.get`` has them once an action has run.
    """
    present = set(df.columns)
    cols: list[Column] = []
    for f in schema.fields:
        if f.name in present:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.nullable:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"required column {f.name!r} is missing")
    out = df.select(*cols)
    req = required_columns(schema)
    ok: Column = F.lit(True)
    for c in req:
        ok = ok & F.col(c).isNotNull()
    if counts is not None:
        out = out.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(~ok).alias("rejected"),
                          *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in req))
    if not req:
        return out
    if on_null == "drop":
        return out.where(ok)
    if on_null == "raise":
        return out.withColumn("__ok", F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.lit("NULL in a required column")))).where(F.col("__ok")).drop("__ok")
    raise ValueError("on_null must be 'drop' or 'raise'")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """An empty frame with the declared schema (``create_all``)."""
    return spark.createDataFrame([], CATALOG[name])


def dimension_rows() -> dict[str, list[tuple]]:
    """Seed rows of the four dimensions (ids assigned 1..n in declaration order).

    ``stat_type``/``stat_period``/``stat_aggregation`` store the enum *name*;
    ``team`` stores the abbreviation and the full name.
    """
    return {
        "stat_type": [(i + 1, name) for i, name in enumerate(STAT_TYPES)],
        "stat_period": [(i + 1, name) for i, name in enumerate(STAT_PERIODS)],
        "stat_aggregation": [(i + 1, name) for i, name in enumerate(STAT_AGGREGATIONS)],
        "team": [(i + 1, abbrev, name) for i, (abbrev, name) in enumerate(TEAMS)],
    }


def team_table(spark: SparkSession) -> DataFrame:
    """The seeded ``team`` dimension (id, abbrev, name)."""
    team = T.StructType([_f("id", I, True), _f("abbrev", S), _f("name", S)])
    return spark.createDataFrame(dimension_rows()["team"], team)


def seed_dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """The seeded dimension tables as DataFrames (fixed, tiny)."""
    rows = dimension_rows()
    dim = T.StructType([_f("id", I, True), _f("name", S, True)])
    return {
        "stat_type": spark.createDataFrame(rows["stat_type"], dim),
        "stat_period": spark.createDataFrame(rows["stat_period"], dim),
        "stat_aggregation": spark.createDataFrame(rows["stat_aggregation"], dim),
        "team": team_table(spark),
    }
