"""Ingest jobs (R10-R14): raw inputs -> clean tables.

* R10/R11 schedule: HTML pages -> table rows -> parsed, looked-up, unpivoted.
* R12 players: nested feed -> scored rows -> insert-or-ignore on the 7-column key.
* R13 rosters: roster feed + the fixed free-agent row -> upsert on ``id``.
* R14 dimensions: the four seeded enum tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.constants import DEFAULT_STATS_YEAR, FREE_AGENT, FREE_AGENT_ROSTER_ID, PLAYER_UNIQUE_KEY
from slate.functions import calendar as cal
from slate.functions.scoring import blended_score, empty_to_null, free_agent_flag, stat_lookup
from slate.operators.dedup import insert_or_ignore, upsert
from slate.operators.joins import lookup_passthrough
from slate.operators.reshape import unpivot_games
from slate.operators.schema import PLAYER, SCHEDULE, enforce_schema, seed_dimensions, team_table
from slate.sources.feeds import explode_feed
from slate.sources.html_tables import html_table_rows
from slate.sources.sinks import with_audit_columns

SCHEDULE_COLS = ["date", "week", "day_of_week", "day_of_year", "time", "opponent_abbrev", "team_abbrev",
                 "matchup", "is_visitor"]


def team_dictionary(spark: SparkSession) -> DataFrame:
    """Full team name -> abbreviation (the seeded ``team`` dimension)."""
    return team_table(spark).select("name", "abbrev")


def schedule_rows_from_cells(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """R11 (unprojected) from table rows ``(page_id, row_index, cells map<header, text>)``.

    P2 lower-cases the headers; F1 converts the clock; F2 parses the date (junk
    and repeated header rows become NULL); F4 builds the start timestamp;
    F5-F7 add calendar columns; J3 maps full team names to abbreviations
    (unknown names pass through); F12 + U2 produce the two team rows.
    """
    cells = F.transform_keys("cells", lambda k, v: F.lower(k))
    parsed = rows.select(
        "page_id", "row_index",
        cells.getItem("date").alias("date_text"),
        cells.getItem("start (et)").alias("start_text"),
        cells.getItem("visitor/neutral").alias("visitor_name"),
        cells.getItem("home/neutral").alias("home_name"),
    )
    parsed = (
        parsed.withColumn("time", cal.clock_to_24h("start_text"))
        .withColumn("date", cal.parse_page_date("date_text"))
        .withColumn("datetime", cal.combine_date_time("date", "time"))
        .withColumns(cal.calendar_columns("date"))
    )
    parsed = lookup_passthrough(parsed, "visitor_name", teams, "name", "abbrev", out_col="visitor")
    parsed = lookup_passthrough(parsed, "home_name", teams, "name", "abbrev", out_col="home")
    keep = ["page_id", "row_index", "date_text", "start_text", "datetime", "time", "week", "day_of_year",
            "day_of_week", "visitor_name", "home_name"]
    return unpivot_games(parsed, date_col="date", keep=keep)


def schedule_from_cells(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """R10 from table rows: the ``schedule`` table (projected, NOT NULL enforced:
    rows with an unparseable date, such as repeated header rows, are dropped
    instead of failing the whole load)."""
    return enforce_schema(schedule_rows_from_cells(rows, teams).select(*SCHEDULE_COLS), SCHEDULE)


def schedule_rows_from_pages(pages: DataFrame, teams: DataFrame) -> DataFrame:
    """R11 (unprojected) from raw HTML pages: S4 table rows, then the cleaning chain."""
    return schedule_rows_from_cells(html_table_rows(pages), teams)


def schedule_from_pages(pages: DataFrame, teams: DataFrame) -> DataFrame:
    """R10 from raw HTML pages (S4 + :func:`schedule_from_cells`)."""
    return schedule_from_cells(html_table_rows(pages), teams)


def player_rows_from_feed(feed: DataFrame, year: int = DEFAULT_STATS_YEAR) -> DataFrame:
    """R12 before the keyed load: scored player rows with their arrival order."""
    x = explode_feed(feed)
    return with_audit_columns(x.select(
        "feed_seq", "player_pos",
        F.col("playerId").alias("player_id"),
        "name",
        F.col("proTeam").alias("team_abbrev"),
        F.col("roster_name").alias("fantasy_roster_name"),
        free_agent_flag("roster_name").alias("is_free_agent"),
        "position",
        empty_to_null("injuryStatus").alias("injury_status"),
        F.col("injured").cast("int").alias("injured"),
        F.col("lineupSlot").alias("lineup_slot"),
        "total_points",
        "avg_points",
        stat_lookup("stats", year, "_last_7").alias("avg_last_7"),
        stat_lookup("stats", year, "_last_15").alias("avg_last_15"),
        stat_lookup("stats", year, "_last_30").alias("avg_last_30"),
        "projected_total_points",
        "projected_avg_points",
    ).withColumn("fantasy_points", blended_score()))


def players_from_feed(feed: DataFrame, target: DataFrame | None = None,
                      year: int = DEFAULT_STATS_YEAR) -> DataFrame:
    """The ``player`` table after loading ``feed`` with insert-or-ignore.

    Arrival order is (feed_seq, position in the roster list); the free-agent
    pool is expected first, as the original loaded it first.
    """
    rows = player_rows_from_feed(feed, year)
    required = ["player_id", "name", "is_free_agent"]
    batch = rows.select(*[f.name for f in PLAYER.fields], "feed_seq", "player_pos")
    tgt = None
    if target is not None:
        tgt = enforce_schema(target, PLAYER).withColumn("feed_seq", F.lit(None).cast("long")) \
            .withColumn("player_pos", F.lit(None).cast("int"))
    loaded = insert_or_ignore(tgt, batch, PLAYER_UNIQUE_KEY, ["feed_seq", "player_pos"], required)
    return loaded.drop("feed_seq", "player_pos")


def rosters_from_feed(roster_feed: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """``fantasy_roster`` after upserting the fixed free-agent row and the feed."""
    spark = roster_feed.sparkSession
    fa = spark.createDataFrame(
        [(FREE_AGENT_ROSTER_ID, FREE_AGENT, -1)], "id int, name string, feed_seq int")
    feed = roster_feed.select(
        F.col("team_id").alias("id"), F.col("team_abbrev").alias("abbrev"), F.col("team_name").alias("name"),
        "division_id", "division_name", "standing", "final_standing", "feed_seq")
    batch = with_audit_columns(feed.unionByName(fa, allowMissingColumns=True))
    cols = ["id", "abbrev", "name", "division_id", "division_name", "owner", "standing", "final_standing",
            "created_at", "modified_at"]
    batch = batch.withColumn("owner", F.lit(None).cast("string"))
    tgt = target.select(*cols).withColumn("feed_seq", F.lit(None).cast("int")) if target is not None else None
    return upsert(tgt, batch.select(*cols, "feed_seq"), ["id"], ["feed_seq"]).drop("feed_seq")


def dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """The seeded dimension tables."""
    return seed_dimensions(spark)
