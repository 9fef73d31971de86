"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from slate.plans.catalog import QUERIES
from conftest import SF01
from slate.plans.compare import compare, duck_connection


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF01)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = queries()[key](spark, SF01)
    o = compare(key, df, oracle_sql()[key], con)
    assert o.ok, o.detail
    assert o.rows_spark > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() == 2
    assert df.columns[:3] == ["name", "sum_fantasy_points", "games"]


TZ_SENSITIVE = ["eastern_as_of", "date_parse_coerce", "clock_24h", "free_agent_report", "upsert_latest",
                "existing_keys", "union_pages", "player_table", "schedule_etl", "player_etl", "roster_etl"]


@pytest.mark.parametrize("key", TZ_SENSITIVE)
def test_results_do_not_depend_on_session_time_zone(spark, con, key):
    """A driver session may not be set to UTC; literals and conversions must not care."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        o = compare(key, queries()[key](spark, SF01), oracle_sql()[key], con)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert o.ok, o.detail
