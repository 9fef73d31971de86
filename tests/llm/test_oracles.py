"""Corpus queries against their DuckDB statements, on the smallest tables."""

import pytest

from slate.llm.queries import ORACLE_SQL, QUERIES
from slate.plans.compare import compare, duck_connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, key):
    o = compare(key, QUERIES[key](spark, SF), ORACLE_SQL[key], duck_connection(SF))
    assert o.ok and (o.rows_spark == 200 or key == "op13_hard_negatives"), o.detail


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
