"""Side-by-side check of a Spark query against its DuckDB oracle.

Used by the tests and by ``scripts/check_oracle.py``.  Both results go through
Arrow; columns are compared by sorted name, types by Arrow type family, and
rows as an order-insensitive multiset of normalised values.
"""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa

from slate.sources.tables import DRIVER_TABLES, table_path


@dataclass
class Outcome:
    key: str
    rows_spark: int
    rows_oracle: int
    columns_match: bool
    types_match: bool
    values_match: bool
    detail: str = ""

    @property
    def ok(self) -> bool:
        return self.columns_match and self.types_match and self.values_match and self.rows_spark == self.rows_oracle


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _family(t: pa.DataType) -> str:
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return f"timestamp[{t.tz}]"
    return str(t)


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(table: pa.Table, cols: list[str]) -> Counter:
    data = [table.column(c).to_pylist() for c in cols]
    return Counter(tuple(_norm(col[i]) for col in data) for i in range(table.num_rows))


def compare(key: str, spark_df, sql: str, con) -> Outcome:
    left = spark_df.toArrow()
    right = con.sql(sql).to_arrow_table()
    lc, rc = sorted(left.column_names), sorted(right.column_names)
    columns_match = lc == rc
    detail = ""
    types_match = False
    values_match = False
    if columns_match:
        lt = {f.name: _family(f.type) for f in left.schema}
        rt = {f.name: _family(f.type) for f in right.schema}
        bad = {c: (lt[c], rt[c]) for c in lc if lt[c] != rt[c]}
        types_match = not bad
        if bad:
            detail += f"types differ: {bad}; "
        a, b = _rows(left, lc), _rows(right, lc)
        values_match = a == b
        if not values_match:
            only_l = list((a - b).elements())[:3]
            only_r = list((b - a).elements())[:3]
            detail += f"spark-only {only_l} oracle-only {only_r}"
    else:
        detail = f"columns spark={lc} oracle={rc}"
    return Outcome(key, left.num_rows, right.num_rows, columns_match, types_match, values_match, detail)
