"""Table scans.

``read_table`` is a plain parquet scan: Catalyst prunes columns and pushes
filters into it.  ``run_sql`` binds parameters instead of formatting them into
the text, and raises on error (the original returned None).
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.session import remove_stored, scratch_path, store
from slate.sources.sinks import write_table

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


_HANDLES: dict[tuple, DataFrame] = {}


def _stamp(path: str) -> tuple | None:
    """Modification stamp of a local path (None for remote stores: no caching)."""
    try:
        st = os.stat(path)
    except OSError:
        return None
    return (st.st_mtime_ns, st.st_size)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one stored table (parquet).

    The scan handle (a logical plan: file listing and footer schema, no data)
    is reused within a session while the file is unchanged, so composing many
    queries over the same tables does not re-read footers each time.
    """
    path = table_path(sf_dir, name)
    stamp = _stamp(path)
    if stamp is None:
        return spark.read.parquet(path)
    key = (id(spark), path, stamp)
    df = _HANDLES.get(key)
    if df is None:
        df = spark.read.parquet(path)
        _HANDLES[key] = df
    return df


def run_sql(spark: SparkSession, query: str, args: Mapping[str, object] | None = None,
            **frames: DataFrame) -> DataFrame:
    """S1 + S2: run SQL with named, bound parameters (``:name`` markers).

    DataFrames passed as keywords are referenced as ``{name}`` in the text
    (no global temp view is registered).
    """
    return spark.sql(query, args=dict(args) if args else None, **frames)


def date_range_scan(df: DataFrame, start: dt.date, days: int, date_col: str = "date",
                    week_col: str | None = None) -> DataFrame:
    """S3: rows with ``date_col`` in ``[start, start + days]`` (DATE comparison, inclusive).

    The predicate is on the bare column, so it reaches the parquet scan.  For a
    table laid out by ISO week, ``week_col`` adds the weeks of the range, which
    prunes directories.
    """
    inside = F.col(date_col).between(F.lit(start), F.date_add(F.lit(start), int(days)))
    if week_col is not None:
        weeks = {(start + dt.timedelta(days=i)).isocalendar().week for i in range(min(int(days), 371) + 1)}
        inside = F.col(week_col).isin(sorted(weeks)) & inside
    return df.where(inside)


def input_stamp(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> tuple:
    """Paths, lengths and modification times of the files of some tables (metadata only)."""
    path_class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        path = path_class(table_path(sf_dir, name))
        out += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in path.getFileSystem(conf).listStatus(path)]
    return tuple(out)


#: Shared tables that are kept at most; the one used longest ago goes first.
MOST_SHARED = 64
_SHARED: dict[tuple, DataFrame] = {}


def shared_table(spark: SparkSession, sf_dir: str, name: str, inputs: Sequence[str], build: Callable[[], DataFrame],
                 partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), rebalance: bool = True) -> DataFrame:
    """A derived table, stored once per session and version of its inputs, then scanned.

    Several reports of a session read the same stored table.  A changed input
    file gives a new one, and the stored files of the old one are deleted, as are
    those of the table used longest ago once there are more than ``MOST_SHARED``.
    A frame over a deleted table cannot be read any more: ask for it again.
    """
    key = (spark.sparkContext.applicationId, name, sf_dir, input_stamp(spark, sf_dir, inputs))
    if key in _SHARED:
        _SHARED[key] = _SHARED.pop(key)  # used last
        return _SHARED[key]
    df = build()
    if partition_by or sort_by:
        path = write_table(df, scratch_path(spark, name), "error", partition_by, sort_by=sort_by, rebalance=rebalance)
        _SHARED[key] = spark.read.parquet(path)
    else:
        _SHARED[key] = store(df, name)
    superseded = [k for k in _SHARED if k != key and k[:3] == key[:3]]
    own = [k for k in _SHARED if k[0] == key[0]]
    for k in {*superseded, *own[: max(0, len(own) - MOST_SHARED)]}:
        _evict(k)
    return _SHARED[key]


def _evict(key: tuple) -> int:
    return remove_stored(_SHARED.pop(key))


def release_shared(spark: SparkSession, name: str | None = None) -> int:
    """Delete the shared tables of this session (only those of one name, if given); returns how many."""
    app = spark.sparkContext.applicationId
    found = [k for k in _SHARED if k[0] == app and name in (None, k[1])]
    for k in [k for k in _SHARED if k[0] != app]:  # of a session that has ended: its folder is not ours any more
        del _SHARED[k]
    return sum(_evict(k) for k in found)
