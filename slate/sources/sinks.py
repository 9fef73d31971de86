"""Writes (S7-S12, S16).

Outputs are parquet (or CSV) directories.  A keyed load never overwrites the
path it reads from: it writes a new version next to it and returns that path
(the caller swaps a pointer / table location), so a failed job leaves the old
version intact and a lost executor only re-runs its tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slate.constants import BROADCAST_MAX_BYTES
from slate.operators.dedup import replace_keys, rows_to_insert, upsert
from slate.session import planned_bytes, remove_stored, store
from slate.sources.fan_out import fan_out, write_fan_out

#: Columns cast to timestamps on write when present.
DATE_LIKE = ("date", "start_date", "end_date")


def cast_dates_for_write(df: DataFrame, columns: Sequence[str] = DATE_LIKE) -> DataFrame:
    """Cast ``date``/``start_date``/``end_date`` to TIMESTAMP_NTZ if present."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in present}) if present else df


def partitioned_writer(df: DataFrame, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), rebalance: bool = True):
    """A writer for ``df``, laid out by ``partition_by`` directories if given.

    With ``sort_by`` each file is in that order, so the least and greatest values
    that parquet keeps of row groups and pages let a range scan skip most of a file.

    A partitioned write is preceded by a ``rebalance`` on the directory
    columns: without it every write task opens one file per directory value it
    holds (tasks x values small files).  The rebalance shuffles rows of one
    value together, and AQE then splits a value that is too large over several
    tasks (so a hot value does not land in one task) and coalesces small ones,
    giving files of a reasonable size.  Without ``rebalance`` the rows stay in
    the tasks they are in: for a frame whose tasks hold one value each.  The sort
    is left out of the plan if the rows are known to be in that order.
    """
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        # the directory columns lead, as the partitioned write needs rows of one directory side by side
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    return df.write.partitionBy(*partition_by) if partition_by else df.write


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (),
                cast_dates: bool = False, sort_by: Sequence[str] = (), options: Mapping[str, str] | None = None,
                rebalance: bool = True) -> str:
    """Write (replace or append) a table as parquet; returns the path.

    ``options`` go to the parquet writer (for example ``parquet.block.size``).

    A frame that carries the sides of its join and is stored as they are laid out is made and
    written from them (:mod:`slate.sources.fan_out`), with the same rows."""
    if mode not in ("overwrite", "append", "error", "ignore"):
        raise ValueError(f"bad mode {mode!r}")
    plain = mode == "error" and not (rebalance or cast_dates or options)
    if plain and (fan := fan_out(df, path, partition_by, sort_by)):
        write_fan_out(fan, path)
        if fan.rest is not None:
            partitioned_writer(fan.rest, partition_by, sort_by).mode("append").parquet(path)
        return path
    out = cast_dates_for_write(df) if cast_dates else df
    partitioned_writer(out, partition_by, sort_by, rebalance).options(**(options or {})).mode(mode).parquet(path)
    return path


def read_written(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header row."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a header CSV with a declared schema (no inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def with_audit_columns(df: DataFrame) -> DataFrame:
    """``created_at`` / ``modified_at`` set to the load time."""
    now = F.current_timestamp()
    return df.withColumns({"created_at": now, "modified_at": now})


def load_upsert(spark: SparkSession, target_path: str | None, batch: DataFrame, new_path: str,
                key_cols: Sequence[str], order_cols: Sequence[str]) -> str:
    """S11 as a write: new version of the target at ``new_path``.

    The batch's latest rows are stored first; if their keys are within
    ``BROADCAST_MAX_BYTES`` the target is read once and written, without a
    shuffle of its rows.
    """
    if target_path is None:
        upsert(None, batch, key_cols, order_cols).write.mode("error").parquet(new_path)
        return new_path
    latest = store(upsert(None, batch, key_cols, order_cols), "upsert-batch")
    keys = latest.select(*key_cols)
    if planned_bytes(keys) <= BROADCAST_MAX_BYTES:
        keys = F.broadcast(keys)
    replace_keys(spark.read.parquet(target_path), latest, keys, key_cols).write.mode("error").parquet(new_path)
    remove_stored(latest)
    return new_path


# --- versioned tables ----------------------------------------------------------------
#
# A table directory holds ``version=<n>`` sub-directories; readers take the
# newest one the output committer marked complete.  A load that reads the
# current version writes ``n + 1`` next to it, so a failure mid-write leaves the
# previous version readable and a retry simply rewrites ``n + 1``.

VERSION_PREFIX = "version="


def table_versions(spark: SparkSession, table_dir: str, prefix: str = VERSION_PREFIX) -> list[int]:
    """Complete versions of a versioned table, oldest first.

    A version is a ``<prefix><n>`` sub-directory carrying the output
    committer's ``_SUCCESS`` marker.  The listing goes through the Hadoop
    FileSystem of the path (local, HDFS or an object store alike) and reads
    only directory metadata, never the table's data.
    """
    jvm = spark.sparkContext._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    root = Path(table_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if not (status.isDirectory() and name.startswith(prefix)):
            continue
        suffix = name[len(prefix):]
        if suffix.isdigit() and fs.exists(Path(status.getPath(), "_SUCCESS")):
            found.append(int(suffix))
    return sorted(found)


def read_latest(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """The newest complete version of a versioned table (None if there is none)."""
    versions = table_versions(spark, table_dir)
    if not versions:
        return None
    return spark.read.parquet(f"{table_dir.rstrip('/')}/{VERSION_PREFIX}{versions[-1]}")


def write_new_version(df: DataFrame, table_dir: str, partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` as the next version of a versioned table; returns its path."""
    versions = table_versions(df.sparkSession, table_dir)
    path = f"{table_dir.rstrip('/')}/{VERSION_PREFIX}{(versions[-1] + 1) if versions else 1}"
    partitioned_writer(df, partition_by).mode("overwrite").parquet(path)
    return path


# --- append-only keyed loads -----------------------------------------------------------
#
# Insert-or-ignore only ever adds rows, so a load need not rewrite the table:
# load ``k`` writes the rows it adds to ``<table>/load=k`` and finds conflicts
# by reading the key columns of the complete earlier loads.  Re-running a load
# overwrites only its own directory (idempotent), and a failed load leaves the
# earlier ones untouched.  The streaming mode uses the same layout with
# ``batch_id`` as the load column.

LOAD_COL = "load"


def read_loads(spark: SparkSession, table_dir: str, before: int | None = None,
               load_col: str = LOAD_COL) -> DataFrame | None:
    """The union of the complete loads of an append-only table (only loads < ``before`` if given)."""
    loads = [v for v in table_versions(spark, table_dir, prefix=f"{load_col}=") if before is None or v < before]
    if not loads:
        return None
    base = table_dir.rstrip("/")
    return (spark.read.option("basePath", base).parquet(*[f"{base}/{load_col}={v}" for v in loads])
            .drop(load_col))


def append_insert_or_ignore(spark: SparkSession, table_dir: str, batch: DataFrame, load_id: int,
                            key_cols: Sequence[str], order_cols: Sequence[str],
                            required_cols: Sequence[str] = (), load_col: str = LOAD_COL) -> str:
    """S10 as an append-only load: write the rows of ``batch`` that an
    ``INSERT OR IGNORE`` adds to the stored earlier loads; returns the load's path."""
    existing = read_loads(spark, table_dir, before=load_id, load_col=load_col)
    new = rows_to_insert(existing, batch, key_cols, order_cols, required_cols)
    path = f"{table_dir.rstrip('/')}/{load_col}={load_id}"
    new.write.mode("overwrite").parquet(path)
    return path
