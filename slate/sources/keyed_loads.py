"""Keyed loads whose cost follows the load, not the table.

*Insert or ignore* has to know which keys are stored.  Every load of an
append-only table leaves a Bloom filter of its keys beside it; a later load of
few keys probes the filters and opens only the earlier loads that may hold one of
them.  A filter never says no to a key that is there, so results do not depend on
it; loads without a complete filter are always opened.

*Upsert* is merged when it is read: a load writes the latest row of each of its
keys and nothing else.  Readers take the newest compacted version, drop the keys
that later loads replaced and add their newest rows.  :func:`compact` folds the
loads into the next version from time to time.

Layout of a table: ``load=<n>`` directories in the order of arrival,
``version=<n>`` (everything up to load n, merged), ``_bloom/load=<n>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.constants import BROADCAST_MAX_BYTES
from slate.operators.dedup import latest_per_key, replace_keys, rows_to_insert, upsert
from slate.session import planned_bytes, store
from slate.sources.sinks import LOAD_COL, VERSION_PREFIX, read_loads, table_versions

#: Bits set per key, least bits per key (one key in some 150 is then found in a filter by chance), least size.
PROBES, BITS_PER_KEY, LEAST_BITS = 4, 12, 1024
#: A load of more keys than this opens all earlier loads: some of its keys are in each of them anyway.
MOST_PROBED_KEYS = 20_000
BLOOM_DIR = "_bloom"


def _path(table_dir: str, *parts: str) -> str:
    return "/".join([table_dir.rstrip("/"), *parts])


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _full(key_cols: Sequence[str]) -> Column:
    out: Column = F.lit(True)
    for c in key_cols:
        out = out & F.col(c).isNotNull()
    return out


def _probes(key_cols: Sequence[str]) -> Column:
    return F.array(*(F.xxhash64(F.lit(i), *(F.col(c) for c in key_cols)) for i in range(PROBES)))


def _word_and_mask(df: DataFrame) -> DataFrame:
    """``word`` and ``mask`` of the bit that the number ``probe`` stands for in a filter of ``bits`` bits."""
    at = F.pmod(F.col("probe"), F.col("bits"))
    return df.withColumns({"word": F.shiftright(at, 6), "bit": (at % 64).cast("int")}).withColumn("mask", F.expr("shiftleft(1L, bit)")).drop("bit")


def write_bloom(spark: SparkSession, table_dir: str, load_id: int, key_cols: Sequence[str], load_col: str = LOAD_COL) -> str:
    """The Bloom filter of a stored load's full keys: rows (bits, word, mask), built by map-side OR."""
    keys = spark.read.parquet(_path(table_dir, f"{load_col}={load_id}")).where(_full(key_cols))
    bits = max(LEAST_BITS, 1 << (BITS_PER_KEY * keys.count() - 1).bit_length())
    set_bits = _word_and_mask(keys.select(F.explode(_probes(key_cols)).alias("probe"), F.lit(bits).alias("bits")))
    path = _path(table_dir, BLOOM_DIR, f"{load_col}={load_id}")
    set_bits.groupBy("bits", "word").agg(F.expr("bit_or(mask)").alias("mask")).write.mode("overwrite").parquet(path)
    return path


def loads_that_may_hold(spark: SparkSession, table_dir: str, batch: DataFrame, key_cols: Sequence[str],
                        before: int | None = None, load_col: str = LOAD_COL) -> list[int]:
    """Complete loads of a table that may hold a key of ``batch`` (all for a batch of many keys)."""
    loads = [n for n in table_versions(spark, table_dir, prefix=f"{load_col}=") if before is None or n < before]
    filtered = [n for n in table_versions(spark, _path(table_dir, BLOOM_DIR), prefix=f"{load_col}=") if n in set(loads)]
    if not filtered:
        return loads
    probed = store(batch.where(_full(key_cols)).select(_probes(key_cols).alias("probes")).distinct(), "probes")
    n_keys = probed.count()
    if n_keys > MOST_PROBED_KEYS:
        return loads
    base = _path(table_dir, BLOOM_DIR)
    blooms = spark.read.option("basePath", base).parquet(*[_path(base, f"{load_col}={n}") for n in filtered])
    sizes = [r.bits for r in blooms.select("bits").distinct().collect()]  # powers of two: at most some thirty
    probes = probed.select(F.xxhash64("probes").alias("key"), F.explode("probes").alias("probe"))
    probes = _word_and_mask(probes.select("key", "probe", F.explode(F.lit(sizes) if sizes else F.array().cast("array<bigint>")).alias("bits")))
    probes = probes.withColumnsRenamed({"mask": "probe_mask"})
    hit = (blooms.join(F.broadcast(probes), ["bits", "word"])  # at most PROBES rows for each of few keys and sizes
           .where(F.col("mask").bitwiseAND(F.col("probe_mask")) != 0)
           .groupBy(load_col, "key").agg(F.count_distinct("probe").alias("n")))
    wanted = probes.groupBy("key").agg(F.count_distinct("probe").alias("wanted"))
    may = {r[0] for r in hit.join(F.broadcast(wanted), "key").where("n = wanted").select(load_col).distinct().collect()}
    return [n for n in loads if n in may or n not in set(filtered)]


def insert_or_ignore_load(spark: SparkSession, table_dir: str, batch: DataFrame, load_id: int, key_cols: Sequence[str],
                          order_cols: Sequence[str], required_cols: Sequence[str] = (), load_col: str = LOAD_COL) -> list[int]:
    """S10 as an append-only load with a Bloom filter; returns the earlier loads that were opened.

    Running a load again replaces its rows.  Its filter goes first and comes back
    last, so a load whose filter may be wrong has none.
    """
    _delete(spark, _path(table_dir, BLOOM_DIR, f"{load_col}={load_id}"))
    opened = loads_that_may_hold(spark, table_dir, batch, key_cols, load_id, load_col)
    existing = read_some_loads(spark, table_dir, opened, load_col)
    rows_to_insert(existing, batch, key_cols, order_cols, required_cols).write.mode("overwrite").parquet(_path(table_dir, f"{load_col}={load_id}"))
    write_bloom(spark, table_dir, load_id, key_cols, load_col)
    return opened


def read_some_loads(spark: SparkSession, table_dir: str, loads: Sequence[int], load_col: str = LOAD_COL) -> DataFrame | None:
    """The union of the given loads (None if there are none)."""
    if not loads:
        return None
    return spark.read.option("basePath", table_dir).parquet(*[_path(table_dir, f"{load_col}={n}") for n in loads]).drop(load_col)


# --- merge on read ----------------------------------------------------------------------


def upsert_load(spark: SparkSession, table_dir: str, batch: DataFrame, load_id: int, key_cols: Sequence[str],
                order_cols: Sequence[str], load_col: str = LOAD_COL) -> str:
    """S11 as a load: only the latest row of each key of ``batch`` is written (rows with a NULL key
    are rejected).  Running a load again replaces its rows."""
    path = _path(table_dir, f"{load_col}={load_id}")
    upsert(None, batch, key_cols, order_cols).write.mode("overwrite").parquet(path)
    return path


def pending_loads(spark: SparkSession, table_dir: str, load_col: str = LOAD_COL) -> tuple[int | None, list[int]]:
    """The newest compacted version (None if there is none) and the loads after it."""
    versions = table_versions(spark, table_dir)
    version = versions[-1] if versions else None
    return version, [n for n in table_versions(spark, table_dir, prefix=f"{load_col}=") if version is None or n > version]


def read_upserted(spark: SparkSession, table_dir: str, key_cols: Sequence[str], load_col: str = LOAD_COL) -> DataFrame | None:
    """The table as of its last complete load; of a key's rows the one of the newest load counts.

    The compacted version is neither sorted nor aggregated: its rows pass an anti
    join with the keys of the loads, broadcast if their files are small.
    """
    version, loads = pending_loads(spark, table_dir, load_col)
    base = None if version is None else spark.read.parquet(_path(table_dir, f"{VERSION_PREFIX}{version}"))
    if not loads:
        return base
    deltas = spark.read.option("basePath", table_dir).parquet(*[_path(table_dir, f"{load_col}={n}") for n in loads])
    newest = latest_per_key(deltas, key_cols, [load_col]).drop(load_col) if len(loads) > 1 else deltas.drop(load_col)
    if base is None:
        return newest
    keys = deltas.select(*key_cols)
    keys = F.broadcast(keys.distinct()) if planned_bytes(keys) <= BROADCAST_MAX_BYTES else keys.distinct()
    return replace_keys(base, newest, keys, key_cols)


def compact(spark: SparkSession, table_dir: str, key_cols: Sequence[str], load_col: str = LOAD_COL) -> str | None:
    """Fold all complete loads into the next version; returns its path (None if there was nothing to do).

    The loads stay until :func:`drop_compacted`, so readers of the older version
    and a failed compaction lose nothing.
    """
    version, loads = pending_loads(spark, table_dir, load_col)
    if not loads:
        return None
    path = _path(table_dir, f"{VERSION_PREFIX}{loads[-1]}")
    read_upserted(spark, table_dir, key_cols, load_col).write.mode("overwrite").parquet(path)
    return path


def drop_compacted(spark: SparkSession, table_dir: str, load_col: str = LOAD_COL) -> int:
    """Delete the loads and versions that the newest version has taken in; returns how many."""
    version, _ = pending_loads(spark, table_dir, load_col)
    if version is None:
        return 0
    old = [f"{load_col}={n}" for n in table_versions(spark, table_dir, prefix=f"{load_col}=") if n <= version]
    old += [f"{VERSION_PREFIX}{n}" for n in table_versions(spark, table_dir) if n < version]
    return sum(_delete(spark, _path(table_dir, name)) for name in old)


__all__ = ["compact", "drop_compacted", "insert_or_ignore_load", "loads_that_may_hold", "pending_loads", "read_loads", "read_some_loads",
           "read_upserted", "upsert_load", "write_bloom"]
