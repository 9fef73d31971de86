"""Incremental keyed loads with Structured Streaming.

The original re-ran its loaders as whole batch jobs.  The same two keyed
loads (insert-or-ignore S10, insert-or-replace S11) can run incrementally over
a stream of arriving files; each micro-batch goes through the batch operator
of :mod:`slate.operators.dedup` inside ``foreachBatch``.

Exactly-once and executor loss
------------------------------
* The target lives on shared storage next to the query's checkpoint.
* Every micro-batch writes only to a path named after its ``batch_id`` with
  ``overwrite``: if the driver restarts and replays an uncommitted batch, the
  replay replaces its own earlier partial output instead of duplicating it.
  Lost executors only re-run tasks; Spark's retries cover them.
* insert-or-ignore appends: batch ``b`` writes the rows it adds to
  ``target/batch_id=b``; rows of earlier batches are read back to find
  conflicting keys.
* insert-or-replace keeps copy-on-write snapshots: batch ``b`` writes the
  whole new table to ``target/version=b``; readers take the newest complete
  snapshot.  Suited to the small dimension tables this load is used for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from slate.operators.dedup import upsert
from slate.sources import keyed_loads
from slate.sources.sinks import append_insert_or_ignore, read_loads, table_versions

BATCH_COL = "batch_id"
VERSION_COL = "version"


def read_appended(spark: SparkSession, target: str, exclude_batch: int | None = None) -> DataFrame | None:
    """The insert-or-ignore target: every committed batch directory (before ``exclude_batch``)."""
    return read_loads(spark, target, before=exclude_batch, load_col=BATCH_COL)


def _join(base: str, name: str) -> str:
    return base.rstrip("/") + "/" + name


def _versions(spark: SparkSession, target: str) -> list[int]:
    """Committed snapshot versions (see :func:`slate.sources.sinks.table_versions`)."""
    return table_versions(spark, target, prefix=f"{VERSION_COL}=")


def read_snapshot(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The insert-or-replace target: the newest complete snapshot (older than ``before``)."""
    versions = [v for v in _versions(spark, target) if before is None or v < before]
    if not versions:
        return None
    return spark.read.parquet(_join(target, f"{VERSION_COL}={versions[-1]}"))


def insert_or_ignore_stream(
    source: DataFrame,
    target: str,
    checkpoint: str,
    key_cols: Sequence[str],
    order_cols: Sequence[str],
    required_cols: Sequence[str] = (),
    available_now: bool = True,
) -> StreamingQuery:
    """Run S10 continuously: each micro-batch inserts its non-conflicting rows."""
    spark = source.sparkSession

    def load(batch: DataFrame, batch_id: int) -> None:
        # the keyed load reads its batch twice (full keys, NULL keys): keep the
        # micro-batch for the two reads; lost blocks recompute from the same files
        batch.persist()
        try:
            append_insert_or_ignore(spark, target, batch, batch_id, key_cols, order_cols, required_cols,
                                    load_col=BATCH_COL)
        finally:
            batch.unpersist()

    writer = source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def upsert_stream(
    source: DataFrame,
    target: str,
    checkpoint: str,
    key_cols: Sequence[str],
    order_cols: Sequence[str],
    available_now: bool = True,
) -> StreamingQuery:
    """Run S11 continuously: each micro-batch writes the next snapshot."""
    spark = source.sparkSession

    def load(batch: DataFrame, batch_id: int) -> None:
        previous = read_snapshot(spark, target, before=batch_id)
        merged = upsert(previous, batch, key_cols, order_cols)
        merged.write.mode("overwrite").parquet(_join(target, f"{VERSION_COL}={batch_id}"))

    writer = source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def upsert_delta_stream(
    source: DataFrame,
    target: str,
    checkpoint: str,
    key_cols: Sequence[str],
    order_cols: Sequence[str],
    compact_every: int = 16,
    available_now: bool = True,
) -> StreamingQuery:
    """Run S11 continuously, merged on read: each micro-batch writes only its own keys' latest rows
    (:func:`slate.sources.keyed_loads.upsert_load`), and every ``compact_every`` batches they are
    folded into a version.  Read the table with ``keyed_loads.read_upserted(spark, target, key_cols, BATCH_COL)``."""
    spark = source.sparkSession

    def load(batch: DataFrame, batch_id: int) -> None:
        keyed_loads.upsert_load(spark, target, batch, batch_id, key_cols, order_cols, BATCH_COL)
        if (batch_id + 1) % compact_every == 0:
            keyed_loads.compact(spark, target, key_cols, BATCH_COL)

    writer = source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
