"""Keyed loads: insert-or-ignore (S10) and insert-or-replace / upsert.

Spark tables have no unique constraints, so both are expressed as set
operations against the target: pick one row per key from the batch, then
anti-join the keys already present (S10) or replace them (S11).

"One row per key" uses ``min_by`` / ``max_by`` over a struct of the arrival
order.  These plan as sort aggregates (the row is a struct), but unlike a
``row_number`` window they combine map-side first, so a key holding a third of
the batch does not end up as one huge sort in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all_not_null(cols: Sequence[str]) -> Column:
    out: Column = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def _pick(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str], latest: bool) -> DataFrame:
    others = [c for c in df.columns if c not in key_cols]
    if not others:
        return df.select(*key_cols).distinct()
    picker = F.max_by if latest else F.min_by
    row = F.struct(*[F.col(c) for c in others])
    order = F.struct(*[F.col(c) for c in order_cols])
    return (
        df.groupBy(*key_cols).agg(picker(row, order).alias("__row"))
        .select(*key_cols, *[F.col(f"__row.{c}").alias(c) for c in others])
        .select(*df.columns)
    )


def first_per_key(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """The earliest row (by ``order_cols``) of each key."""
    return _pick(df, key_cols, order_cols, latest=False)


def latest_per_key(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """The latest row (by ``order_cols``) of each key."""
    return _pick(df, key_cols, order_cols, latest=True)


def rows_to_insert(
    target: DataFrame | None,
    batch: DataFrame,
    key_cols: Sequence[str],
    order_cols: Sequence[str],
    required_cols: Sequence[str] = (),
) -> DataFrame:
    """The rows of ``batch`` that an ``INSERT OR IGNORE`` would add to ``target``.

    * rows with NULL in a required (NOT NULL) column are skipped;
    * a row whose key columns are all non-NULL is inserted only if no target row
      and no earlier batch row (by ``order_cols``) has the same key;
    * a row with a NULL in any key column never conflicts and is always inserted.

    ``order_cols`` is the arrival order (e.g. an ingest sequence); it is kept
    as data, so the result is independent of partitioning.

    ``batch`` is read twice (rows with a full key are de-duplicated, the others
    pass through without a shuffle); pass a stored or checkpointed batch when
    its lineage is expensive.
    """
    b = batch.where(_all_not_null(required_cols)) if required_cols else batch
    full_key = _all_not_null(key_cols)
    keyed = first_per_key(b.where(full_key), key_cols, order_cols)
    loose = b.where(~full_key)
    if target is not None:
        present = target.where(full_key).select(*key_cols)
        # a USING anti join puts the key columns first: restore the batch's order
        keyed = keyed.join(present, list(key_cols), "left_anti").select(*b.columns)
    return keyed.unionByName(loose)


def insert_or_ignore(
    target: DataFrame | None,
    batch: DataFrame,
    key_cols: Sequence[str],
    order_cols: Sequence[str],
    required_cols: Sequence[str] = (),
) -> DataFrame:
    """The target after inserting ``batch`` with ``INSERT OR IGNORE`` semantics
    (see :func:`rows_to_insert`)."""
    new = rows_to_insert(target, batch, key_cols, order_cols, required_cols)
    return new if target is None else target.unionByName(new)


def upsert(
    target: DataFrame | None,
    batch: DataFrame,
    key_cols: Sequence[str],
    order_cols: Sequence[str],
) -> DataFrame:
    """The target after ``INSERT OR REPLACE`` of ``batch`` on ``key_cols`` (last wins).

    Rows of ``batch`` with a NULL key are rejected (a primary key is NOT NULL).
    The batch is reduced to its latest row per key (map-side first), and
    replaces the target's rows of these keys (:func:`replace_keys`).
    """
    latest = latest_per_key(batch.where(_all_not_null(key_cols)), key_cols, order_cols)
    return latest if target is None else replace_keys(target, latest, latest.select(*key_cols), key_cols)


def replace_keys(target: DataFrame, rows: DataFrame, keys: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """``target`` without the rows of ``keys`` (the keys of ``rows``), plus ``rows``.

    The target is neither sorted nor aggregated: one anti join drops the
    replaced rows.  With broadcast ``keys`` it is not shuffled either.  Target
    rows with a NULL key match nothing and stay.
    """
    return target.join(keys, list(key_cols), "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))
