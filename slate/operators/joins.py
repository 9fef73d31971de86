"""Join operators (J1-J5) and the join strategies they share.

* A stored dimension is left to the planner, which knows its size.
* A derived side that is small (totals per team) is finished first: it is
  written to the shared folder, and its size decides.  Up to
  ``BROADCAST_MAX_BYTES`` it is broadcast, and the large side is neither
  shuffled nor made the build side while the small one is still running; beyond
  that the join is salted, so hot keys of the large side spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.constants import BROADCAST_MAX_BYTES
from slate.session import planned_bytes, store


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int = 32,
) -> DataFrame:
    """Equi-join that spreads every key of ``big`` over ``salts`` tasks.

    ``small`` is replicated ``salts`` times (it must be the smaller side);
    ``big`` rows draw a salt from a hash of all their columns, so a key holding
    a third of the rows lands on ``salts`` tasks instead of one.  Output equals
    ``big.join(small, on, how)`` for ``inner`` and ``left`` joins.

    The salt is a deterministic function of the row, so a re-run task after an
    executor loss sends every row to the same place again.  Exact copies of
    one row share a salt; a hot group of copies is split by AQE's skew-join
    handling, which cuts a large partition by map-output blocks, not by key.
    """
    if how not in ("inner", "left", "left_outer"):
        raise ValueError("salted_join supports inner and left joins")
    salt = "__salt"
    big_s = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)))
    small_s = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big_s.join(small_s, [*on, salt], how).drop(salt)


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str] | str,
    how: str = "inner",
    max_bytes: int = BROADCAST_MAX_BYTES,
    salts: int = 32,
) -> DataFrame:
    """Join a large input to a derived side that is usually small.

    ``small`` is stored first; then its size is known.  Within ``max_bytes`` it
    is broadcast, so every row of ``big`` stays where it is; beyond, the join is
    salted (:func:`salted_join`).  Both ways give the same rows.
    """
    keys = [on] if isinstance(on, str) else list(on)
    small = store(small, "small-side")
    if planned_bytes(small) <= max_bytes:
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how, salts)


def lookup_passthrough(
    df: DataFrame,
    column: str,
    dictionary: DataFrame,
    key_col: str,
    value_col: str,
    out_col: str | None = None,
) -> DataFrame:
    """Replace ``column`` by its dictionary value; unmatched values pass through.

    The dictionary is de-duplicated on its key (first value by sort order) so
    the lookup can never multiply rows.  Local and small stored dictionaries are
    broadcast by the planner.
    """
    out_col = out_col or column
    lut = (
        dictionary.groupBy(F.col(key_col).alias("__k"))
        .agg(F.min(F.col(value_col)).alias("__v"))
    )
    out = df.join(lut, F.col(column) == F.col("__k"), "left")
    return out.withColumn(out_col, F.coalesce(F.col("__v"), F.col(column))).drop("__k", "__v")


def existing_keys(df: DataFrame, target: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows of ``df`` whose key exists in ``target`` (EXISTS); ``df``'s columns in order."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(target.select(*keys), keys, "left_semi").select(*df.columns)


def new_keys(df: DataFrame, target: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows of ``df`` whose key is absent from ``target`` (NOT EXISTS); ``df``'s columns in order."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(target.select(*keys), keys, "left_anti").select(*df.columns)


def orphan_keys(
    child: DataFrame,
    child_key: str,
    parent: DataFrame,
    parent_key: str,
) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent row."""
    parents = parent.select(F.col(parent_key).alias("__pk")).where(F.col("__pk").isNotNull())
    cond: Column = F.col(child_key) == F.col("__pk")
    return child.where(F.col(child_key).isNotNull()).join(parents, cond, "left_anti")
