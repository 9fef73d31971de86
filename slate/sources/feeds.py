"""Nested player feed (S5) and the bounded pull.

The feed arrives grouped by roster: ``(roster_name, players array<struct>)``,
each player carrying a ``stats`` map keyed by period (``"2024_last_7"`` ...).
Reading it is a declared-schema scan plus ``posexplode``; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAT = T.StructType([T.StructField("applied_avg", T.DoubleType())])

PLAYER_RECORD = T.StructType([
    T.StructField("playerId", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("proTeam", T.StringType()),
    T.StructField("position", T.StringType()),
    T.StructField("injuryStatus", T.StringType()),
    T.StructField("injured", T.BooleanType()),
    T.StructField("lineupSlot", T.StringType()),
    T.StructField("total_points", T.DoubleType()),
    T.StructField("avg_points", T.DoubleType()),
    T.StructField("projected_total_points", T.DoubleType()),
    T.StructField("projected_avg_points", T.DoubleType()),
    T.StructField("stats", T.MapType(T.StringType(), STAT)),
])

#: Raw feed: one record per roster or part of one (``feed_seq`` = arrival order, unique).
FEED = T.StructType([
    T.StructField("feed_seq", T.LongType()),
    T.StructField("roster_name", T.StringType()),
    T.StructField("players", T.ArrayType(PLAYER_RECORD)),
])

ROSTER_FEED = T.StructType([
    T.StructField("team_id", T.IntegerType()),
    T.StructField("team_abbrev", T.StringType()),
    T.StructField("team_name", T.StringType()),
    T.StructField("division_id", T.StringType()),
    T.StructField("division_name", T.StringType()),
    T.StructField("standing", T.IntegerType()),
    T.StructField("final_standing", T.IntegerType()),
    T.StructField("feed_seq", T.IntegerType()),
])


def read_feed(spark, path: str, fmt: str = "json", schema: T.StructType | None = None) -> DataFrame:
    """Read a stored feed with its declared schema (no inference pass).

    ``schema`` defaults to the nested player feed; pass ``ROSTER_FEED`` for rosters.
    """
    return spark.read.schema(schema or FEED).format(fmt).load(path)


#: Column that holds the text of a record which does not fit the declared schema.
RESCUED = "_rescued"


def read_feed_with_rejects(spark: SparkSession, path: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """A stored JSON feed's good records, and the others as (file, record).

    A record that is no JSON, or has a value of the wrong type, comes whole as
    text; read without a rescue column it would be a row of NULLs among the good
    ones.  Records are lines of text parsed against the declared schema as a
    whole, so a record is good or bad whichever columns a query reads.  Blank lines
    are no records.
    """
    declared = schema or FEED
    rescued = T.StructType([*declared.fields, T.StructField(RESCUED, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("file"), "value")
    parsed = lines.withColumn("r", F.from_json("value", rescued, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RESCUED}))
    bad = F.col("r").isNull() | F.col(f"r.{RESCUED}").isNotNull()
    return parsed.where(~bad).select(*(F.col(f"r.{n}") for n in declared.fieldNames())), parsed.where(bad).select("file", F.col("value").alias("record"))


def load_feed(spark: SparkSession, path: str, rejects_path: str, schema: T.StructType | None = None) -> DataFrame:
    """The good records of a feed; the rejected ones are appended to the side table at ``rejects_path``."""
    good, bad = read_feed_with_rejects(spark, path, schema)
    bad.write.mode("append").parquet(rejects_path)
    return good


def explode_feed(feed: DataFrame) -> DataFrame:
    """One row per player: ``feed_seq, roster_name, player_pos, p.*``.

    ``(feed_seq, player_pos)`` is the arrival order used by insert-or-ignore.
    """
    return feed.select(
        "feed_seq", "roster_name", F.posexplode("players").alias("player_pos", "p")
    ).select("feed_seq", "roster_name", "player_pos", "p.*")


def top_n(df: DataFrame, n: int, order: Sequence[Column], partition_by: Sequence[str] = (),
          salts: int = 16) -> DataFrame:
    """The first ``n`` rows by ``order`` (per group if ``partition_by``).

    ``order`` must be a total order (add a unique tie-breaker) for the result to
    be deterministic.  Without groups this plans as TakeOrderedAndProject: each
    partition keeps its own top n, so at most n x partitions rows move.

    Per group it runs in two rounds so a hot group is not sorted in one task:
    top n within (group, salt) first, then top n of the at most n x salts
    survivors per group.  Spark also puts a map-side ``WindowGroupLimit``
    before each shuffle (n up to ``spark.sql.optimizer.windowGroupLimitThreshold``),
    so every map task sends at most n rows per (group, salt); that bounds a hot
    group even when it consists of identical copies, which share a salt.
    """
    if not partition_by:
        return df.orderBy(*order).limit(n)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    w1 = Window.partitionBy(*partition_by, "__salt").orderBy(*order)
    w2 = Window.partitionBy(*partition_by).orderBy(*order)
    first = (df.withColumn("__salt", salt).withColumn("__rn", F.row_number().over(w1))
             .where(F.col("__rn") <= n).drop("__rn", "__salt"))
    return first.withColumn("__rn", F.row_number().over(w2)).where(F.col("__rn") <= n).drop("__rn")
