"""End-to-end build (R15): the tables every report reads, in dependency order.

The original ran its processes in a fixed order (clear, create, seed,
rosters, players, schedule, mart) that handed over through one database file.
Here each step is a Spark job writing a parquet table to a new folder under a
warehouse root on shared storage; the next step reads the written table, so
every step starts from a short lineage (a lost executor re-runs only the
current step's tasks).  The build ends with one manifest of all its tables
(:mod:`slate.sources.manifest`), which readers look up first: whatever step
fails, they keep the tables of the last build that ended.

Writes that do not depend on each other are submitted side by side: first the
dimensions, rosters, players and schedule, then the mart and the views.

Two entry points:

* :func:`build_from_feeds` - the original inputs: schedule pages, roster feed,
  nested player feed.  Keyed loads (rosters: upsert, players: insert-or-
  ignore) are applied against the current version, so re-running is idempotent.
* :func:`build_from_driver_tables` - the driver's tables through the adapters.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from slate.constants import DEFAULT_AS_OF
from slate.operators.horizon import horizon_detailed, horizon_slim
from slate.operators.schema import CATALOG, PLAYER, empty_table, enforce_schema
from slate.plans import adapters, etl, reports
from slate.sources.manifest import Manifest, drop_unpublished, publish, read_manifest
from slate.sources.sinks import read_latest, write_table

TABLES = ["stat_type", "stat_period", "stat_aggregation", "team", "fantasy_roster", "player", "schedule",
          "proj_player_points"]
#: Stored horizon views.
VIEWS = ["player_points_detailed", "player_points_slim"]
HORIZON_DAYS = 7


@dataclass(frozen=True)
class Warehouse:
    """A root folder whose newest manifest names one folder per table."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def manifest(self, spark: SparkSession) -> Manifest | None:
        return read_manifest(spark, self.root)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        df = self.read_or_none(spark, table)
        if df is None:
            raise FileNotFoundError(f"table {table!r} has not been built under {self.root}")
        return df

    def read_or_none(self, spark: SparkSession, table: str) -> DataFrame | None:
        """The published table; one that was written without a manifest at its newest version."""
        published = self.manifest(spark)
        if published and table in published.tables:
            return spark.read.parquet(self.path(published.tables[table]))
        return read_latest(spark, self.path(table))

    def begin(self, spark: SparkSession) -> Build:
        return Build(spark, self, self.manifest(spark))

    def clear(self, spark: SparkSession) -> list[str]:
        """Drop every table and view of the build; returns those that were there.

        Published first (readers find none of them), deleted afterwards.
        """
        base = self.manifest(spark) or Manifest()
        found = [t for t in [*TABLES, *VIEWS] if t in base.tables]
        publish(spark, self.root, base, {t: p for t, p in base.tables.items() if t not in found})
        for t in found:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(t))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return found

    def create(self, spark: SparkSession) -> dict[str, str]:
        """Publish an empty table for every declared one that does not exist yet."""
        build = self.begin(spark)
        made = build.create_missing(())
        build.publish()
        return made

    def drop_old(self, spark: SparkSession, keep: int = 2) -> int:
        """Delete what neither of the newest ``keep`` builds holds, also the folders of failed builds."""
        return drop_unpublished(spark, self.root, keep)


@dataclass
class Build:
    """Tables on their way: written to new folders, seen by readers once they are published together."""

    spark: SparkSession
    warehouse: Warehouse
    base: Manifest | None
    id: str = field(default_factory=lambda: f"build-{uuid.uuid4().hex}")
    written: dict[str, str] = field(default_factory=dict)

    def write(self, df: DataFrame, table: str, partition_by=(), sort_by=(), rebalance: bool = True) -> str:
        path = write_table(df, self.warehouse.path(f"{table}/{self.id}"), "error", partition_by, sort_by=sort_by, rebalance=rebalance)
        self.written[table] = f"{table}/{self.id}"
        return path

    def read(self, table: str) -> DataFrame:
        """A table of this build, or of the last published one."""
        if table in self.written:
            return self.spark.read.parquet(self.warehouse.path(self.written[table]))
        return self.warehouse.read(self.spark, table)

    def create_missing(self, planned: Iterable[str]) -> dict[str, str]:
        """Empty tables for what is declared, but neither published nor planned."""
        known = {*(self.base.tables if self.base else ()), *planned, *self.written}
        return _write_all({t: (lambda t=t: self.write(empty_table(self.spark, t), t)) for t in CATALOG if t not in known})

    def publish(self) -> Manifest:
        return publish(self.spark, self.warehouse.root, self.base, {**(self.base.tables if self.base else {}), **self.written})


def _write_all(jobs: dict[str, Callable[[], str]]) -> dict[str, str]:
    """Run independent table writes side by side: each is one Spark job submitted
    from its own driver thread, so small writes share the executors instead of
    waiting for one another.  Any failure is raised after all have finished."""
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        futures = {name: pool.submit(job) for name, job in jobs.items()}
        return {name: f.result() for name, f in futures.items()}


def _dimension_jobs(build: Build) -> dict[str, Callable[[], str]]:
    return {name: (lambda df=df, name=name: build.write(df, name)) for name, df in etl.dimensions(build.spark).items()}


def _write_mart(build: Build, as_of: dt.date) -> dict[str, str]:
    """R1, R8 and R9 from the stored player and schedule, side by side.  The mart is laid out by
    ISO week (some thirty directories a season) and by date within its files, so date-range
    scans (S3, P11) prune directories and skip what lies before and after the range in
    a file (:func:`slate.sources.tables.date_range_scan`)."""
    player, schedule = build.read("player"), build.read("schedule")
    return _write_all({
        "proj_player_points": lambda: build.write(reports.player_schedule_mart(player, schedule), "proj_player_points", ["week"], ["date"], rebalance=False),
        "player_points_detailed": lambda: build.write(horizon_detailed(player, schedule, as_of, HORIZON_DAYS), "player_points_detailed"),
        "player_points_slim": lambda: build.write(horizon_slim(player, schedule, as_of, HORIZON_DAYS), "player_points_slim"),
    })


def build_from_feeds(
    spark: SparkSession,
    root: str,
    pages: DataFrame,
    roster_feed: DataFrame,
    player_feed: DataFrame,
    as_of: dt.date = DEFAULT_AS_OF,
) -> dict[str, str]:
    """R15 over the original inputs; returns table -> written folder."""
    wh = Warehouse(root)
    build = wh.begin(spark)
    rosters = etl.rosters_from_feed(roster_feed, wh.read_or_none(spark, "fantasy_roster"))
    players = etl.players_from_feed(player_feed, wh.read_or_none(spark, "player"))
    out = _write_all({
        **_dimension_jobs(build),
        "fantasy_roster": lambda: build.write(rosters, "fantasy_roster"),
        "player": lambda: build.write(players, "player"),
    })
    # the schedule load looks names up in the stored team dimension
    out["schedule"] = build.write(etl.schedule_from_pages(pages, build.read("team").select("name", "abbrev")), "schedule")
    out |= _write_mart(build, as_of)
    build.publish()
    return out


def build_from_driver_tables(
    spark: SparkSession, sf_dir: str, root: str, as_of: dt.date = DEFAULT_AS_OF
) -> dict[str, str]:
    """R15 over the driver tables (adapters instead of feeds): the dimensions, rosters, players
    and schedule, then the mart and the views; declared tables that nothing fills are created
    empty.  All of them replace the published ones at the end, at once."""
    build = Warehouse(root).begin(spark)
    schedule = adapters.schedule(spark, sf_dir)
    player = enforce_schema(adapters.player(spark, sf_dir, as_of), PLAYER)
    rosters = etl.rosters_from_feed(adapters.roster_feed(spark, sf_dir, as_of))
    out = _write_all({
        **_dimension_jobs(build),
        "fantasy_roster": lambda: build.write(rosters, "fantasy_roster"),
        "schedule": lambda: build.write(schedule, "schedule"),
        "player": lambda: build.write(player, "player"),
    })
    out |= _write_mart(build, as_of)
    build.create_missing(())
    build.publish()
    return out
