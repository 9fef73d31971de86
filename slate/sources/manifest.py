"""Atomic publication of several tables: a manifest names the files of each.

A build writes every table to a folder of its own, which no reader knows of, and
at the end one small file, the next manifest.  It is written under another name
and renamed, so it is there as a whole or not at all.  Readers look up the newest
manifest first: they see all tables of one build, and a build that fails in any
step leaves the last published one as it was.  Two builds that start from the
same manifest cannot both publish.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

MANIFEST_DIR = "_manifests"


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    #: table -> folder, relative to the root
    tables: dict[str, str] = field(default_factory=dict)


class PublishConflict(RuntimeError):
    """Another build has published since this one began."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def manifest_numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root.rstrip('/')}/{MANIFEST_DIR}")
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_manifest(spark: SparkSession, root: str, number: int | None = None) -> Manifest | None:
    """The newest manifest, or the one of the given number (None if there is none)."""
    numbers = manifest_numbers(spark, root)
    if not numbers or (number is not None and number not in numbers):
        return None
    number = numbers[-1] if number is None else number
    fs, path = _fs(spark, f"{root.rstrip('/')}/{MANIFEST_DIR}/{number}.json")
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(number, json.loads(text)["tables"])


def publish(spark: SparkSession, root: str, base: Manifest | None, tables: dict[str, str]) -> Manifest:
    """Make ``tables`` the content of ``root``, if no one else has published since ``base``."""
    made = Manifest((base.number if base else 0) + 1, dict(sorted(tables.items())))
    folder = f"{root.rstrip('/')}/{MANIFEST_DIR}"
    fs, final = _fs(spark, f"{folder}/{made.number}.json")
    _, draft = _fs(spark, f"{folder}/.{made.number}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps({"tables": made.tables}, indent=1).encode()))
    stream.close()
    newest = manifest_numbers(spark, root)
    # a rename onto a file that exists fails or returns False
    if (newest and newest[-1] >= made.number) or fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise PublishConflict(f"{root}: manifest {made.number} was published by another build")
    return made


def drop_unpublished(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete table folders that none of the newest ``keep`` manifests names, and older manifests.

    Not to be run beside a build: its folders are not published yet.  Returns the
    number of folders.
    """
    numbers = manifest_numbers(spark, root)
    named = {path for n in numbers[-keep:] for path in read_manifest(spark, root, n).tables.values()}
    fs, top = _fs(spark, root)
    dropped = 0
    for table in fs.listStatus(top) if fs.exists(top) else []:
        name = table.getPath().getName()
        if not table.isDirectory() or name.startswith("_"):
            continue
        for build in fs.listStatus(table.getPath()):
            if f"{name}/{build.getPath().getName()}" not in named:
                dropped += bool(fs.delete(build.getPath(), True))
    for n in numbers[:-keep]:
        fs.delete(_fs(spark, f"{root.rstrip('/')}/{MANIFEST_DIR}/{n}.json")[1], False)
    return dropped
