"""A many-to-many join stored without passing its rows through the row-based writer.

The rows of a join that repeats both sides many times (players x games) cost far
more to hand on and encode one by one than the sides that they come from.  A
:class:`FanOut` names these sides; :func:`write_fan_out` moves them cell by cell
(a directory value and a part of the left side) to Arrow tasks, which pair row numbers and
write whole columns of the joined rows as parquet.  The stored rows are those of
the join, in the order of ``order`` within a file.

A task attempt writes a file of its own name to a folder that readers do not see;
the driver moves the files of the attempts that Spark counts, so a retried or
repeated attempt leaves nothing behind that is read.  Folders are reached through
``pyarrow.fs``; for a store that it does not know, the ordinary writer is used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

#: Rows that a task encodes at once (a row group).
GROUP_ROWS = 1 << 18
#: Spark's names of codecs that pyarrow calls otherwise.
CODECS = {"uncompressed": "none", "lz4_raw": "lz4"}


@dataclass(frozen=True)
class FanOut:
    """Sides of an inner join on ``on``, both with the column ``cell``.

    Every pair of rows with equal ``on`` is in one cell; the right rows of a cell share their
    value of ``directory``, a whole number.  ``on`` and, on the right, ``order`` are not null.
    ``rest`` are rows beside those of the cells.
    """

    left: DataFrame
    right: DataFrame
    cell: str
    on: str
    directory: str
    order: str
    columns: list[str]
    rest: DataFrame | None = None


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path in it; ``file:`` with one slash or three and bare paths are local."""
    if path.startswith("file:/"):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def fan_out(df: DataFrame, path: str, partition_by: Sequence[str], sort_by: Sequence[str]) -> FanOut | None:
    """The sides that ``df`` carries (``df.fan_out``), if a table of this layout at ``path`` can be made from them."""
    sides = vars(df).get("fan_out")
    if sides is None:
        return None
    try:
        opened(path)
    except (pa.ArrowException, OSError, ValueError):
        return None
    fan = sides()
    return fan if [[fan.directory], [fan.order]] == [list(partition_by), list(sort_by)] else None


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def pairs(left: pa.Array, right: pa.Array, order: pa.Array, rows: int = GROUP_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (left, right) of all pairs with equal keys, by ``order`` of the right row.

    About ``rows`` pairs at a time (beyond that by the matches of one left row at most).
    Keys and order are not null.
    """
    codes = pa.chunked_array([left, right]).dictionary_encode().combine_chunks().indices.to_numpy()
    of_left, of_right = codes[:len(left)], codes[len(left):]
    by_key = np.argsort(of_left, kind="stable")
    have = np.bincount(of_left, minlength=int(codes.max(initial=-1)) + 1)
    first = _starts(have)
    ranks = pc.rank(order, tiebreaker="dense").to_numpy()
    sorted_right = np.lexsort((of_right, ranks))
    of_right, ranks = of_right[sorted_right], ranks[sorted_right]
    # blocks: right rows of one key and order
    begin = np.flatnonzero(np.r_[True, (of_right[1:] != of_right[:-1]) | (ranks[1:] != ranks[:-1])])
    size = np.diff(np.r_[begin, len(of_right)])
    key = of_right[begin]
    # every left row of a block's key, and behind it the block's right rows
    block = np.repeat(np.arange(len(begin)), have[key])
    which = np.arange(len(block)) + np.repeat(first[key] - _starts(have[key]), have[key])
    matches = size[block]
    ends = np.cumsum(matches)
    at = 0
    while at < len(block):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + rows, side="right")))
        n = matches[at:to]
        offset = np.repeat(begin[block[at:to]] - _starts(n), n)
        yield by_key[np.repeat(which[at:to], n)], sorted_right[np.arange(len(offset)) + offset]
        at = to


def _column(table: pa.Table, name: str) -> pa.Array:
    """A column to take rows from: texts as numbers of a dictionary, which parquet writes as it is."""
    values = table.column(name).combine_chunks()
    text = pa.types.is_string(values.type) or pa.types.is_large_string(values.type)
    return values.dictionary_encode() if text else values


def _writer(fan: FanOut, folder: str, codec: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    on, directory, order = fan.on, fan.directory, fan.order
    of_left = {c for c in fan.left.columns if c not in (fan.cell, directory)}
    columns = [c for c in fan.columns if c != directory]

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"directory": pa.array([], pa.string()), "file": pa.array([], pa.string())})
        files, root = opened(folder)
        sides = {c: _column(left if c in of_left else right, c) for c in columns}
        name = f"part-{uuid.uuid4().hex}.parquet"
        schema = pa.schema([(c, v.type) for c, v in sides.items()])
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{name}") as out, pq.ParquetWriter(
                out, schema, compression=codec, store_schema=False, write_page_index=True,
                write_statistics=[order], write_batch_size=1 << 14) as writer:
            for p, g in pairs(*(t.column(on).combine_chunks() for t in (left, right)), right.column(order).combine_chunks()):
                p, g = pa.array(p), pa.array(g)
                group = [v.take(p if c in of_left else g) for c, v in sides.items()]
                writer.write_table(pa.Table.from_arrays(group, schema=schema), row_group_size=len(p))
        return pa.table({"directory": [f"{directory}={right.column(directory)[0].as_py()}"], "file": [name]})

    return write


def write_fan_out(fan: FanOut, path: str) -> None:
    """Store the joined rows in the new folder ``path``, one directory per value of ``fan.directory``."""
    spark = fan.left.sparkSession
    codec = spark.conf.get("spark.sql.parquet.compression.codec").lower()
    codec = CODECS.get(codec, codec)
    pending = f"{path.rstrip('/')}/_pending-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        raise FileExistsError(path)
    fs.mkdirs(hadoop(pending))
    written = fan.left.groupBy(fan.cell).cogroup(fan.right.groupBy(fan.cell)).applyInArrow(
        _writer(fan, pending, codec), "directory string, file string").collect()
    for folder in {w.directory for w in written}:
        fs.mkdirs(hadoop(f"{path}/{folder}"))
    for w in written:
        if not fs.rename(hadoop(f"{pending}/{w.file}"), hadoop(f"{path}/{w.directory}/{w.file}")):
            raise OSError(f"{pending}/{w.file} could not be moved to {path}/{w.directory}")
    fs.delete(hadoop(pending), True)
    fs.create(hadoop(f"{path}/_SUCCESS")).close()
