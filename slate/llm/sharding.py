"""Sharding by sampled splitters: near-equal bytes per shard, texts that are equal side by side.

1. Rows are ordered by a hash of the text, so the order says nothing about
   source, time or topic, and copies lie together.  Only ids, sizes and hashes
   move; texts are read once and never shuffled.
2. A sample of about ``SAMPLE`` keys, drawn with a chance in proportion to the
   row's size, gives quantile boundaries of ``RANGES_PER_SHARD`` ranges a shard.
3. Exact bytes per range show the overfull ones (a text that is copied very
   often sits in a single range); those are subdivided by a hash of the id.  The
   number of pieces of all others grows with the rows, so a task's work does not.
4. Within a range, a running sum gives each row its place in the whole order.
   A row belongs to the shard in which the middle of its bytes falls; a group of
   copies that is small against a shard moves as one.

``split`` keeps only the first key of each shard, so any frame with the same
rows can be given its shard by comparing keys, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.llm.common import stored

SAMPLE = 8192
RANGES_PER_SHARD = 16
#: Rows (keys and sizes, no texts) that one task sorts, about; beyond that a range is cut into pieces.
ROWS_PER_PIECE = 500_000
#: A group of copies stays in one shard if it holds at most this part of a shard.
GROUP_PART = 0.005
LAW = "bytes"
#: Columns that order all rows, and their types.
ORDER = {"place": "int", "part": "int", "key": "long", "tie": "long"}


def _size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def _key(docs: DataFrame) -> tuple[Column, Column]:
    """Order of the rows: hash of the text, then hash of the id."""
    return F.xxhash64(docs["text"]), F.xxhash64(docs["doc_id"])


def _search(column: Column, bounds: list[int], low: int = 0, high: int | None = None) -> Column:
    """Number of ``bounds`` (sorted) at most ``column``, by a tree of comparisons."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(column < F.lit(bounds[mid]), _search(column, bounds, low, mid)).otherwise(
        _search(column, bounds, mid + 1, high))


@dataclass(frozen=True)
class Ranges:
    bounds: list[int]
    parts: list[int]
    pieces: int = 1

    def place(self, key: Column) -> Column:
        return _search(key, self.bounds).cast("int")

    def part(self, place: Column, key: Column, tie: Column) -> Column:
        """Subdivision of a range: an overfull one by the hash of the id, the others, if there
        are very many rows, into even pieces of the key (a hash) in its order."""
        parts = F.element_at(F.lit(self.parts), place + 1).cast("long")
        piece: Column = F.lit(0)
        if self.pieces > 1:
            edges = [-(2.0**63), *map(float, self.bounds), 2.0**63]
            low = F.element_at(F.lit(edges[:-1]), place + 1)
            width = F.element_at(F.lit([max(b - a, 1.0) for a, b in zip(edges, edges[1:], strict=False)]), place + 1)
            share = (key.cast("double") - low) / width  # grows with the key, equal keys share a piece
            piece = F.greatest(F.lit(0), F.least(F.lit(self.pieces - 1), F.floor(share * self.pieces).cast("int")))
        return F.when(parts > 1, F.shiftright(F.shiftrightunsigned(tie, 33) * parts, 31)).otherwise(piece).cast("int")


def sampled_ranges(rows: DataFrame, n: int) -> tuple[Ranges, int]:
    """Boundaries of about ``n`` ranges of equal bytes, and all bytes."""
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not total:
        return Ranges([], [1]), 0
    chance = F.col("size") * F.lit(SAMPLE / total)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit(11)), 11) / F.lit(float(1 << 53))
    drawn = rows.where(draw < chance).select("key", F.greatest(chance, F.lit(1.0)).alias("weight"))
    sample = sorted((r.key, r.weight) for r in drawn.collect())  # about SAMPLE keys at any size
    step, at, bounds = sum(w for _, w in sample) / n, 0.0, []
    for key, weight in sample:
        at += weight
        if at >= step * (len(bounds) + 1) and (not bounds or key > bounds[-1]):
            bounds.append(key)
    bounds = bounds[: n - 1]
    share = total / n
    full = dict(rows.groupBy(_search(F.col("key"), bounds).alias("place")).agg(F.sum("size")).collect())
    return Ranges(bounds, [max(1, round(full.get(i, 0) / share)) if full.get(i, 0) > 2 * share else 1
                           for i in range(len(bounds) + 1)], -(-n_rows // (ROWS_PER_PIECE * (len(bounds) + 1)))), total


@dataclass(frozen=True)
class Split:
    """Where shards begin, in the order (place, part, key, tie)."""

    ranges: Ranges
    starts: list[tuple[int, int, int, int]]

    def shard(self, place: Column, part: Column, key: Column, tie: Column) -> Column:
        own = F.struct(place.alias("place"), part.alias("part"), key.alias("key"), tie.alias("tie"))
        later = [F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(start, ORDER.items(), strict=True)))
                 for start in self.starts[1:]]
        return sum(((own >= start).cast("int") for start in later), F.lit(0)).cast("int")


def ordered_rows(docs: DataFrame, shards: int) -> tuple[DataFrame, Split]:
    """Keyed rows with their running number ``index``, and the split into shards."""
    key, tie = _key(docs)
    rows = stored(docs.select(
        "doc_id", _size().alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        key.alias("key"), tie.alias("tie")), "shard-keys")
    ranges, total = sampled_ranges(rows, shards * RANGES_PER_SHARD)
    rows = rows.withColumn("place", ranges.place(F.col("key")))
    rows = rows.withColumn("part", ranges.part(F.col("place"), F.col("key"), F.col("tie")))

    sums = rows.groupBy("place", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range, not per document
    sums = sums.select("place", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))

    inside = Window.partitionBy("place", "part").orderBy("key", "tie", "doc_id")
    group = Window.partitionBy("place", "part", "key")
    rows = (rows.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("row", F.row_number().over(inside) - 1)
            .withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_end", F.max("end").over(group)))
    rows = rows.join(F.broadcast(sums), ["place", "part"])  # at most three rows a range
    small = F.col("group_bytes") <= GROUP_PART * total / shards
    middle = F.col("bytes_before") + F.when(small, F.col("group_end") - F.col("group_bytes") / 2).otherwise(
        F.col("end") - F.col("size") / 2)
    rows = stored(rows.select(
        "doc_id", "size", "text_crc32", "place", "part", "key", "tie", (F.col("rows_before") + F.col("row")).alias("index"),
        F.least(F.floor(middle * F.lit(shards / max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard")), "shard-order")
    starts = dict(rows.groupBy("shard").agg(F.min(F.struct(*ORDER))).collect())
    last = max(starts.values(), default=None)
    ordered: list[tuple[int, int, int, int]] = []
    for s in reversed(range(shards)):  # a shard without rows begins where the next one does
        last = starts.get(s, last)
        ordered.append(tuple(last) if last else (0, 0, 0, 0))
    return rows, Split(ranges, ordered[::-1])


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: shards hold nearly the same bytes (a row's size is its text's
    UTF-8 bytes plus 1; a null text has none).  ``slot`` counts a shard's rows
    from 0 without gaps.  Rows that agree in id and text share a shard.  An
    empty table gives an empty result; with few rows shards may stay empty.
    """
    rows, split = ordered_rows(docs, shards)
    rows = rows.withColumn("shard", split.shard(*(F.col(c) for c in ORDER)))
    first = rows.groupBy("shard").agg(F.min("index").alias("first"))  # one row a shard
    return rows.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("index") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def with_shard(docs: DataFrame, shards: int = 8, name: str = "shard") -> DataFrame:
    """``docs`` with its shard in the new column ``name``, without a join or a shuffle of texts."""
    _, split = ordered_rows(docs, shards)
    key, tie = _key(docs)
    place = split.ranges.place(key)
    return docs.withColumn(name, split.shard(place, split.ranges.part(place, key, tie), key, tie))
