"""Removal of repeated passages, exact to the word, by a compressed FM-index per shard.

A window is ``least`` (35) consecutive words.  A repeated window must meet its
double in one shard, so windows are routed by their content:

1. Of the 8-word runs in a window, the one that the corpus holds least often
   (by a histogram of fixed size; then by hash) is its anchor.  Neighbouring
   windows with the anchor at one place form a segment, about 50 words; equal
   windows have equal anchors.  Frequent runs are no anchors unless a window has no other,
   so a passage or line that very many documents share draws no crowd of
   segments that merely touch it.
2. A window whose anchor occurs once occurs once.  Of the other segments, equal
   ones are counted before texts move: a segment that occurs twice is repeated
   as a whole, wherever it occurs.  Copied documents end here.
3. The remaining, distinct segments travel as text to the shard of their anchor.
   A task sorts them by it and builds one index after the other, each of
   whole groups and about ``SHARD_WORDS`` words: a wavelet matrix over the
   Burrows-Wheeler transform.  Backward search gives the matching statistics of
   each single segment and with them the intervals of ``least`` or more words
   that occur elsewhere.  An anchor with more than ``HOT_SEGMENTS`` of them is
   split: of the 27 other words of a window at least 14 lie before or at least 14
   behind the anchor, and equal windows agree in them.  So a segment goes to the
   group of its 14 words before the anchor, of the 14 behind it, or to both, and
   a run that stands in every text draws no crowd either.
4. Intervals return to their texts, and the words they cover are removed.

Texts are identified by a 128-bit hash, so copies are searched once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from slate.llm.common import gram_hashes, stored, word_hashes
from slate.llm.fm_index import FMIndex, repeated_intervals

LEAST = 35
ANCHOR = 8
BUCKETS = 1 << 16
SHARD_WORDS = 200_000
#: Distinct segments of an anchor beyond which it is split by the words around it.
HOT_SEGMENTS = 2000
#: Texts whose hashes (16 bytes each) may be sent to all executors to pick rows; more are joined by shuffle.
BROADCAST_TEXTS = 1_000_000


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(5), "text").alias("t2")]


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(BUCKETS - 1)).astype(np.int64)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts += np.bincount(_bucket(gram_hashes(word_hashes((text or b"").split()), ANCHOR)), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value (the first, in a tie) of each run of ``width``."""
    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(x[right] < x[left], right, left)

    at, span = np.arange(len(x)), 1
    while 2 * span <= width:
        at = better(at[:-span], at[span:])
        span *= 2
    rest = width - span
    return better(at[: len(at) - rest], at[rest:]) if rest else at


def segments(hashes: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text: first window, number of windows, anchor, hash of all words."""
    if len(hashes) < least:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    grams = gram_hashes(hashes, ANCHOR)
    rank = (np.minimum(counts[_bucket(grams)], (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (grams >> np.uint64(24))
    anchor = _sliding_argmin(rank, least - ANCHOR + 1)
    first = np.append(0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1)
    windows = np.diff(np.append(first, len(anchor)))
    # hash of words[a:b] by differences of one running sum
    power = np.cumprod(np.append(np.uint64(1), np.full(len(hashes), 0xD6E8FEB86659FD93, np.uint64)))
    inverse = np.cumprod(np.append(np.uint64(1), np.full(len(hashes), pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64)))
    total = np.append(np.uint64(0), np.cumsum(hashes * power[:-1]))
    last = first + windows + least - 1
    content = ((total[last] - total[first]) * inverse[first]) ^ (windows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return first, windows, rank[anchor[first]], content


def _segments(counts: np.ndarray, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes = [], []
            for text in batch.column("text").to_pylist():
                parts.append(segments(word_hashes((text or b"").split()), counts, least))
                sizes.append(len(parts[-1][0]))
            whole = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*parts, strict=True) if parts else [[]] * 4)]
            key = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes), pa.int64()) for c in ("t1", "t2")]
            yield pa.RecordBatch.from_arrays(
                [*key, pa.array(whole[0], pa.int32()), pa.array(whole[1], pa.int32()), pa.array(whole[2].view(np.int64)), pa.array(whole[3].view(np.int64))],
                ["t1", "t2", "first", "windows", "anchor", "content"])
    return run


def _groups(words: list[bytes], anchor: int, least: int) -> list[int]:
    """Groups of a segment of a split anchor: by the words before its place, by those behind it, or both."""
    near = -(-(least - ANCHOR) // 2)
    hashes = word_hashes(words)
    low = np.uint64(anchor & ((1 << 40) - 1))
    place = int(np.flatnonzero(gram_hashes(hashes, ANCHOR) >> np.uint64(24) == low)[0])  # of equal runs the first is the anchor
    sides = [(1, words[place - near : place])] if place >= near else []
    if len(words) - place - ANCHOR >= near:
        sides.append((2, words[place + ANCHOR : place + ANCHOR + near]))
    return [xxh3_64_intdigest(b" ".join(around), seed=(anchor ^ side) & ((1 << 64) - 1)) - (1 << 63) for side, around in sides]


def _segment_texts(least: int):
    """Rows (t1, t2, first, group, single, words) of the wanted segments of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t1, t2, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text", "wanted")), strict=True):
                words = text.split()
                for w in wanted:
                    own = words[w["first"] : w["first"] + w["windows"] + least - 1]
                    groups = _groups(own, w["anchor"], least) if w["hot"] else [w["anchor"]]
                    rows += [(t1, t2, w["first"], group, w["single"], b" ".join(own)) for group in groups]
            names = ("t1", "t2", "first", "group", "single", "words")
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))
    return run


INTERVALS = "t1 long, t2 long, start int, end int"


def _search(rows: list[tuple], least: int) -> pa.RecordBatch:
    """Intervals of the single segments of one shard that occur elsewhere in it."""
    words = [r[5].split() for r in rows]
    lengths = np.array([len(w) for w in words])
    begins = np.append(0, np.cumsum(lengths + 1))[:-1]
    ids = np.unique(word_hashes([x for w in words for x in w]), return_inverse=True)[1] + 1
    symbols = np.zeros(int(lengths.sum()) + len(lengths), np.int64)
    symbols[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    single = np.array([r[4] for r in rows])
    found = repeated_intervals(FMIndex(symbols, least), symbols, begins, np.where(single, lengths, 0), least)
    out = [(rows[q][0], rows[q][1], rows[q][2] + a, rows[q][2] + b) for q, a, b in found]
    columns = list(zip(*out, strict=True)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["t1", "t2", "start", "end"])


def _shards(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0  # sorted by group
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "first", "group", "single", "words")), strict=True):
                if size >= SHARD_WORDS and row[3] != rows[-1][3]:
                    yield _search(rows, least)
                    rows, size = [], 0
                rows.append(row)
                size += row[5].count(b" ") + 2
        if rows:
            yield _search(rows, least)
    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words, n_removed and the hash of what is kept of each text."""
    for batch in batches:
        n, removed, digests = [], [], []
        for text, cut in zip(batch.column("text").to_pylist(), batch.column("intervals").to_pylist(), strict=True):
            words = (text or b"").split()
            gone = np.zeros(len(words) + 1, np.int64)
            for i in cut or []:
                gone[i["start"]] += 1
                gone[i["end"]] -= 1
            kept = np.cumsum(gone[:-1]) == 0
            n.append(len(words))
            removed.append(len(words) - int(kept.sum()))
            digests.append(hashlib.sha256(b" ".join([w for w, k in zip(words, kept, strict=True) if k])).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` (t1, t2, ...) that have one of ``keys`` (distinct)."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_TEXTS else keys, ["t1", "t2"], "left_semi")


def repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(t1, t2, intervals) of each text (by hash) with repeated windows; intervals (start, end) in words, sorted."""
    texts = docs.select(*_text_key(), F.col("text").cast("binary").alias("text"))
    counts = np.zeros(BUCKETS, np.int64)  # of fixed size
    for r in texts.select("text").mapInArrow(_gram_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).toLocalIterator():
        counts[r[0]] = r[1]

    found = texts.mapInArrow(_segments(counts, least), "t1 long, t2 long, first int, windows int, anchor long, content long")
    # stored, so that the join has plain shuffles on both sides and a hot anchor's rows can be split
    repeated = stored(found.groupBy("anchor").count().where("count > 1").select("anchor"), "repeated-anchors")
    found = stored(found.join(repeated, "anchor"), "segments")

    distinct = found.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "first", "windows")).alias("at"))
    distinct = stored(distinct, "distinct-segments")
    several = stored(distinct.groupBy("anchor").count().where("count > 1").select("anchor", (F.col("count") > HOT_SEGMENTS).alias("hot")), "anchors")
    wanted = (distinct.join(several, "anchor").select("at.*", "anchor", "hot", (F.col("n") == 1).alias("single"))
              .groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "windows", "anchor", "hot", "single")).alias("wanted")))
    wanted = stored(wanted, "wanted")  # a text's own segments: bounded by its length
    moving = _only(texts, wanted.select("t1", "t2")).dropDuplicates(["t1", "t2"]).join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "wanted")
    moving = moving.mapInArrow(_segment_texts(least), "t1 long, t2 long, first int, group long, single boolean, words binary")
    shards = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = moving.repartition(shards, "group").sortWithinPartitions("group").mapInArrow(_shards(least), INTERVALS)

    copied = found.join(distinct.where("n > 1").select("anchor", "content"), ["anchor", "content"]).select(
        "t1", "t2", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (least - 1)).alias("end"))
    return copied.unionByName(single).groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("intervals"))


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs`` (doc_id, text).

    Null and empty texts, and texts under ``least`` words, have nothing to
    remove.  Repeated rows are repeats of each other.  An empty table gives an
    empty result.
    """
    spans = stored(repeated_spans(docs, least), "intervals")
    rows = docs.select("doc_id", *_text_key(), F.col("text").cast("binary").alias("text"))
    keys = spans.select("t1", "t2")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    if keys.count() > BROADCAST_TEXTS:
        return rows.join(spans, ["t1", "t2"], "left").select("doc_id", "text", "intervals").mapInArrow(_without, schema)
    hit = rows.join(F.broadcast(keys), ["t1", "t2"], "left_semi").join(spans, ["t1", "t2"]).select("doc_id", "text", "intervals")
    clean = rows.join(F.broadcast(keys), ["t1", "t2"], "left_anti").select("doc_id", "text", F.lit(None).cast(spans.schema["intervals"].dataType).alias("intervals"))
    return hit.unionByName(clean).mapInArrow(_without, schema)
