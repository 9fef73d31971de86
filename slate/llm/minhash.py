"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Every document becomes its set of hashed word shingles; documents with the
   same set are one node from here on, so exact copies cost nothing later.
2. The ``k`` smallest hashes of a set are its sketch (the upper 32 bits of each).
   A sketch is put in order from rare to frequent values, by a histogram of
   fixed size, and each two neighbours in this order make a list key.  Two sets
   with the wanted similarity have at least ``least_neighbours`` keys in common
   (exactly so for sets that are their own sketch, else up to a chance below
   ``MISS``), so each set only needs to be listed under its first
   ``keys - least_neighbours + 1`` keys: then one common key is listed for both.
   Very frequent shingles and chance meetings of two common ones thereby form
   almost no pairs, yet no link is lost.
3. Each inverted list first links its members with the one whose values are
   most frequent (a star: linear in the list; in a family of copies that member
   is close to the original).  The sketch of the union of two sets estimates
   their similarity and drops pairs far too unlike; the others are verified on
   full sets.
4. Lists whose members are then still in different components are searched
   again, on full sets: a pair must share one of the rarest values of both, at
   places that leave enough values for the similarity.  The smaller set of a
   pair holds that value among its first ninth (at 80 percent), so only such
   rows are joined with all rows of the value.  (Lists of up to ``SHORT_LIST``
   members simply give their pairs, for step 3.)  Only pairs across components
   count; pairs within one could not change it.  They are left out before they
   are formed: of a value whose rows lie in one component none are taken, and
   else one side leaves out the component with most rows.  So the components
   are exact, and a family costs what its pairs across components do.

Rows with the same doc_id and different texts are judged one by one; a row
without doc_id is linked with nothing and has no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm.common import fresh, gram_hashes, stored, word_hashes
from slate.llm.components import connected

SKETCH_SIZE = 64
#: Chance at which a pair at the threshold may fall below the assumed overlap of sketches.
MISS = 1e-9
#: Buckets of the histograms that order values by frequency (a fixed size, half a MB).
BUCKETS = 1 << 16
#: Lists of up to so many members give all pairs across components; longer ones are searched on full sets.
SHORT_LIST = 32
#: Documents whose ids (8 bytes each) may be sent to all executors to fetch texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, without words none."""
    words = (text or b"").lower().split()
    hashes = word_hashes(words)
    return np.unique(gram_hashes(hashes, min(width, len(words)))) if words else hashes


def least_shared(size: int, percent: int) -> int:
    """Of the ``size`` smallest values of a union at the threshold, at least so many are shared (but for MISS)."""
    p, tail = percent / 100, 0.0
    for x in range(size + 1):
        tail += math.comb(size, x) * p**x * (1 - p) ** (size - x)
        if tail > MISS:
            return x
    return size


def least_neighbours(size: int, percent: int) -> int:
    """Of them, at least so many shared values directly follow a shared one (but for MISS)."""
    p = percent / 100
    apart, close = np.zeros(size), np.zeros(size)  # by count; the last value not shared, shared
    apart[0], close[0] = 1 - p, p
    for _ in range(size - 1):
        apart, close = (apart + close) * (1 - p), p * (apart + np.append(0.0, close[:-1]))
    return int(np.searchsorted((apart + close).cumsum(), MISS, side="right"))


def _rare_first(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return values[np.lexsort((values, counts[(values & (BUCKETS - 1)).astype(np.int64)]))]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Short batches, so that a worker holds few texts and lists as Python objects at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, keys, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, width)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketches.append((s[:k] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sketches, pa.list_(pa.int32()))], ["doc_id", "text_hash", "n_shingles", "content", "sketch"])
    return run


def _listed(counts: np.ndarray, percent: int, k: int):
    """Rows (key, node, fame): a set's list keys; fame is the mean frequency of its values."""
    sure = least_neighbours(k, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keys, nodes, fames, lengths = [], [], [], []
            for n, sketch in zip(batch.column("n_shingles").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
                v = _rare_first(np.array(sketch, np.int32).view(np.uint32), counts)
                # partners of a small set are their own sketches: each value that is not shared parts one pair of neighbours
                whole = -(-(2 * percent - 100) * n // 100) - 1
                shared = max(1, whole if 100 * n <= percent * k else min(sure, whole))
                pairs = gram_hashes(v.astype(np.uint64), 2)[: max(0, len(v) - shared)]
                keys.append(pairs.view(np.int64))
                lengths.append(len(pairs))
                fames.append(int(1000 * np.log2(1 + counts[v & (BUCKETS - 1)]).mean()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys) if keys else [], pa.int64()),
                 pa.array(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), lengths), pa.int64()),
                 pa.array(np.repeat(np.array(fames, np.int32), lengths))], ["key", "node", "fame"])
    return run


def _matrix(lists: pa.Array, k: int, filler: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = filler + np.arange(len(lists) * k, dtype=np.int64).reshape(-1, k)  # no filler equals another
    out[np.arange(k) < sizes[:, None]] = lists.flatten().to_numpy().view(np.uint32)
    return out, sizes


def _likely(percent: int, k: int):
    """Keep pairs whose union sketch does not rule the similarity out."""
    floor = least_shared(k, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            a, na = _matrix(batch.column("sketch_a"), k, 1 << 40)
            b, nb = _matrix(batch.column("sketch_b"), k, 1 << 50)
            union = np.sort(np.concatenate([a, b], 1), 1)
            twice = union[:, 1:] == union[:, :-1]
            rank = np.arange(1, 2 * k) - np.cumsum(twice, 1)  # of a repeated value, among the distinct ones
            all_shared = twice.sum(1)
            exact = 100 * all_shared >= percent * (na + nb - all_shared)
            keep = np.where((na < k) & (nb < k), exact, (twice & (rank < k)).sum(1) >= floor)
            batch = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
    return run


def _frequencies(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in _slices(batches):
            for text in batch.column("text").to_pylist():
                counts += np.bincount((shingles(text, width) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])
    return run


def _rarest(width: int, percent: int, counts: np.ndarray):
    """Rows (value, node, label, n, place): the values of a full set of which a similar set must share one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            values, sizes, kept = [], [], []
            for text in batch.column("text").to_pylist():
                s = _rare_first(shingles(text, width), counts)
                sizes.append(len(s))
                values.append(s[: len(s) + percent * len(s) // -100 + 1].view(np.int64))
                kept.append(len(values[-1]))
            spread = lambda x: pa.array(np.repeat(np.asarray(x, np.int64), kept), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values) if values else [], pa.int64()), spread(batch.column("node")), spread(batch.column("label")),
                 spread(sizes), pa.array(np.concatenate([np.arange(n) for n in kept]) if kept else [], pa.int64())],
                ["value", "node", "label", "n", "place"])
    return run


def _verified(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, None  # pairs come together by b
        for batch in _slices(batches):
            keep = []
            for b, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("b", "text_a", "text_b")), strict=True):
                if b != last:
                    last, pivot = b, shingles(text_b, width)
                s = shingles(text_a, width)
                shared = len(np.intersect1d(s, pivot, assume_unique=True))
                keep.append(100 * shared >= percent * (len(s) + len(pivot) - shared))
            batch = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
    return run


def _histogram(buckets: DataFrame) -> np.ndarray:
    """An array of fixed size from rows (bucket, n)."""
    counts = np.zeros(BUCKETS, np.int64)
    for r in buckets.groupBy("bucket").agg(F.sum("n")).toLocalIterator():
        counts[r[0]] = r[1]
    return counts


PAIR = "a long, b long"


def _meetings(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs (node_a < node_b) of different labels that share a value at places that leave enough for the similarity.

    With ``reach`` the size of the largest set that a row's place leaves enough
    for, that is n_a <= reach_b and n_b <= reach_a.  So at least the row of the
    smaller set reaches its own size: the ``near`` ones.
    """
    rows = rare.withColumn("reach", F.expr(f"((n - place) * {100 + percent} - n * {percent}) div {percent}"))
    by_label = rows.groupBy("value", "label").agg(F.count("*").alias("rows"), F.count_if(F.expr("reach >= n")).alias("near"))
    most = by_label.groupBy("value").agg(F.max(F.struct("rows", "label")).alias("most"), F.count("*").alias("labels"), F.sum("near").alias("near"))
    most = most.where("labels > 1 and near > 0").select("value", F.col("most.label").alias("major"))
    rows = stored(rows.join(most, "value").withColumn("minor", F.expr("label <> major")), "meeting")
    side = lambda df, x: df.select("value", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "reach")))
    # a near row outside the major component with any row, and one inside with the rows outside
    met = side(rows.where("reach >= n and minor"), "x").join(side(rows, "y"), "value").union(
        side(rows.where("reach >= n and not minor"), "x").join(side(rows.where("minor"), "y"), "value"))
    return met.where("label_x <> label_y and n_x <= reach_y and n_y <= reach_x").select(
        F.least("node_x", "node_y").alias("node_a"), F.greatest("node_x", "node_y").alias("node_b"))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, k: int = SKETCH_SIZE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_hash, n_shingles, component_id, kept.

    Links sets of ``width``-word shingles with 100 * intersection >= percent *
    union.  ``component_id`` is the smallest doc_id that links reach, ``kept``
    marks the document that bears it.  Null or empty texts have no shingle and
    stay alone.  An empty table gives an empty result.
    """
    if not 75 <= percent <= 100:
        raise ValueError("list keys need a similarity of 75 to 100 percent")
    docs = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.mapInArrow(
        _sketches(width, k), f"doc_id {id_type}, text_hash long, n_shingles long, content binary, sketch array<int>"), "sketches")

    linked = rows.where("n_shingles > 0 and doc_id is not null")
    nodes = stored(linked.groupBy("content").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")

    bucket = F.col("value").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")
    counts = _histogram(nodes.select(F.explode("sketch").alias("value")).groupBy(bucket).agg(F.count("*").alias("n")))

    lists = nodes.select("node", "n_shingles", "sketch").mapInArrow(_listed(counts, percent, k), "key long, node long, fame int")
    shared = lists.groupBy("key").agg(F.max(F.struct("fame", "node")).alias("most"), F.count("*").alias("n")).where("n > 1")
    lists = stored(lists.select("key", "node").join(shared.select("key", F.col("most.node").alias("pivot"), "n"), "key"), "lists")
    once = rows.groupBy("doc_id").count().where("count > 1").isEmpty()

    def texts(wanted: DataFrame) -> DataFrame:
        ids = stored(nodes.join(wanted, "node").select("node", F.col("doc_id").alias("id_"), "content", *wanted.columns[1:]), "wanted")
        found = _texts(docs, ids)
        return found.drop("content") if once else _of_node(found, width)

    sketch = nodes.select("node", "sketch")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs (a, b): by sketches first, then on full sets."""
        likely = (pairs.join(sketch.toDF("a", "sketch_a"), "a").join(sketch.toDF("b", "sketch_b"), "b")
                  .select("a", "b", "sketch_a", "sketch_b").mapInArrow(_likely(percent, k), PAIR))
        likely = stored(likely, "likely")
        text = stored(texts(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "texts")
        both = likely.join(text.toDF("a", "text_a"), "a").join(text.toDF("b", "text_b"), "b").sortWithinPartitions("b")
        return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(width, percent), PAIR), "links")

    links = verified(lists.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
    label = connected(links)

    # Lists that still hold several components are searched across components; two members have met already.
    labelled = lists.where("n > 2").join(label, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    mixed = stored(labelled.join(mixed, "key"), "mixed")

    def across(rows: DataFrame) -> DataFrame:
        left, right = (rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "label"))) for x in "ab")
        return left.join(right, "key").where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")))

    as_pairs = [F.col("node_a").alias("a"), F.col("node_b").alias("b")]
    short = across(mixed.where(F.col("n") <= SHORT_LIST)).select(*as_pairs).distinct()
    # long ones: on full sets, a pair must share a rare value at places that leave enough for the similarity
    unsure = stored(mixed.where(F.col("n") > SHORT_LIST).select("node", "label").distinct(), "unsure")
    counts = _histogram(texts(unsure).select("text").mapInArrow(_frequencies(width), "bucket long, n long"))
    rare = stored(texts(unsure).mapInArrow(_rarest(width, percent, counts), "value long, node long, label long, n long, place long"), "rare")
    long = _meetings(rare, percent).select(*as_pairs).distinct()
    label = connected(links.union(verified(short.union(long).distinct())))

    ids = (nodes.select("node", "content", "doc_id").join(label, "node", "left")
           .select("content", "doc_id", F.coalesce("label", "node").alias("label")))
    least = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ids = ids.join(least, "label").select("content", "component_id")
    return (rows.select("doc_id", "text_hash", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("content")).alias("content"))
            .join(ids, "content", "left")
            .select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text, content, ...) of each wanted (node, id_, content, ...)."""
    right = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return docs.join(right, F.col("doc_id") == F.col("id_")).select("node", "text", "content", *wanted.columns[3:])


def _of_node(found: DataFrame, width: int) -> DataFrame:
    """Where doc_ids repeat: of the texts found for a node, one whose set is the node's."""
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            same = [xxhash.xxh3_128_digest(shingles(t, width).tobytes()) == c for t, c in
                    zip(batch.column("text").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_())).drop_columns(["content"])

    more = [c for c in found.columns if c not in ("node", "text", "content")]
    found = found.mapInArrow(checked, ", ".join(["node long", "text binary", *(f"{c} long" for c in more)]))
    return found.dropDuplicates(["node"])


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id.

    Rows that repeat a doc_id and text count as one document and one of them
    stays; rows without doc_id all stay.
    """
    verdict = stored(near_duplicates(docs, **settings), "verdict")
    dropped = verdict.where("not kept").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct()
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    kept = docs.join(dropped, (docs["doc_id"] == dropped["id_"]) & (F.xxhash64(docs["text"]) == dropped["hash_"]), "left_anti")
    if verdict.where("doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return kept
    hashed = fresh(docs, "text_hash")
    once = kept.where("doc_id is not null").withColumn(hashed, F.xxhash64("text")).dropDuplicates(["doc_id", hashed]).drop(hashed)
    return once.unionByName(kept.where("doc_id is null"))
