"""Hard-negative mining over anchor-clustered shared lists (after MAXIMUS).

Vectors are made of integers, so scores (inner products) are exact.  Anchors are
clustered by direction.  For an anchor ``u`` of a cluster with centre ``c`` whose
members lie within the angle ``b`` of it, and a row ``i`` at the angle ``t`` from
``c``,

    u . i  <=  |u| |i| cos(max(0, t - b)),

so ``|i| cos(max(0, t - b))`` bounds all members at once.  For each cluster the
rows are sorted by that bound once; every member walks the shared list until the
bound of what is left, times its own length, cannot enter its result any more.
That ends a walk with a certificate: nothing is approximate, whatever the
clusters look like.

1. Rows are cleaned and made distinct in Spark SQL and stored.
2. Centres come from a bounded sample of the anchors; all anchors are assigned in
   parallel.  Anchors are taken in groups of bounded size (whole clusters, or
   parts of a large one); a group is broadcast to all rows.
3. Each task walks its own rows, block by block, with the results so far as
   the threshold, and gives what its rows contribute to each anchor; one window
   per anchor over these few rows merges the tasks.
4. The first pass finds each anchor's positives, the second one, with the
   positives' scores known, the negatives in each positive's range of scores.

No pair of an anchor and a row leaves a task unless it is in the task's result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.llm.common import stored

SCALE = 256
#: Vectors of this length or more take no part: a hundred times their products would not fit a long.
LENGTH_LIMIT = float(1 << 28)
#: Anchors from which the centres are learned, members a cluster has on average, most centres, rounds.
SAMPLE, MEMBERS, MOST_CENTRES, ROUNDS = 8192, 32, 512, 8
#: Bytes of anchors' vectors that are broadcast at a time, and rows of a shared list.
GROUP_BYTES, LIST_ROWS = 8 << 20, 8192
STEPS = (64, 256, 1024)
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v, size, norm: the rows that take part, each once.

    Out are rows without an id, a label or a vector, with a null or non-finite
    component, and with a vector beyond ``LENGTH_LIMIT``.
    """
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & sound)
    v = F.transform(x, lambda c: F.floor(c * SCALE))
    rows = rows.where(F.aggregate(x, F.lit(0.0), lambda a, c: a + F.pow(F.floor(c * F.lit(float(SCALE))).cast("double"), F.lit(2.0))) < LENGTH_LIMIT**2)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), v.alias("v")).distinct()
    return rows.select("*", F.size("v").alias("size"))


def _matrix(rows: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    """Vectors as a matrix; shorter ones end with zeros, longer ones are cut where the other side ends."""
    column = rows.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = at < width
    out[np.repeat(np.arange(len(sizes)), sizes)[keep], at[keep]] = flat[keep]
    return out


def _lengths(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    v = rows.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    at = np.repeat(np.arange(len(v)), np.diff(v.offsets.to_numpy()))
    return np.sqrt(np.bincount(at, np.square(v.flatten().to_numpy(zero_copy_only=False).astype(float)), len(v)))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros(m.shape), where=n > 0)


def centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of a bounded sample; deterministic."""
    unit = _unit(sample.astype(float))
    found = unit[np.random.default_rng(13).permutation(len(unit))[:k]]
    for _ in range(ROUNDS):
        nearest = np.argmax(unit @ found.T, axis=1)
        total = np.zeros(found.shape)
        np.add.at(total, nearest, unit)
        found = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, _unit(total), found)
    return found


@dataclass
class Walk:
    """What is looked for: per anchor one or more slots, each the best ``k`` rows of a range of scores."""

    anchor: np.ndarray  # anchor's number of each slot
    least: np.ndarray  # lowest and highest score of the slot
    most: np.ndarray
    k: int
    same_label: bool


@dataclass
class Group:
    """Anchors of some clusters, side by side cluster by cluster."""

    ids: np.ndarray
    labels: np.ndarray
    m: np.ndarray
    norms: np.ndarray
    clusters: list[tuple[int, int, np.ndarray, float]]  # from, to, centre, greatest angle

    def search(self, batches: Iterable[pa.RecordBatch], walk: Walk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, vec_id, score) of the best rows of all batches, for every slot."""
        best = (np.empty(0, np.int64),) * 3
        bar = walk.least.copy()  # a row must reach it to enter a slot
        slots = np.split(np.arange(len(walk.anchor)), np.searchsorted(walk.anchor, np.arange(1, len(self.ids))))
        for batch in batches:
            for at in range(0, batch.num_rows, LIST_ROWS):
                best = self._search_list(batch.slice(at, LIST_ROWS), walk, slots, bar, best)
        return best

    def _search_list(self, rows: pa.RecordBatch, walk: Walk, slots: list[np.ndarray], bar: np.ndarray, best: tuple) -> tuple:
        ids, labels, lengths = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _lengths(rows)
        m = _matrix(rows, self.m.shape[1])
        exact_in_float = lengths.max(initial=0) * self.norms.max(initial=0) < 2.0**52
        number = float if exact_in_float else np.int64
        m, own = m.astype(number), self.m.astype(number)
        unit = np.divide(m, lengths[:, None], out=np.zeros(m.shape), where=lengths[:, None] > 0)
        for first, last, centre, spread in self.clusters:
            angle = np.arccos(np.clip(unit @ centre, -1, 1))
            bound = lengths * np.cos(np.maximum(0.0, angle - spread))
            order = np.argsort(-bound, kind="stable")  # the list shared by the cluster's members
            # lists are cut short, not rows: what the certificate leaves out cannot enter
            walking, at, step = np.arange(first, last), 0, 0
            while at < len(order) and len(walking):
                limit = np.array([bar[slots[a]].min(initial=np.iinfo(np.int64).max) for a in walking])
                reach = bound[order[at]] * self.norms[walking]
                walking = walking[np.floor(reach + 1e-9 * np.abs(reach) + 1e-6) >= limit]
                part = order[at : at + STEPS[min(step, len(STEPS) - 1)]]
                at, step = at + len(part), step + 1
                if not len(walking):
                    break
                scores = own[walking] @ m[part].T
                fits = (labels[part] == self.labels[walking, None]) == walk.same_label
                fits &= ids[part] != self.ids[walking, None]
                found = []
                for j in range(max(len(slots[a]) for a in walking)):
                    held = np.array([slots[a][j] if j < len(slots[a]) else -1 for a in walking])
                    x, y = np.nonzero(fits & (scores >= bar[held, None]) & (scores <= walk.most[held, None]) & (held >= 0)[:, None])
                    if len(x):
                        found.append((held[x], ids[part][y], scores[x, y].astype(np.int64)))
                if found:
                    best = _best(tuple(np.concatenate(c) for c in zip(best, *found, strict=True)), walk.k)
                    slot = best[0]
                    full = np.flatnonzero(np.diff(slot, prepend=-1, append=-1) != 0)
                    starts, ends = full[:-1], full[1:] - 1
                    whole = ends - starts + 1 == walk.k
                    bar[slot[starts[whole]]] = best[2][ends[whole]]
        return best


def _best(found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple:
    """The first ``k`` (slot, id, score) of each slot: higher scores first, ties by smaller id."""
    slot, ids, score = found
    order = np.lexsort((ids, -score, slot))
    slot, ids, score = slot[order], ids[order], score[order]
    starts = np.flatnonzero(np.diff(slot, prepend=-1) != 0)
    place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
    return slot[place < k], ids[place < k], score[place < k]


def _assigned(anchors: DataFrame, centre: np.ndarray) -> DataFrame:
    """Anchors with their nearest centre."""
    shared = anchors.sparkSession.sparkContext.broadcast(centre)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.argmax(_unit(_matrix(b, shared.value.shape[1]).astype(float)) @ shared.value.T, axis=1) if b.num_rows else np.empty(0)
            yield b.append_column("cluster", pa.array(near, pa.int32()))

    return anchors.mapInArrow(assign, "vec_id long, label long, v array<bigint>, size int, cluster int")


def _group(rows: pa.Table, centre: np.ndarray) -> Group:
    rows = rows.sort_by([("cluster", "ascending"), ("vec_id", "ascending")])
    m, norms, cluster = _matrix(rows, centre.shape[1]), _lengths(rows), rows.column("cluster").to_numpy()
    starts = np.flatnonzero(np.diff(cluster, prepend=-1) != 0)
    clusters = []
    for first, last in zip(starts, np.append(starts[1:], len(cluster)), strict=True):
        c = centre[cluster[first]]
        cosine = np.divide(m[first:last] @ c, norms[first:last], out=np.full(last - first, -1.0), where=norms[first:last] > 0)
        # a zero vector has no direction, its products are 0 anyway; the slack is for rounding
        cosine[norms[first:last] == 0] = 1.0
        clusters.append((int(first), int(last), c, float(np.arccos(np.clip(cosine, -1, 1)).max() + 1e-6)))
    return Group(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), m, norms, clusters)


def _walked(rows: DataFrame, group: Group, walk: Walk) -> DataFrame:
    """slot, id, score: what each task's rows contribute to the slots of a group."""
    shared = rows.sparkSession.sparkContext.broadcast((group, walk))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, walk = shared.value
        slot, ids, score = group.search(batches, walk)
        yield pa.RecordBatch.from_pydict({"slot": slot, "id": ids, "score": score})

    return rows.mapInArrow(search, "slot long, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each slot over all tasks; a task gives ``k`` rows a slot at most."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _groups(anchors: DataFrame, bytes_per_group: int) -> list[Column]:
    """Conditions that part the assigned anchors into groups of bounded size."""
    counts = anchors.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("numbers")).collect()  # a row per centre
    conditions: list[Column] = []
    together, held = [], 0
    for r in sorted(counts, key=lambda r: r["cluster"]):
        size = 8 * r["numbers"] + 64 * r["n"]
        parts = -(-2 * size // bytes_per_group) if size > bytes_per_group else 1
        if parts > 1:  # one large cluster, split by a hash of the id
            conditions += [(F.col("cluster") == r["cluster"]) & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p) for p in range(parts)]
            continue
        if held + size > bytes_per_group and together:
            conditions.append(F.col("cluster").isin(together))
            together, held = [], 0
        together.append(r["cluster"])
        held += size
    return conditions + ([F.col("cluster").isin(together)] if together else [])


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(embeddings: DataFrame, anchor_every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``anchor_every``.  An
    anchor's positives are its first ``positives`` rows of the same label and
    another id; for each of them the first ``negatives`` rows of another label
    whose score is from ``low`` to ``high`` percent of the positive's.  Higher
    scores come first, ties by smaller id.  Positives without such a row, and
    anchors without a positive, give no row.

    Rows that agree in id, label and vector count once; other rows of the same id
    are rows of their own (an anchor then gives the rows of each of them).
    Where vectors differ in length, the shorter one ends with zeros.  A zero
    vector scores 0 with all.  See :func:`prepared` for the rows that take no part.
    """
    spark = embeddings.sparkSession
    rows = stored(prepared(embeddings), "vectors")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    n = anchors.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    width = anchors.agg(F.max("size")).first()[0]
    drawn = anchors.where(F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(13)), 11) / F.lit(float(1 << 53)) < SAMPLE / n)
    sample = _matrix(drawn.select("vec_id", "v").orderBy("vec_id").toArrow(), width)  # about SAMPLE rows at any size
    centre = centres(sample, max(1, min(MOST_CENTRES, len(sample), len(sample) // MEMBERS))) if len(sample) else np.zeros((1, width))
    anchors = stored(_assigned(anchors.select("vec_id", "label", "v", "size"), centre), "anchors")

    results = []
    for condition in _groups(anchors, group_bytes):
        members = anchors.where(condition).toArrow()  # of bounded size
        if members.num_rows:  # a part of a split cluster may be empty
            results.append(_mined(rows, _group(members, centre), positives, negatives, low, high))
    return reduce(DataFrame.unionAll, results)


def _mined(rows: DataFrame, group: Group, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark, all_anchors, widest = rows.sparkSession, np.arange(len(group.ids)), np.iinfo(np.int64)
    everything = np.full(len(group.ids), widest.min), np.full(len(group.ids), widest.max)
    found = _first(_walked(rows, group, Walk(all_anchors, *everything, positives, True)), positives)
    # a few rows for each anchor of the group
    pairs = found.select("slot", "id", "score").toArrow().sort_by([("slot", "ascending"), ("score", "descending"), ("id", "ascending")])
    anchor, positive, score = (pairs.column(c).to_numpy() for c in ("slot", "id", "score"))
    # low * positive <= 100 * negative <= high * positive, in whole numbers
    least, most = -((-low * score) // 100), (high * score) // 100
    slots = pa.table({"slot": np.arange(len(anchor)), "anchor_id": group.ids[anchor], "positive_id": positive, "positive_score": score})
    lost = _first(_walked(rows, group, Walk(anchor, least, most, negatives, False)), negatives)
    lost = stored(lost.join(F.broadcast(spark.createDataFrame(slots)), "slot"), "negatives")  # a few rows for each anchor of the group
    return lost.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                       "positive_score", F.col("score").alias("negative_score"))
