"""Hard negatives against all pairs in plain Python, and the certificate of the walk."""

import math

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slate.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, seed, spread=0.3, width=12, directions=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(directions, width))
    near = centre[rng.integers(0, directions, n)] + spread * rng.normal(size=(n, width))
    length = rng.choice([0.1, 1.0, 1.0, 5.0], size=(n, 1))
    return (length * near / np.linalg.norm(near, axis=1, keepdims=True)).astype(np.float32)


def awkward():
    """Clusters, ties, repeats, zeros, junk, nulls, unequal widths."""
    rng = np.random.default_rng(3)
    v = vectors(600, 1)
    rows = [(i, v[i].tolist(), int(rng.integers(0, 4))) for i in range(600)]
    rows += [(i, v[0].tolist(), 2) for i in range(600, 660)]  # one vector sixty times
    rows += [(700, [0.0] * 12, 1), (750, [0.0] * 12, 0), (701, [0.0] * 12, 0), (702, [], 1), (800, [], 1)]
    rows += [(703, [float("nan")] * 12, 1), (704, [1.0, None], 1), (705, None, 1), (706, [float("inf")], 1), (708, v[3].tolist(), None), (None, v[3].tolist(), 1)]
    rows += [(709, v[5].tolist() + [1.0, 2.0], 1), (711, v[6].tolist()[:5], 2), (850, v[7].tolist()[:3], 1), (-50, v[8].tolist(), 3), (-7, (-v[9]).tolist(), 2)]
    return rows + rows[40:70] + rows[-3:]


@pytest.mark.parametrize("options", [{}, {"group_bytes": 400}, {"anchor_every": 3, "positives": 2, "negatives": 4, "low": 20, "high": 100}])
def test_equals_all_pairs(spark, monkeypatch, options):
    monkeypatch.setattr(hn, "MEMBERS", 3)
    rows = awkward()
    got = rows_of(hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), **options))
    plain = {"every": options.get("anchor_every", 50), **{k: v for k, v in options.items() if k in ("positives", "negatives", "low", "high")}}
    assert got == brute.hard_negatives([(i, label, [x for x in v] if v is not None else None) for i, v, label in
                                        [(i, np.array(v, np.float32).tolist() if v is not None and None not in v else v, x) for i, v, x in rows]], **plain)
    assert got


def group_of(v, labels, every, members):
    m = np.floor(256 * v.astype(float)).astype(np.int64)
    ids = np.arange(len(v))
    anchors = ids % every == 0
    centre = hn.centres(m[anchors], max(1, anchors.sum() // members))
    near = np.argmax(hn._unit(m[anchors].astype(float)) @ centre.T, axis=1)
    table = lambda keep, **more: pa.table({"vec_id": ids[keep], "label": labels[keep], "v": pa.array(m[keep].tolist(), pa.list_(pa.int64())), **more})
    return hn._group(table(anchors, cluster=pa.array(near, pa.int32())), centre), table(ids >= 0), m


@pytest.mark.parametrize("spread", [0.02, 0.3, 2.0])
def test_bounds_hold_for_every_member(spread):
    v = vectors(400, 5, spread)
    group, _, m = group_of(v, np.zeros(400, np.int64), 10, 4)
    lengths = np.linalg.norm(m, axis=1)
    for first, last, centre, widest in group.clusters:
        angle = np.arccos(np.clip(m @ centre / np.where(lengths > 0, lengths, 1), -1, 1))
        bound = lengths * np.cos(np.maximum(0, angle - widest))
        assert (group.m[first:last] @ m.T <= group.norms[first:last, None] * bound * (1 + 1e-9) + 1e-6).all()


def test_walks_end_before_the_list_does(monkeypatch):
    """In tight clusters most rows are never scored, and the result is that of all pairs."""
    v, labels = vectors(6000, 9, 0.02, directions=12), np.random.default_rng(1).integers(0, 2, 6000)
    group, table, m = group_of(v, labels, 100, 5)
    scored = []
    fits = hn._best
    monkeypatch.setattr(hn, "_best", fits)
    walk = hn.Walk(np.arange(len(group.ids)), np.full(len(group.ids), -2**62), np.full(len(group.ids), 2**62), 5, True)

    class Counting(np.ndarray):
        def __matmul__(self, other):
            scored.append(self.shape[0] * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    group.m = group.m.view(Counting)
    slot, ids, score = group.search(table.to_batches(), walk)
    own = np.asarray(group.m) @ m.T
    for k in range(len(group.ids)):
        fit = [(-own[k, j], j) for j in range(len(m)) if j != group.ids[k] and labels[j] == group.labels[k]]
        assert [(int(i), int(s)) for i, s in zip(ids[slot == k], score[slot == k], strict=True)] == [(j, -s) for s, j in sorted(fit)[:5]]
    assert sum(scored) < 0.5 * own.size


def test_rows_that_take_no_part(spark):
    rows = [(50, [1.0], 1), (51, [1.0], 1), (52, [0.8], 2), (53, [1e30], 2), (54, [float("-inf")], 2), (55, [None], 2)]
    got = rows_of(hn.hard_negatives(spark.createDataFrame(rows, SCHEMA)))
    assert got == [(50, 51, 1, 52, 256 * 256, 256 * math.floor(256 * float(np.float32(0.8))))]


def test_empty_tables_and_other_columns(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hn.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).collect() == []  # no anchor
    assert hn.hard_negatives(spark.createDataFrame([(50, [1.0], 1)], SCHEMA)).collect() == []  # no positive
    df = spark.createDataFrame(awkward()[:200], SCHEMA)
    more = df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(["v", "size", "slot", "id", "score", "cluster", "rank"])))
    assert rows_of(hn.hard_negatives(more)) == rows_of(hn.hard_negatives(df))


def test_long_vectors_stay_exact():
    """Products beyond 2^53 are counted in whole numbers."""
    big = np.array([[2**27, 1, 3], [2**27, 2, 1], [2**27 - 1, 0, 0]], np.int64)
    group = hn.Group(np.array([0]), np.array([1]), big[:1], np.linalg.norm(big[:1].astype(float), axis=1), [(0, 1, np.array([1.0, 0, 0]), 0.1)])
    rows = pa.RecordBatch.from_pydict({"vec_id": [1, 2], "label": [1, 1], "v": pa.array(big[1:].tolist(), pa.list_(pa.int64()))})
    walk = hn.Walk(np.array([0]), np.array([-2**62]), np.array([2**62]), 2, True)
    assert group.search([rows], walk)[2].tolist() == [2**54 + 2 + 3, 2**54 - 2**27]
