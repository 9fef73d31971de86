"""Benchmark decontamination by winnowing.

Both sides are cut into words and every 5 consecutive words are hashed.  Of each
6 consecutive hashes the smallest (the first one, in a tie) is a fingerprint.
Six 5-word hashes are exactly a 10-word window, so two equal windows have the
same fingerprint at the same place: every shared span of 10 words is found, and
only one hash in 3.5 takes part in the join.  A fingerprint carries the hashes
around it; a hit is extended over all windows that chose this fingerprint by
comparing the first and second five words of the window.

A benchmark item of fewer than 10 words is one window of its own length; for the
lengths that occur (at most nine) documents give all runs of that length.

Most documents share nothing with the benchmark.  A Bloom filter of the
benchmark's fingerprints (64 bits each) reaches all tasks as one array, and a
document is winnowed and joined only if one of its hashes is in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.llm.common import let, stored
from slate.session import planned_bytes

WINDOW, GRAM = 10, 5
CHOSEN_FROM = WINDOW - GRAM + 1
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stored bytes of benchmark windows, or of ids of contaminated rows, that may be sent to all executors; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Longest filter, in numbers of 64 bits; a larger benchmark fills it more, and more documents are winnowed in vain.
MOST_FILTER_WORDS = 1 << 17
FILTER_BITS = 4


def _words(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), BETWEEN_WORDS), lambda w: w != "")


def _runs(words: Column, length: int) -> Column:
    """Hash of each run of ``length`` words."""
    return F.when(F.size(words) < length, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(words) - length + 1),
        lambda i: F.xxhash64(F.lit(length), *(F.element_at(words, i + j) for j in range(length)))))


def _chosen(hashes: Column) -> Column:
    """For each window (from 1) the place of its fingerprint."""
    return F.when(F.size(hashes) < CHOSEN_FROM, F.array().cast("array<int>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(hashes) - CHOSEN_FROM + 1),
        lambda i: let(F.slice(hashes, i, CHOSEN_FROM), lambda s: i + F.array_position(s, F.array_min(s)).cast("int") - 1)))


def _filter_bit(hash_: Column, k: int) -> Column:
    """The ``k``-th of the bits of its number that a hash sets in the filter."""
    return F.shiftrightunsigned(hash_, 40 + 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")


def _filter(windows: DataFrame, n: int) -> tuple[Column, int]:
    """The Bloom filter of all hashes of ``windows`` as one array of 64-bit numbers, and its length."""
    size = min(MOST_FILTER_WORDS, 1 << max(4, n.bit_length()))
    one = F.lit(1).cast("long")
    set_bits = windows.select(F.pmod("hash", F.lit(size)).alias("word"), F.explode(F.array(*(_filter_bit(F.col("hash"), k) for k in range(FILTER_BITS)))).alias("bit"))
    found = dict(set_bits.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", one, F.col("bit")))).collect())  # at most MOST_FILTER_WORDS
    # as one folded constant of the plan
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(size))), ",").cast("array<bigint>"), size


def _may_hold(numbers: Column, size: int, hash_: Column) -> Column:
    """False only if the benchmark does not have the hash."""
    number = F.get(numbers, F.pmod(hash_, F.lit(size)).cast("int"))
    bits = [F.call_function("shiftright", number, _filter_bit(hash_, k)).bitwiseAND(F.lit(1).cast("long")) == 1 for k in range(FILTER_BITS)]
    return reduce(lambda a, b: a & b, bits)


def _fingerprints(words: Column, may_hold) -> Column:
    """Array of (length, hash, at, first, around): windows first.. chose the hash at ``at``; ``around`` starts at ``first``.

    Only hashes that ``may_hold`` lets pass; none for a text without any.
    """
    def of(hashes: Column) -> Column:
        found = let(_chosen(hashes), lambda places: F.transform(
            F.filter(F.transform(places, lambda p, i: F.struct(p.alias("at"), (i + 1).alias("first"), F.get(places, i - 1).alias("last"))),
                     lambda x: (x["last"].isNull() | (x["last"] != x["at"])) & may_hold(F.element_at(hashes, x["at"]))),
            lambda x: F.struct(
                F.lit(WINDOW).alias("length"), F.element_at(hashes, x["at"]).alias("hash"), x["at"].alias("at"), x["first"].alias("first"),
                F.slice(hashes, x["first"], x["at"] - x["first"] + WINDOW).alias("around"))))
        return F.when(F.exists(hashes, may_hold), found)
    return F.coalesce(let(_runs(words, GRAM), of), F.array())


def _short_runs(words: Column, length: int, may_hold) -> Column:
    runs = F.transform(_runs(words, length), lambda h, i: F.struct(
        F.lit(length).alias("length"), h.alias("hash"), (i + 1).alias("at"), (i + 1).alias("first"), F.array(h).alias("around")))
    return F.filter(runs, lambda r: may_hold(r["hash"]))


def _benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """length, hash, offset, head, tail, item_id: every window of every item and where its fingerprint lies."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    long = items.where(F.size("words") >= WINDOW).select("item_id", F.explode(let(_runs(F.col("words"), GRAM), lambda h: F.transform(
        _chosen(h), lambda p, i: F.struct(
            F.lit(WINDOW).alias("length"), F.element_at(h, p).alias("hash"), (p - i - 1).alias("offset"),
            F.element_at(h, i + 1).alias("head"), F.element_at(h, i + 1 + GRAM).alias("tail"))))).alias("w"))
    short = items.where(F.size("words") < WINDOW)
    whole = F.coalesce(*(F.when(F.size("words") == n, F.element_at(_runs(F.col("words"), n), 1)) for n in range(1, WINDOW)))
    short = short.select("item_id", F.struct(
        F.size("words").alias("length"), whole.alias("hash"), F.lit(0).alias("offset"), whole.alias("head"),
        F.lit(None).cast("long").alias("tail")).alias("w"))
    return long.unionByName(short).select("w.*", "item_id").distinct()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, text_hash, n_words, spans and items.

    ``spans`` lists (start, end) of the windows found, in words; ``items`` the
    benchmark items that have one of them.
    """
    windows = stored(_benchmark_windows(benchmark), "benchmark-windows")
    # one small aggregate over the benchmark decides on lengths and on the filter's size
    facts = windows.groupBy("length").agg(F.approx_count_distinct("hash").alias("n")).collect()
    short = sorted(r["length"] for r in facts if r["length"] < WINDOW)
    numbers, size = _filter(windows, sum(r["n"] for r in facts))
    if planned_bytes(windows) <= BROADCAST_BYTES:
        windows = F.broadcast(windows)
    windows = windows.withColumnsRenamed({"length": "length_", "hash": "hash_"})

    nothing = F.struct(F.lit(0).alias("length"), F.lit(None).cast("long").alias("hash"), F.lit(0).alias("at"),
                       F.lit(0).alias("first"), F.array().cast("array<bigint>").alias("around"))
    def prints(words: Column, bloom: Column) -> Column:
        may_hold = lambda h: _may_hold(bloom, size, h)
        return F.concat(F.array(nothing), _fingerprints(words, may_hold), *(_short_runs(words, n, may_hold) for n in short))

    found = let(_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), prints(w, numbers).alias("prints")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), found.alias("f"))
    rows = rows.select("doc_id", "text_hash", "f.n_words", F.explode("f.prints").alias("p")).select("doc_id", "text_hash", "n_words", "p.*")

    start = F.col("at") - F.col("offset")  # the document window that would be the item's window
    place = start - F.col("first") + 1
    same = (F.col("length") == F.col("length_")) & (F.col("hash") == F.col("hash_")) & (place >= 1) & (
        F.get("around", place - 1) == F.col("head")) & (F.col("tail").isNull() | (F.get("around", place - 1 + GRAM) == F.col("tail")))
    rows = rows.join(windows, same, "left").where(F.col("length_").isNotNull() | (F.col("length") == 0))
    span = F.when(F.col("length_").isNotNull(), F.struct((start - 1).alias("start"), (start - 1 + F.col("length")).alias("end")))
    return rows.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(span)).alias("spans"),
        F.collect_set("item_id").alias("items"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row per distinct (doc_id, text).

    Null and empty texts have no words and are clean; a null item has no
    window; an item_id that repeats counts once.  Windows of items without an id are hits
    like any other; they are in no list of items.
    """
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"),
                              F.greatest(a["upto"], s["end"]).alias("upto")))["n"]
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return benchmark_hits(docs, benchmark).select(
        "doc_id", "text_hash", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs."""
    bad = stored(decontamination_report(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")), "contaminated")
    if planned_bytes(bad) <= BROADCAST_BYTES:
        bad = F.broadcast(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id_"]) & (F.xxhash64(docs["text"]) == bad["hash_"]), "left_anti")
