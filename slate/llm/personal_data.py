"""Personal data: fixed patterns as seeds, and identifiers that bootstrapped contexts discover.

1. Four patterns (email, ip, card, phone) find the seed entities.  Each is a
   form of the stated pattern that cannot backtrack, with the same matches.
   Offsets come from the lengths of the texts between matches.
2. Every seed entity is an instance, whatever its characters, and so is every
   other token that touches none and has a digit or looks like an address (a
   letter after ``@``, or letters joined by a dot or underscore).  An instance's
   pattern is the two words before it (digits folded to 9).  Seeds score 1.
3. Spark scores the pattern-instance graph in rounds: a pattern's confidence is
   the mean score of its distinct instances, if at least ``LEAST_SEEDS`` of them
   are seeds; an instance that is no seed scores one minus the chance that all
   its confident patterns are wrong.  Only distinct edges move, counted before
   the shuffle, so a hot pattern is one row per task.
4. Tokens of ``LEAST_LENGTH`` characters whose score reaches ``CONFIDENT`` after
   a pattern of that confidence are reported as ``context``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.llm.common import let, stored

KINDS = ("email", "ip", "card", "phone", "context")
PATTERNS = {
    # a run of local characters is entered at its start, or where the last match ended
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = (r"(?<![A-Za-z0-9@._%+/-])(?=[A-Za-z@._%+/-]*+[0-9]|[A-Za-z@._%+/-]*(?:@|[A-Za-z][._])[A-Za-z])"
         r"[A-Za-z0-9@._%+/-]++")
#: Texts without this cannot match; saves the search.
HAS_TOKEN = r"[0-9]|@[A-Za-z]|[A-Za-z][._][A-Za-z]"
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
ROUNDS = 3
BLOCK = 256  # matches that are placed in a text at a time
BEFORE = 60  # characters ahead of a match that its context is read from
CONFIDENT, LEAST_SEEDS, LEAST_LENGTH = 0.8, 3, 6


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found, before) of all matches, in code points; before: up to ``BEFORE`` characters of the text ahead of it."""
    def last(text: Column) -> Column:
        return F.right(text, F.lit(BEFORE))

    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), last(p).alias("tail")))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def length(x: Column) -> Column:
        return x["p"]["n"] + F.length(x["f"])

    def block(both: Column, i: Column) -> Column:
        return F.slice(both, i * BLOCK + 1, F.lit(BLOCK))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["p"]["n"]
        end = begin + F.length(x["f"])
        before = last(F.concat(acc["tail"], x["p"]["tail"]))
        return F.struct(end.alias("at"), last(F.concat(before, x["f"])).alias("tail"), F.concat(acc["out"], F.array(F.struct(
            begin.alias("start"), end.alias("end"), x["f"].alias("found"), before.alias("before")))).alias("out"))

    def tail(both: Column, i: Column) -> Column:
        """The text ahead of a block; no match is empty, so the last ``BEFORE`` matches hold enough of it."""
        near = F.slice(both, F.greatest(i * BLOCK - BEFORE, F.lit(0)) + 1, F.least(i * BLOCK, F.lit(BEFORE)))
        return last(F.array_join(F.transform(near, lambda x: F.concat(x["p"]["tail"], x["f"])), ""))

    def placed(both: Column) -> Column:
        """Running sums by blocks: an array grows by at most a block at a time, so long texts stay linear."""
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(both) - 1, F.lit(0)) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda i: F.aggregate(block(both, i), F.lit(0), lambda a, x: a + length(x)))
        starts = let(sums, lambda s: F.aggregate(s, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
        none = F.array().cast("array<struct<start:int,end:int,found:string,before:string>>")
        return let(starts, lambda at: F.flatten(F.transform(blocks, lambda i: F.aggregate(
            block(both, i), F.struct(F.get(at, i).alias("at"), tail(both, i).alias("tail"), none.alias("out")), add)["out"])))

    pairs = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda f, p: F.struct(f.alias("f"), p.alias("p")))
    return let(pairs, placed)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(found, r"\."), lambda p: (F.length(part(p)) == 0) | (
            (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255")))
    if kind == "card":
        return F.length(_digits(found)).between(12, 19) & _luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _context(before: Column) -> Column:
    """The two words before a token, digits folded to 9."""
    return F.regexp_replace(F.regexp_extract(F.btrim(F.lower(before), F.lit(" \t\n\x0b\f\r")), r"(\S*\s*\S*?)[\s\"'(\[<]*$", 1), "[0-9]+", "9")


def _seeds(text: Column) -> Column:
    """Sorted array of (start, kind number, end, instance, pattern) by the fixed patterns."""
    def of(kind: str) -> Column:
        none = F.array().cast("array<struct<start:int,kind:int,end:int,instance:string,pattern:string>>")
        found = F.transform(F.filter(_matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["found"])), lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"),
            m["found"].alias("instance"), _context(m["before"]).alias("pattern")))
        return F.when(text.rlike(GATES[kind]), found).otherwise(none)

    return F.sort_array(F.concat(*(of(k) for k in PATTERNS)))


def _touching(kinds: Column, start: Column, end: Column) -> Column:
    """Whether a seed overlaps [start, end): of each kind, the last one that starts ahead of ``end``, found by bisection.

    Seeds of one kind are sorted and do not overlap, so that one also ends last.
    """
    def ahead(k: Column) -> Column:
        return F.aggregate(k["halves"], F.lit(0), lambda n, half: F.when(F.get(k["spans"], n + half - 1)["start"] < end, n + half).otherwise(n))

    return F.exists(kinds, lambda k: F.coalesce(F.get(k["spans"], ahead(k) - 1)["end"] > start, F.lit(False)))


def _instances(text: Column, seeds: Column) -> Column:
    """Seeds, and the tokens that touch none: start, end, instance, pattern, and whether it is a seed."""
    def of(kind: int) -> Column:
        halves = F.filter(F.array(*(F.lit(1 << b) for b in range(30, -1, -1))), lambda half: half <= F.size(F.filter(seeds, lambda s: s["kind"] == kind)))
        return F.struct(F.filter(seeds, lambda s: s["kind"] == kind).alias("spans"), halves.alias("halves"))

    def instance(x: Column, seed: bool) -> Column:
        return F.struct(*(x[c].alias(c) for c in ("start", "end", "instance", "pattern")), F.lit(seed).alias("seed"))

    none = F.array().cast("array<struct<start:int,end:int,instance:string,pattern:string,seed:boolean>>")
    tokens = F.transform(_matches(text, TOKEN), lambda m: let(F.rtrim(m["found"], F.lit("._%+/-@")), lambda t: F.struct(
        m["start"].alias("start"), (m["start"] + F.length(t)).alias("end"), t.alias("instance"),
        _context(m["before"]).alias("pattern"))))
    others = let(F.array(*map(of, range(len(PATTERNS)))), lambda kinds: F.filter(
        tokens, lambda t: (t["end"] > t["start"]) & ~_touching(kinds, t["start"], t["end"])))
    return F.concat(F.transform(seeds, lambda s: instance(s, True)),
                    F.when(text.rlike(HAS_TOKEN), F.transform(others, lambda t: instance(t, False))).otherwise(none))


def entities(docs: DataFrame) -> DataFrame:
    """row (a number), doc_id, text_hash, spans (fixed patterns) and instances, for each row of ``docs``; written to the shared folder."""
    both = let(F.coalesce(F.col("text"), F.lit("")), lambda t: let(_seeds(t), lambda s: F.struct(
        F.transform(s, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "kind", "end")))).alias("spans"),
        _instances(t, s).alias("instances"))))
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), both.alias("b")).select(
        "row", "doc_id", "text_hash", "b.spans", "b.instances"), "entities")


def confident_contexts(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of instances (instance, score) and of patterns (pattern, confidence) from rows (instance, pattern, seed)."""
    edges = stored(instances.where("pattern != ''").groupBy("instance", "pattern").agg(F.max("seed").alias("seed")), "edges")
    scores = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(ROUNDS):
        patterns = stored(edges.join(scores, "instance").groupBy("pattern").agg(
            F.round(F.avg("score"), 9).alias("confidence"), F.sum((F.col("score") >= CONFIDENT).cast("long")).alias("good"))
            .where(f"good >= {LEAST_SEEDS}").select("pattern", "confidence"), "patterns")
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("confidence", F.lit(0.0)), F.lit(1e-9)))))
        scores = stored(edges.join(patterns, "pattern", "left").groupBy("instance").agg(
            F.when(F.max("seed"), F.lit(1.0)).otherwise(F.round(1 - wrong, 9)).alias("score")), "scores")
    return scores, patterns


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, base and spans, arrays of (start, kind, end).

    Offsets are code points, ends exclusive; ``kind`` is a number in ``KINDS``.
    Null and empty texts have no spans.  Rows that repeat are judged one by one.
    """
    rows = entities(docs)
    key = ["row", "doc_id", "text_hash"]
    tokens = rows.select(*key, F.explode("instances").alias("i")).select(*key, "i.*")
    scores, patterns = confident_contexts(tokens.select("instance", "pattern", "seed"))
    new = (tokens.where(F.expr(f"not seed and length(instance) >= {LEAST_LENGTH}"))
           .join(scores.where(F.col("score") >= CONFIDENT).select("instance"), "instance")
           .join(patterns.where(F.col("confidence") >= CONFIDENT).select("pattern"), "pattern"))
    more = F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end")
    found = rows.select(*key, "spans", F.lit(None).cast("struct<start:int,kind:int,end:int>").alias("more")).unionByName(
        new.select(*key, F.lit(None).cast("array<struct<start:int,kind:int,end:int>>").alias("spans"), more.alias("more")))
    return found.groupBy(*key).agg(
        F.max("spans").alias("base"), F.collect_set("more").alias("more")).select(
        "doc_id", "text_hash", "base", F.sort_array(F.concat("base", "more")).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, one row per row of ``docs``."""
    names = F.lit(list(KINDS))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return find_personal_data(docs).select("doc_id", *map(count, range(4)), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
                                           joined("spans").alias("spans"))
