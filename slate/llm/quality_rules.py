"""Quality rules whose cut-offs come from the corpus: quantile sketches per language and source.

1. Word, line and repetition counts of each text, in one pass of array functions.
2. Each (language, source) summarises every measure by a log-linear histogram
   (``BITS`` leading bits of the value, so a quantile is right to a part in
   2**BITS).  Such sketches merge by adding counts: partial sums before the
   shuffle, languages from their sources, the corpus from its languages.  A hot
   source is no more than a row per bin and task.
3. The cut-off of a measure is its upper quartile plus ``SPREAD`` interquartile
   ranges plus a smallest step (so that a group in which nearly all texts
   measure 0 does not drop the first one that doesn't).  Groups of fewer than
   ``LEAST_DOCS`` rows take their language's sketch, or else the corpus's.
4. Cut-offs join the measured rows on language and source.

Everything but the regular expressions is integer arithmetic, so results do not
depend on the order of rows or tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.llm.common import SPACE, let, stored

WINDOW = 5
BITS = 5
SPREAD = 3
LEAST_DOCS = 200
#: Measure -> smallest step of its cut-off: symbols and repeated lines in
#: thousandths (of words and of lines with words), letters per word in hundredths.
STEPS = {"symbols": 100, "dup_lines": 500, "word_length": 500}
#: Cut-offs are a row per language and source; sent to all executors up to this many.
BROADCAST_GROUPS = 50_000


def _repeated(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more."""

    def positions(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ranked, lambda r: F.sort_array(F.transform(
            F.filter(r, lambda e, j: (F.get(r, j - 1)["h"] == e["h"]).eqNullSafe(F.lit(True))
                     | (F.get(r, j + 1)["h"] == e["h"]).eqNullSafe(F.lit(True))),
            lambda e: e["i"])))

    def covered(at: Column) -> Column:  # starts in order: each adds what the one before left open
        return F.aggregate(F.transform(at, lambda p, j: F.coalesce(F.least(p - F.get(at, j - 1), F.lit(WINDOW)), F.lit(WINDOW))),
                           F.lit(0).cast("long"), lambda a, x: a + x)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1),
                          lambda i: F.xxhash64(*(F.element_at(words, i + j) for j in range(WINDOW))))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(positions(h), covered))))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated(w).alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.select("doc_id", "lang", "source", counts.alias("c"), line_counts.alias("l"),
                      F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    out = out.select("doc_id", "lang", "source", "c.n_words", "c.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "c.n_repeat_words")
    return out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def _measures() -> Column:
    """Array of (measure, value); only for texts with words."""
    value = {"symbols": "n_symbols * 1000 div nullif(n_words, 0)", "dup_lines": "n_dup_lines * 1000 div nullif(n_lines, 0)",
             "word_length": "word_chars * 100 div nullif(n_words, 0)"}
    return F.expr("array(" + ", ".join(f"struct('{m}' as measure, {v} as value)" for m, v in value.items()) + ")")


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Cut-off parts per group and measure: n, q1, q3 from the merged bins."""
    bins = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    # bins per group and measure are bounded by the bin law (at most 64 << BITS)
    grouped = bins.groupBy(*by, "measure").agg(F.sum("n").alias("docs"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))

    def quantile(quarters: int) -> Column:
        cumulative = F.aggregate(
            "bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
            lambda acc, b: F.struct((acc["seen"] + b["n"]).alias("seen"),
                                    F.coalesce(acc["at"], F.when((acc["seen"] + b["n"]) * 4 >= F.col("docs") * quarters, b["bin"])).alias("at")))
        return cumulative["at"]

    return grouped.select(*by, "measure", "docs", quantile(1).alias("q1"), quantile(3).alias("q3"))


def cut_offs(rows: DataFrame) -> DataFrame:
    """lang, source and for each measure its limit; one row per language and source that has words."""
    sketch = (rows.where("not base_failed").select("lang", "source", F.explode(_measures()).alias("m")).select("lang", "source", "m.*")
              .withColumn("low", F.greatest(F.length(F.bin("value")) - BITS, F.lit(0)))
              .withColumn("bin", F.expr("shiftleft(shiftright(value, low), low)"))
              .groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n")))
    sketch = stored(sketch, "quantile-sketches")
    own, lang, corpus = (_quartiles(sketch, by) for by in (["lang", "source"], ["lang"], []))
    rename = lambda df, p: df.withColumnsRenamed({c: f"{p}_{c}" for c in df.columns})
    lang, corpus = rename(lang, "l"), rename(corpus, "c")
    out = (own.join(lang, own["lang"].eqNullSafe(lang["l_lang"]) & (own["measure"] == lang["l_measure"]))
           .join(F.broadcast(corpus), own["measure"] == corpus["c_measure"]))  # three rows
    pick = lambda q: F.expr(f"case when docs >= {LEAST_DOCS} then {q} when l_docs >= {LEAST_DOCS} then l_{q} else c_{q} end")
    step = F.element_at(F.create_map(*(F.lit(x) for kv in STEPS.items() for x in kv)), F.col("measure"))
    out = out.select("lang", "source", "measure", (pick("q3") + SPREAD * (pick("q3") - pick("q1")) + step).alias("limit"))
    return out.groupBy("lang", "source").pivot("measure", list(STEPS)).agg(F.first("limit")).withColumnsRenamed({m: f"{m}_limit" for m in STEPS})


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source) with its counts, limits and verdict.

    ``kept`` is false for a text that fails the base rules (fewer than 10 words,
    or over a fifth of its words in repeated 5-word windows) or exceeds a limit
    of its language and source.  Null texts have no words.  Null languages and
    sources are groups of their own.  An empty table gives an empty result.
    """
    rows = stored(measured(docs), "measures")
    limits = stored(cut_offs(rows), "limits").withColumnsRenamed({"lang": "lang_", "source": "source_"})
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    rows = rows.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    over = F.expr("n_symbols * 1000 div nullif(n_words, 0) > symbols_limit or n_dup_lines * 1000 div nullif(n_lines, 0) > dup_lines_limit "
                  "or word_chars * 100 div nullif(n_words, 0) > word_length_limit")
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~F.coalesce(over, F.lit(False)))
    return rows.withColumn("kept", kept).drop("lang_", "source_")
