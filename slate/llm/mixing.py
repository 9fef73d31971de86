"""Mixing sources to target weights by iterative proportional fitting.

1. Each text's words are counted and its topic (its form) is read off; tokens
   are summed per cell (source, language, topic).  From here on only cells move:
   their number is the number of combinations that occur, not of documents.
2. Raking: cell weights are multiplied so that the weighted tokens meet the
   source targets, then the language targets, then the topic targets, until
   no weight moves by more than ``TOLERANCE``.  A sweep is three window sums
   over the cells, written to the shared folder.
3. Weights become probabilities min(1, scale * weight); the scale is raised
   until the expected tokens meet the budget, as cells reach probability 1.
4. A document is drawn if a hash of its id and text, as a number in [0, 1), is
   below its cell's probability.

Targets default to the marginals of one table: the cells' tokens, flattened by a
power below 1 (large cells give up tokens to small ones) and raked to the targets
that are given.  As marginals of one table they agree with each other, so the
sweeps can meet them without driving a cell to 0.  Given targets may still
contradict each other; what the sweeps do not meet is reported as a warning.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.llm.common import SPACE, stored, whole_row

DIMENSIONS = ("source", "lang", "topic")
FLATTEN = 0.7
BUDGET = 0.8
SWEEPS, TOLERANCE = 40, 1e-6
#: A share further from its target than this after the sweeps is reported.
MISSED = 1e-3
#: Cells that may be sent to all executors; more are joined by shuffle.
BROADCAST_CELLS = 200_000


def n_tokens(text: Column) -> Column:
    """Words between white space; a null or empty text has none."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def topic(text: Column) -> Column:
    """What a text is: a table, a licence, contact data, settings, or else prose by its length."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(text.rlike(r"\|[^|\n]*\|[^|\n]*\|"), "table").when(text.rlike("(?i)licen[sc]ed? under"), "licence")
            .when(text.rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.|\+[0-9][0-9 ().-]{7}"), "contact")
            .when(text.rlike(r"[A-Za-z_]\x20?=\x20?[\"'A-Za-z0-9]"), "settings")
            .when(F.length(text) < 500, "note").otherwise("prose"))


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "lang", topic(F.col("text")).alias("topic"), n_tokens(F.col("text")).alias("n_tokens"),
                       F.xxhash64("text").alias("text_hash"))


def _swept(cells: DataFrame, dimensions: list[str], total: float) -> DataFrame:
    """``cells`` (with a target column for each of ``dimensions``), its ``weight`` raked to the targets."""
    out = stored(cells, "cells")
    for _ in range(SWEEPS if dimensions else 0):
        before = out
        for d in dimensions:
            mass = F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(d))
            out = out.withColumn("weight", F.when(mass > 0, F.round(F.col("weight") * F.col(f"{d}_target") * F.lit(total) / mass, 10)).otherwise(0.0))
        out = stored(out, "cells")
        moved = out.select(*DIMENSIONS, F.col("weight").alias("now")).join(
            before.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), F.col("weight").alias("was")),
            [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS])
        if (moved.agg(F.max(F.abs(F.col("now") - F.col("was")))).first()[0] or 0.0) <= TOLERANCE:
            break
    return out


def _missed(cells: DataFrame, dimensions: list[str]) -> list[tuple[str, float]]:
    """Dimensions of which a value's weighted share is not its target, and by how much at most."""
    mass = F.sum(F.col("weight") * F.col("tokens"))
    out = []
    for d in dimensions:
        shares = cells.groupBy(d).agg(mass.alias("mass"), F.max(f"{d}_target").alias("target"))
        sums = shares.agg(F.sum("mass"), F.sum("target")).first()
        if sums[0] and sums[1]:
            gap = shares.agg(F.max(F.abs(F.col("mass") / F.lit(sums[0]) - F.col("target") / F.lit(sums[1])))).first()[0]
        else:
            gap = 1.0 if sums[1] else 0.0
        if gap > MISSED:
            out.append((d, gap))
    return out


def raked(cells: DataFrame, targets: dict[str, DataFrame] | None = None, flatten: float = FLATTEN) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``.

    ``targets`` may give, per dimension, a frame (that dimension's column,
    target): shares of all tokens.  Values without a target keep weight 0.
    Targets that the sweeps do not meet, as they contradict each other, give a
    ``RuntimeWarning`` with the dimensions and the largest gap.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    given = [d for d in DIMENSIONS if targets and d in targets]
    flat = cells.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(flatten - 1))).otherwise(0.0))
    for d in given:
        t = targets[d].select(F.col(d).alias("_v"), F.col("target").alias(f"{d}_target"))
        flat = flat.join(t, F.col(d).eqNullSafe(F.col("_v")), "left").drop("_v").fillna(0.0, [f"{d}_target"])
    out = _swept(flat, given, total)
    mass = F.col("weight") * F.col("tokens")
    all_mass = out.agg(F.sum(mass)).first()[0] or 1.0
    for d in DIMENSIONS:
        if d not in given:
            out = out.withColumn(f"{d}_target", F.round(F.sum(mass).over(Window.partitionBy(d)) / F.lit(all_mass), 12))
    out = _swept(out.withColumn("weight", F.lit(1.0)), list(DIMENSIONS), total)
    if missed := _missed(out, list(DIMENSIONS)):
        warnings.warn("mixing targets not met: " + ", ".join(f"{d} (by {gap:.4f})" for d, gap in missed), RuntimeWarning, stacklevel=2)
    return out.select(*DIMENSIONS, "tokens", "docs", "weight")


def with_probability(cells: DataFrame, budget: float) -> DataFrame:
    """Probabilities min(1, scale * weight) whose expected tokens are ``budget`` of all (less if weights of 0 forbid it)."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    scale = 0.0
    for _ in range(SWEEPS):
        full = F.col("weight") * F.lit(scale) >= 1
        r = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight") * F.col("tokens")))).first()
        new = round((budget * total - (r[0] or 0)) / r[1], 10) if r[1] else scale
        if new <= scale:
            break
        scale = new
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))


def cell_probabilities(rows: DataFrame, targets: dict[str, DataFrame] | None, budget: float) -> DataFrame:
    """source_, lang_, topic_, tokens, weight, probability of each cell of measured ``rows``."""
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    cells = stored(with_probability(raked(stored(cells, "cells"), targets), budget), "probabilities")
    out = cells.select(*(F.col(d).alias(f"{d}_") for d in DIMENSIONS), F.round("weight", 8).alias("weight"),
                       F.when(F.col("tokens") > 0, F.round("probability", 8)).otherwise(F.lit(1.0)).alias("probability"))
    return F.broadcast(out) if cells.count() <= BROADCAST_CELLS else out


def _same_cell() -> list[Column]:
    return [F.col(d).eqNullSafe(F.col(f"{d}_")) for d in DIMENSIONS]


def _drawn() -> Column:
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(6)), 11) / F.lit(float(1 << 53))
    return draw < F.col("probability")


def mixture(docs: DataFrame, *, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, n_tokens, text_hash, weight, probability, sampled.

    Null sources and languages are values like any other.  A cell without a
    token (only null or empty texts) has probability 1.  Repeated rows are drawn
    together.  An empty table gives an empty result.
    """
    rows = stored(measured(docs), "tokens")
    rows = rows.join(cell_probabilities(rows, targets, budget), _same_cell(), "left")
    return rows.select("doc_id", *DIMENSIONS, "n_tokens", "text_hash", "weight", "probability", _drawn().alias("sampled"))


def sample(docs: DataFrame, *, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` that ``mixture`` samples, without a shuffle of texts."""
    cells = cell_probabilities(stored(measured(docs), "tokens"), targets, budget)
    rows = docs.select(whole_row(docs).alias("row"), docs["doc_id"], docs["source"], docs["lang"],
                       topic(docs["text"]).alias("topic"), F.xxhash64(docs["text"]).alias("text_hash"))
    return rows.join(cells, _same_cell(), "left").where(_drawn()).select("row.*")
