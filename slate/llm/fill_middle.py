"""Fill-in-the-middle transformation as a pyarrow.compute pipeline.

Each text is cut into lines.  Two cut points, drawn by a hash of the row's id,
part the lines into prefix, middle and suffix, which are put together again with
a mark before each: suffix first (``spm``) or prefix first (``psm``).

A batch of whole texts is worked on column by column: split into a list array of
lines, flatten it with the index of each line's text, number the lines within
their text, filter them by role, rebuild one list array per role from the
counts, and join each list and then the pieces with ``binary_join``.  Nothing is
shuffled, and a batch is all that a task holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are transformed, and of these the percent with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the hash of ``seed:doc_id`` (a null id is no text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def lines(texts: pa.Array) -> pa.ListArray:
    """List of each text's lines, each with its line end; an empty text has none."""
    pieces = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(pieces)
    flat, parent = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
    last = pc.equal(_ordinals(counts, parent), pc.subtract(pc.take(counts, parent), 1))
    flat = pc.binary_join_element_wise(flat, pc.if_else(last, "", "\n"), "")
    # what follows the last line end is a line only if it has a character
    real = pc.not_equal(flat, "")
    ended = pc.or_(pc.ends_with(texts, "\n"), pc.equal(texts, ""))
    return _rebuilt(pc.subtract(counts, pc.cast(ended, pa.int32())), pc.filter(flat, real))


def _ordinals(counts: pa.Array, parent: pa.Array) -> pa.Array:
    """Place (from 0) of each flattened element in its own list."""
    first = pc.subtract(pc.cumulative_sum(pc.cast(counts, pa.int64())), counts)
    return pc.subtract(pa.array(range(len(parent)), pa.int64()), pc.take(first, parent))


def _rebuilt(counts: pa.Array, flat: pa.Array) -> pa.ListArray:
    """List array of ``flat`` with ``counts`` elements per list."""
    ends = pc.cumulative_sum(pc.cast(counts, pa.int32()))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), flat)


def transform_batch(texts: pa.Array, draws: list[pa.Array], rate: int, suffix_first: int) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch without nulls."""
    units = lines(texts)
    n = pc.cast(pc.list_value_length(units), pa.int64())
    cuts = [_modulo(h, pc.add(n, 1)) for h in draws[:2]]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)

    marked = pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))
    out = pc.greater_equal(_modulo(draws[2], 100), rate)
    plain = pc.or_(pc.or_(pc.equal(texts, ""), marked), out)
    spm = pc.less(_modulo(draws[3], 100), suffix_first)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))

    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    place = _ordinals(n, parent)
    after_low, after_high = (pc.greater_equal(place, pc.take(x, parent)) for x in (low, high))
    roles = [(pc.invert(after_low), low), (pc.and_(after_low, pc.invert(after_high)), pc.subtract(high, low)), (after_high, pc.subtract(n, high))]
    prefix, middle, suffix = (pc.binary_join(_rebuilt(count, pc.filter(flat, role)), "") for role, count in roles)

    psm_text = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm_text = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
    return {"n": n, "form": form, "prefix_chars": chars[0], "middle_chars": chars[1],
            "output": pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text))}


def _modulo(x: pa.Array, by) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (lines), form, prefix_chars, middle_chars, output.

    ``form`` is ``psm``, ``spm`` or ``plain``.  Plain texts stay as they are and
    have no piece lengths: the empty ones (a null text counts as empty), those
    that hold a mark themselves, and those the rate leaves out.  Rows with the
    same id draw the same numbers; a null id draws those of the bare seed.  Other
    columns of ``docs`` are not read.
    """
    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), *_draws(docs["doc_id"], seed))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def transformed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.string())
            made = transform_batch(texts, [b.column(f"h{k}") for k in (1, 2, 3, 4)], rate, suffix_first)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made.values()], ["doc_id", *made])

    return rows.mapInArrow(transformed, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A transformed text held no mark, and none can arise where pieces meet (each
    begins with the only ``<`` in it), so the marks found are the ones set.
    """
    def between(text: Column, start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(text, end, 1), start, -1)

    first, second = between(output, PREFIX, SUFFIX), between(output, PREFIX, MIDDLE)
    middle = F.substring_index(output, MIDDLE, -1)
    return F.when(form == "psm", F.concat(first, middle, between(output, SUFFIX, MIDDLE))).when(
        form == "spm", F.concat(second, middle, between(output, SUFFIX, PREFIX))).otherwise(output)


def report(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of the output and of the text rebuilt from it."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs, rate, suffix_first, seed).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
