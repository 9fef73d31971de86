"""Content keys (F19): name-based UUID version 5 built from row values.

The key is SHA-1 over (name-space bytes || UTF-8 text), truncated to 128 bits
with the version nibble set to 5 and the RFC 4122 variant bits set, exactly as
Python's ``uuid.uuid5`` does.  Everything runs as built-in expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slate.constants import UUID_NAMESPACE_DNS


#: Decimal places that are tried by arithmetic, as powers of ten.
POWERS = [10.0**k for k in range(7)]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _short_decimal(a: Column, otherwise: Column) -> Column:
    """Text of a positive ``a`` that is a decimal of at most 15 digits, few of them behind the point; ``otherwise`` for all else.

    The fewest decimal places ``k`` are sought by arithmetic: ``a`` has them if
    the whole number next to ``a * 10^k`` divided by ``10^k`` gives ``a`` back.  Below
    10^15 both are exact, so the quotient is rounded as a reader would round the
    text, and no other decimal of at most 15 digits reads as the same number.
    """
    def fits(p: float) -> Column:
        return (a * p < 1e15) & (F.rint(a * p) / p == a)

    def text(k: Column) -> Column:
        digits = F.rint(a * F.get(F.lit(POWERS), k - 1)).cast("long").cast("string")
        padded = F.lpad(digits, F.greatest(F.length(digits), k), "0")
        whole = F.substring(padded, F.lit(1), F.length(padded) - k + 1)
        return F.when(k == 0, otherwise).when(k == 1, F.concat(digits, F.lit(".0"))).otherwise(
            F.concat(whole, F.lit("."), F.substring(padded, F.length(padded) - k + 2, k)))

    # place of the first power that fits, from 1; 0 if none does (what is beyond the first fit is not evaluated)
    place = reduce(lambda rest, i: F.when(fits(POWERS[i]), F.lit(i + 1)).otherwise(rest), reversed(range(len(POWERS))), F.lit(0))
    return let(F.when((a >= 1e-4) & (a < 1e15), place).otherwise(F.lit(0)), text)


def _searched_digits(x: Column) -> Column:
    """Text of any finite double: the fewest digits that read back as the same number, each tried once."""
    def sized(n: Column) -> Column:
        return F.call_function("format_string", F.concat(F.lit("%."), (n - 1).cast("string"), F.lit("e")), x)

    lengths = F.when(F.abs(x) < 2.2250738585072014e-308, F.sequence(F.lit(1), F.lit(17))).otherwise(F.array(F.lit(15), F.lit(16), F.lit(17)))
    exact = F.filter(F.transform(lengths, sized), lambda t: t.cast("double") == x)
    return let(F.element_at(exact, 1), lambda text: let(F.struct(
        F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")).alias("sign"),
        F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)e", 1), r"\.", ""), "(?<=.)0+$", "").alias("digits"),
        F.regexp_extract(text, r"e([+-]?\d+)$", 1).cast("int").alias("power")), _laid_out))


def _laid_out(t: Column) -> Column:
    """A number's text from its sign, digits and power of ten."""
    digits, power, n = t["digits"], t["power"], F.length(t["digits"])
    whole = F.when(n <= power + 1, F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    mantissa = F.when(n == 1, digits).otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n)))
    size = F.abs(power).cast("string")
    exponent = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
    return F.concat(t["sign"], F.when(power.between(0, 15), whole).when(power.between(-4, -1), small).otherwise(F.concat(mantissa, exponent)))


def double_text(col: Column) -> Column:
    """A double as Python's ``repr`` prints it.

    The digits are the fewest that read back as the same number: at most 15 for
    most data, found by arithmetic, else of 15, 16 or 17 (or of all lengths for
    the tiny numbers that have less precision).  They stand as a plain decimal
    for magnitudes from 1e-4 up to below 1e16, and in exponent form outside.
    """
    def text(x: Column) -> Column:
        positive = _short_decimal(x, _searched_digits(x))
        return (F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf"))
                .otherwise(positive))
    return let(col.cast("double"), text)


def value_text(col: Column, dtype: T.DataType) -> Column:
    """Text of one value as Python's ``str()`` prints it.

    NULL -> ``None``; booleans -> ``True``/``False``; integers and strings as is;
    dates ``YYYY-MM-DD``; timestamps ``YYYY-MM-DD HH:MM:SS`` and, if there are
    any, six digits of microseconds; doubles by :func:`double_text`.
    """
    if isinstance(dtype, T.BooleanType):
        text = F.when(col, F.lit("True")).otherwise(F.lit("False"))
    elif isinstance(dtype, T.DateType):
        text = F.date_format(col, "yyyy-MM-dd")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(col, "SSSSSS")
        text = F.concat(F.date_format(col, "yyyy-MM-dd HH:mm:ss"),
                        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = double_text(col)
    else:
        text = col.cast("string")
    return F.coalesce(F.when(col.isNotNull(), text), F.lit("None"))


def uuid5_from_text(text: Column, namespace: str = UUID_NAMESPACE_DNS) -> Column:
    """UUIDv5 of a text column under ``namespace`` (default: DNS)."""
    ns = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(ns, F.encode(text, "UTF-8")))

    def laid_out(h: Column) -> Column:
        # version nibble (hex position 13) -> 5; variant nibble (position 17) -> 8..b
        variant = F.lower(F.conv(
            ((F.conv(F.substring(h, 17, 1), 16, 10).cast("int")).bitwiseAND(F.lit(3))
             .bitwiseOR(F.lit(8))).cast("string"), 10, 16))
        return F.concat_ws(
            "-",
            F.substring(h, 1, 8),
            F.substring(h, 9, 4),
            F.concat(F.lit("5"), F.substring(h, 14, 3)),
            F.concat(variant, F.substring(h, 18, 3)),
            F.substring(h, 21, 12),
        )

    return let(digest, laid_out)


def content_key(
    df: DataFrame,
    ignore_cols: Iterable[str] = (),
    columns: Sequence[str] | None = None,
    separator: str = "",
) -> Column:
    """UUIDv5 (DNS) of the row's values, except ``ignore_cols``, concatenated.

    Values are joined in column order with ``separator`` (default none, as in
    the original helper), each rendered by :func:`value_text`.
    """
    ignore = set(ignore_cols)
    names = [c for c in (columns or df.columns) if c not in ignore]
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [value_text(F.col(n), types[n]) for n in names]
    return uuid5_from_text(F.concat_ws(separator, *parts))
