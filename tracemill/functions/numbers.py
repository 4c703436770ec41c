"""Numbers of tracefiles as column expressions: unsigned and saturating 64-bit counts, lenient counts, markers, digests."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

U64_MAX = 18446744073709551615
I64_MAX = 9223372036854775807
NUMBER = "decimal(20,0)"


def u64(text: Column) -> Column:
    """ASCII digits up to 2^64-1, leading zeros allowed; null for anything else."""
    digits = F.regexp_replace(text, "^0+(?=[0-9])", "")
    value = F.when(text.rlike("^[0-9]+$") & (F.length(digits) <= 20), digits.try_cast(NUMBER))
    return F.when(value <= F.lit(Decimal(U64_MAX)).cast(NUMBER), value)


def saturated_sum(value: Column, limit: int = U64_MAX) -> Column:
    """sum() that stays at ``limit``; null if all values are. Counts aren't negative, so the order doesn't matter."""
    total, most = F.sum(value.cast("decimal(38,0)")), F.lit(Decimal(limit)).cast("decimal(38,0)")
    return F.when(total > most, most).otherwise(total).cast(NUMBER)


def lenient_count(text: Column) -> Column:
    """struct<value decimal(20,0), error string>: digits exact and saturated at 2^63-1, float spellings truncated.

    ``error`` is ``negative`` (value 0) or ``format`` (value null); ``-0`` is 0.
    """
    whole = text.rlike("^[+]?[0-9]+$")
    digits = F.regexp_replace(F.regexp_replace(text, "^[+]", ""), "^0+(?=[0-9])", "")
    limit = F.lit(I64_MAX).cast(NUMBER)
    exact = F.when(F.length(digits) > 19, limit).otherwise(F.least(digits.try_cast(NUMBER), limit))
    floating = text.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    number = text.try_cast("double")
    finite = floating & number.isNotNull() & (F.abs(number) <= F.lit(1.7976931348623157e308))
    truncated = F.when(number >= F.lit(9.223372036854775808e18), limit).otherwise(F.floor(number).cast(NUMBER))
    value = F.when(whole, exact).when(finite & (number <= 0), F.lit(0).cast(NUMBER)).when(finite, truncated)
    error = F.when(whole, F.lit(None).cast("string")).when(finite, F.when(number < 0, "negative")).otherwise("format")
    return F.struct(value.alias("value"), error.alias("error"))


def line_digest(text: Column) -> Column:
    """MD5 of a source line in base64 without padding, line end excluded."""
    return F.rtrim(F.base64(F.unhex(F.md5(F.regexp_replace(text, "[\r\n]+$", "")))), F.lit("="))


def bytes_view(text: Column) -> Column:
    """A string with one character per UTF-8 byte, for rules that count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def normalized_testcase(name: Column) -> Column:
    """The part before the first comma with every byte but ASCII letters, digits and ``_`` as ``_``; a suffix that begins with ``diff`` leaves ``,diff``."""
    trimmed = F.regexp_replace(name, "[ \\t-\\r]+$", "")
    clean = F.regexp_replace(bytes_view(F.substring_index(trimmed, ",", 1)), "[^A-Za-z0-9_]", "_")
    return F.when(trimmed.rlike("^[^,]*,diff"), F.concat(clean, F.lit(",diff"))).otherwise(clean)


def extension(path: Column) -> Column:
    """The extension of the last path part, case kept; none for names that only begin with a dot."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
