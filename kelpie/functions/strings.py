"""Column functions: entropy over bytes, redaction, positions in a source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DOT = "•"
SHOWN = 4


def byte_values(c: Column) -> Column:
    """The UTF-8 bytes as two-digit hex strings."""
    return F.regexp_extract_all(F.hex(c.cast("binary")), F.lit(".."), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: in a lambda, what stands outside is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def byte_histogram(c: Column) -> Column:
    """array<struct<byte, n>>: how often each byte occurs, by sorting the bytes and telling where each begins."""

    def counted(ordered: Column) -> Column:
        marks = F.transform(ordered, lambda b, i: F.when((i == 0) | (F.get(ordered, i - 1) != b), i))
        return bound(F.filter(marks, lambda i: i.isNotNull()), lambda begins: F.transform(begins, lambda i, k: F.struct(F.get(ordered, i).alias("byte"), (F.coalesce(F.get(begins, k + 1), F.size(ordered)) - i).alias("n"))))

    return bound(F.array_sort(byte_values(c)), counted)


def shannon_entropy(c: Column) -> Column:
    """Bits per byte; 0 for the empty string, null for null."""
    n = F.octet_length(c).cast("double")
    counts = F.transform(byte_histogram(c), lambda h: h["n"].cast("double") / n)
    return F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def redact(c: Column) -> Column:
    """The first four bytes and a dot for each byte after them; four bytes or fewer are all dots.

    Where the fourth byte ends inside a character, the whole characters before it are shown.
    """
    n = F.octet_length(c)
    shown = F.when(F.octet_length(F.substring(c, 1, 4)) == SHOWN, F.substring(c, 1, 4))
    for k in (3, 2, 1):
        shown = F.coalesce(shown, F.when(F.octet_length(F.substring(c, 1, k)) <= SHOWN, F.substring(c, 1, k)))
    shown = F.coalesce(shown, F.lit(""))
    return F.when(n <= SHOWN, F.repeat(F.lit(DOT), n)).otherwise(F.concat(shown, F.repeat(F.lit(DOT), n - F.octet_length(shown))))


def byte_prefix(source: Column, offset: Column) -> Column:
    """The first offset bytes of a source, as binary."""
    return F.substring(source.cast("binary"), F.lit(1), offset.cast("int"))


def latin_prefix(source: Column, offset: Column) -> Column:
    """The first offset bytes with one character for each byte."""
    return F.decode(byte_prefix(source, offset), "ISO-8859-1")


def line_of(source: Column, offset: Column) -> Column:
    """1-based line of a byte offset: the line feeds before it are what their removal takes from the length."""
    prefix = latin_prefix(source, offset)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def column_of(source: Column, offset: Column) -> Column:
    """1-based column, in bytes, of a byte offset."""
    return F.length(F.substring_index(latin_prefix(source, offset), "\n", -1)) + 1
