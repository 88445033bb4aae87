"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; no words for a null or blank text."""
    flat = F.translate(text_or_empty(text), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(flat, " "), "")


def crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; of no bytes where the text is null."""
    return F.crc32(F.encode(text_or_empty(text), "UTF-8"))


def spread(count: int, key: Column) -> Column:
    """0 to count - 1: equal slices of the order of the key's upper 63 bits, taken as unsigned."""
    width = float((1 << 63) // count + 1)
    return F.least(F.floor(order(key) / F.lit(width)), F.lit(count - 1)).cast("int")


def order(key: Column) -> Column:
    """A non-negative long in whose order spread() cuts its slices."""
    return F.shiftrightunsigned(key, 1)


#: Rows of a few longs up to which a table goes to every executor whole: about 100 MB there.
BROADCAST_ROWS = 1_000_000


def bounded_broadcast(rows: DataFrame) -> DataFrame:
    """A written table of narrow rows, hinted for broadcast where it has at most BROADCAST_ROWS; else joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
