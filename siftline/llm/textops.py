"""Text pieces that several operators share, as SQL expressions and as bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Byte table that lower-cases A-Z and leaves every other byte (so all of UTF-8 beyond ASCII) alone.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does the same for texts without other characters and is faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009..U+000D; 0 for null.

    Padding both ends with a space makes the split give one empty string at each end.
    """
    return (F.size(F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), r"[\x20\x09-\x0D]+")) - 2).cast("long")
