"""Word search without an index: tokens once per text, set tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def tokens(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z0-9]+")


def matches(words: Column, all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = ()) -> Column:
    """Every word of ``all_of``, one of ``any_of`` if given, none of ``none_of``."""
    ok = F.lit(True)
    for w in all_of:
        ok = ok & F.array_contains(words, w)
    if any_of:
        ok = ok & F.arrays_overlap(words, F.array(*map(F.lit, any_of)))
    for w in none_of:
        ok = ok & ~F.array_contains(words, w)
    return ok


def term_count(words: Column, terms: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*terms))).cast("long")
