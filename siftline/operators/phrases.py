"""Many phrases in many texts by one automaton (TXT-12..14, SCO-27).

Phrases become an Aho-Corasick automaton that reads each text once, however many phrases
there are.  Phrases come from a table and are taken in blocks of BLOCK_BYTES: the automaton of
a block is broadcast, its size has that bound, and their number has none.  Texts stay where
they are scanned; only hits or counts leave a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
# What makes a word where technologies are named; any other character parts them.
WORD_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+#._-")


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Automaton over phrases, each known by its number in the list."""
    a = ahocorasick.Automaton()
    for n, p in enumerate(phrases):
        a.add_word(p, n)
    a.make_automaton()
    return a


def lower_in_place(text: str) -> str:
    """Lower case, character by character, so that places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def whole_hits(a: ahocorasick.Automaton, phrases: list[str], low: str) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of every occurrence with no word character beside it."""
    for last, n in a.iter(low):
        start, end = last + 1 - len(phrases[n]), last + 1
        if (start == 0 or low[start - 1] not in WORD_CHARACTERS) and (end == len(low) or low[end] not in WORD_CHARACTERS):
            yield n, start, end


def longest_first(hits: list[tuple[int, int, int]], order: list[int]) -> list[tuple[int, int, int]]:
    """Occurrences that stay when longer phrases take their place in the text before shorter ones (``order``: rank of each phrase)."""
    taken: set[int] = set()
    kept = []
    for n, start, end in sorted(hits, key=lambda h: (order[h[0]], h[1])):
        if taken.isdisjoint(range(start, end)):
            taken.update(range(start, end))
            kept.append((n, start, end))
    return kept


def blocks(phrases: DataFrame, column: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """Distinct values of a column, not null and not empty, in lists of at most ``block_bytes`` (a longer one stands alone)."""
    block, size = [], 0
    for (p,) in phrases.select(column).where(F.col(column) != "").distinct().toLocalIterator():
        n = len(p.encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append(p)
        size += n
    if block:
        yield block


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, a = shared.value
        found: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found.update({n for _, n in a.iter(text)})
        yield pa.RecordBatch.from_arrays([pa.array([phrases[n] for n in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["phrase", "n"])

    return run


def _whole(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, a = shared.value
        for batch in batches:
            ids, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n in sorted({n for n, _, _ in whole_hits(a, phrases, lower_in_place(text or ""))}):
                    ids.append(i)
                    found.append(phrases[n])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.string())], names=["id", "phrase"])

    return run


def _over_blocks(texts: DataFrame, phrases: DataFrame, column: str, run, schema: str, block_bytes: int) -> DataFrame:
    out = None
    for block in blocks(phrases, column, block_bytes):
        shared = texts.sparkSession.sparkContext.broadcast((block, automaton(block)))
        found = texts.mapInArrow(run(shared), schema)
        out = found if out is None else out.unionAll(found)
    return texts.sparkSession.createDataFrame([], schema) if out is None else out


def phrase_counts(docs: DataFrame, phrases: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, n: in how many rows of ``docs`` (text) each phrase (item_id, phrase) occurs, case aside; phrases that occur nowhere have no row.

    Every row of ``docs`` counts once, whether or not ids repeat; null and empty phrases and texts are left out.
    """
    asked = phrases.select("item_id", F.lower("phrase").alias("phrase"))
    found = _over_blocks(docs.select(F.lower("text").alias("text")), asked, "phrase", _counts, "phrase string, n long", block_bytes)
    return asked.join(found.groupBy("phrase").agg(F.sum("n").alias("n")), "phrase").select("item_id", "n")


def whole_phrases(texts: DataFrame, phrases: DataFrame, column: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, phrase: the phrases (lower case) that stand in each text (id, text), case aside, with no word character beside them."""
    kind = texts.schema["id"].dataType.simpleString()
    return _over_blocks(texts.select("id", "text"), phrases, column, _whole, f"id {kind}, phrase string", block_bytes)
