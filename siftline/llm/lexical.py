"""Ranked lexical search by windowed bucket scoring.

Documents are tokenized once.  Postings of the terms that the queries hold are grouped by
fixed windows of WINDOW consecutive doc_ids; a window's lists are traversed term by term,
each list scatter-adds its weights into one array of the window's size (it fits a core's
cache) and ORs its bits into an occupancy bitset, and the occupied slots are harvested into
a heap of the best ``k`` documents of the query.  Heaps live as long as their task, so a
task hands on at most ``k`` documents a query; a window function merges them.

A text is read by the task that scans it and never shuffled: what moves are packed postings
(term number, slot, count) and the lengths.  Queries run in blocks of BLOCK_BYTES of query
text (one larger query is a block of its own): the terms of a block, never of the corpus, are
held by the driver and sent to the tasks.  Scores are 64-bit integers throughout, so that
partitioning cannot change them.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.scratch import stage

WINDOW, BLOCK_BYTES = 4096, 4 << 20
#: Window number of documents without an id; no id divided by WINDOW comes near it.
NO_ID = -(1 << 62)

#: Letters, digits and every byte beyond ASCII stay (A-Z lower-cased); the other 66 characters part terms.
_TERM_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased, in order."""
    return text.translate(_TERM_BYTES).split()


class _Held:
    """Documents of one window as a task has read them, until they are packed."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.term: list[int] = []
        self.slot: list[int] = []
        self.tf: list[int] = []

    def add(self, doc_id: int, length: int, counts: list[tuple[int, int]]) -> None:
        at = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(length)
        for term, tf in counts:
            self.term.append(term)
            self.slot.append(at)
            self.tf.append(tf)

    def packed(self) -> list[bytes]:
        term = np.array(self.term, np.int32)
        order = np.argsort(term, kind="stable")
        return [np.array(self.ids, np.int64).tobytes(), np.array(self.lengths, np.int64).tobytes(), term[order].tobytes(), np.array(self.slot, np.int16)[order].tobytes(), np.array(self.tf, np.int32)[order].tobytes()]


_POSTINGS = "window long, part long, n_docs long, n_terms long, ids binary, lengths binary, term binary, slot binary, tf binary"


def _index(number: dict[bytes, int], window: int):
    """Tokenize (id, text) rows and pack postings by window.

    An id that the task has seen before goes to another part of its window, keyed by the
    task, so that rows that repeat one id do not meet in one place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        task, extra = TaskContext.get().partitionId() + 1, 0
        for batch in batches:
            held: dict[tuple[int, int], _Held] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(terms(text)) if text else {}
                counts = [(number[w], tf) for w, tf in found.items() if w in number]
                again = doc_id is None or doc_id in seen
                key = (NO_ID if doc_id is None else doc_id // window, task * 65536 + extra if again else 0)
                seen.add(doc_id)
                mine = held.setdefault(key, _Held())
                mine.add(doc_id or 0, sum(found.values()), counts)
                if again and len(mine.ids) == window:
                    extra += 1
            rows = [[k[0], k[1], len(h.ids), sum(h.lengths), *h.packed()] for k, h in held.items()]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64], strict=True), [pa.int64()] * 4 + [pa.binary()] * 5, strict=True)], names=[f.split()[0] for f in _POSTINGS.split(", ")])

    return run


def _statistics(size: int):
    """One row for each term of the block that a task has met: its number and how many documents hold it.  Term -1: documents with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, some = np.zeros(size, np.int64), 0
        for batch in batches:
            for raw, lengths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                df += np.bincount(np.frombuffer(raw, np.int32), minlength=size)
                some += int((np.frombuffer(lengths, np.int64) > 0).sum())
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(df[met], some))], names=["term", "df"])

    return run


class _Windows:
    """Scores the windows that a task reads against all queries of a block."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, docs: int, total: int, k: int, window: int) -> None:
        self.queries, self.weight, self.docs, self.total, self.k = queries, weight, docs, total, k
        self.scores = np.zeros(window, np.int64)
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in queries]

    def score(self, known: bool, rows: list[tuple[bytes, ...]]) -> None:
        """``rows`` hold at most a window's size of documents."""
        ids, lengths = (np.concatenate([np.frombuffer(r[i], np.int64) for r in rows]) for i in (0, 1))
        first = np.cumsum([0, *(len(r[0]) // 8 for r in rows)])
        term, tf = (np.concatenate([np.frombuffer(r[i], np.int32) for r in rows]) for i in (2, 4))
        slot = np.concatenate([np.frombuffer(r[3], np.int16).astype(np.int64) + at for r, at in zip(rows, first, strict=False)])
        if not len(term):
            return
        order = np.argsort(term, kind="stable")
        term, slot, tf = term[order], slot[order], tf[order].astype(np.int64)
        m = 100 - 75 + (75 * lengths * self.docs) // self.total
        gain = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slot]))
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        lists = dict(zip(term[starts].tolist(), zip(starts.tolist(), np.r_[starts[1:], len(term)].tolist(), strict=True), strict=True))
        n = len(ids)
        bits: dict[int, np.ndarray] = {}
        for t, (a, b) in lists.items():
            flags = np.zeros(n, bool)
            flags[slot[a:b]] = True
            bits[t] = np.packbits(flags)
        scores = self.scores
        for q, (own, repeats) in enumerate(self.queries):
            occupied = np.zeros((n + 7) // 8, np.uint8)
            for t, r in zip(own.tolist(), repeats.tolist(), strict=True):
                if t in lists:
                    a, b = lists[t]
                    scores[slot[a:b]] += r * gain[a:b]
                    occupied |= bits[t]
            at = np.flatnonzero(np.unpackbits(occupied, count=n))
            if len(at):
                self.harvest(q, known, ids[at], scores[at])
                scores[at] = 0

    def harvest(self, q: int, known: bool, ids: np.ndarray, scores: np.ndarray) -> None:
        heap = self.heaps[q]
        keep = scores >= heap[0][0] if len(heap) == self.k else scores > 0
        ids, scores = ids[keep], scores[keep]
        for i in np.lexsort((ids, -scores))[: self.k].tolist():
            entry = (int(scores[i]), int(known), -int(ids[i]))
            if entry[0] <= 0:
                break
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _search(shared, k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight, docs, total = shared.value
        task = _Windows(queries, weight, docs, total, k, window)
        key, held, size = None, [], 0
        for batch in batches:
            for w, part, n, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (key != (w, part) or size + n > window):
                    task.score(key[0] != NO_ID, held)
                    held, size = [], 0
                key, size = (w, part), size + n
                held.append(row)
        if held:
            task.score(key[0] != NO_ID, held)
        found = [(q, score, -minus if known else None) for q, heap in enumerate(task.heaps) for score, known, minus in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["query", "score", "doc"])

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """(item, text) rows in order of item, in lists of at most ``block_bytes`` of text."""
    block, size = [], 0
    for r in items.orderBy("item", "text").toLocalIterator():
        n = len(r.text.encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.item, r.text))
        size += n
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", *, k: int = 10, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item.

    Terms, weights and scores are those of the module's contract (README, op11); equal scores
    go by ascending doc_id.  A null or empty text has no term, counts in no statistic and is
    never found; texts of any length are read whole.  Each row of ``docs`` is a document, so
    rows that repeat an id may be found each; rows without an id are found after all others of
    their score, with a null doc_id.  Equal rows of ``items`` are one query; other rows that
    repeat an item_id are queries of their own under that item_id.  An item without terms, or
    whose terms no document holds, gives no row, as does an item without id.  Other columns
    are ignored, whatever their names; empty tables give an empty result.
    """
    if not 0 < window <= 32768:
        raise ValueError("a window has 1 to 32768 documents")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(query_col).cast("string"), F.lit("")).alias("text")).where("item is not null").distinct()
    out = None
    for block in _blocks(asked, block_bytes):
        number: dict[bytes, int] = {}
        queries = []
        for _, text in block:
            found = Counter(number.setdefault(w, len(number)) for w in terms(text.encode()))
            queries.append((np.array(list(found), np.int64), np.array(list(found.values()), np.int64)))
        if not number:
            continue
        postings = stage(source.mapInArrow(_index(number, window), _POSTINGS), "postings")
        total = postings.agg(F.sum("n_terms")).first()[0] or 0
        counts = dict(postings.select("term", "lengths").mapInArrow(_statistics(len(number)), "term long, df long").groupBy("term").agg(F.sum("df")).collect())  # at most the terms of the block
        n = counts.pop(-1, 0)
        if not n:
            continue
        weight = np.zeros(len(number), np.int64)
        for t, df in counts.items():
            weight[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        shared = spark.sparkContext.broadcast((queries, weight, n, total))
        dealt = postings.drop("n_terms").repartition("window", "part").sortWithinPartitions("window", "part")
        best = dealt.mapInArrow(_search(shared, k, window), "query long, score long, doc long")
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "query long, item long")
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
        found = best.withColumn("rank", place).where(F.col("rank") <= k).join(names, "query").select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
