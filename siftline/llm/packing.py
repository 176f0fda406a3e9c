"""Packing documents into sequences of fixed capacity by harmonic classes.

A piece of length r belongs to class k = floor(capacity / r), and a sequence of class k
holds exactly k pieces.  Documents may be cut, so a document is cut into whole sequences
(class 1) and, for what is left, into pieces of length floor(capacity / k) until the last
piece wastes next to nothing in its class.  Which class a piece has depends on its document
alone, so each worker fills the sequences of each class by counting to k, without seeing
other workers:

1. every task tokenises its documents and fills sequences of each class; at its end fewer
   than k pieces of class k are left over;
2. the left-overs of TASKS tasks meet by class, and what those leave meets by class again;
   full sequences are made in the same way;
3. fewer than k pieces of each class remain, a bound that does not grow with the data; one
   task lays them out by first fit over decreasing lengths.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.scratch import stage

CAPACITY, SEPARATOR = 2048, 1
#: A remainder up to this length is not cut further.
SMALL = 128
#: A piece whose class wastes at most 1/SLACK of it is not cut further.
SLACK = 64
#: Tasks whose left-overs meet first, so that no class is one task's work however many tasks there are.
TASKS = 256

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int, ids binary"
_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("class", pa.int32()), ("ids", pa.binary())]

#: How a byte-level vocabulary parts a text (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs beyond what the faster encoder takes; its time or stack would grow with their length.
_LONG = re.compile(r"\s{200}|\S{20000}")
_encoders: dict[str, Encoder] = {}


def _byte_names() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: itself if it is visible, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Encoder:
    """Text -> ids of a byte-level vocabulary file of ``tokenizers``, as a uint32 array.

    Ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
    Ordinary texts are encoded by tiktoken from the same file's vocabulary, several times
    faster; texts with the string of a special token or with very long runs go to the
    tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        names, special = _byte_names(), set(self._special)
        ranks = {bytes(map(names.__getitem__, token)): i for token, i in self._tokenizer.get_vocab(with_added_tokens=True).items() if token not in special}
        self._fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(t in text for t in self._special) or _LONG.search(text):
            return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        return self._fast.encode_to_numpy(text, disallowed_special=())


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(length: int, capacity: int = CAPACITY, small: int = SMALL, slack: int = SLACK) -> list[tuple[int, int]]:
    """(piece length, class) of the pieces that a document of ``length`` ids is cut into."""
    pieces = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        full = capacity // k
        if rest <= small or (full - rest) * slack <= rest:
            pieces.append((rest, k))
            break
        pieces.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return pieces


class _Filler:
    """Counts pieces of each class into sequences; a row is a list in the order of SCHEMA."""

    def __init__(self, base: int) -> None:
        self.pending: dict[int, list[list]] = {}
        self.next = base
        self.done: list[list] = []

    def add(self, row: list, k: int) -> None:
        bin_ = self.pending.setdefault(k, [])
        bin_.append(row)
        if len(bin_) == k:
            self._close(bin_)
            self.pending[k] = []

    def _close(self, bin_: list[list]) -> None:
        at = 0
        for row in bin_:
            row[5], row[6] = self.next, at
            at += row[2]
        self.next += 1
        self.done += bin_

    def take(self) -> list[list]:
        out, self.done = self.done, []
        return out

    def left(self, mark: int) -> list[list]:
        """Rows without a sequence, which carry ``mark`` in its place."""
        out = [row for bin_ in self.pending.values() for row in bin_]
        for row in out:
            row[5] = mark
        self.pending = {}
        return out


def _batch(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in range(9)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], _FIELDS, strict=True))], names=["doc_id", *(n for n, _ in _FIELDS)])


def _tokenise(path: str, capacity: int, separator: int | None, with_ids: bool):
    end = b"" if separator is None else separator.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode, fill = encoder(path), _Filler(task << 36)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "").tobytes() + end
                total, at = len(ids) // 4, 0
                for length, k in cut(total, capacity):
                    piece = ids[4 * at : 4 * (at + length)]
                    fill.add([doc_id, at, length, zlib.crc32(piece), total, None, None, k, piece if with_ids else None], k)
                    at += length
                if len(fill.done) >= 20_000:
                    yield _batch(fill.take(), pa.int64())
        yield _batch(fill.take() + fill.left(-1 - task // TASKS), pa.int64())

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        yield from map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True))


def _by_class(last: bool):
    """Rows of a class and group of tasks (by class alone at last) are together; sequence ids are of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill, current = _Filler(0), None
        for row in _rows(batches):
            key = (row[7], -1 if last else row[5])
            if key != current:
                if current:
                    fill.done += fill.left(-1)
                current = key
                fill.next = (1 << 61) + (last << 60) + (key[0] << 48) + (-1 - key[1] << 36)
            fill.add(row, key[0])
            if len(fill.done) >= 20_000:
                yield _batch(fill.take(), pa.int64())
        yield _batch(fill.take() + fill.left(-1), pa.int64())

    return run


def _first_fit(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, free = sorted(_rows(batches), key=lambda r: -r[2]), []
        for row in rows:
            place = next((i for i, room in enumerate(free) if room >= row[2]), len(free))
            if place == len(free):
                free.append(capacity)
            row[5], row[6] = (1 << 62) + place, capacity - free[place]
            free[place] -= row[2]
        yield _batch(rows, pa.int64())

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY,
         separator: int | None = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class, ids.

    A document's ids are those of the vocabulary file and then ``separator`` (none if None).
    Null text is empty; an empty document is its separator alone, or no piece at all without
    one.  ``ids`` (little-endian uint32) is filled with ``with_ids``.  Repeated rows are
    packed each for itself.  An empty table gives an empty result.  Other columns of
    ``docs`` are ignored.  Ids must be integers; null ids are carried along.  A very long
    text is encoded in one task, in memory of a few times its size.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = stage(texts.mapInArrow(_tokenise(tokenizer_path, capacity, separator, with_ids), SCHEMA), "pack-pieces")
    order, open_, done = ["class", "doc_id", "start", "ids_crc32"], F.col("sequence_id") < 0, F.col("sequence_id") >= 0
    grouped = first.where(open_).repartition("class", "sequence_id").sortWithinPartitions("class", "sequence_id", *order[1:])
    second = stage(grouped.mapInArrow(_by_class(False), SCHEMA), "pack-groups")
    third = stage(second.where(open_).repartition("class").sortWithinPartitions(*order).mapInArrow(_by_class(True), SCHEMA), "pack-classes")
    tail = third.where(open_).coalesce(1).sortWithinPartitions(*order).mapInArrow(_first_fit(capacity), SCHEMA)
    return first.where(done).unionAll(second.where(done)).unionAll(third.where(done)).unionAll(tail)
