"""Removal of repeated byte strings across documents, decided by suffix arrays.

A byte of a document goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id.  To bring equal strings together without one suffix array of
everything, each string is filed under an anchor: the smallest hash among its ``gram``-byte
substrings.  An anchor lies at the same place in equal strings, so equal strings meet under
one anchor.  The strings filed under an anchor at a place follow one another; the bytes they
cover are its context, at most ``2 * length - gram`` of them.

1. anchors: every worker finds the anchors of its documents and folds equal (anchor,
   context) pairs to the smallest id before the shuffle, so that a passage that many
   documents share costs a row per batch;
2. by anchor: those seen in one document only are done.  Where several documents have one
   context, all strings in it are repeated, whatever the anchor's other contexts hold.
   Where an anchor has different contexts, their bytes are fetched, and a suffix array
   (``suffixes``, linear grouping) over the parts that may hold a common string (``related``)
   groups equal strings and gives each the smallest id.  The contexts of a crowded
   anchor are parted by what lies beside it (``sides``) first; where a part is still crowded,
   it is resolved batch by batch and equal strings of all batches are then folded;
3. a last pass over the texts keeps what is in a known context; the spans that follow are
   merged by document and cut out.

Bytes travel once for each context in doubt, and what is not shared is kept away from the
later shuffles by bitmaps whose size grows with what is shared, up to a bound.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.bitmaps import bitmap, with_maybe
from siftline.llm.runs import run_edges, whole_runs
from siftline.llm.scratch import discard, stage
from siftline.llm.simhash import _mixed
from siftline.llm.suffixes import suffix_array

LENGTH, GRAM = 50, 20
#: Bits of a bitmap of contexts: 16 MiB, and up to 64 MiB where there are more than 1 / PER_KEY keys a bit.
BITS, MOST_BITS, PER_KEY = 1 << 27, 1 << 29, 6
#: A bitmap is dealt out by pages; a key has up to MARKS bits, all in one page.
PAGE, MARKS = 1 << 15, 3
#: Bytes handled at once, so that the arrays stay in a core's cache; longer texts are cut into overlapping parts.
CHUNK = 1 << 17
#: Bytes of a batch's texts taken out of Arrow, and anchors folded, at once.
SLICE, FOLD = 1 << 21, 1 << 17
#: Open contexts under one anchor beyond which they are resolved batch by batch and no longer as one run.
CROWD = 4096
_STEP = np.uint64(0x100000001B3)
_STEP32 = np.uint32(0x01000193)


def _grams(values: np.ndarray, size: int) -> np.ndarray:
    """Mixed 32-bit polynomial hash of every run of ``size`` values."""
    parts, powers, n = {1: values}, {1: _STEP32}, 1
    with np.errstate(over="ignore"):
        while n * 2 <= size:
            parts[2 * n] = parts[n][:-n] * powers[n] + parts[n][n:]
            powers[2 * n] = powers[n] * powers[n]
            n *= 2
        out, have = parts[n], n
        for p in sorted(parts, reverse=True):
            while have + p <= size:
                m = len(values) - have - p + 1
                out = out[:m] * powers[p] + parts[p][have : have + m]
                have += p
        out = out * np.uint32(0x9E3779B1)
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x85EBCA77)
    return out ^ (out >> np.uint32(13))


def _slide(a: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over every ``width`` neighbours."""
    n = 1
    while n * 2 <= width:
        a = best(a[:-n], a[n:])
        n *= 2
    return best(a[: -(width - n)], a[width - n :]) if width > n else a


def _parts(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes, int, int]]]:
    """Groups of (row, offset, bytes, first, last): anchors at first <= place < last of the bytes are the row's own."""
    group, held = [], 0
    for row, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text), CHUNK):
            lo, hi = max(0, at - 2 * length), min(len(text), at + CHUNK + 2 * length)
            group.append((row, lo, text[lo:hi], at - lo, min(len(text), at + CHUNK) - lo))
            held += hi - lo
            if held >= CHUNK:
                yield group
                group, held = [], 0
    if group:
        yield group


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse; kept for the next call."""
    held = _powers_held
    if len(held[0]) < n:
        with np.errstate(over="ignore"):
            base = np.array([1], np.uint64), np.array([1], np.uint64)
            steps = (_STEP, np.uint64(pow(int(_STEP), -1, 1 << 64)))
            while len(base[0]) < n:
                base = tuple(np.concatenate([x, x * np.uint64(pow(int(step), len(x), 1 << 64))]) for x, step in zip(base, steps, strict=True))
        held[:] = base
    return held[0][:n], held[1][:n]


_powers_held: list[np.ndarray] = [np.array([1], np.uint64), np.array([1], np.uint64)]


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, context, row, place, first, last) arrays, some texts at a time.

    first to last are the places at which the strings filed under the anchor start; anchor
    is a hash of its bytes, context one of the bytes those strings cover and of where the
    anchor lies among them.  Of several equal smallest hashes in a string the first counts.
    """
    windows = length - gram + 1
    nowhere = np.uint32(0xFFFFFFFF)
    for group in _parts(texts, length):
        sizes = np.array([len(g[2]) for g in group])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        raw = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        h = _grams(raw.astype(np.uint32) + np.uint32(1), gram)
        ranked = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
        at = _slide(ranked, windows, np.minimum).astype(np.uint32)  # the place of the anchor, by first byte of a string
        for e in ends[:-1].tolist():
            at[e - length + 1 : e] = nowhere  # strings across two texts
        new = np.flatnonzero(at[1:] != at[:-1]) + 1
        first, last = np.concatenate([[0], new]), np.append(new, len(at)) - 1
        inside = at[first] != nowhere
        first, last = first[inside], last[inside]
        place = at[first].astype(np.int64)
        up, down = _powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            name = (sums[place + gram] - sums[place]) * down[place]
            name = _mixed(_mixed(name, np.uint64(gram)), np.uint64(1))
            context = (sums[last + length] - sums[first]) * down[first]
            context = _mixed(_mixed(context, (last - first).astype(np.uint64)), (place - first).astype(np.uint64))
        piece = np.searchsorted(starts, place, "right") - 1
        row, offset, own_first, own_last = (np.array([g[k] for g in group])[piece] for k in (0, 1, 3, 4))
        here = place - starts[piece]
        own = (here >= own_first) & (here < own_last)
        shift = (offset - starts[piece])[own]
        yield name[own].view(np.int64), context[own].view(np.int64), row[own], place[own] + shift, first[own] + shift, last[own] + shift


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about SLICE bytes of a binary column at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _fold(length: int, gram: int):
    """(anchor, context, doc, several) of a batch, one row for each anchor and context; several: in more than one document.

    Of a whole batch only anchors, contexts and ids are held; they are sorted and folded FOLD
    anchors at a time, by ranges of the anchor, so that equal pairs meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for some in _slices(batch, 1):
                ids = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                found += [(a, c, ids[row]) for a, c, row, *_ in anchors(some.column(1).to_pylist(), length, gram)]
            parts = 1 + sum(len(a) for a, _, _ in found) // FOLD
            part = [((a.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32) for a, _, _ in found]
            for k in range(parts):
                own = [np.flatnonzero(p == k) for p in part]
                a, c, doc = (np.concatenate([x[n][at] for x, at in zip(found, own, strict=True)] or [np.empty(0, np.int64)]) for n in range(3))
                if len(a):
                    yield _folded(a, c, doc)

    return run


def _folded(a: np.ndarray, c: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    both = _key_of(a, c)
    order = np.argsort(both)
    a, c, both, doc = a[order], c[order], both[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    # keys of two columns that collide are told apart by a slower sort
    if (np.maximum.reduceat(a, first) != np.minimum.reduceat(a, first)).any() or (np.maximum.reduceat(c, first) != np.minimum.reduceat(c, first)).any():
        order = np.lexsort((c, a))
        a, c, doc = a[order], c[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
    least, most = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(c[first]), pa.array(least), pa.array(most > least)], names=["anchor", "context", "doc", "several"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of anchors that more than one document has, folded; ``others`` counts the anchor's other contexts."""
    for a, c, doc, several in whole_runs(batches, 4):
        # rows are sorted by anchor, context, doc
        new_c = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        first = np.flatnonzero(new_c)
        top = np.maximum.reduceat(doc, first)
        more = np.logical_or.reduceat(several, first) | (top > doc[first])
        a, c, doc = a[first], c[first], doc[first]
        run = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        sizes = np.diff(np.append(run, len(a)))
        least, most = np.minimum.reduceat(doc, run), np.maximum.reduceat(doc, run)
        shared = np.repeat((least < most) | np.logical_or.reduceat(more, run), sizes)
        others = np.repeat(sizes - 1, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(a[shared]), pa.array(c[shared]), pa.array(doc[shared]), pa.array(more[shared]), pa.array(others[shared])], names=["anchor", "context", "doc", "several", "others"])


def _size_of(keys: int, bits: int, most: int) -> tuple[int, int]:
    """(bits, marks of a key) of a bitmap for so many keys, from ``bits`` to ``most`` bits."""
    while bits < min(PER_KEY * keys, most):
        bits *= 2
    return bits, max(1, min(MARKS, round(0.69 * bits / max(keys, 1))))


def _bitmap(rows: DataFrame, bits: int, marks: int) -> np.ndarray:
    """The bitmap of what the columns of ``rows`` hold, on the driver: ``bits`` / 8 bytes, whatever the number of rows."""
    pages = rows.mapInArrow(_dealt(bits), "page int, rest long").repartition("page").mapInArrow(_filled(bits, marks), "page int, bitmap binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in pages.collect():
        out[r.page * (PAGE // 8) : (r.page + 1) * (PAGE // 8)] = np.frombuffer(bytes(r.bitmap), np.uint8)
    return out


def _places(key: np.ndarray, mark: int) -> np.ndarray:
    """Where in its page a key has a bit."""
    return (key >> np.uint64(19 + 15 * mark) & np.uint64(PAGE - 1)).astype(np.int64)


def _pages(key: np.ndarray, bits: int) -> np.ndarray:
    return (key & np.uint64(bits // PAGE - 1)).astype(np.int64)


def _may_have(table: np.ndarray, key: np.ndarray, bits: int, marks: int) -> np.ndarray:
    """False where a key certainly is not in the bitmap."""
    at = _pages(key, bits) * PAGE
    test = lambda at, key, mark: (table[(p := at + _places(key, mark)) >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    hit = test(at, key, 0)
    for mark in range(1, marks):
        left = np.flatnonzero(hit)
        hit[left] = test(at[left], key[left], mark)
    return hit


def _key_of(*columns: np.ndarray) -> np.ndarray:
    h = np.full(len(columns[0]), 7, np.uint64)
    with np.errstate(over="ignore"):
        for x in columns:
            h = _mixed(h, x.view(np.uint64))
    return h


def _dealt(bits: int):
    """(page, rest) of the key of all columns; rest is the key, whose highest bits are the places in the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _key_of(*(c.to_numpy(zero_copy_only=False) for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(_pages(key, bits).astype(np.int32)), pa.array(key.view(np.int64))], names=["page", "rest"])

    return run


def _filled(bits: int, marks: int):
    """(page, bitmap): a task holds the pages dealt to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = PAGE // 8
        slot, table, used = np.full(bits // PAGE, -1, np.int64), np.zeros(0, np.uint8), 0
        for b in batches:
            page, key = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            new = np.unique(page[slot[page] < 0])
            slot[new] = np.arange(used, used + len(new))
            used += len(new)
            if used * size > len(table):
                table = np.concatenate([table, np.zeros(max(used * size - len(table), len(table) // 4), np.uint8)])
            for mark in range(marks):
                at = _places(key, mark)
                np.bitwise_or.at(table, slot[page] * size + (at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
        for page in np.flatnonzero(slot >= 0).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([table[slot[page] * size :][:size].tobytes()], pa.binary())], names=["page", "bitmap"])

    return run


def _among(table: Broadcast, bits: int, marks: int, wanted: bool):
    """Rows whose first column may be (or, if not ``wanted``, is not) in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = _may_have(table.value, _key_of(b.column(0).to_numpy(zero_copy_only=False)), bits, marks)
            yield b.filter(pa.array(hit == wanted))

    return run


_SEEN = "anchor long, context long, doc long, tag int, first int, width short"


def _occurrences(table, bits: int, marks: int, length: int, gram: int, with_bytes: bool):
    """Rows of _SEEN for (anchor, context) pairs that may be in the bitmap; with the context's bytes, once per batch, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table.value
        for batch in itertools.chain.from_iterable(_slices(b, 2) for b in batches):
            ids, tags, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            for found in anchors(texts, length, gram):
                key = _key_of(found[0], found[1])
                keep = _may_have(held, key, bits, marks)
                if with_bytes:  # one of equal contexts is enough
                    once = np.zeros(len(keep), bool)
                    once[np.unique(key, return_index=True)[1]] = True
                    keep &= once
                a, c, row, place, first, last = (x[keep] for x in found)
                columns = [pa.array(a), pa.array(c), pa.array(ids[row].astype(np.int64)), pa.array(tags[row].astype(np.int32)), pa.array(first.astype(np.int32)), pa.array((last - first).astype(np.int16))]
                names = ["anchor", "context", "doc", "tag", "first", "width"]
                if with_bytes:
                    piece = [texts[r][s : e + length] for r, s, e in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)]
                    columns, names = [*columns[:2], pa.array((place - first).astype(np.int16)), pa.array(piece, pa.binary())], ["anchor", "context", "left", "bytes"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def smallest_ids(contexts: list[bytes], docs: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context and each string of ``length`` bytes that starts in it, the smallest id among contexts with an equal string."""
    lengths = [len(c) for c in contexts]
    out = [np.full(max(0, n - length + 1), d, np.int64) for n, d in zip(lengths, docs, strict=True)]
    text, owner, offset = [], [], []
    separators = len(contexts)
    for i, c in enumerate(contexts):
        text += [b + separators for b in c]
        text.append(i)  # distinct, below all bytes
        owner += [i] * (len(c) + 1)
        offset += range(len(c) + 1)
    previous, group = None, []

    def close() -> None:
        if len(group) > 1:
            least = min(docs[i] for i, _ in group)
            for i, o in group:
                out[i][o] = min(out[i][o], least)

    for at in suffix_array(text):
        i, o = owner[at], offset[at]
        if o + length > lengths[i]:
            continue
        string = contexts[i][o : o + length]
        if string != previous:
            close()
            previous, group = string, []
        group.append((i, o))
    close()
    return out


def related(anchor: np.ndarray, left: np.ndarray, contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the part of each context that may hold strings of another context of its anchor; equal where there is none.

    Equal strings have equal hashes and the anchor at the same place, so contexts without a
    common hash share nothing.  What is let through is compared as bytes later.
    """
    sizes = np.array([len(c) for c in contexts])
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    up, down = _powers(len(raw) + 1)
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(sizes)), counts)
    begin = np.cumsum(counts) - counts
    place = np.arange(len(row)) - begin[row]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        x = at[row] + place
        key = _mixed((sums[x + length] - sums[x]) * down[x], anchor.view(np.uint64)[row])
        key = _mixed(key, (left[row] - place).astype(np.uint64))
    slot = key & np.uint64((1 << max(10, int(len(key)).bit_length() + 2)) - 1)
    twice = np.flatnonzero(np.bincount(slot.astype(np.int64))[slot.astype(np.int64)] > 1)
    few = key[twice]
    order = np.argsort(few)
    same = few[order][1:] == few[order][:-1]
    common = np.zeros(len(key), bool)
    common[twice[order[1:][same]]] = True
    common[twice[order[:-1][same]]] = True
    first = np.minimum.reduceat(np.where(common, place, 1 << 40), begin)
    last = np.maximum.reduceat(np.where(common, place, -length), begin)
    return np.where(last < 0, 0, first), last + length


def _solve(contexts: list[bytes], docs: list[int], spans: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(context, start, smallest ids) of the parts of contexts under one anchor; equal parts are one text of the suffix array."""
    parts: dict[bytes, list[int]] = {}
    for i, (s, e) in enumerate(spans):
        if e > s:
            parts.setdefault(contexts[i][s:e], []).append(i)
    least = [min(docs[i] for i in members) for members in parts.values()]
    if len(parts) > 1:
        told = smallest_ids(list(parts), least, length)
    else:
        told = [np.full(len(part) - length + 1, d, np.int64) for part, d in zip(parts, least, strict=True)]
    for members, ids in zip(parts.values(), told, strict=True):
        yield from ((i, spans[i][0], ids) for i in members)


_KNOWN = "anchor long, context long, least long, start int, ids binary"


def _known(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "context", "least", "start", "ids"])


#: Stands for the id that a row of bytes does not carry.
_NO_DOC = np.iinfo(np.int64).min


def _resolve(length: int):
    """_KNOWN rows of contexts under an anchor: the smallest id of each string of a part.

    Rows come sorted by anchor and context, those with a context's id beside those with its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, c, doc, left, raw in whole_runs(batches, 5):
            head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
            ends = np.append(head[1:], len(a)).tolist()
            doc, left = np.maximum.reduceat(doc, head), np.maximum.reduceat(left, head)
            # bytes without an id were let through by the bitmap alone
            ok = doc != _NO_DOC
            pieces = [max(raw[lo:hi], key=len) for lo, hi, use in zip(head.tolist(), ends, ok.tolist(), strict=True) if use]
            a, c, doc, left = a[head][ok], c[head][ok], doc[ok], left[ok]
            yield _known([(a[i], c[i], doc[i], start, ids) for i, start, ids in _answers(a, left, doc, pieces, length)])

    return run


def _answers(run: np.ndarray, left: np.ndarray, doc: np.ndarray, contexts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, start, smallest ids) for contexts sorted by run, where an id is smaller than the context's own."""
    if not len(run):
        return
    start, end = related(run, left, contexts, length)
    edges = run_edges(run)
    some = np.maximum.reduceat(end - start, edges[:-1]) > 0
    for lo, hi in zip(edges[:-1][some].tolist(), edges[1:][some].tolist(), strict=True):
        docs = doc[lo:hi].tolist()
        for i, s, ids in _solve(contexts[lo:hi], docs, list(zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)), length):
            if (ids < docs[i]).any():
                yield lo + i, s, ids.tobytes()


def sides(context: bytes, left: int, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[bytes, int, int]]:
    """(key, start, end): parts of a context and what all strings in a part have in common.

    A string has at least half of what it holds beside the anchor on one side of it.  So
    equal strings of an anchor lie in parts with equal keys.
    """
    half, last = (length - gram) // 2, len(context) - length
    if left >= half:
        yield b"<" + context[left - half : left + gram], 0, min(left - half, last) + length
    if left - half + 1 <= last:
        yield b">" + context[left : left + length - half + 1], max(0, left - half + 1), len(context)


_PARTS = "run long, anchor long, context long, doc long, start int, left short, bytes binary"


def _parted(length: int, gram: int):
    """Rows of _PARTS: the contexts of crowded anchors in two parts, a run for each anchor and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, c, doc, left, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for key, start, end in sides(raw, left, length, gram):
                    rows.append((xxhash.xxh64_intdigest(key, a & 0xFFFFFFFFFFFFFFFF) - (1 << 63), a, c, doc, start, left - start, raw[start:end]))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary()), strict=True)], names=["run", "anchor", "context", "doc", "start", "left", "bytes"])

    return run


def _resolve_parts(length: int):
    """_KNOWN rows of parts; rows come sorted by run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, a, c, doc, start, left, raw in whole_runs(batches, 7):
            yield _known([(a[i], c[i], doc[i], int(start[i]) + s, ids) for i, s, ids in _answers(key, left, doc, list(raw), length)])

    return run


def _strings(length: int):
    """(run, anchor, context, doc, start, string, least): the strings of crowded runs' parts, the smallest id within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CROWD):
                key, a, c, doc, start, raw = (x.to_pylist() for x in batch.slice(at, CROWD).columns)
                by_run: dict[int, list[int]] = {}
                for i, x in enumerate(key):
                    by_run.setdefault(x, []).append(i)
                rows = []
                for k, members in by_run.items():
                    told = smallest_ids([raw[i] for i in members], [doc[i] for i in members], length)
                    for i, ids in zip(members, told, strict=True):
                        rows += [(k, a[i], c[i], doc[i], start[i] + s, raw[i][s : s + length], least) for s, least in enumerate(ids.tolist())]
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["run", "anchor", "context", "doc", "start", "string", "least"])

    return run


def _spans(length: int):
    """(doc, tag, start, end) of strings that also start in a document with a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag, first, width, least, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            first = first.astype(np.int64)
            ids = batch.column(6)
            partly = ids.is_valid().to_numpy(zero_copy_only=False)
            whole = ~partly & (least < doc)
            # the strings of all partly repeated contexts in a row, those that go, and where runs of them begin and end
            known = ids.filter(pa.array(partly)).to_pylist()
            owner = np.repeat(np.flatnonzero(partly), [len(x) // 8 for x in known])
            new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
            place = np.arange(len(owner)) - np.repeat(new, np.diff(np.append(new, len(owner))))
            gone = np.frombuffer(b"".join(known), np.int64) < doc[owner]
            owner, at = owner[gone], (first[owner] + start[owner].astype(np.int64) + place)[gone]
            cut = np.flatnonzero((owner[1:] != owner[:-1]) | (np.diff(at) > 1))
            heads, tails = (np.concatenate([[0], cut + 1]), np.append(cut, len(at) - 1)) if len(at) else (np.zeros(0, int),) * 2
            out_d, out_t = [doc[whole], doc[owner[heads]]], [tag[whole], tag[owner[heads]]]
            out_s, out_e = [first[whole], at[heads]], [first[whole] + width[whole] + length, at[tails] + length]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in ((out_d, np.int64), (out_t, np.int32), (out_s, np.int64), (out_e, np.int64))], names=["doc", "tag", "start", "end"])

    return run


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of spans that overlap or touch; sorted by start."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:] - 1, len(start) - 1)]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by doc, tag, start; one row for each doc and tag with its merged spans."""
    for doc, tag, start, end in whole_runs(batches, 4):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        edges = [*np.flatnonzero(new).tolist(), len(doc)]
        rows = [np.stack(merged(start[lo:hi], end[lo:hi])).astype(np.int64).tobytes() for lo, hi in itertools.pairwise(edges)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[edges[:-1]]), pa.array(tag[edges[:-1]]), pa.array(rows, pa.binary())], names=["doc", "tag", "spans"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, gram: int = GRAM, bits: int = BITS, most: int = MOST_BITS) -> DataFrame:
    """(doc, tag, spans): for each document with repeated strings its merged spans, int64 starts and then ends.

    ``tag`` is the upper half of xxhash64 of the text and tells apart rows that repeat an id.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), _tag(text_col).alias("tag"), F.col(text_col).cast("string").cast("binary").alias("t"))
    folded = texts.select("doc", "t").mapInArrow(_fold(length, gram), "anchor long, context long, doc long, several boolean")
    by_anchor = folded.repartition("anchor").sortWithinPartitions("anchor", "context", "doc")
    shared = stage(by_anchor.mapInArrow(_shared, "anchor long, context long, doc long, several boolean, others long"), "anchors")
    opened = shared.where("others > 0").select("anchor", "context", "doc", "others")

    def table(rows: DataFrame) -> tuple[Broadcast, int, int]:
        size = _size_of(rows.count(), bits, most)
        return spark.sparkContext.broadcast(_bitmap(rows, *size)), *size

    pieces = texts.mapInArrow(_occurrences(*table(opened.select("anchor", "context")), length, gram, True), "anchor long, context long, left short, bytes binary")
    crowd = opened.where(F.col("others") >= CROWD).select("anchor")
    some = not crowd.isEmpty()
    told, met = opened, pieces
    if some:
        # contexts and bytes part alike by a bitmap, without a shuffle; anchors that it lets through by chance do no harm
        pieces = stage(pieces, "contexts")
        marks = table(crowd)
        (told, told_crowd), (met, met_crowd) = (tuple(x.mapInArrow(_among(*marks, w), x.schema) for w in (False, True)) for x in (opened, pieces))
    told = told.select("anchor", "context", "doc", F.lit(0).cast("short").alias("left"), F.lit(b"").alias("bytes"))
    rows = told.unionAll(met.select("anchor", "context", F.lit(_NO_DOC).alias("doc"), "left", "bytes"))
    solved = rows.repartition("anchor").sortWithinPartitions("anchor", "context").mapInArrow(_resolve(length), _KNOWN)
    if some:
        held = met_crowd.groupBy("anchor", "context").agg(F.first("left").alias("left"), F.first("bytes").alias("bytes")).join(told_crowd, ["anchor", "context"])
        parts = stage(held.select("anchor", "context", "doc", "left", "bytes").mapInArrow(_parted(length, gram), _PARTS), "context-parts")
        sizes = parts.groupBy("run").count()
        small = parts.join(sizes.where((F.col("count") > 1) & (F.col("count") < CROWD)).select("run"), "run", "left_semi")
        solved = solved.unionAll(small.repartition("run").sortWithinPartitions("run").mapInArrow(_resolve_parts(length), _KNOWN))
        large = parts.join(sizes.where(F.col("count") >= CROWD).select("run"), "run", "left_semi")
        strings = stage(large.select("run", "anchor", "context", "doc", "start", "bytes").mapInArrow(_strings(length), "run long, anchor long, context long, doc long, start int, string binary, least long"), "context-strings")
        least = strings.groupBy("run", "string").agg(F.min("least").alias("smallest"))
        found = strings.join(least, ["run", "string"]).where("smallest < doc")
        solved = solved.unionAll(found.select("anchor", "context", F.col("doc").alias("least"), "start", _little_endian(F.col("smallest")).alias("ids")))
    equal = shared.where("several").select("anchor", "context", F.col("doc").alias("least"), F.lit(0).alias("start"), F.lit(None).cast("binary").alias("ids"))
    known = stage(solved.unionAll(equal), "anchor-ids")
    seen = texts.mapInArrow(_occurrences(*table(known.select("anchor", "context")), length, gram, False), _SEEN)
    hit = seen.select("anchor", "context", "doc", "tag", "first", "width").join(known.hint("merge"), ["anchor", "context"]).select("doc", "tag", "first", "width", "least", "start", "ids")
    spans = hit.mapInArrow(_spans(length), "doc long, tag int, start long, end long")
    spans = stage(spans.repartition("doc", "tag").sortWithinPartitions("doc", "tag", "start").mapInArrow(_merge, "doc long, tag int, spans binary"), "spans")
    discard(shared, known, *([pieces, parts, strings] if some else []))
    return spans


def _little_endian(x: Column) -> Column:
    """A long as 8 bytes, lowest first."""
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(x), 16, "0"), 15 - 2 * i, 2) for i in range(8)]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in itertools.chain.from_iterable(_slices(b, 1) for b in batches):
        kept, removed, count = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            text, raw = text.as_py(), spans.as_py()
            start, end = np.frombuffer(raw or b"", np.int64).reshape(2, -1).tolist()
            edges = [0, *itertools.chain.from_iterable(zip(start, end, strict=True)), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(len(text) - len(kept[-1]))
            count.append(len(start))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())], names=["doc_id", "bytes", "kept", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, gram: int = GRAM, bits: int = BITS, most: int = MOST_BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay, joined) for every row.

    Null text is empty.  A row with a null id keeps its text and is no source for others;
    rows that repeat an id are no sources for each other.  Strings are judged on the input,
    not on what is left.  Other columns are ignored; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, id_col, text_col, length=length, gram=gram, bits=bits, most=most)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"), _tag(text_col).alias("tag"))
    marked = with_maybe(rows, F.xxhash64("doc_id", "tag"), bitmap(spans, F.xxhash64("doc", "tag")))
    zero = F.lit(0).cast("long")
    clear = marked.where("not __maybe").select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("bytes").alias("kept"))
    doubt = marked.where("__maybe").join(spans.withColumnRenamed("doc", "doc_id").hint("merge"), ["doc_id", "tag"], "left").select("doc_id", "bytes", "spans")
    cut = doubt.mapInArrow(_cut, "doc_id long, bytes binary, kept binary, n_removed long, n_spans long")
    return clear.unionAll(cut.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), "n_removed", "n_spans", "kept"))


def _tag(text_col: str):
    return F.shiftright(F.xxhash64(F.col(text_col).cast("string")), 32).cast("int")
