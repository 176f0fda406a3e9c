"""SimHash near-duplicates through pivot distance tables.

A fingerprint is described by its Hamming distances to many reference fingerprints: an
origin, one reference for each cell of bits (the origin with that cell flipped) and some at
random.  Distances differ by no more than the fingerprints do, so a pair with any
coordinate further apart than ``max_bits`` is discarded without looking at it again; what
survives is verified.

The table is its own index.  The coordinates of one block of cells depend on that block's
bits alone.  With ``blocks`` blocks, a pair that differs in at most ``blocks - agree`` bits
has equal coordinates in at least ``agree`` blocks, so it meets under one of the
C(blocks, agree) keys made of that many blocks.  No pair within that radius is lost and no
two fingerprints are compared that share no key.

Equal fingerprints are folded to one before that, on the map side.  Rows of a key are
streamed in key order; a key with many fingerprints is linked through common neighbours (see
``_links_by_neighbours``), never by all pairs, in memory of a few bytes per fingerprint.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.bitmaps import drop_ids, keep_ids
from siftline.llm.components import connected_components
from siftline.llm.runs import run_edges, whole_runs
from siftline.llm.scratch import stage
from siftline.llm.textops import LOWER_TABLE

BITS, SEED, SHINGLE, MAX_BITS = 64, 42, 3, 2
BLOCKS, AGREE = 5, 3
RANDOM_REFERENCES = 16
#: Keys with more fingerprints than this are linked through neighbours, those of near copies beyond CROWD.
PAIRWISE = 64
#: The table of near copies: copies of similarity 0.8 are up to about 13 bits apart, of which keys of 3 of 8 blocks reach 5 for sure.
WIDE_BITS, WIDE_BLOCKS, WIDE_AGREE = 13, 8, 3
#: Keys of near copies that the table does not reach, and the permutations of each: a pair of similarity 0.8 shares none with probability 2e-9.
BANDS, BAND_ROWS = 50, 5
#: Keys of near copies with more documents than this are linked to a leader first and then compared in blocks.
CROWD = 8
#: Documents of a crowded key in one block.
CROWD_BLOCK = 2048
_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_digests(text: bytes, size: int, seed: int = SEED) -> bytes:
    """XXH64 digests (8 bytes each, big-endian) of the word shingles of a UTF-8 text.

    A-Z is lower-cased; words are runs of bytes other than space and 0x09..0x0D.  Fewer
    words than ``size`` give one shingle of all, none give none.
    """
    words = text.translate(LOWER_TABLE).split()
    if not words:
        return b""
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) < size:
        return digest(joined, seed)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)][size - 1 :]
    return b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=False)])


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash as a signed integer; 0 without words."""
    digests = shingle_digests(text, size, seed)
    if not digests:
        return 0
    raw, ones, n = np.frombuffer(digests, np.uint8).reshape(-1, 8), np.zeros(BITS, np.int64), len(digests) // 8
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big"))


def _fingerprints(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", size, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; null text counts as empty."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return texts.mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long")


def references(seed: int = SEED, extra: int = RANDOM_REFERENCES) -> list[int]:
    """The origin, the origin with one cell (a bit) flipped for each cell, and random ones."""
    rng = np.random.default_rng(seed)
    origin, *others = (int(x) for x in rng.integers(0, 1 << 63, 1 + extra, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    return [origin, *(origin ^ (1 << b) for b in range(BITS)), *others]


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One step of a 64-bit hash over columns."""
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def table_keys(fps: np.ndarray, blocks: int, agree: int, seed: int = SEED) -> np.ndarray:
    """(n, C(blocks, agree)) keys, each from the table's coordinates in ``agree`` blocks."""
    refs = np.array(references(seed, 0), np.uint64)
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int64)
    cells = ((table[:, 1:] - table[:, :1] + 1) >> 1).astype(np.uint64)  # a cell moves the distance up or down by one
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    codes = [(cells[:, lo:hi] << np.arange(hi - lo, dtype=np.uint64)).sum(1, dtype=np.uint64) for lo, hi in itertools.pairwise(edges)]
    keys = np.empty((len(fps), 0), np.uint64)
    for n, chosen in enumerate(itertools.combinations(range(blocks), agree)):
        h = np.full(len(fps), n + 1, np.uint64)
        for c in chosen:
            h = _mixed(h, codes[c])
        keys = np.column_stack([keys, h])
    return keys


def _emit_keys(blocks: int, agree: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                keys = table_keys(part, blocks, agree, seed)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], names=["key", "fp"])

    return run


def _near(a: np.ndarray, b: np.ndarray, refs: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs are within ``max_bits``: coordinate by coordinate of the distance table, then verified."""
    left = np.arange(len(a))
    for ref in refs[::-1]:
        if not len(left):
            return left
        x, y = (np.bitwise_count(v[left] ^ ref).astype(np.int8) for v in (a, b))
        left = left[np.abs(x - y) <= max_bits]
    return left[np.bitwise_count(a[left] ^ b[left]) <= max_bits]


def _links_pairwise(key: np.ndarray, fps: np.ndarray, refs: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``max_bits`` of the same key, for many keys at once; keys are sorted."""
    edges = run_edges(key)
    to_end = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(key)) - 1  # rows of the key that follow
    us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    at = np.arange(len(key))
    for step in range(1, int(to_end.max(initial=0)) + 1):
        at = at[to_end[at] >= step]
        for part in range(0, len(at), 1 << 18):
            i = at[part : part + (1 << 18)]
            ok = _near(fps[i], fps[i + step], refs, max_bits)
            us.append(fps[i[ok]])
            vs.append(fps[i[ok] + step])
    return np.concatenate(us), np.concatenate(vs)


def _links_by_neighbours(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs within 2 bits connect, without all pairs.

    Two fingerprints are within 2 bits of each other exactly if some value is within 1 bit
    of both.  Every value is within 1 bit of at most 65 distinct fingerprints, so linking
    each of them to the first gives at most 65 links for a fingerprint.  Values are handled
    in slices by their hash, which bounds memory.
    """
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    slices = max(1, len(fps) * 65 >> 22)
    out_a, out_b = [], []
    for part in range(slices):
        values, owners = [], []
        for flip in flips:
            v = fps ^ flip
            keep = np.flatnonzero((v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(slices) == part)
            values.append(v[keep])
            owners.append(keep)
        v, o = np.concatenate(values), np.concatenate(owners)
        order = np.lexsort((o, v))
        v, o = v[order], o[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        lead = np.repeat(o[first], np.diff(np.append(first, len(v))))
        other = lead != o
        pair = np.unique(lead[other].astype(np.int64) * len(fps) + o[other])
        out_a.append(pair // len(fps))
        out_b.append(pair % len(fps))
    return np.concatenate(out_a), np.concatenate(out_b)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that links reach, for each of n."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        keep = label[a] != label[b]
        if not keep.any():
            break
        a, b = a[keep], b[keep]
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def _link_runs(max_bits: int, pairwise: int, seed: int):
    if max_bits < 2:
        raise ValueError("max_bits below 2 is not supported")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = np.array(references(seed), np.uint64)
        for key, fp in whole_runs(batches, 2):
            edges, fps = run_edges(key), fp.view(np.uint64)
            sizes = np.diff(edges)
            small = np.repeat((sizes > 1) & (sizes <= pairwise), sizes)
            us, vs = ([x] for x in _links_pairwise(key[small], fps[small], refs, max_bits))
            for n in np.flatnonzero(sizes > pairwise).tolist():
                crowd = np.unique(fps[edges[n] : edges[n + 1]])
                a, b = _links_by_neighbours(crowd)
                us.append(crowd[a])
                vs.append(crowd[b])
            a, b = (np.concatenate(x).view(np.int64) for x in (us, vs))
            u, v = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def fingerprint_links(distinct: DataFrame, *, max_bits: int = MAX_BITS, blocks: int = BLOCKS, agree: int = AGREE, pairwise: int | None = None, seed: int = SEED) -> DataFrame:
    """(u, v): links between the distinct values of column ``fp``.

    With ``blocks - agree`` >= 2 and ``max_bits`` 2 they connect exactly what all pairs within
    2 bits connect.  With more bits they connect at least that; pairs of up to ``blocks -
    agree`` bits are linked in every key of at most ``pairwise`` fingerprints, those further
    apart if they happen to share one.
    """
    keyed = distinct.select("fp").mapInArrow(_emit_keys(blocks, agree, seed), "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link_runs(max_bits, PAIRWISE if pairwise is None else pairwise, seed), "u long, v long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) for every row: documents whose fingerprints are linked at 2 bits or fewer.

    Documents without words have fingerprint 0 and are linked like any other.  Rows that
    repeat a doc_id are one node.  component_id is the smallest doc_id reachable; rows with
    a null id count for no group's smallest id (a group of such rows alone has a null one).
    Null text is empty; a text of any length is read whole, its shingles' hashes
    are held by the task that reads it.  An empty table gives an empty result.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-nodes")
    links = fingerprint_links(nodes, seed=seed)
    # a doc_id on several rows may have several fingerprints, which it links
    repeated = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("v")).where("u <> v").select("doc_id")
    same = fps.join(repeated, "doc_id").join(fps.join(repeated, "doc_id").groupBy("doc_id").agg(F.min("fp").alias("v")), "doc_id").select(F.col("fp").alias("u"), "v").where("u <> v")
    parts = stage(connected_components(links.unionAll(same)), "fp-components")
    # the smallest doc_id of each component of fingerprints
    placed = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    least = placed.groupBy("part").agg(F.min("first").alias("component_id"))
    named = placed.select("fp", "part").join(least, "part").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _permutations(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 32, (2, BANDS * BAND_ROWS), dtype=np.uint32)
    return a | np.uint32(1), b


def band_keys(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of 32-bit shingles, each of the least shingles under BAND_ROWS permutations.

    Sets of similarity s agree in a key with probability s ** BAND_ROWS.
    """
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * a + b).min(0), out=least)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        h = _mixed(h, column.astype(np.uint64))
    return h


def _marks(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(seed)
        for batch in batches:
            fps, whole, keys = [], [], []
            for t in batch.column(1):
                text = t.as_py() or b""
                fps.append(fingerprint(text, SHINGLE, seed))
                digests = np.unique(np.frombuffer(shingle_digests(text, size, seed), np.uint64))
                whole.append(xxhash.xxh128_digest(digests.tobytes(), seed))
                keys.append(band_keys(np.unique(digests.view(np.uint32)[::2]), a, b).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(whole, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "fp", "whole", "keys"])

    return run


def _spread_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(ids[at : at + (1 << 16)], pa.int64())], names=["key", "id"])


def _shingle_sets(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for t in batch.column(1):
                digests = np.frombuffer(shingle_digests(t.as_py() or b"", size, seed), np.uint32)[::2]
                sets.append(np.unique(digests).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, u, v): all pairs of small keys, without the key; each document v of a crowded key with the key's smallest u."""
    for key, ids in whole_runs(batches, 2):
        edges = run_edges(key)
        sizes = np.diff(edges)
        small = np.repeat((sizes > 1) & (sizes <= CROWD), sizes)
        k, i = key[small], ids[small]
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for step in range(1, CROWD):
            same = np.flatnonzero(k[step:] == k[:-step])
            us.append(i[same])
            vs.append(i[same + step])
        u, v = np.concatenate(us), np.concatenate(vs)
        u, v = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        crowd = sizes > CROWD
        there = np.repeat(crowd, sizes)
        lead = np.repeat(np.minimum.reduceat(ids, edges[:-1])[crowd], sizes[crowd])
        keys = pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(key[there], pa.int64())])
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([u, lead]), pa.int64()), pa.array(np.concatenate([v, ids[there]]), pa.int64())], names=["key", "u", "v"])


def crowd_links(part: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links that join all documents with a similar one in another part.

    A pair is left out only if verified links join it already.  One end of every pair across
    parts lies outside the largest part, so only those documents are held against all.
    """
    size = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    starts = ends - size
    label = np.unique(part, return_inverse=True)[1]
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for x in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        mark = np.zeros(len(codes) + 1, bool)
        mark[codes[starts[x] : ends[x]]] = True
        upto = np.concatenate([[0], np.cumsum(mark[codes])])
        both = upto[ends] - upto[starts]
        hit = np.flatnonzero((label != label[x]) & (both >= least * (size[x] + size - both)))
        if len(hit):
            out_a.append(np.full(len(hit), x))
            out_b.append(hit)
            label[np.isin(label, label[hit])] = label[x]
            if (label == label[x]).all():
                break
    return np.concatenate(out_a), np.concatenate(out_b)


def _compare_crowds(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, part, raw in whole_runs(batches, 4):
            edges = run_edges(key)
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for lo, hi in itertools.pairwise(edges.tolist()):
                a, b = crowd_links(part[lo:hi], [np.frombuffer(x, np.uint32) for x in raw[lo:hi]], least)
                us.append(ids[lo:hi][a])
                vs.append(ids[lo:hi][b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (us, vs)], names=["a", "b"])

    return run


def _crowd_rows(crowd: DataFrame, parts: DataFrame) -> DataFrame:
    """(run, id, part): the documents of crowded keys that are not all joined, each pair of a key's blocks as a run."""
    told = crowd.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    open_keys = told.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    blocks = F.ceil(F.col("n") / CROWD_BLOCK)
    dealt = told.join(open_keys, "key").withColumn("i", F.pmod(F.xxhash64("id"), blocks)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return dealt.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("run"), "id", "part")


def _fingerprint_pairs(owners: DataFrame, seed: int) -> DataFrame:
    """(a, b), a < b: owners (fp, id) whose fingerprints the distance table links, by the smallest id of each fingerprint."""
    nodes = stage(owners.groupBy("fp").agg(F.min("id").alias("first")), "near-fp-nodes")
    links = fingerprint_links(nodes, max_bits=WIDE_BITS, blocks=WIDE_BLOCKS, agree=WIDE_AGREE, pairwise=CROWD, seed=seed)
    linked = links.join(nodes.select(F.col("fp").alias("u"), F.col("first").alias("x")), "u").join(nodes.select(F.col("fp").alias("v"), F.col("first").alias("y")), "v")
    equal = owners.join(nodes, "fp").select(F.col("first").alias("x"), F.col("id").alias("y"))
    return linked.select("x", "y").unionAll(equal).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets of shingles are similar."""
    seen = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return seen.select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long")


def _not_joined(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different groups of ``parts`` (node, component)."""
    told = pairs
    for end in ("a", "b"):
        told = told.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}")), end, "left")
    return told.where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, verify_shingle: int = 5, similarity: float = 0.8, seed: int = SEED) -> DataFrame:
    """(id, component_id): documents grouped by SimHash and their ``verify_shingle``-word shingles.

    A link needs a Jaccard similarity of at least ``similarity``, taken from whole sets.
    Candidates come first from the fingerprints of ``near_groups`` and their pivot distance
    table, here up to WIDE_BITS apart: sure for 5 bits (2 in crowded keys), by chance beyond.
    As copies of similarity 0.8 may be 13 bits and more apart, documents that verified SimHash
    links leave in different groups are candidates also if they share one of BANDS keys of
    BAND_ROWS least shingles.
    Pairs of similarity s share none with probability (1 - s ** BAND_ROWS) ** BANDS, whatever
    the size of the table: 2e-9 at 0.8, but 0.004 at 0.64; a smaller ``similarity`` needs
    more keys.  Documents of a crowded key are held against its smallest id first; those of
    keys that this leaves in several groups are then all compared across the groups, in
    blocks.  Documents with one set of ``verify_shingle``-word shingles are one node, seen as
    the one with the smallest id, with the fingerprints of all.  Only documents in a group of
    two or more are returned; rows with a null id are in none.  A text of any length is read
    whole, and its set of shingles' hashes travels as one value.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    marks = stage(texts.mapInArrow(_marks(verify_shingle, seed), "doc_id long, fp long, whole binary, keys binary"), "near-marks")
    nodes = stage(marks.groupBy("whole").agg(F.min("doc_id").alias("id"), F.min("keys").alias("keys")), "near-nodes")
    members = stage(marks.select("doc_id", "fp", "whole").join(nodes.select("whole", "id"), "whole").select("doc_id", "fp", "id"), "near-members")
    close = stage(_fingerprint_pairs(members.select("fp", "id").distinct(), seed), "near-fp-pairs")
    keyed = nodes.select("id", "keys").mapInArrow(_spread_keys, "key long, id long")
    links = stage(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_candidates, "key long, u long, v long"), "near-links")
    pairs = stage(links.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), "near-pairs")
    ends = pairs.unionAll(close)
    needed = stage(ends.select(F.col("a").alias("id")).unionAll(ends.select(F.col("b").alias("id"))).distinct(), "near-needed")
    sets = keep_ids(texts, "id", needed).mapInArrow(_shingle_sets(verify_shingle, seed), "id long, shingles binary")
    sets = stage(sets.dropDuplicates(["id"]), "near-shingles")
    one = members.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    joined = stage(connected_components(_verified(close, sets, similarity).unionAll(one), "a", "b"), "near-joined")
    alike = _verified(_not_joined(pairs, joined), sets, similarity)
    parts = stage(connected_components(alike.unionAll(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b"), "near-parts")
    crowds = _crowd_rows(links.where("key is not null").select("key", F.col("v").alias("id")), parts).join(sets, "id").select("run", "id", "part", "shingles")
    more = stage(crowds.repartition("run").sortWithinPartitions("run").mapInArrow(_compare_crowds(similarity), "a long, b long"), "near-crowds")
    groups = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), "a", "b")
    return groups.select(F.col("node").alias("id"), F.col("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` with the document of the smallest id of each group; see ``near_copies``."""
    groups = near_copies(docs, id_col, text_col, **options)
    return drop_ids(docs, id_col, stage(groups.where("id <> component_id").select("id"), "near-dropped"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
