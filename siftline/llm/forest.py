"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long hash string: DEPTH symbols, each naming the coordinate of
largest magnitude, and its sign, among GROUP directions of seeded random rotations (a
cross-polytope symbol of 7 bits).  Similar vectors agree in longer prefixes.  A tree is the sorted array of
its strings.  A query descends by binary search to the longest matching prefix of each tree;
then all trees ascend together, one bit at a time, until the subtrees they stand on hold
enough different candidates, and those are compared by cosine in double precision.

Rows are folded to distinct vectors (each keeps its k + 1 smallest ids, so that a vector
repeated a million times is one entry and loses no answer), and dealt by hash into blocks of
at most BLOCK vectors.  A task holds the forest of one block; queries, a bounded share of the
rows, go to every block and are streamed through it.  Nothing is broadcast or collected but
counts.  There is no sample: random rotations need no fit.

Candidates: CANDIDATES * n^0.75 of n vectors, shared out evenly over the blocks.  That is set
by the hardest case, independent random vectors, whose nearest neighbours are hardly nearer
than the rest; clustered vectors are found with far fewer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.scratch import stage

TREES, DEPTH, GROUP, SEED, CANDIDATES = 64, 4, 64, 42, 4
BLOCK = 1 << 18
_SYMBOL_BITS = 7
BITS = DEPTH * _SYMBOL_BITS


def blocks_of(n: int, block: int = BLOCK) -> int:
    """Blocks for n vectors: as memory asks, and some for small tables so that they have tasks."""
    return max(1, math.ceil(n / block), math.ceil(math.sqrt(n) / 64))


def candidates_of(n: int, blocks: int) -> int:
    """Different candidates that each block looks up for a query."""
    return math.ceil(CANDIDATES * n**0.75 / blocks)


def directions(tree: int, dim: int, seed: int = SEED) -> np.ndarray:
    """DEPTH * GROUP columns of as many random rotations of a tree as that takes."""
    rng, out, n = np.random.default_rng([seed, tree, dim]), [], DEPTH * GROUP
    for _ in range(0, n, dim):
        out.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0])
    return np.concatenate(out, axis=1)[:, :n].astype(np.float32)


def strings(unit: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Hash strings of unit vectors in one tree, as integers whose leading bits are the first symbols."""
    out = np.zeros(len(unit), np.uint32)
    for at in range(0, len(unit), 8192):
        seen = (unit[at : at + 8192] @ across).reshape(-1, DEPTH, GROUP)
        largest = np.abs(seen).argmax(2)
        sign = np.take_along_axis(seen, largest[:, :, None], 2)[:, :, 0] > 0
        symbol = (largest * 2 + sign).astype(np.uint32)
        for d in range(DEPTH):
            out[at : at + 8192] = out[at : at + 8192] << np.uint32(_SYMBOL_BITS) | symbol[:, d]
    return out


def unit32(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with q in double precision, scaled first so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    q = q / np.abs(q).max()
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * math.sqrt(float((q * q).sum())))


class Forest:
    """Sorted arrays of the hash strings of one block, and its vectors."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = SEED) -> None:
        self.x, self.seed = x, seed
        unit = unit32(x.astype(np.float64))
        self.order, self.sorted = np.empty((trees, len(x)), np.int32), np.empty((trees, len(x)), np.uint32)
        for t in range(trees):
            h = strings(unit, directions(t, x.shape[1], seed))
            self.order[t] = np.argsort(h, kind="stable")
            self.sorted[t] = h[self.order[t]]

    def subtrees(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) in each tree of the strings that share the first b bits with each query; axes tree, bits, query."""
        unit = unit32(queries.astype(np.float64))
        first, end = (np.empty((len(self.sorted), BITS + 1, len(queries)), np.int32) for _ in range(2))
        for t, mine in enumerate(self.sorted):
            h = strings(unit, directions(t, self.x.shape[1], self.seed)).astype(np.uint64)
            for b in range(BITS + 1):
                low = h >> np.uint64(BITS - b) << np.uint64(BITS - b)
                first[t, b] = np.searchsorted(mine, low.astype(np.uint32))
                end[t, b] = np.searchsorted(mine, (low + (np.uint64(1) << np.uint64(BITS - b)) - np.uint64(1)).astype(np.uint32), "right")
        return first, end

    def candidates(self, first: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
        """Rows under the subtrees of one query: all trees ascend from their deepest match until ``least`` rows differ."""
        sizes = (end - first).sum(axis=0)
        level = max(0, int(np.searchsorted(-sizes, -least, "right")) - 1)  # the longest prefix under which as many rows stand, repeats counted
        while True:
            rows = np.concatenate([o[a:b] for o, a, b in zip(self.order, first[:, level].tolist(), end[:, level].tolist(), strict=True)])
            met = np.zeros(len(self.x), bool)
            met[rows] = True
            rows = np.flatnonzero(met)
            if len(rows) >= least or level == 0:
                return rows
            level -= 1


def _answers(k: int, trees: int, seed: int, dtype: str):
    """Stream the queries of a block (kind 1) through the forest of its vectors (kind 0, which come first)."""

    def answer(forest: Forest, ids: list[list[int]], least: int, batch: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, float]]:
        for at in range(0, len(batch), 256):
            part = batch[at : at + 256]
            queries = np.frombuffer(b"".join(raw for _, raw in part), dtype).reshape(len(part), -1).astype(np.float64)
            first, end = forest.subtrees(queries)
            for i, (own, _) in enumerate(part):
                rows = forest.candidates(first[:, :, i], end[:, :, i], least)
                near = cosines(forest.x[rows].astype(np.float64), queries[i])
                most = k + 1  # one of them may be the query's own vector alone
                while True:
                    cut = np.partition(near, len(near) - most)[len(near) - most] if most < len(near) else -math.inf
                    found: dict[int, float] = {}
                    for j in np.flatnonzero(near >= cut).tolist():
                        for x in ids[rows[j]]:
                            if x != own:
                                found[x] = max(found.get(x, -math.inf), float(near[j]))
                    if len(found) >= k or most >= len(near):
                        break
                    most *= 4
                for x, score in sorted(found.items(), key=lambda f: (-f[1], f[0]))[:k]:
                    yield own, x, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, raws, ids, forest, need = None, [], [], None, 0
        for batch in batches:
            out, asked = [], []
            for dim, block, kind, least, query, same, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (dim, block):
                    if asked and forest:
                        out += answer(forest, ids, need, asked)
                    key, raws, ids, forest, asked, need = (dim, block), [], [], None, [], least
                if kind == 0:
                    raws.append(vec)
                    ids.append(same)
                elif raws:
                    if forest is None:
                        forest = Forest(np.frombuffer(b"".join(raws), dtype).reshape(len(raws), -1), trees, seed)
                    asked.append((query, vec))
            if asked and forest:
                out += answer(forest, ids, need, asked)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _bytes(dtype: str):
    """Vectors as bytes; a row that a task has seen already, id and vector, is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        for batch in batches:
            v = batch.column(1)
            flat = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False).astype(dtype)) + np.dtype(dtype).type(0)  # -0.0 becomes 0.0
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            out = []
            for i, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                raw = flat[a:b].tobytes()
                if (key := (i, blake2b(raw, digest_size=16).digest())) not in seen:
                    seen.add(key)
                    out.append((i, b - a, raw))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["id", "dim", "vec"])

    return run


def nearest(vectors: DataFrame, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, trees: int = TREES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` nearest vectors found, by largest cosine, ties to the smaller id.

    Queries are the rows for which the SQL condition ``is_query`` on ``id`` holds; candidates
    are the rows with another id.  Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows without id, take no part.  Only vectors of equal length are
    compared.  Rows that repeat an id and a vector are one; an id with several vectors is
    searched with each and listed once, with its best score.  Other columns are ignored; an
    empty table gives an empty result.  Scores are exact, the choice of candidates is not.
    """
    dtype = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    rows = rows.where(F.coalesce(F.col("id").isNotNull() & finite & F.exists("v", lambda e: e != 0), F.lit(False)))
    rows = stage(rows.mapInArrow(_bytes(dtype), "id long, dim int, vec binary"), "forest-rows")
    keyed = rows.select("id", "dim", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(seed), "vec").alias("k2"))
    place = F.dense_rank().over(W.partitionBy("dim", "k1", "k2").orderBy("id"))
    folded = keyed.withColumn("place", place).where(F.col("place") <= k + 1)
    classes = folded.groupBy("dim", "k1", "k2").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("vec").alias("vec"))
    classes = stage(classes, "forest-vectors")
    sizes = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length of a vector
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan = vectors.sparkSession.createDataFrame([(d, p := blocks_of(n, block), candidates_of(n, p)) for d, n in sizes.items()], "dim int, blocks int, least int")
    held = classes.join(F.broadcast(plan), "dim").select("dim", F.pmod("k1", "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "least", F.lit(None).cast("long").alias("query"), "ids", "vec")
    asked = rows.where(is_query).distinct().join(F.broadcast(plan), "dim")
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "least", F.col("id").alias("query"), F.lit(None).cast("array<long>").alias("ids"), "vec")
    # queries meet all blocks: blocks are few and large, queries a fixed share of the rows
    met = held.unionAll(asked).repartition(max(1, sum(blocks_of(n, block) for n in sizes.values())), "dim", "block").sortWithinPartitions("dim", "block", "kind")
    found = met.mapInArrow(_answers(k, trees, seed, dtype), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
