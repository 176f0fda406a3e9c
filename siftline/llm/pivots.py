"""Embedding near-duplicates through a pivot-permutation index.

Each vector is described by its nearest reference points (pivots) in order, its permutation
prefix.  Similar vectors see similar pivots, so two vectors are compared only if their
prefixes share at least ``shared`` pivots: the inverted lists are keyed by sets of that many
pivots (and by label), and a pair is counted in the list of the smallest such set it
shares, once.  Cosines are then taken in double precision from the vectors themselves.

Pivots come from a bounded seeded sample (PIVOT_SAMPLE vectors), spread out so that a dense
group gives one pivot and not all; their number follows the cube root of the number of
vectors of a label.  More pivots come with longer prefixes (``prefix_length``), so that a
pair is found at any size.  Equal vectors of a label are folded to one with a count before that.  Rows of a list
are streamed in key order and compared in blocks; only links that join groups leave a
list, not pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.components import connected_components
from siftline.llm.runs import run_edges, whole_runs
from siftline.llm.scratch import stage
from siftline.llm.simhash import forest

THRESHOLD, SHARED, SEED = 0.93, 2, 42
#: Pivots of a prefix for up to so many pivots: 0.998 and more of random pairs at cosine 0.93 in 64 dimensions share SHARED.
NEAREST = ((200, 7), (400, 8), (2480, 10), (1 << 15, 12))
PIVOT_SAMPLE, LEAST_PIVOTS, MOST_PIVOTS, SPREAD = 4096, 96, 4096, 0.8
BLOCK = 512


def prefix_length(count: int) -> int:
    """Pivots of a prefix where there are ``count`` pivots."""
    return next(n for most, n in NEAREST if count <= most)


def spread_pivots(sample: np.ndarray, count: int, dim: int, seed: int = SEED) -> np.ndarray:
    """Up to ``count`` unit vectors of the sample no two of which have a cosine above SPREAD; random ones fill up."""
    chosen = np.empty((0, dim))
    for x in sample:
        if len(chosen) == count:
            break
        if not len(chosen) or (chosen @ x).max() <= SPREAD:
            chosen = np.vstack([chosen, x])
    more = np.random.default_rng([seed, dim]).normal(size=(count - len(chosen), dim))
    return np.vstack([chosen, more / np.linalg.norm(more, axis=1, keepdims=True)]) if len(more) else chosen


def prefixes(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """(n, nearest) pivots of each unit vector, nearest first; ties by number."""
    near = x @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :nearest]


def _unit(raw: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _emit(pivots_of: dict[int, np.ndarray], count: int, nearest: int, shared: int, dtype: str, seed: int):
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = list(itertools.combinations(range(nearest), shared))
        for batch in batches:
            labels, cid, mult, raw = (c.to_pylist() for c in batch.columns)
            by_dim: dict[int, list[int]] = {}
            for i, b in enumerate(raw):
                by_dim.setdefault(len(b) // width, []).append(i)
            for dim, rows in by_dim.items():
                pivots = pivots_of.get(dim)
                if pivots is None:
                    pivots = pivots_of[dim] = spread_pivots(np.empty((0, dim)), count, dim, seed)
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    near = np.sort(prefixes(_unit([raw[i] for i in part], dtype), pivots, nearest), axis=1).astype(np.int16)
                    n, s = len(part), len(sets)
                    keys = np.empty((n, s), np.int64)
                    tops = np.empty((n, s), np.int16)
                    lab = np.array([labels[i] for i in part], np.int64)
                    for j, chosen in enumerate(sets):
                        h = lab * 1_000_003 + dim
                        for c in chosen:
                            h = (h * 8191) ^ (near[:, c].astype(np.int64) + 1) * np.int64(0x9E3779B97F4A7C1)
                        keys[:, j], tops[:, j] = h, near[:, chosen[-1]]
                    again = np.repeat(np.arange(n), s).tolist()
                    packed = [near[i].tobytes() for i in range(n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.reshape(-1)), pa.array(np.repeat(lab, s)), pa.array([cid[part[i]] for i in again], pa.int64()), pa.array([mult[part[i]] for i in again], pa.int64()),
                         pa.array(tops.reshape(-1).astype(np.int32)), pa.array([packed[i] for i in again], pa.binary()), pa.array([raw[part[i]] for i in again], pa.binary())],
                        names=["key", "label", "cid", "mult", "top", "near", "vec"])

    return run


_KEYED = "key long, label long, cid long, mult long, top int, near binary, vec binary"


def _link_run(cid: np.ndarray, mult: np.ndarray, top: np.ndarray, near: np.ndarray, x: np.ndarray, threshold: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, smallest row it is joined to) within one list; only pairs whose smallest shared set is this list's."""
    n = len(cid)
    links, us, vs = np.zeros(n, np.int64), [], []
    for at in range(0, n, BLOCK):
        sim = x[at : at + BLOCK] @ x.T
        i, j = np.nonzero(sim >= threshold)
        i += at
        keep = i < j
        i, j = i[keep], j[keep]
        for part in range(0, len(i), 1 << 16):
            a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            both = (near[a][:, :, None] == near[b][:, None, :]).any(2)
            # the list's own set is shared; it is the smallest if nothing else shared lies below its largest pivot
            mine = (both & (near[a] <= top[a][:, None])).sum(1) == shared
            a, b = a[mine], b[mine]
            np.add.at(links, a, mult[b])
            np.add.at(links, b, mult[a])
            us.append(a)
            vs.append(b)
    a, b = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (us, vs))
    return links, forest(n, a, b)


def _link(threshold: float, nearest: int, shared: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, *cols in whole_runs(batches, 7):
            edges = run_edges(key)
            outs: tuple[list, ...] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)])
            for n in np.flatnonzero(np.diff(edges) > 1).tolist():
                label, cid, mult, top, near, vec = (c[edges[n] : edges[n + 1]] for c in cols)
                raw_near = np.frombuffer(b"".join(near), np.int16).reshape(-1, nearest)
                # lists whose keys collide by chance are told apart here
                own = [(int(lb), int(t), len(v)) for lb, t, v in zip(label, top, vec, strict=True)]
                for kind in set(own):
                    at = np.array([i for i, o in enumerate(own) if o == kind])
                    if len(at) < 2:
                        continue
                    links, low = _link_run(cid[at], mult[at], top[at], raw_near[at], _unit([vec[i] for i in at], dtype), threshold, shared)
                    found = np.flatnonzero((links > 0) | (low != np.arange(len(at))))
                    for out, x in zip(outs, (cid[at][found], links[found], cid[at][low[found]]), strict=True):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in outs], names=["cid", "links", "other"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, threshold: float = THRESHOLD,
                 nearest: int | None = None, shared: int = SHARED, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors are linked if labels are equal and not null and the cosine is at least
    ``threshold``.  A null, empty or zero vector, one with a null or non-finite component,
    one without label or id links with nothing.  Labels may be of any type that casts to a string.  Vectors of different length never link.
    n_links counts other rows.  Rows that repeat an id count as rows and are one node for
    component_id.  A row with a null id has 0 links, a null component and is not kept.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    dtype = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(label_col).cast("string")).alias("lab"), F.col(label_col).isNotNull().alias("labelled"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    valid = F.coalesce(F.col("id").isNotNull() & F.col("labelled") & finite & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = rows.withColumn("ok", valid).withColumn("k1", F.when(valid, F.xxhash64("v"))).withColumn("k2", F.when(valid, F.xxhash64(F.lit(seed), "v", F.size("v"))))
    classes = rows.where("ok").groupBy("lab", "k1", "k2").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v"))
    as_bytes = _to_bytes(dtype)
    classes = stage(classes.mapInArrow(as_bytes, "lab long, k1 long, k2 long, cid long, mult long, vec binary"), "pivot-classes")

    most = classes.groupBy("lab").count().agg(F.max("count")).first()[0] or 0
    count = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 8 * round(most ** (1 / 3)))))
    nearest = nearest or prefix_length(count)
    width = np.dtype(dtype).itemsize
    dims = classes.groupBy(F.octet_length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    pivots_of: dict[int, np.ndarray] = {}
    if dims:
        total = dims["count"]
        share = min(1.0, PIVOT_SAMPLE / total)
        picked = classes.where((F.octet_length("vec") == dims["n"]) & (F.pmod(F.xxhash64(F.lit(seed), "k1"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
        sample = sorted(picked.select("vec", F.xxhash64(F.lit(seed), "k1").alias("h")).limit(2 * PIVOT_SAMPLE).collect(), key=lambda r: (r.h, bytes(r.vec)))
        dim = dims["n"] // width
        pivots_of[dim] = spread_pivots(_unit([bytes(r.vec) for r in sample], dtype), count, dim, seed)
    keyed = classes.select("lab", "cid", "mult", "vec").mapInArrow(_emit(pivots_of, count, nearest, shared, dtype, seed), _KEYED)
    found = stage(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link(threshold, nearest, shared, dtype), "cid long, links long, other long"), "pivot-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = stage(connected_components(found.where("cid <> other"), "cid", "other"), "pivot-components")
    told = classes.select("lab", "k1", "k2", "cid", "mult").join(links, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    told = told.select("lab", "k1", "k2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    # rows that link with nothing get a key of their own, so that they spread over all tasks
    spread = rows.drop("v").withColumn("k1", F.coalesce("k1", F.xxhash64("id"))).withColumn("k2", F.coalesce("k2", F.lit(0)))
    out = spread.join(told, ["lab", "k1", "k2"], "left")
    linked = F.col("ok") & F.col("n_links").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("vec_id"), F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _to_bytes(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(5)
            flat = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False).astype(dtype)) + np.dtype(dtype).type(0)
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([flat[a:b].tobytes() for a, b in itertools.pairwise(ends.tolist())], pa.binary())], names=["lab", "k1", "k2", "cid", "mult", "vec"])

    return run
