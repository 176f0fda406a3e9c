"""Cosine similarity and exact k nearest neighbours.

A query set is broadcast only if it is a stated, bounded number of rows; corpus rows are
scanned once and only k rows per query survive a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_QUERIES = 1000


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for zero vectors."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def knn(corpus: DataFrame, query: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """corpus (id, vector), query (one row: vector) -> id, similarity of the k nearest, ties by id."""
    q = query.select(F.col("vector").alias("__q"), norm(F.col("vector")).alias("__n")).limit(1)
    hit = corpus.crossJoin(F.broadcast(q)).select("id", F.try_divide(dot(F.col("vector"), F.col("__q")), norm(F.col("vector")) * F.col("__n")).alias("similarity"))
    if floor is not None:
        hit = hit.where(F.col("similarity") > floor)
    return hit.orderBy(F.desc("similarity"), "id").limit(k)
