"""A set of long keys as a bitmap of fixed size: a broadcast whose size does not grow with the data.

A set bit means "perhaps in the set", a clear one "certainly not".  Rows that are certainly
not in the set skip a shuffle; the others go through an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 4 MiB.
FILTER_BITS = 1 << 25


def bitmap(keys: DataFrame, key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """(bucket, bitmap) rows, at most bits / 32768 of 4 KiB; null keys are left out."""
    position = keys.select(F.pmod(key, F.lit(bits)).alias("pos")).where("pos is not null")
    return position.groupBy(F.expr("bitmap_bucket_number(pos)").alias("__bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(pos))").alias("__bitmap"))


def with_maybe(df: DataFrame, key: Column, bitmap_rows: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with boolean ``__maybe``: false only where ``key`` is certainly not in the set."""
    probe = df.withColumn("__pos", F.pmod(key, F.lit(bits)))
    probe = probe.withColumn("__bucket", F.expr("bitmap_bucket_number(__pos)")).withColumn("__bit", F.expr("bitmap_bit_position(__pos)"))
    bit = F.expr("shiftright(cast(conv(hex(substring(__bitmap, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int), cast(__bit % 8 as int)) & 1")
    joined = probe.join(F.broadcast(bitmap_rows), "__bucket", "left").withColumn("__maybe", F.coalesce(bit == 1, F.lit(False)))
    return joined.drop("__pos", "__bucket", "__bit", "__bitmap")


def packed(df: DataFrame, *keys: Column) -> DataFrame:
    """Rows as one column ``__row`` beside ``keys``, so that no name of theirs can clash with a column's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *keys)


def _marked(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    return with_maybe(packed(df, F.col(id_col).alias("__id")), F.xxhash64("__id"), bitmap(ids, F.xxhash64("id")))


def drop_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``df`` without the rows whose id is in ``ids`` (long column ``id``, staged); only rows that may be are shuffled."""
    marked = _marked(df, id_col, ids)
    doubt = marked.where("__maybe").join(ids.select(F.col("id").alias("__drop")), F.col("__id") == F.col("__drop"), "left_anti")
    return marked.where("not __maybe").select("__row.*").unionAll(doubt.select("__row.*"))


def keep_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is in ``ids`` (long column ``id``, staged); other rows are not shuffled."""
    marked = _marked(df, id_col, ids).where("__maybe")
    return marked.join(ids.select(F.col("id").alias("__keep")), F.col("__id") == F.col("__keep"), "left_semi").select("__row.*")
