"""State as a base and layers of changes, merged when it is read (STR-1..3, STR-11).

A batch writes the rows that it changed, not the state; every so often a new base is written
and older layers go.  The base is partitioned by a hash of one key column, so that a batch
reads the buckets of its own keys alone.  Versions are batch ids: a batch done again reads
what its predecessors left and overwrites its own layer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.operators import keyed


class LayeredTable:
    """A keyed table under one folder: ``base/v=N`` and ``layers/v=N``."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], bucket_by: str, *, buckets: int = 32, compact_every: int = 16) -> None:
        self.spark, self.path, self.keys, self.bucket_by, self.buckets, self.compact_every = spark, path.rstrip("/"), keys, bucket_by, buckets, compact_every
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.bucket_by)), F.lit(self.buckets)).cast("int")

    def _folder(self, kind: str) -> tuple:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        return jvm, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, kind: str) -> list[int]:
        jvm, folder, fs = self._folder(kind)
        names = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(str(p.getName())[2:]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, kind: str, version: int) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, *StructType.fromDDL("bucket int")])).parquet(f"{self.path}/{kind}/v={version}").withColumn("__v", F.lit(version))

    def before(self, version: int, buckets: list[int] | None = None) -> DataFrame:
        """The table as batches below ``version`` left it, of these buckets or of all.

        Base and layers are stacked and the newest row of each key is taken: one shuffle of
        what is read, and none of it is of other buckets.
        """
        based = [v for v in self.versions("base") if v < version][-1:]
        newer = [v for v in self.versions("layers") if v < version and (not based or v > based[0])]
        parts = [self._read("base", v) for v in based] + [self._read("layers", v) for v in newer]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        stacked = parts[0]
        for p in parts[1:]:
            stacked = stacked.unionByName(p)
        if buckets is not None:
            stacked = stacked.where(F.col("bucket").isin(buckets))
        return (keyed.top_per_key(stacked, self.keys, [F.desc("__v")]) if newer else stacked).select(*self.schema.names)

    def latest(self) -> DataFrame:
        return self.before(1 << 62)

    def _write(self, kind: str, version: int, df: DataFrame) -> None:
        typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn("bucket", self.bucket())
        typed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/v={version}")

    def advance(self, version: int, batch: DataFrame, step: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(rows before, rows after) of the buckets of ``batch``; ``step`` takes the old rows to the new ones and must leave other buckets' alone.

        Only rows that ``step`` changed are written, as layer ``version``.
        """
        touched = sorted(r.b for r in batch.select(self.bucket().alias("b")).distinct().collect())  # at most ``buckets`` numbers
        old = self.before(version, touched)
        new = step(old).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        self._write("layers", version, new.subtract(old))
        if len([v for v in self.versions("layers") if v > max([-1, *self.versions("base")])]) >= self.compact_every:
            self.compact(version)
        return old, self.before(version + 1, touched)

    def compact(self, version: int) -> None:
        """Write base ``version`` and drop what neither it nor a batch done again can need: the base before it and the layers since stay."""
        self._write("base", version, self.before(version + 1))
        kept = self.versions("base")[-2:]
        for kind, gone in (("base", [v for v in self.versions("base") if v not in kept]), ("layers", [v for v in self.versions("layers") if len(kept) == 2 and v <= kept[0]])):
            jvm, folder, fs = self._folder(kind)
            for v in gone:
                fs.delete(jvm.org.apache.hadoop.fs.Path(folder, f"v={v}"), True)
