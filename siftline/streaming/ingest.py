"""Incremental ingest with Structured Streaming (STR-1..5, 9, 11, 14).

State lives in Parquet tables, as versions of the whole (``VersionedTable``) or as a base with
layers of changes (``layers.LayeredTable``): a batch reads what its predecessor left and
writes its own part, named by the batch id.  A batch that is replayed after a failure reads and
writes the same versions again, so replays change nothing.  Only the last batch can be
replayed, so versions older than the one it read are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siftline.operators import ingest, keyed
from siftline.streaming.layers import LayeredTable

STATE = "company_id string, external_id string, fingerprint string, title string, source string, status string, first_seen timestamp, last_seen timestamp"


class VersionedTable:
    """A table of numbered versions under one folder; the newest below a number is its input."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    def _folder(self) -> tuple:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, folder, folder.getFileSystem(conf)

    def _versions(self) -> list[int]:
        jvm, folder, fs = self._folder()
        if not fs.exists(folder):
            return []
        done = [str(s.getPath().getName()) for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(n[2:]) for n in done if n.startswith("v="))

    def before(self, version: int) -> DataFrame:
        older = [v for v in self._versions() if v < version]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={older[-1]}") if older else self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        return self.before(1 << 62)

    def write(self, version: int, df: DataFrame) -> None:
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.mode("overwrite").parquet(f"{self.path}/v={version}")
        jvm, folder, fs = self._folder()
        for old in [v for v in self._versions() if v < version][:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(folder, f"v={old}"), True)

    def advance(self, version: int, batch: DataFrame, step: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(rows before, rows after): the whole table goes through ``step`` and is written as ``version``."""
        old = self.before(version)
        self.write(version, step(old))
        return old, self.before(version + 1)


def ingest_stream(postings: DataFrame, state: VersionedTable | LayeredTable, checkpoint: str, *, full_snapshot: bool, on_new: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs every waiting micro-batch of ``postings`` (company_id, external_id, fingerprint, title, source, batch_pos, crawled_at) through ``ingest.apply_batch``.

    ``on_new`` gets the rows whose key the state did not have: the next stage of the chain.
    A ``LayeredTable`` writes what a batch changed, a ``VersionedTable`` all of the state.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            at = F.lit(batch.agg(F.max("crawled_at")).first()[0]).cast("timestamp")
            old, new = state.advance(batch_id, batch, lambda rows: ingest.apply_batch(rows, batch.drop("crawled_at"), at, full_snapshot=full_snapshot))
            if on_new is not None:
                on_new(keyed.insert_if_absent(old, new, ingest.JOB_KEYS), batch_id)
        finally:
            batch.unpersist()

    return postings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_actions(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """kind counts per event-time window with a watermark; works on streams and tables."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("at", late)
    g = e.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def distinct_stream(events: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def snapshot_actions(actions: DataFrame, scores: DataFrame) -> DataFrame:
    """Stream-static join that copies the newest decided score into each action (STR-12)."""
    newest = keyed.latest_per_key(scores, ["job_id"], "decided_at").select("job_id", "score", "verdict")
    return actions.join(newest, "job_id", "left")


def quarantine(raw: DataFrame, json_col: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejects): rows whose JSON does not parse go aside and the rest goes on (STR-14)."""
    parsed = raw.withColumn("__p", F.when(F.try_parse_json(json_col).isNotNull(), F.from_json(json_col, schema)))
    return parsed.where("__p is not null").select("__p.*"), parsed.where("__p is null").drop("__p")
