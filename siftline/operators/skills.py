"""Skills of resume versions: links replaced by version, a vocabulary that grows, vectors that are replaced (SNK-16).

The key of a skill is a hash of its name, so links need no look-up and a step done again
writes the same keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import keyed
from siftline.session import cut

VOCABULARY, LINKS, VECTORS = "skill_id string, name string, category string", "version_id long, skill_id string, years double", "version_id long, model string, vector array<float>"


def skill_key(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 32)


def sync(vocabulary: DataFrame, links: DataFrame, parsed: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, links) after the parsed skills (version_id, pos, name, category, years) of ``versions`` (version_id) take the place of what these had.

    Names are trimmed and lower-cased, empty ones skipped.  A skill that the vocabulary has
    stays as it is, a new one gets the category of its first mention; of a version's
    repeated mentions the last one's years count.  A version without skills loses its links.
    """
    rows = parsed.withColumn("name", F.lower(F.trim("name"))).where("name <> ''").withColumn("skill_id", skill_key(F.col("name")))
    first = keyed.top_per_key(rows, ["skill_id"], ["version_id", "pos"]).select("skill_id", "name", "category")
    grown = vocabulary.unionByName(keyed.insert_if_absent(vocabulary, first, ["skill_id"]))
    own = keyed.top_per_key(rows.join(versions, "version_id", "left_semi"), ["version_id", "skill_id"], [F.desc("pos")]).select("version_id", "skill_id", "years")
    return grown, links.join(versions, "version_id", "left_anti").unionByName(own)


class SkillStore:
    """Vocabulary, links and vectors under one folder; links and vectors lie in buckets of versions.

    A step reads and overwrites the buckets of its own versions only, each as a whole.  It is
    safe to do again after it died anywhere: the vocabulary takes only keys that it lacks, and
    a bucket written twice is the same bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("version_id"), F.lit(self.buckets)).cast("int")

    def _exists(self, name: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def read(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema + ("" if schema == VOCABULARY else ", bucket int")).parquet(f"{self.path}/{name}")
        return df if buckets is None else df.where(F.col("bucket").isin(buckets)).drop("bucket")

    def step(self, parsed: DataFrame, versions: DataFrame, vectors: DataFrame) -> None:
        """Sync the skills of ``versions`` and replace the vectors (version_id, model, vector) that are given."""
        touched = sorted(r.b for r in versions.unionByName(vectors.select("version_id")).select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets`` numbers
        old, links = self.read("vocabulary", VOCABULARY), self.read("links", LINKS, touched)
        grown, synced = sync(old, links, parsed, versions)
        held = self.read("vectors", VECTORS, touched)
        replaced = held.join(vectors, "version_id", "left_anti").unionByName(keyed.top_per_key(vectors, ["version_id"], ["model"]))
        fresh, synced, replaced = (cut(df) for df in (keyed.insert_if_absent(old, grown, ["skill_id"]), synced, replaced))  # what is overwritten may not be read meanwhile
        fresh.write.mode("append").parquet(f"{self.path}/vocabulary")
        for name, df in (("links", synced), ("vectors", replaced)):
            self._replace(name, df, touched)

    def _replace(self, name: str, df: DataFrame, touched: list[int]) -> None:
        rows = df.withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
        left = {r.bucket for r in rows.select("bucket").distinct().collect()}
        for b in [b for b in touched if b not in left]:  # a bucket that holds nothing now has no files that could replace its old ones
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/bucket={b}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
