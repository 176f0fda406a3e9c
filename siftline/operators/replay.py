"""Stored pages, and taking them anew when the rule that reads them changes (SRC-17..19, SNK-9, STR-7).

Contents are kept once, by the hash of their bytes; a snapshot row says which content a page
had, at which address, and which version of the rule read it last.  Replay reads the contents
of the rows that are behind, each distinct (content, address) once, and replaces their
postings: what the new version no longer finds goes, what it finds comes, the rest stays.
After that no row is behind, so replaying again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators import keyed
from siftline.streaming.ingest import VersionedTable

#: A rule takes pages (page_id, url, html) to (postings with page_id and external_id, one summary row per page with page_id, jobs, strong, confidence).
Rule = Callable[[DataFrame], tuple[DataFrame, DataFrame]]

SNAPSHOT = "page_id long, url string, content string, version string, jobs long, strong long, confidence long, fetched_at timestamp, replayed_at timestamp"


def content_key(html: Column) -> Column:
    return F.sha2(F.coalesce(html, F.lit("")), 256)


def take(pages: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(postings, summaries) of pages (page_id, url, content, html), each distinct content and address read once.

    Copies of a page get the postings of the first of them under their own id.
    """
    first = F.min("page_id").over(Window.partitionBy("content", "url"))
    members = pages.select("page_id", "url", "content", "html").withColumn("__first", first)
    postings, summaries = rule(members.where("page_id = __first").select("page_id", "url", "html"))
    copies = members.select(F.col("page_id").alias("__id"), F.col("__first").alias("page_id"))
    own = lambda df: copies.join(df, "page_id").withColumn("page_id", F.col("__id")).drop("__id")
    return own(postings), own(summaries)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """page_id, external_id, change: ADDED, REMOVED or KEPT."""
    o, n = (df.select("page_id", "external_id").distinct().withColumn(flag, F.lit(True)) for df, flag in ((old, "__old"), (new, "__new")))
    change = F.when(F.col("__old").isNull(), "ADDED").when(F.col("__new").isNull(), "REMOVED").otherwise("KEPT")
    return o.join(n, ["page_id", "external_id"], "full_outer").select("page_id", "external_id", change.alias("change"))


def behind(snapshots: DataFrame, version: str, limit: int | None = None) -> DataFrame:
    """Rows that another version read; never replayed ones first, then the oldest, at most ``limit``."""
    due = snapshots.where(F.col("version") != version)
    return due if limit is None else due.orderBy(F.asc_nulls_first("replayed_at"), "fetched_at", "page_id").limit(limit)


def replay(snapshots: DataFrame, contents: DataFrame, postings: DataFrame, rule: Rule, version: str, as_of: Column, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshots, postings, changes) after replay; changes: page_id, external_id, change (ADDED, REMOVED or KEPT) of the pages taken anew."""
    due = behind(snapshots, version, limit).select("page_id", "url", "content")
    found, summaries = take(due.join(contents, "content"), rule)
    found = found.select([c for c in postings.columns if c != "version"]).withColumn("version", F.lit(version)).select(postings.columns)
    read = summaries.select("page_id", *[F.col(c).alias(f"__{c}") for c in ("jobs", "strong", "confidence")])
    fresh = snapshots.join(read, "page_id", "left")
    now = {c: F.coalesce(f"__{c}", c) for c in ("jobs", "strong", "confidence")} | {"version": F.when(F.col("__jobs").isNotNull(), version).otherwise(F.col("version")), "replayed_at": F.when(F.col("__jobs").isNotNull(), as_of).otherwise(F.col("replayed_at"))}
    fresh = fresh.withColumns(now).select(snapshots.columns)
    pages = due.select("page_id").distinct()
    old = postings.join(pages, "page_id", "left_semi")
    kept = postings.join(pages, "page_id", "left_anti").unionByName(found)
    return fresh, kept, changes(old, found)


class SnapshotStore:
    """Snapshots, contents and postings under one folder.

    Contents are appended by prefix of their key and never rewritten; the other two are
    versioned tables, so that a run that died is done again from what its predecessor wrote.
    """

    def __init__(self, spark: SparkSession, path: str, posting_schema: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.snapshots = VersionedTable(spark, f"{self.path}/snapshots", SNAPSHOT)
        self.postings = VersionedTable(spark, f"{self.path}/postings", posting_schema)

    def contents(self, prefixes: DataFrame | None = None) -> DataFrame:
        schema = "content string, html string, prefix string"
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/contents") if self._has_contents() else self.spark.createDataFrame([], schema)
        return (stored if prefixes is None else stored.join(prefixes, "prefix", "left_semi")).select("content", "html")

    def _has_contents(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/contents")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def capture(self, run: int, pages: DataFrame, rule: Rule, version: str, as_of: Column) -> None:
        """Store pages (page_id, url, html), take them by the rule, and merge both tables as version ``run``."""
        pages = pages.withColumn("content", content_key(F.col("html"))).withColumn("html", F.coalesce("html", F.lit("")))
        known = self.contents().select("content")
        fresh = keyed.insert_if_absent(known, pages.select("content", "html").dropDuplicates(["content"]), ["content"])
        fresh.withColumn("prefix", F.substring("content", 1, 2)).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(f"{self.path}/contents")
        found, summaries = take(pages, rule)
        rows = pages.select("page_id", "url", "content").join(summaries.select("page_id", "jobs", "strong", "confidence"), "page_id")
        rows = rows.select("*", F.lit(version).alias("version"), as_of.alias("fetched_at"), F.lit(None).cast("timestamp").alias("replayed_at"))
        old = self.snapshots.before(run)
        self.snapshots.write(run, old.join(rows.select("page_id"), "page_id", "left_anti").unionByName(rows.select(old.columns)))
        held = self.postings.before(run)
        columns = [c for c in held.columns if c != "version"]
        self.postings.write(run, held.join(rows.select("page_id"), "page_id", "left_anti").unionByName(found.select(columns).withColumn("version", F.lit(version))))

    def replay(self, run: int, rule: Rule, version: str, as_of: Column, limit: int | None = None) -> DataFrame:
        """Replay as version ``run``; returns the changes.  Only contents of rows that are behind are read."""
        snapshots, postings = self.snapshots.before(run), self.postings.before(run)
        prefixes = behind(snapshots, version, limit).select(F.substring("content", 1, 2).alias("prefix")).distinct()
        fresh, kept, _ = replay(snapshots, self.contents(prefixes), postings, rule, version, as_of, limit)
        # what changed is told from the versions written, so that telling does not take the pages once more
        touched = behind(snapshots, version, limit).select("page_id")
        self.snapshots.write(run, fresh)
        self.postings.write(run, kept)
        return changes(*(df.join(touched, "page_id", "left_semi") for df in (postings, self.postings.before(run + 1))))
