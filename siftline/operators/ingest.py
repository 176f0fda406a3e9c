"""Ingest semantics: two-key de-duplication, removal sweep, company merge.

Each step is a function of (state, batch) to new state, so that a replayed batch changes
nothing and a stream can call it for every micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators import keyed

JOB_KEYS = ["company_id", "external_id"]


def dedupe_batch(batch: DataFrame, position: str = "batch_pos") -> DataFrame:
    """First occurrence by external id, then by fingerprint, within a company and batch order."""
    once = keyed.top_per_key(batch, JOB_KEYS, [position])
    named = keyed.top_per_key(once.where("fingerprint is not null"), ["company_id", "fingerprint"], [position])
    return named.unionByName(once.where("fingerprint is null"))


def split_duplicates(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh, duplicates): duplicates share company and fingerprint with a state row of another external id."""
    owners = state.where("fingerprint is not null").groupBy("company_id", "fingerprint").agg(F.min("external_id").alias("owner"))
    known = state.select(*JOB_KEYS).withColumn("__known", F.lit(True))
    tagged = batch.join(owners, ["company_id", "fingerprint"], "left").join(known, JOB_KEYS, "left")
    is_dup = F.col("owner").isNotNull() & F.col("__known").isNull() & (F.col("owner") != F.col("external_id"))
    fresh = tagged.where(~F.coalesce(is_dup, F.lit(False))).select(batch.columns)
    return fresh, tagged.where(is_dup).select(*batch.columns, "owner")


def sweep(state: DataFrame, seen: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """ACTIVE rows that were not seen become REMOVED; rows seen become ACTIVE."""
    flag = seen.select(*keys).distinct().withColumn("__seen", F.lit(True))
    joined = state.join(flag, keys, "left")
    new = F.when(F.col("__seen"), "ACTIVE").when(F.col(status) == "ACTIVE", "REMOVED").otherwise(F.col(status))
    return joined.withColumn(status, new).select(state.columns)


def apply_batch(state: DataFrame, batch: DataFrame, as_of: Column, *, full_snapshot: bool) -> DataFrame:
    """One ingest: dedupe, refresh canonical rows of duplicates, upsert, sweep (direct boards only).

    State: company_id, external_id, fingerprint, title, source, status, first_seen, last_seen.
    ``full_snapshot`` says that the batch lists everything its companies have; aggregators
    do not, and nothing is removed for them.
    """
    fresh, dups = split_duplicates(state, dedupe_batch(batch))
    new = fresh.select(*JOB_KEYS, "fingerprint", "title", "source", F.lit("ACTIVE").alias("status"), as_of.alias("first_seen"), as_of.alias("last_seen"))
    merged = keyed.upsert(state, new, JOB_KEYS, keep_old=("first_seen",), prefer_new_unless_null=("source", "fingerprint", "title"))
    touched = dups.select("company_id", F.col("owner").alias("external_id")).distinct().withColumn("__dup", F.lit(True))
    merged = merged.join(touched, JOB_KEYS, "left")
    seen = F.col("touched") | F.coalesce("__dup", F.lit(False))
    merged = merged.withColumn("last_seen", F.when(seen, as_of).otherwise(F.col("last_seen")))
    status = F.when(seen, "ACTIVE")
    if full_snapshot:
        covered = batch.select("company_id").distinct().withColumn("__covered", F.lit(True))
        merged = merged.join(covered, "company_id", "left")
        status = status.when(F.col("__covered") & (F.col("status") == "ACTIVE"), "REMOVED")
    return merged.withColumn("status", status.otherwise(F.col("status"))).select(state.columns)


#: What stands for an unknown board.
UNKNOWN = "UNKNOWN"


def bare_host(url: Column) -> Column:
    """Lower-cased host without ``www.``, null for what is no address."""
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def _board() -> Column:
    known = F.col("ats_provider").isNotNull() & (F.col("ats_provider") != UNKNOWN) & F.col("ats_identifier").isNotNull()
    return F.when(known, F.concat_ws("|", "ats_provider", "ats_identifier"))


def company_index(existing: DataFrame) -> DataFrame:
    """(kind, key, id), one id for each key: boards (0), every ending of the host at a dot (1), lower-cased names (2).

    A site answers to each ending of its host that has a dot, so that ``acme.example`` finds
    ``careers.acme.example``; the site with fewest labels more wins, then the smallest id.
    Because a key has one id, nothing that is joined to it multiplies.
    """
    labels = F.split("host", r"\.")
    e = existing.select("id", _board().alias("board"), bare_host(F.col("website")).alias("host"), F.lower("name").alias("name"))
    endings = F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.struct((i - 1).alias("more"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"))))
    by_host = e.where("host is not null").select("id", F.explode(endings).alias("x")).select(F.lit(1).alias("kind"), "x.key", "x.more", "id")
    by_board, by_name = (e.select(F.lit(kind).alias("kind"), F.col(c).alias("key"), F.lit(0).alias("more"), "id") for kind, c in ((0, "board"), (2, "name")))
    keys = by_board.unionAll(by_host).unionAll(by_name).where("key is not null and key <> ''")
    return keys.groupBy("kind", "key").agg(F.min(F.struct("more", "id")).alias("x")).select("kind", "key", F.col("x.id").alias("id"))


def match_companies(existing: DataFrame, found: DataFrame, fid: str) -> DataFrame:
    """(fid, id) of the found rows that a known company answers to, by board, then host, then name: one equi-join with unique keys."""
    asked = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in enumerate((_board(), bare_host(F.col("website")), F.lower("name")))])
    keys = found.select(F.col(fid).alias("__fid"), F.explode(asked).alias("x")).select("__fid", "x.kind", "x.key").where("key is not null and key <> ''")
    return keys.join(company_index(existing), ["kind", "key"]).groupBy("__fid").agg(F.min(F.struct("kind", "id")).alias("b")).select("__fid", F.col("b.id").alias("id"))


def merge_companies(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Bulk merge: by board id, then website host, then lower-cased name; blanks are filled, nothing overwritten.

    Columns of both: name, website, ats_provider, ats_identifier; ``existing`` also has id.
    An ``UNKNOWN`` provider is a blank, filled together with its identifier from one found row.
    Found rows without a match are appended with a null id; those that agree in the first of
    board, host and name that they have are one company, and those that have none stay apart.
    """
    fields = ("name", "website", "ats_provider", "ats_identifier")
    f = found.select(*fields).withColumn("__fid", F.monotonically_increasing_id())
    best = match_companies(existing, f, "__fid")
    matched = f.join(best, "__fid").withColumn("__board", F.when(_board().isNotNull(), F.struct("ats_provider", "ats_identifier")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__fid"))).alias(f"__f_{c}")
    fill = matched.groupBy("id").agg(first("name"), first("website"), first("__board"))
    blank = F.coalesce(F.col("ats_provider") == UNKNOWN, F.lit(True)) | F.col("ats_identifier").isNull()
    upgrade = blank & F.col("__f___board").isNotNull()
    now = {"name": F.coalesce("name", "__f_name"), "website": F.coalesce("website", "__f_website")} | {c: F.when(upgrade, F.col(f"__f___board.{c}")).otherwise(F.col(c)) for c in fields[2:]}
    kept = existing.join(fill, "id", "left").select(*[now.get(c, F.col(c)).alias(c) for c in existing.columns])
    alone = f.join(best, "__fid", "left_anti").withColumn("__same", F.coalesce(F.concat(F.lit("b"), _board()), F.concat(F.lit("h"), bare_host(F.col("website"))), F.concat(F.lit("n"), F.lower("name")), F.concat(F.lit("-"), F.col("__fid").cast("string"))))
    fresh = keyed.top_per_key(alone, ["__same"], ["__fid"])
    return kept.unionByName(fresh.select(*fields), allowMissingColumns=True)
