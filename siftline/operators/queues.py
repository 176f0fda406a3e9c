"""What is due: crawls, derivations, and flags that are raised by id (FLT-11, FLT-16, STR-16, SNK-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Boards that can be crawled, companies of a batch, days after which a derivation is stale.
CRAWLABLE = ("GREENHOUSE", "LEVER", "ASHBY", "WORKABLE", "SMARTRECRUITERS", "RECRUITEE", "BREEZY", "KEKA")
BATCH, STALE_DAYS = 25, 7


def crawl_due(companies: DataFrame, as_of: Column, most: int = BATCH) -> DataFrame:
    """company_id, next_crawl_at, place of the ``most`` companies (company_id, provider, identifier, next_crawl_at) whose crawl is longest due."""
    due = companies.where(F.col("provider").isin(*CRAWLABLE) & F.col("identifier").isNotNull() & (F.col("next_crawl_at") <= as_of))
    batch = due.select("company_id", "next_crawl_at").orderBy("next_crawl_at", "company_id").limit(most)
    return batch.withColumn("place", F.row_number().over(Window.orderBy("next_crawl_at", "company_id")))  # at most ``most`` rows


def derivation_due(companies: DataFrame, jobs: DataFrame, profiles: DataFrame, as_of: Column, days: int = STALE_DAYS) -> DataFrame:
    """company_id, derived_at of monitored companies (company_id, stage) with an active job (company_id, status) and no profile (company_id, derived_at) younger than ``days``."""
    active = jobs.where("status = 'ACTIVE'").select("company_id")
    held = companies.where("stage = 'MONITORED'").select("company_id").join(active, "company_id", "left_semi").join(profiles.select("company_id", "derived_at"), "company_id", "left")
    return held.where(F.col("derived_at").isNull() | (F.col("derived_at") < as_of - F.make_dt_interval(F.lit(days))))


def raise_flag(rows: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag`` true for the keys of ``ids``, and ``changed`` for those that were not true before."""
    named = ids.select(key).distinct().withColumn("__named", F.lit(True))
    up = F.coalesce("__named", F.lit(False))
    was = F.coalesce(F.col(flag), F.lit(False))
    return rows.join(named, key, "left").withColumns({"changed": up & ~was, flag: was | up}).drop("__named")
