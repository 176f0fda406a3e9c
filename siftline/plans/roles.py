"""Role views: the driver tables seen as jobs, companies, runs, actions and so on.

The mapping only chooses inputs; the operators take any frames with these columns.  The
same views as SQL text (``SQL``) head the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import table

JOBS_AS_OF = "2001-08-02 00:00:00"
RUNS_AS_OF = "2001-11-05 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """job_id, company_id, posted_at, status, salary, priority."""
    status = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "F", "REMOVED").otherwise("EXPIRED")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("posted_at"),
        status.alias("status"), F.col("o_totalprice").alias("salary"), F.col("o_orderpriority").alias("priority"))


def companies(spark: SparkSession, d: str) -> DataFrame:
    """company_id, name, source, city, confidence (0-100 from the balance)."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(F.col("c_acctbal") / 100).cast("double")))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("source"), "city", conf.alias("confidence"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """job_id, part_id, company_key, started_at, state, pages, seconds, found (crawl and extraction runs)."""
    state = F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_returnflag") == "A", "SUCCEEDED").otherwise("PARTIAL")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("company_key"), F.col("l_shipdate").alias("started_at"),
        state.alias("state"), F.col("l_quantity").alias("pages"), F.col("l_extendedprice").alias("seconds"), F.col("l_linenumber").alias("found"))


def actions(spark: SparkSession, d: str) -> DataFrame:
    """event_id, ts, user_id, kind, score, module."""
    kind = F.when(F.col("event_type") == "view", "SHOWN").when(F.col("event_type") == "click", "CLICKED").when(F.col("event_type") == "purchase", "APPLIED").when(F.col("event_type") == "error", "DISMISSED").otherwise("OTHER")
    return table(spark, d, "events").select("event_id", "ts", "user_id", kind.alias("kind"), F.col("value").alias("score"), F.get_json_object("props", "$.k").cast("int").alias("module"))


SQL = """
jobs as (select o_orderkey as job_id, o_custkey as company_id, o_orderdate as posted_at,
  case o_orderstatus when 'O' then 'ACTIVE' when 'F' then 'REMOVED' else 'EXPIRED' end as status, o_totalprice as salary, o_orderpriority as priority from orders),
companies as (select c_custkey as company_id, c_name as name, c_mktsegment as source, n_name as city,
  greatest(0.0::double, least(100.0::double, floor(c_acctbal/100)::double)) as confidence from customer join nation on c_nationkey = n_nationkey),
runs as (select l_orderkey as job_id, l_partkey as part_id, l_suppkey as company_key, l_shipdate as started_at,
  case l_returnflag when 'R' then 'FAILED' when 'A' then 'SUCCEEDED' else 'PARTIAL' end as state, l_quantity as pages, l_extendedprice as seconds, l_linenumber as found from lineitem),
actions as (select event_id, ts, user_id, case event_type when 'view' then 'SHOWN' when 'click' then 'CLICKED' when 'purchase' then 'APPLIED' when 'error' then 'DISMISSED' else 'OTHER' end as kind,
  value as score, cast(json_extract_string(props, '$.k') as int) as module from events)
"""


def sql(body: str) -> str:
    """Oracle text: the role views, then ``body`` (which may add CTEs after a leading comma)."""
    body = body.strip()
    return f"with {SQL.strip()}{'' if body.startswith(',') else ' '}{body}"
