"""Source trust: per-source freshness counts turned into a clamped score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import common as C
from siftline.functions.scoring import source_trust_score
from siftline.session import table

#: One day after the last order; windows in days (the order table spans years).
ORDERS_AS_OF = "2001-08-02 00:00:00"
STALE_DAYS, FRESH_DAYS = 1500, 400


def source_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = C.as_of_lit(ORDERS_AS_OF)
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    active = F.col("o_orderstatus") == "O"
    counted = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("c_mktsegment", "c_nationkey")
        .agg(
            F.count(F.lit(1)).alias("seen"),
            F.count_if(active).alias("active"),
            F.count_if(F.col("o_orderstatus") == "F").alias("removed"),
            F.count_if(active & (F.col("o_orderdate") < as_of - F.expr(f"INTERVAL {STALE_DAYS} DAYS"))).alias("stale"),
            F.count_if(active & (F.col("o_orderdate") > as_of - F.expr(f"INTERVAL {FRESH_DAYS} DAYS"))).alias("fresh"),
        )
    )
    score = source_trust_score(F.lit(85), F.col("active"), F.col("stale"), F.col("fresh"))
    return counted.withColumnRenamed("c_mktsegment", "source").withColumnRenamed("c_nationkey", "nation").withColumn("trust", score)


QUERIES = {"source_trust": source_trust}

ORACLE = {
    "source_trust": """
with s as (
  select c_mktsegment as source, c_nationkey as nation, count(*) as seen,
    count(*) filter (where o_orderstatus='O') as active,
    count(*) filter (where o_orderstatus='F') as removed,
    count(*) filter (where o_orderstatus='O' and o_orderdate < timestamp '2001-08-02' - interval 1500 day) as stale,
    count(*) filter (where o_orderstatus='O' and o_orderdate > timestamp '2001-08-02' - interval 400 day) as fresh
  from orders join customer on o_custkey=c_custkey group by 1, 2)
select *, cast(case when active=0 then 85 else greatest(40, least(100,
   85 + floor(least(5.0::double, fresh::double/active*5)+0.5) - floor(least(12.0::double, stale::double/active*12)+0.5))) end as bigint) as trust
from s"""
}
