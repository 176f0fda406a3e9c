"""Grouped reports: funnels, coverage, freshness, health, conversion (AGG-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import common as C
from siftline.functions import scoring as S
from siftline.plans.roles import EVENTS_AS_OF, JOBS_AS_OF, RUNS_AS_OF, actions, companies, jobs, runs, sql
from siftline.session import table

L = F.lit
QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add


def days_ago(as_of: str, n: int) -> Column:
    return C.as_of_lit(as_of) - F.expr(f"INTERVAL {n} DAYS")


def _n(cond: Column) -> Column:
    return F.count_if(cond)


# --- companies (AGG-1, AGG-2, SCO-7, SCO-8, FLT-6, WIN-7, SRT-11) --------------------

DEPARTMENTS = {"rings": "ring", "bolts": "bolt|rod", "plates": "plate", "gears": "gear", "hot": r"\bhot\b", "new": r"\bnew\b"}


@query("""
, counted as (select j.company_id,
   count(*) filter (where status='ACTIVE') as active,
   count(*) filter (where posted_at > timestamp '2001-08-02' - interval 400 day) as recent,
   count(*) filter (where posted_at between timestamp '2001-08-02' - interval 800 day and timestamp '2001-08-02' - interval 400 day) as prior,
   max(posted_at) as last_job, min(posted_at) as first_job from jobs j group by 1 having count(*) filter (where status='ACTIVE') > 0),
scored as (select *, cast(floor((epoch_us(timestamp '2001-08-02') - epoch_us(last_job))/86400000000.0) as bigint) as days_since,
   case when not floor((epoch_us(timestamp '2001-08-02') - epoch_us(first_job))/86400000000.0) > 45 or (recent=0 and prior=0) then 'INSUFFICIENT_DATA'
        when prior=0 then case when recent>=2 then 'GROWING' else 'STABLE' end
        when recent > prior*1.25 then 'GROWING' when recent < prior*0.75 then 'DECLINING' else 'STABLE' end as trend from counted)
select company_id, active, recent, prior, last_job, first_job, days_since, trend,
  cast(greatest(0, least(100, least(35, active*4) + least(35, recent*7) + case trend when 'GROWING' then 20 when 'STABLE' then 10 when 'DECLINING' then -5 else 0 end
   + case when days_since<=7 then 10 when days_since<=21 then 4 when days_since>60 then -10 else 0 end)) as bigint) as growth
from scored""")
def company_signals(spark: SparkSession, d: str) -> DataFrame:
    as_of = C.as_of_lit(JOBS_AS_OF)
    t = F.col("posted_at")
    g = jobs(spark, d).groupBy("company_id").agg(
        _n(F.col("status") == "ACTIVE").alias("active"), _n(t > days_ago(JOBS_AS_OF, 400)).alias("recent"),
        _n(t.between(days_ago(JOBS_AS_OF, 800), days_ago(JOBS_AS_OF, 400))).alias("prior"), F.max(t).alias("last_job"), F.min(t).alias("first_job")).where("active > 0")
    g = g.withColumn("days_since", C.elapsed_days(as_of, "last_job"))
    g = g.withColumn("trend", S.hiring_trend(F.col("recent"), F.col("prior"), C.elapsed_days(as_of, "first_job") > 45))
    return g.withColumn("growth", S.growth_score(F.col("active"), F.col("recent"), F.col("trend"), F.col("days_since")))


@query("""
, g as (select company_id, count(*) filter (where status='ACTIVE') as active, count(*) filter (where posted_at > timestamp '2001-08-02' - interval 400 day) as recent from jobs group by 1)
select company_id, active, recent from g where active > 0 order by active desc, recent desc, company_id limit 50""")
def top_growing(spark: SparkSession, d: str) -> DataFrame:
    g = jobs(spark, d).groupBy("company_id").agg(_n(F.col("status") == "ACTIVE").alias("active"), _n(F.col("posted_at") > days_ago(JOBS_AS_OF, 400)).alias("recent"))
    return g.where("active > 0").orderBy(F.desc("active"), F.desc("recent"), "company_id").limit(50)


@query(r"""
, titled as (select j.company_id, p_name from jobs j join lineitem on l_orderkey = job_id join part on p_partkey = l_partkey where status='ACTIVE')
select company_id, count(*) filter (where regexp_matches(p_name, 'ring', 'i')) as rings, count(*) filter (where regexp_matches(p_name, 'bolt|rod', 'i')) as bolts,
  count(*) filter (where regexp_matches(p_name, 'plate', 'i')) as plates, count(*) filter (where regexp_matches(p_name, 'gear', 'i')) as gears,
  count(*) filter (where regexp_matches(p_name, '\bhot\b', 'i')) as hot, count(*) filter (where regexp_matches(p_name, '\bnew\b', 'i')) as "new" from titled group by 1""")
def department_mix(spark: SparkSession, d: str) -> DataFrame:
    """Title regex counts, not exclusive (FLT-9, FN-9)."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    j = jobs(spark, d).where("status = 'ACTIVE'").select("job_id", "company_id")
    t = j.join(runs(spark, d).select("job_id", "part_id"), "job_id").join(part, F.col("part_id") == F.col("p_partkey"))
    return t.groupBy("company_id").agg(*[_n(F.col("p_name").rlike(f"(?i){p}")).alias(n) for n, p in DEPARTMENTS.items()])


@query("""
select source, cast(round_even(quantile_cont(salary, 0.5), 0) as int) as median_salary, max(salary) as top_salary
from jobs join companies using (company_id) where salary is not null and status='ACTIVE' group by 1""")
def salary_median(spark: SparkSession, d: str) -> DataFrame:
    """AGG-4: ordered-set median, cast half-even."""
    j = jobs(spark, d).where("status = 'ACTIVE' and salary is not null").join(companies(spark, d).select("company_id", "source"), "company_id")
    return j.groupBy("source").agg(F.bround(F.expr("percentile_cont(0.5) within group (order by salary)"), 0).cast("int").alias("median_salary"), F.max("salary").alias("top_salary"))


@query("""
, m as (select source, date_trunc('month', posted_at) as mon, count(*) as n from jobs join companies using(company_id)
   where posted_at > (select min(posted_at) from jobs) + interval 1 day group by 1, 2),
r as (select *, row_number() over (partition by source order by mon desc) as rn from m), newest as (select * from r where rn <= 4),
a as (select source, max(n) filter (where rn=1) as latest, avg(n) filter (where rn>1) as before from newest group by 1)
select newest.source, strftime(mon, '%Y-%m') as month, n as jobs,
 case when latest > before*1.25 then 'GROWING' when latest < before*0.75 then 'DECLINING' else 'STABLE' end as trend
from newest join a using (source)""")
def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    """AGG-5, WIN-6, STR-8: newest four months, first observed day left out, latest against the mean of the earlier."""
    j = jobs(spark, d)
    first = j.agg(F.min("posted_at").alias("first"))
    j = j.crossJoin(F.broadcast(first)).where(F.col("posted_at") > F.col("first") + F.expr("INTERVAL 1 DAY"))
    m = j.join(companies(spark, d).select("company_id", "source"), "company_id").groupBy("source", F.date_trunc("month", "posted_at").alias("mon")).agg(F.count(L(1)).alias("jobs"))
    w = Window.partitionBy("source")
    m = m.withColumn("rn", F.row_number().over(w.orderBy(F.desc("mon")))).where("rn <= 4")
    m = m.withColumn("latest", F.max(F.when(F.col("rn") == 1, F.col("jobs"))).over(w)).withColumn("before", F.avg(F.when(F.col("rn") > 1, F.col("jobs"))).over(w))
    trend = F.when(F.col("latest") > F.col("before") * 1.25, "GROWING").when(F.col("latest") < F.col("before") * 0.75, "DECLINING").otherwise("STABLE")
    return m.select("source", F.date_format("mon", "yyyy-MM").alias("month"), "jobs", trend.alias("trend"))


# --- coverage and funnels (AGG-6..9, AGG-14, AGG-19, AGG-25, JN-14) ------------------


@query("""
, per as (select c.company_id, c.city, count(j.job_id) filter (where j.status='ACTIVE') as active from companies c left join jobs j using (company_id) group by 1, 2)
select city, count(*) as companies, count(*) filter (where active > 0) as monitored, cast(sum(active) as bigint) as jobs,
  cast(floor(count(*) filter (where active>0)*100.0::double/count(*)+0.5) as bigint) as coverage
from per where city is not null and city <> '' group by 1 having count(*) >= 3 order by companies desc, city limit 30""")
def city_coverage(spark: SparkSession, d: str) -> DataFrame:
    active = jobs(spark, d).where("status = 'ACTIVE'").groupBy("company_id").agg(F.count(L(1)).alias("active"))
    per = companies(spark, d).where("city is not null and city <> ''").join(active, "company_id", "left").withColumn("active", F.coalesce("active", L(0)))
    g = per.groupBy("city").agg(F.count(L(1)).alias("companies"), _n(F.col("active") > 0).alias("monitored"), F.sum("active").alias("jobs")).where("companies >= 3")
    return g.withColumn("coverage", C.js_round(F.col("monitored") * 100.0 / F.col("companies"))).orderBy(F.desc("companies"), "city").limit(30)


@query("""
, j as (select company_id, count(*) filter (where date_diff('day', posted_at, timestamp '2001-08-02') <= 900) as fresh,
    count(*) filter (where date_diff('day', posted_at, timestamp '2001-08-02') <= 900 and priority in ('1-URGENT','2-HIGH')) as target from jobs where status='ACTIVE' group by 1)
select coalesce(source, '(none)') as source, count(*) as companies, count(*) filter (where confidence > 20) as websites, count(*) filter (where confidence > 40) as career_pages,
  count(*) filter (where confidence > 60) as monitored, cast(coalesce(sum(fresh), 0) as bigint) as fresh, cast(coalesce(sum(target), 0) as bigint) as target,
  floor(coalesce(sum(target), 0)::double/count(*)*100*10+0.5)/10 as per_100 from companies left join j using (company_id) group by 1""")
def source_funnel(spark: SparkSession, d: str) -> DataFrame:
    fresh = F.datediff(C.as_of_lit(JOBS_AS_OF), "posted_at") <= 900
    j = jobs(spark, d).where("status = 'ACTIVE'").groupBy("company_id").agg(_n(fresh).alias("fresh"), _n(fresh & F.col("priority").isin("1-URGENT", "2-HIGH")).alias("target"))
    c = companies(spark, d).join(j, "company_id", "left")
    g = c.groupBy(F.coalesce("source", L("(none)")).alias("source")).agg(
        F.count(L(1)).alias("companies"), *[_n(F.col("confidence") > x).alias(n) for n, x in (("websites", 20), ("career_pages", 40), ("monitored", 60))],
        F.coalesce(F.sum("fresh"), L(0)).alias("fresh"), F.coalesce(F.sum("target"), L(0)).alias("target"))
    return g.withColumn("per_100", C.pct1("target", "companies"))


@query("""
, staged as (select coalesce(source, 'manual') as source, case when confidence >= 70 then 'MONITORED' when confidence >= 45 then 'CAREER' when confidence >= 15 then 'WEBSITE' else 'FOUND' end as stage from companies)
select source, count(*) filter (where stage='FOUND') as found, count(*) filter (where stage='WEBSITE') as website, count(*) filter (where stage='CAREER') as career, count(*) filter (where stage='MONITORED') as monitored,
 count(*) as total, floor(count(*) filter (where stage='MONITORED')*100.0::double/count(*)*10+0.5)/10 as rate from staged group by 1""")
def stage_funnel(spark: SparkSession, d: str) -> DataFrame:
    conf = F.col("confidence")
    stage = F.when(conf >= 70, "monitored").when(conf >= 45, "career").when(conf >= 15, "website").otherwise("found")
    c = companies(spark, d).select(F.coalesce("source", L("manual")).alias("source"), stage.alias("stage"))
    stages = ["found", "website", "career", "monitored"]
    g = c.groupBy("source").pivot("stage", stages).count().na.fill(0, stages)
    g = g.withColumn("total", sum((F.col(s) for s in stages), L(0)).cast("long"))
    return g.withColumn("rate", C.pct1("monitored", "total"))


@query("""
, a as (select priority, date_diff('day', posted_at, timestamp '2001-08-02') as age, status, job_id in (select job_id from runs where state='FAILED') as matched from jobs)
select priority as provider, count(*) filter (where status='ACTIVE') as active, count(*) filter (where status='ACTIVE' and age<=400) as fresh, count(*) filter (where status='ACTIVE' and matched) as matched,
 round(100.0::double*count(*) filter (where status='ACTIVE' and age>1500)/nullif(count(*) filter (where status='ACTIVE'),0)) as zombie_pct from a group by 1 order by zombie_pct desc, provider limit 6""")
def fresh_supply(spark: SparkSession, d: str) -> DataFrame:
    """AGG-9, JN-9: the semi join inside an aggregate becomes a flag."""
    hit = runs(spark, d).where("state = 'FAILED'").select("job_id").distinct().withColumn("matched", L(True))
    j = jobs(spark, d).join(hit, "job_id", "left").withColumn("age", F.datediff(C.as_of_lit(JOBS_AS_OF), "posted_at"))
    active = F.col("status") == "ACTIVE"
    g = j.groupBy(F.col("priority").alias("provider")).agg(_n(active).alias("active"), _n(active & (F.col("age") <= 400)).alias("fresh"), _n(active & F.col("matched").isNotNull()).alias("matched"), _n(active & (F.col("age") > 1500)).alias("old"))
    return g.withColumn("zombie_pct", F.round(F.try_divide(100.0 * F.col("old"), F.col("active").cast("double")))).drop("old").orderBy(F.desc("zombie_pct"), "provider").limit(6)


@query("""
, s as (select c.company_id, count(j.job_id) filter (where j.status='ACTIVE') as active, count(j.job_id) filter (where posted_at > timestamp '2001-08-02' - interval 100 day) as new14,
   max(posted_at) as last_new, count(j.job_id) as attempts, bool_or(c.confidence >= 95) as watched from companies c left join jobs j using(company_id) group by 1),
t as (select case when watched then 'HOT' when attempts>=5 and active=0 and (last_new is null or floor((epoch_us(timestamp '2001-08-02')-epoch_us(last_new))/86400000000.0) > 120) then 'DORMANT'
   when new14>=3 then 'HOT' when new14>=1 or floor((epoch_us(timestamp '2001-08-02')-epoch_us(last_new))/86400000000.0) <= 30 then 'WARM' else 'COLD' end as tier from s)
select count(*) filter (where tier='HOT') as hot, count(*) filter (where tier='WARM') as warm, count(*) filter (where tier='COLD') as cold, count(*) filter (where tier='DORMANT') as dormant,
 floor(count(*) filter (where tier='DORMANT')*100.0::double/nullif(count(*),0)*10+0.5)/10 as dormant_pct from t""")
def tier_distribution(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14, AGG-25, SCO-5: all four tiers are present even at 0."""
    t = schedule_frame(spark, d)
    tiers = ["HOT", "WARM", "COLD", "DORMANT"]
    g = t.agg(*[_n(F.col("tier") == x).alias(x.lower()) for x in tiers], F.count(L(1)).alias("n"))
    return g.withColumn("dormant_pct", C.pct1("dormant", "n")).drop("n")


def schedule_frame(spark: SparkSession, d: str) -> DataFrame:
    as_of = C.as_of_lit(JOBS_AS_OF)
    j = jobs(spark, d).groupBy("company_id").agg(_n(F.col("status") == "ACTIVE").alias("active"), _n(F.col("posted_at") > days_ago(JOBS_AS_OF, 100)).alias("new14"), F.max("posted_at").alias("last_new"), F.count(L(1)).alias("attempts"))
    s = companies(spark, d).select("company_id", (F.col("confidence") >= 95).alias("watched")).join(j, "company_id", "left").na.fill(0, ["active", "new14", "attempts"])
    return s.withColumn("tier", S.crawl_tier(F.col("new14"), F.col("active"), C.elapsed_days(as_of, "last_new"), F.col("attempts"), F.col("watched")))


@query("""
, s as (select c.company_id, count(j.job_id) filter (where j.status='ACTIVE') as active, count(j.job_id) filter (where posted_at > timestamp '2001-08-02' - interval 100 day) as new14,
   max(posted_at) as last_new, count(j.job_id) as attempts, bool_or(c.confidence >= 95) as watched from companies c left join jobs j using(company_id) group by 1),
t as (select *, case when watched then 'HOT' when attempts>=5 and active=0 and (last_new is null or floor((epoch_us(timestamp '2001-08-02')-epoch_us(last_new))/86400000000.0) > 120) then 'DORMANT'
   when new14>=3 then 'HOT' when new14>=1 or floor((epoch_us(timestamp '2001-08-02')-epoch_us(last_new))/86400000000.0) <= 30 then 'WARM' else 'COLD' end as tier from s)
select company_id, active, new14, last_new, attempts, watched, tier, timestamp '2001-08-02' + to_minutes(case tier when 'HOT' then 30 when 'WARM' then 240 when 'COLD' then 1440 else 43200 end) as next_due from t""")
def crawl_schedule(spark: SparkSession, d: str) -> DataFrame:
    """STR-4, DT-10: tier and next due time of every company."""
    t = schedule_frame(spark, d)
    return t.withColumn("next_due", S.next_due(C.as_of_lit(JOBS_AS_OF), F.col("tier"), L(False)))


@query("""
select source, count(*) as total, count(*) filter (where status<>'EXPIRED') as applied, count(*) filter (where status='ACTIVE') as interviews, count(*) filter (where status='ACTIVE' and priority='1-URGENT') as offers,
 case when count(*) filter (where status<>'EXPIRED') >= 5 then floor(count(*) filter (where status='ACTIVE')*100.0::double/count(*) filter (where status<>'EXPIRED')*10+0.5)/10 end as interview_rate
from jobs join companies using(company_id) group by 1""")
def application_funnel(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19: the rate is null below five applications."""
    j = jobs(spark, d).join(companies(spark, d).select("company_id", "source"), "company_id")
    active = F.col("status") == "ACTIVE"
    g = j.groupBy("source").agg(F.count(L(1)).alias("total"), _n(F.col("status") != "EXPIRED").alias("applied"), _n(active).alias("interviews"), _n(active & (F.col("priority") == "1-URGENT")).alias("offers"))
    return g.withColumn("interview_rate", F.when(F.col("applied") >= 5, C.pct1("interviews", "applied")))


# --- run health (AGG-10..13, 15..18, 26, JN-5, WIN-4, FN-8) --------------------------


@query("""
select state, count(*) as runs, cast(sum(pages) as double) as pages, cast(sum(found) as bigint) as found, max(found) as most, round(avg(nullif(found - 1, 0)), 4) as avg_nonzero,
 round(sum(found)::double/nullif(sum(pages),0), 6) as found_per_page, count(distinct job_id) as jobs from runs group by 1""")
def extraction_health(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10, AGG-11, AGG-13, FN-1: zeros do not drag the mean."""
    g = runs(spark, d).groupBy("state").agg(F.count(L(1)).alias("runs"), F.sum("pages").alias("pages"), F.sum("found").alias("found"), F.max("found").alias("most"),
        F.round(F.avg(F.nullif(F.col("found") - 1, L(0))), 4).alias("avg_nonzero"), F.round(F.try_divide(F.sum("found").cast("double"), F.sum("pages")), 6).alias("found_per_page"), F.countDistinct("job_id").alias("jobs"))
    return g


@query("""
, newest as (select * from runs order by started_at desc, job_id, part_id, pages, seconds limit 100),
m as (select unnest(['short','plain','long']) as reason, unnest([case when pages<10 then 1 else 0 end, cast(found as int), cast(pages as int)]) as n from newest)
select reason, cast(sum(n) as bigint) as n from m group by 1 order by n desc, reason limit 6""")
def rejection_reasons(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: reason maps of the newest 100 runs, merged by sum."""
    newest = runs(spark, d).orderBy(F.desc("started_at"), "job_id", "part_id", "pages", "seconds").limit(100)
    m = newest.select(F.create_map(L("short"), F.when(F.col("pages") < 10, 1).otherwise(0), L("plain"), F.col("found").cast("int"), L("long"), F.col("pages").cast("int")).alias("m"))
    return m.select(F.explode("m").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "reason").limit(6)


@query("""
select substring(p_name, 1, 4) as error, count(*) as n from runs join part on part_id = p_partkey where state='FAILED' and started_at > timestamp '2001-11-05' - interval 200 day
group by 1 order by n desc, error limit 3""")
def top_errors(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15, FN-8."""
    r = runs(spark, d).where((F.col("state") == "FAILED") & (F.col("started_at") > days_ago(RUNS_AS_OF, 200)))
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return r.join(p, r.part_id == p.p_partkey).groupBy(F.left("p_name", L(4)).alias("error")).agg(F.count(L(1)).alias("n")).orderBy(F.desc("n"), "error").limit(3)


@query("""
select priority, round(avg((epoch_us(started_at) - epoch_us(posted_at))/1000000.0), 3) as avg_seconds, round(avg((epoch_us(started_at) - epoch_us(posted_at))/1000000.0)/60, 3) as avg_minutes
from runs join jobs using (job_id) group by 1""")
def average_durations(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16, DT-6."""
    r = runs(spark, d).select("job_id", "started_at").join(jobs(spark, d).select("job_id", "posted_at", "priority"), "job_id")
    s = F.avg(C.seconds_between("started_at", "posted_at"))
    return r.groupBy("priority").agg(F.round(s, 3).alias("avg_seconds"), F.round(s / 60, 3).alias("avg_minutes"))


@query("""
, w as (select company_key, state from runs where started_at > timestamp '2001-11-05' - interval 30 day)
select s_suppkey as company_key, count(state) as runs, count(*) filter (where state='FAILED') as failed,
 case when count(state) > 0 then floor(count(*) filter (where state='SUCCEEDED')*100.0::double/count(state)*10+0.5)/10 end as success_pct from supplier left join w on s_suppkey = company_key group by 1""")
def recent_health(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17: percent is null without runs."""
    w = runs(spark, d).where(F.col("started_at") > days_ago(RUNS_AS_OF, 30)).groupBy("company_key").agg(F.count(L(1)).alias("runs"), _n(F.col("state") == "FAILED").alias("failed"), _n(F.col("state") == "SUCCEEDED").alias("ok"))
    g = table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_key")).join(w, "company_key", "left").na.fill(0, ["runs", "failed", "ok"])
    return g.withColumn("success_pct", C.pct1("ok", "runs")).drop("ok")


@query("""
, r as (select company_key, state, row_number() over (partition by company_key order by started_at desc, job_id, part_id, pages, seconds) as rn from runs)
select company_key, cast(count(*) filter (where state='SUCCEEDED' and rn<=10) as double)/10 as ratio, count(*) filter (where state='SUCCEEDED' and rn<=10) >= 7 as healthy, count(*) filter (where rn<=3 and state='FAILED') = 3 as last_three_failed from r group by 1""")
def run_streaks(spark: SparkSession, d: str) -> DataFrame:
    """AGG-26, JN-5, WIN-4: last 10 and last 3 runs per company."""
    w = Window.partitionBy("company_key").orderBy(F.desc("started_at"), "job_id", "part_id", "pages", "seconds")
    r = runs(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 10")
    ok = _n(F.col("state") == "SUCCEEDED")
    return r.groupBy("company_key").agg((ok.cast("double") / 10).alias("ratio"), (ok >= 7).alias("healthy"), (_n((F.col("rn") <= 3) & (F.col("state") == "FAILED")) == 3).alias("last_three_failed"))


@query("""
, u as (select case when l_returnflag='R' then 'generate' else 'embed' end as kind, l_linestatus as model, l_quantity as tin, l_linenumber*10.0::double as tout, l_extendedprice as latency, l_shipdate as "at",
   case when l_returnflag='R' then 0.30::double when l_linestatus='O' then 0.02::double end as pin, case when l_returnflag='R' then 2.50::double when l_linestatus='O' then 0.0::double end as pout from lineitem)
select kind, model, count(*) as calls, cast(sum(tin) as double) as tokens_in, cast(sum(tout) as double) as tokens_out, round(avg(latency), 3) as avg_latency,
 round(sum((pin*tin+pout*tout)/1000000), 4) as cost, count(*) filter (where "at" >= date_trunc('month', timestamp '2001-11-01')) as this_month from u group by 1, 2""")
def usage_costs(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18, SCO-32, DT-7."""
    li = table(spark, d, "lineitem")
    gen = F.col("l_returnflag") == "R"
    u = li.select(F.when(gen, "generate").otherwise("embed").alias("kind"), F.col("l_linestatus").alias("model"), F.col("l_quantity").alias("tin"), (F.col("l_linenumber") * 10.0).alias("tout"), F.col("l_extendedprice").alias("latency"), F.col("l_shipdate").alias("at"),
        F.when(gen, 0.30).when(F.col("l_linestatus") == "O", 0.02).alias("pin"), F.when(gen, 2.50).when(F.col("l_linestatus") == "O", 0.0).alias("pout"))
    month = F.date_trunc("month", C.as_of_lit("2001-11-01 00:00:00"))
    return u.groupBy("kind", "model").agg(F.count(L(1)).alias("calls"), F.sum("tin").alias("tokens_in"), F.sum("tout").alias("tokens_out"), F.round(F.avg("latency"), 3).alias("avg_latency"),
        F.round(F.sum((F.col("pin") * F.col("tin") + F.col("pout") * F.col("tout")) / 1_000_000), 4).alias("cost"), _n(F.col("at") >= month).alias("this_month"))


# --- event analytics (AGG-20, AGG-21, SNK-10) ----------------------------------------


@query("""
, b as (select kind, module % 8 as module, score from actions)
, g as (select module, floor(coalesce(avg(score) filter (where kind in ('CLICKED','APPLIED')),0)*10+0.5)/10 as engaged, floor(coalesce(avg(score) filter (where kind='DISMISSED'),0)*10+0.5)/10 as dismissed from b group by 1)
select module, engaged, dismissed, floor((engaged - dismissed)*10+0.5)/10 as lift from g""")
def signal_lift(spark: SparkSession, d: str) -> DataFrame:
    """AGG-20: difference of rounded means; a missing side is 0."""
    b = actions(spark, d).withColumn("module", F.col("module") % 8)
    mean = lambda cond: C.round1(F.coalesce(F.avg(F.when(cond, F.col("score"))), L(0.0)))
    g = b.groupBy("module").agg(mean(F.col("kind").isin("CLICKED", "APPLIED")).alias("engaged"), mean(F.col("kind") == "DISMISSED").alias("dismissed"))
    return g.withColumn("lift", C.round1(F.col("engaged") - F.col("dismissed"))).orderBy(F.desc("lift"), "module")


@query("""
, g as (select user_id % 50 as cohort, count(*) filter (where kind='SHOWN') as shown, count(*) filter (where kind='CLICKED') as clicked, count(*) filter (where kind='DISMISSED') as dismissed, count(*) filter (where kind='APPLIED') as applied,
  floor(avg(score) filter (where kind='APPLIED')*10+0.5)/10 as mean_applied, floor(avg(score) filter (where kind='DISMISSED')*10+0.5)/10 as mean_dismissed from actions group by 1)
select *, case when shown<>0 then floor(clicked*100.0::double/shown*10+0.5)/10 end as ctr, case when shown<>0 then floor(applied*100.0::double/shown*10+0.5)/10 end as apply_rate, case when shown<>0 then floor(dismissed*100.0::double/shown*10+0.5)/10 end as dismiss_rate from g""")
def recommendation_quality(spark: SparkSession, d: str) -> DataFrame:
    """AGG-21."""
    kinds = {"shown": "SHOWN", "clicked": "CLICKED", "dismissed": "DISMISSED", "applied": "APPLIED"}
    k, mean = F.col("kind"), lambda v: C.round1(F.avg(F.when(F.col("kind") == v, F.col("score"))))
    g = actions(spark, d).groupBy((F.col("user_id") % 50).alias("cohort")).agg(*[_n(k == v).alias(n) for n, v in kinds.items()], mean("APPLIED").alias("mean_applied"), mean("DISMISSED").alias("mean_dismissed"))
    return g.select("*", C.pct1("clicked", "shown").alias("ctr"), C.pct1("applied", "shown").alias("apply_rate"), C.pct1("dismissed", "shown").alias("dismiss_rate"))


@query("""
, w as (select unnest(string_split(p_name, ' ')) as skill from runs join part on part_id=p_partkey where state in ('FAILED','PARTIAL'))
select skill, count(*) as n from w group by 1 having count(*) >= 3 order by n desc, skill limit 3""")
def skill_demand(spark: SparkSession, d: str) -> DataFrame:
    """AGG-22, AGG-23, JN-6."""
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("skills"))
    r = runs(spark, d).where(F.col("state").isin("FAILED", "PARTIAL")).select("part_id")
    return r.join(p, r.part_id == p.p_partkey).select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count(L(1)).alias("n")).where("n >= 3").orderBy(F.desc("n"), "skill").limit(3)


@query("""
select name, count(*) as n from jobs join companies using(company_id) where status='ACTIVE' and date_diff('day', posted_at, timestamp '2001-08-02') <= 300 and city in ('NATION_1','NATION_2') or (status='ACTIVE' and date_diff('day', posted_at, timestamp '2001-08-02') <= 300 and priority in ('1-URGENT'))
group by 1 order by n desc, name limit 3""")
def trending_companies(spark: SparkSession, d: str) -> DataFrame:
    """AGG-24, FLT-4, FLT-5."""
    fresh = F.datediff(C.as_of_lit(JOBS_AS_OF), "posted_at") <= 300
    region = F.col("city").isin("NATION_1", "NATION_2") | F.col("priority").isin("1-URGENT")
    j = jobs(spark, d).where((F.col("status") == "ACTIVE") & fresh).join(companies(spark, d), "company_id").where(region)
    return j.groupBy("name").agg(F.count(L(1)).alias("n")).orderBy(F.desc("n"), "name").limit(3)


@query("""
, s as (select job_id, case when salary < 100000 then 'LOW_CONFIDENCE' when salary < 250000 then 'NOT_DEVELOPMENT' else 'TARGET_ROLE_TOO_SENIOR' end as code from jobs where status='REMOVED')
select code, lower(replace(code, '_', ' ')) as label, count(*) as n, min(job_id) as first_job from s group by 1, 2""")
def rejection_buckets(spark: SparkSession, d: str) -> DataFrame:
    """AGG-27."""
    code = F.when(F.col("salary") < 100000, "LOW_CONFIDENCE").when(F.col("salary") < 250000, "NOT_DEVELOPMENT").otherwise("TARGET_ROLE_TOO_SENIOR")
    s = jobs(spark, d).where("status = 'REMOVED'").withColumn("code", code)
    return s.groupBy("code").agg(F.count(L(1)).alias("n"), F.min("job_id").alias("first_job")).withColumn("label", F.lower(F.replace("code", L("_"), L(" ")))).orderBy(F.desc("n"))


@query("""
select city, count(*) filter (where confidence >= 80) as leaders, count(*) filter (where confidence between 40 and 79) as recruiters, count(*) filter (where confidence < 40) as engineers, count(*) filter (where confidence >= 10) as contactable from companies group by 1""")
def contact_graph(spark: SparkSession, d: str) -> DataFrame:
    """AGG-28."""
    c = F.col("confidence")
    return companies(spark, d).groupBy("city").agg(_n(c >= 80).alias("leaders"), _n(c.between(40, 79)).alias("recruiters"), _n(c < 40).alias("engineers"), _n(c >= 10).alias("contactable"))


_RECONCILE = """
, r as (select job_id, pages*2 as score, row_number() over (partition by job_id order by started_at desc, part_id, pages, seconds) as rn from runs),
p as (select j.job_id, a.score as new_score, b.score as old_score from jobs j left join r a on a.job_id=j.job_id and a.rn=1 left join r b on b.job_id=j.job_id and b.rn=2)
"""


@query(_RECONCILE + """
select count(*) as inspected, count(*) filter (where new_score is not null and old_score is null) as created, count(*) filter (where abs(new_score-old_score) < 1) as unchanged,
 count(*) filter (where new_score-old_score >= 1) as up, count(*) filter (where new_score-old_score <= -1) as down, floor(avg(new_score-old_score)*10+0.5)/10 as mean_delta,
 count(*) filter (where new_score >= 75) as apply, count(*) filter (where new_score >= 60 and new_score < 75) as consider, count(*) filter (where new_score < 60) as skip from p""")
def reconcile_report(spark: SparkSession, d: str) -> DataFrame:
    """AGG-29, STR-6, JN-17: newest score of a job against the one before."""
    p = reconcile_frame(spark, d)
    delta, verdict = F.col("new_score") - F.col("old_score"), S.verdict_band(F.col("new_score"))
    has = F.col("new_score").isNotNull()
    return p.agg(F.count(L(1)).alias("inspected"), _n(has & F.col("old_score").isNull()).alias("created"), _n(F.abs(delta) < 1).alias("unchanged"), _n(delta >= 1).alias("up"), _n(delta <= -1).alias("down"),
        C.round1(F.avg(delta)).alias("mean_delta"), *[_n(has & (verdict == v)).alias(v.lower()) for v in ("APPLY", "CONSIDER", "SKIP")])


@query(_RECONCILE + "select job_id, new_score, old_score, new_score-old_score as delta from p where old_score is not null order by abs(new_score-old_score) desc, job_id limit 10")
def reconcile_movers(spark: SparkSession, d: str) -> DataFrame:
    p = reconcile_frame(spark, d).where("old_score is not null").withColumn("delta", F.col("new_score") - F.col("old_score"))
    return p.orderBy(F.abs("delta").desc(), "job_id").limit(10)


def reconcile_frame(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(F.desc("started_at"), "part_id", "pages", "seconds")
    r = runs(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 2").withColumn("score", F.col("pages") * 2)
    r = r.groupBy("job_id").agg(F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("new_score"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("old_score"))
    return jobs(spark, d).select("job_id").join(r, "job_id", "left")


@query("""
, o as (select case when salary>=300000 then 'APPLY' when salary>=150000 then 'CONSIDER' else 'SKIP' end as outcome, priority as family,
  case when date_diff('day', posted_at, timestamp '2001-08-02') <= 400 then 'fresh' when date_diff('day', posted_at, timestamp '2001-08-02') <= 1500 then 'open' else 'old' end as freshness from jobs)
select 'outcome' as what, outcome as value, count(*) as n from o group by 2 union all select 'family', family, count(*) from o group by 2 union all select 'freshness', freshness, count(*) from o group by 2""")
def shadow_distributions(spark: SparkSession, d: str) -> DataFrame:
    """AGG-30, SET-7: one pass, one row per distribution value."""
    age = F.datediff(C.as_of_lit(JOBS_AS_OF), "posted_at")
    o = jobs(spark, d).select(F.when(F.col("salary") >= 300000, "APPLY").when(F.col("salary") >= 150000, "CONSIDER").otherwise("SKIP").alias("outcome"), F.col("priority").alias("family"), F.when(age <= 400, "fresh").when(age <= 1500, "open").otherwise("old").alias("freshness"))
    return o.unpivot([], ["outcome", "family", "freshness"], "what", "value").groupBy("what", "value").agg(F.count(L(1)).alias("n"))


@query("""
select count(*) filter (where posted_at > timestamp '2001-08-02' - interval 1 day) as new_day, count(*) filter (where posted_at > timestamp '2001-08-02' - interval 30 day) as new_month,
 count(*) filter (where posted_at > timestamp '2001-08-02' - interval 30 day and priority='1-URGENT') as urgent_month, count(*) filter (where status='ACTIVE' and posted_at <= timestamp '2001-08-02' - interval 7 day) as waiting from jobs""")
def daily_headline(spark: SparkSession, d: str) -> DataFrame:
    """AGG-31."""
    t = F.col("posted_at")
    month = t > days_ago(JOBS_AS_OF, 30)
    return jobs(spark, d).agg(_n(t > days_ago(JOBS_AS_OF, 1)).alias("new_day"), _n(month).alias("new_month"), _n(month & (F.col("priority") == "1-URGENT")).alias("urgent_month"), _n((F.col("status") == "ACTIVE") & (t <= days_ago(JOBS_AS_OF, 7))).alias("waiting"))


@query("""
, f as (select j.job_id, j.status, max(case when r.state='FAILED' then 1 else 0 end) as applied, max(r.pages) as score from jobs j left join runs r using(job_id) group by 1, 2)
select count(*) as inspected, count(score) as scored, count(*) filter (where score>=45 and applied=0) as apply, count(*) filter (where score>=30 and score<45 and applied=0) as consider, count(*) filter (where score is null) as review, count(*) filter (where applied=1 and status='ACTIVE') as applied from f""")
def dashboard_decisions(spark: SparkSession, d: str) -> DataFrame:
    """AGG-32."""
    r = runs(spark, d).groupBy("job_id").agg(F.max((F.col("state") == "FAILED").cast("int")).alias("applied"), F.max("pages").alias("score"))
    f = jobs(spark, d).select("job_id", "status").join(r, "job_id", "left").withColumn("applied", F.coalesce("applied", L(0)))
    s, free = F.col("score"), F.col("applied") == 0
    return f.agg(F.count(L(1)).alias("inspected"), F.count("score").alias("scored"), _n((s >= 45) & free).alias("apply"), _n((s >= 30) & (s < 45) & free).alias("consider"), _n(s.isNull()).alias("review"), _n((F.col("applied") == 1) & (F.col("status") == "ACTIVE")).alias("applied"))


@query("""
, page as (select job_id, posted_at, (select count(*) from jobs where status='ACTIVE') as total from jobs where status='ACTIVE' order by posted_at desc nulls last, job_id limit 100 offset 200) select * from page""")
def jobs_page(spark: SparkSession, d: str) -> DataFrame:
    """AGG-33, SRT-4, SRT-10, FLT-1, FLT-14: a page and the total beside it."""
    j = jobs(spark, d).where("status = 'ACTIVE'")
    page = j.select("job_id", "posted_at").orderBy(F.desc_nulls_last("posted_at"), "job_id").offset(200).limit(100)
    return page.crossJoin(F.broadcast(j.agg(F.count(L(1)).alias("total"))))
