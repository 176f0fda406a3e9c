"""Joins, windows, top-k and set operators by shape (JN-*, WIN-*, SRT-*, SET-*, SNK-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import common as C
from siftline.functions import scoring as S
from siftline.operators import keyed, vectors
from siftline.plans.roles import EVENTS_AS_OF, JOBS_AS_OF, actions, companies, jobs, runs, sql
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


def _n(cond):
    return F.count_if(cond)


# --- joins ---------------------------------------------------------------------------


@query("select job_id, name, city from jobs join companies using (company_id) where status='ACTIVE' and salary > 400000")
def jobs_with_company(spark: SparkSession, d: str) -> DataFrame:
    """JN-1: inner equi join; both filters reach the scan."""
    return jobs(spark, d).where("status = 'ACTIVE' and salary > 400000").join(companies(spark, d), "company_id").select("job_id", "name", "city")


@query("""
, q as (select embedding as v from embeddings where vec_id = 0)
select vec_id, round(list_cosine_similarity(embedding::double[], q.v::double[]), 6) as similarity from embeddings, q where vec_id <> 0 order by list_cosine_similarity(embedding::double[], q.v::double[]) desc, vec_id limit 40""")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """JN-2, SRT-1, SCO-1: all rows against one query vector, top 40."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("vector"))
    hit = vectors.knn(e.where("vec_id <> 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, 40)
    return hit.select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("""
, q as (select embedding as v from embeddings where vec_id = 0), s as (select vec_id, label, list_cosine_similarity(embedding::double[], q.v::double[]) as sim from embeddings, q where vec_id <> 0)
select label, count(*) as n, round(max(sim), 6) as best from s where sim > 0.1 group by 1""")
def similarity_floor(spark: SparkSession, d: str) -> DataFrame:
    """FLT-7."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("__q")).limit(1)
    s = e.where("vec_id <> 0").crossJoin(F.broadcast(q)).withColumn("sim", vectors.cosine(F.col("embedding"), F.col("__q")))
    return s.where("sim > 0.1").groupBy("label").agg(F.count(L(1)).alias("n"), F.round(F.max("sim"), 6).alias("best"))


_BROWSE = """
, q as (select embedding as v from embeddings where vec_id = 0), s as (select vec_id, label, list_cosine_similarity(embedding::double[], q.v::double[]) as sim from embeddings, q where vec_id <> 0),
pool as (select * from s order by sim desc, vec_id limit 60),
f as (select vec_id, sim, 55 + sim*35 as fit, cast(vec_id % 60 as int) as age, vec_id % 3 = 0 as watched, vec_id % 7 = 0 as applied, 70 + label*3 as trust,
   case vec_id % 4 when 0 then 'CONTACTED' when 1 then 'FOUND' else 'NONE' end as referral, case vec_id % 5 when 0 then 'GROWING' when 1 then 'DECLINING' else 'STABLE' end as trend from pool),
r as (select vec_id, age, cast(greatest(0, least(100, floor(greatest(0, least(68, (fit-55)/35*68))+0.5) + case when age<=1 then 12 when age<=3 then 9 when age<=7 then 5 when age>45 then -8 when age>21 then -4 else 0 end
  + case referral when 'CONTACTED' then 12 when 'FOUND' then 6 else 0 end + case when watched then 8 else 0 end + case trend when 'GROWING' then 5 when 'DECLINING' then -3 else 0 end
  + case when trust>=95 then 3 when trust<=75 then -5 else 0 end + case when applied then -18 else 0 end)) as bigint) as score from f)
"""


@query(_BROWSE + "select vec_id, score, case when age<=2 then 'LOW' when age<=10 then 'MEDIUM' else 'HIGH' end as competition from r order by score desc, vec_id limit 20")
def browse_by_fit(spark: SparkSession, d: str) -> DataFrame:
    """SRT-2, SRT-3, SCO-2: retrieve a pool by similarity, re-rank with signals, cut."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("vector"))
    pool = vectors.knn(e.where("vec_id <> 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, 60)
    i = F.col("id")
    p = pool.join(e.select(F.col("vec_id").alias("id"), "label"), "id").select("id", (55 + F.col("similarity") * 35).alias("fit"), (i % 60).cast("int").alias("age"),
        F.when(i % 4 == 0, "CONTACTED").when(i % 4 == 1, "FOUND").otherwise("NONE").alias("referral"), (i % 3 == 0).alias("watched"),
        F.when(i % 5 == 0, "GROWING").when(i % 5 == 1, "DECLINING").otherwise("STABLE").alias("trend"), (i % 7 == 0).alias("applied"), (70 + F.col("label") * 3).alias("trust"))
    signals = [F.col(c) for c in ("fit", "age", "referral", "watched", "trend", "applied", "trust")]
    return p.select(F.col("id").alias("vec_id"), S.ranking_score(*signals).alias("score"), S.competition(F.col("age")).alias("competition")).orderBy(F.desc("score"), "vec_id").limit(20)


@query("""
, applied as (select distinct user_id from actions where kind='APPLIED'), dismissed as (select user_id, count(*) as n from actions where kind='DISMISSED' group by 1)
select c.company_id, a.user_id is not null as applied, d.user_id is not null as dismissed, coalesce(d.n, 0) as n from companies c left join applied a on a.user_id=c.company_id left join dismissed d on d.user_id=c.company_id""")
def flag_fan_in(spark: SparkSession, d: str) -> DataFrame:
    """JN-3, JN-20: outer joins whose null test is a flag."""
    a = actions(spark, d)
    applied = a.where("kind = 'APPLIED'").select("user_id").distinct().withColumn("a", L(True))
    gone = a.where("kind = 'DISMISSED'").groupBy("user_id").agg(F.count(L(1)).alias("n"))
    c = companies(spark, d).select("company_id").join(applied.withColumnRenamed("user_id", "company_id"), "company_id", "left").join(gone.withColumnRenamed("user_id", "company_id"), "company_id", "left")
    return c.select("company_id", F.col("a").isNotNull().alias("applied"), F.col("n").isNotNull().alias("dismissed"), F.coalesce("n", L(0)).alias("n"))


@query("select c.company_id, coalesce(bool_or(j.priority='1-URGENT'), false) as urgent, count(j.job_id) > 0 as has_jobs from companies c left join jobs j on j.company_id=c.company_id and j.status='ACTIVE' group by 1")
def lateral_flags(spark: SparkSession, d: str) -> DataFrame:
    """JN-4, FN-10: a lateral aggregate becomes a pre-aggregated left join."""
    j = jobs(spark, d).where("status = 'ACTIVE'").groupBy("company_id").agg(F.bool_or(F.col("priority") == "1-URGENT").alias("urgent"))
    return companies(spark, d).select("company_id").join(j, "company_id", "left").select("company_id", F.coalesce("urgent", L(False)).alias("urgent"), F.col("urgent").isNotNull().alias("has_jobs"))


@query("select i.a as n, i.b as word from (select unnest([1,2,3]) as a, unnest(['x','y','z']) as b) i")
def zipped_arrays(spark: SparkSession, d: str) -> DataFrame:
    """JN-7, FN-11: several arrays to rows."""
    return spark.range(1).select(F.array(*map(L, (1, 2, 3))).alias("a"), F.array(*map(L, "xyz")).alias("b")).select(F.inline(F.arrays_zip("a", "b")).alias("n", "word"))


@query("select job_id from jobs j where status='ACTIVE' and not exists (select 1 from runs r where r.job_id=j.job_id and r.started_at > timestamp '1999-01-01')")
def unmatched_jobs(spark: SparkSession, d: str) -> DataFrame:
    """JN-8: anti join against a right side that is filtered first."""
    r = runs(spark, d).where(F.col("started_at") > C.as_of_lit("1999-01-01 00:00:00")).select("job_id")
    return jobs(spark, d).where("status = 'ACTIVE'").select("job_id").join(r, "job_id", "left_anti")


@query("select company_id, exists (select 1 from actions a where a.user_id=c.company_id and kind='APPLIED') as watched, confidence from companies c order by exists (select 1 from actions a where a.user_id=c.company_id and kind='APPLIED') desc, confidence desc, company_id limit 25")
def watched_first(spark: SparkSession, d: str) -> DataFrame:
    """JN-10, SRT-5, FLT-16: the EXISTS sort key becomes a join flag."""
    w = actions(spark, d).where("kind = 'APPLIED'").select(F.col("user_id").alias("company_id")).distinct().withColumn("w", L(True))
    c = companies(spark, d).select("company_id", "confidence").join(w, "company_id", "left").withColumn("watched", F.col("w").isNotNull()).drop("w")
    return c.orderBy(F.desc("watched"), F.desc("confidence"), "company_id").limit(25)


@query("select count(*) as with_jobs, (select count(*) from companies c where not exists (select 1 from jobs j where j.company_id=c.company_id)) as without_jobs from companies c where exists (select 1 from jobs j where j.company_id=c.company_id)")
def relation_some_none(spark: SparkSession, d: str) -> DataFrame:
    """JN-11."""
    c, k = companies(spark, d).select("company_id"), jobs(spark, d).select("company_id")
    return c.join(k, "company_id", "left_semi").agg(F.count(L(1)).alias("with_jobs")).crossJoin(c.join(k, "company_id", "left_anti").agg(F.count(L(1)).alias("without_jobs")))


@query("select job_id, part_id, started_at, started_at < max(started_at) over (partition by job_id) as superseded from runs")
def superseded_rows(spark: SparkSession, d: str) -> DataFrame:
    """JN-12: "a newer row exists" as a window, not a self join."""
    newest = F.max("started_at").over(Window.partitionBy("job_id"))
    return runs(spark, d).select("job_id", "part_id", "started_at", (F.col("started_at") < newest).alias("superseded"))


@query("select c.company_id, c.confidence >= 50 as due, timestamp '2001-08-02' as claimed_at, name from companies c order by confidence desc, company_id limit 25")
def claimed_batch(spark: SparkSession, d: str) -> DataFrame:
    """JN-13, SNK-12: the top rows due, stamped and returned with their names."""
    due = companies(spark, d).orderBy(F.desc("confidence"), "company_id").limit(25)
    return due.select("company_id", (F.col("confidence") >= 50).alias("due"), C.as_of_lit(JOBS_AS_OF).alias("claimed_at"), "name")


@query("select job_id, salary, (select max(salary) from jobs where status='ACTIVE') as top, (select job_id from jobs order by posted_at desc, job_id limit 1) as newest from jobs where salary > 490000")
def scalar_subqueries(spark: SparkSession, d: str) -> DataFrame:
    """JN-15, JN-18: one-row sides, broadcast because they are one row."""
    j = jobs(spark, d)
    top = j.where("status = 'ACTIVE'").agg(F.max("salary").alias("top"))
    newest = j.agg(F.max_by("job_id", F.struct("posted_at", -F.col("job_id"))).alias("newest"))
    return j.where("salary > 490000").select("job_id", "salary").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(newest))


@query("""
, refs as (select lower(p_brand) as brand, count(*) as n from part group by 1)
select s_suppkey as company_key, coalesce(sum(n), 0)::bigint as contacts from supplier left join refs on brand = lower('Brand#' || (s_suppkey % 30)) group by 1""")
def contacts_by_name(spark: SparkSession, d: str) -> DataFrame:
    """JN-16, FLT-9: join by lower-cased name; differently cased names add up."""
    refs = table(spark, d, "part").groupBy(F.lower("p_brand").alias("brand")).agg(F.count(L(1)).alias("n"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_key"), F.lower(F.concat(L("Brand#"), (F.col("s_suppkey") % 30).cast("string"))).alias("brand"))
    return s.join(refs, "brand", "left").groupBy("company_key").agg(F.coalesce(F.sum("n"), L(0)).alias("contacts"))


@query("""
select e.event_id, (select max_by(score, ts) from actions a where a.user_id=e.user_id and a.kind='SHOWN' and a.ts <= e.ts) as shown_score from actions e where e.kind='APPLIED'""")
def score_as_of_action(spark: SparkSession, d: str) -> DataFrame:
    """JN-17, STR-12, SNK-10: the newest impression of a user at or before the action, by one sweep."""
    a = actions(spark, d)
    shown = a.where("kind = 'SHOWN'").select("user_id", "ts", F.col("score").alias("shown_score"))
    out = keyed.as_of_join(a.where("kind = 'APPLIED'").select("event_id", "user_id", "ts"), shown, ["user_id"], "ts", "ts", ["shown_score"])
    return out.select("event_id", "shown_score")


@query("""
, f as (select job_id, company_id, priority || '|' || cast(year(posted_at) as varchar) as fp from jobs), o as (select company_id, fp, min(job_id) as owner from f group by 1, 2)
select f.job_id, o.owner from f join o using (company_id, fp) where f.job_id <> o.owner""")
def fingerprint_owner(spark: SparkSession, d: str) -> DataFrame:
    """JN-19: same company and fingerprint, another id."""
    f = jobs(spark, d).select("job_id", "company_id", F.concat_ws("|", "priority", F.year("posted_at").cast("string")).alias("fp"))
    own = F.min("job_id").over(Window.partitionBy("company_id", "fp"))
    return f.select("job_id", own.alias("owner")).where("job_id <> owner")


@query("""
, v as (select embedding as q from embeddings where vec_id = 1), x as (select e.vec_id, e.label, case when l.toxic is null then null else list_cosine_similarity(embedding::double[], v.q::double[]) end as sim from embeddings e left join labels l on l.doc_id=e.vec_id, v)
select label, count(*) as n, count(sim) as labelled, round(avg(sim), 6) as mean from x group by 1""")
def cte_chain(spark: SparkSession, d: str) -> DataFrame:
    """JN-21, FN-6: one-row side, left joins, null-safe similarity."""
    e = table(spark, d, "embeddings")
    v = e.where("vec_id = 1").select(F.col("embedding").alias("__q")).limit(1)
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "toxic")
    x = e.join(lab, "vec_id", "left").crossJoin(F.broadcast(v)).withColumn("sim", F.when(F.col("toxic").isNotNull(), vectors.cosine(F.col("embedding"), F.col("__q"))))
    return x.groupBy("label").agg(F.count(L(1)).alias("n"), F.count("sim").alias("labelled"), F.round(F.avg("sim"), 6).alias("mean"))


@query("""
, v as (select embedding as q from embeddings where vec_id = 0)
select e.vec_id, round(list_cosine_similarity(embedding::double[], v.q::double[]), 6) as sim, exists(select 1 from labels l where l.doc_id=e.vec_id and toxic=1) as applied from embeddings e, v where label in (2, 5)""")
def knn_of_watched(spark: SparkSession, d: str) -> DataFrame:
    """JN-22, FLT-8: keys are restricted before the similarity."""
    e = table(spark, d, "embeddings")
    v = e.where("vec_id = 0").select(F.col("embedding").alias("__q")).limit(1)
    tox = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id")).distinct().withColumn("t", L(True))
    x = e.where(F.col("label").isin(2, 5)).crossJoin(F.broadcast(v)).join(tox, "vec_id", "left")
    return x.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("__q")), 6).alias("sim"), F.col("t").isNotNull().alias("applied"))


@query("select c.company_id, name, count(j.job_id) as active from companies c left join jobs j on j.company_id=c.company_id and j.status='ACTIVE' where name ilike '%0001%' group by 1, 2")
def company_search(spark: SparkSession, d: str) -> DataFrame:
    """JN-23, FLT-9: children counted per parent, parents without any kept."""
    j = jobs(spark, d).where("status = 'ACTIVE'").groupBy("company_id").agg(F.count(L(1)).alias("active"))
    return companies(spark, d).where(F.lower("name").contains("0001")).join(j, "company_id", "left").select("company_id", "name", F.coalesce("active", L(0)).alias("active"))


@query("""
, r as (select job_id, started_at, state, row_number() over (partition by job_id order by started_at desc, part_id, pages, seconds) as rn from runs)
select job_id, count(*) as n, string_agg(state, ',' order by rn) as states from r where rn <= 5 group by 1""")
def nested_children(spark: SparkSession, d: str) -> DataFrame:
    """JN-24, WIN-8: the newest five children of each parent as one array."""
    r = keyed.ranked_per_key(runs(spark, d), ["job_id"], [F.desc("started_at"), "part_id", "pages", "seconds"]).where("rn <= 5")
    g = r.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("rn", "state"))).alias("c"))
    return g.select("job_id", F.size("c").cast("long").alias("n"), F.array_join(F.col("c.state"), ",").alias("states"))


# --- windows -------------------------------------------------------------------------


@query("select conv_id, max(turn) as turn, max_by(role, turn) as role, max_by(length(text), turn) as chars from conversations group by 1")
def latest_turn(spark: SparkSession, d: str) -> DataFrame:
    """WIN-1: the newest row per key."""
    c = keyed.top_per_key(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")])
    return c.select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("""
, r as (select doc_id, row_number() over (partition by lang, sha256(text) order by doc_id) as rn from documents) select doc_id from r where rn = 1""")
def first_in_batch(spark: SparkSession, d: str) -> DataFrame:
    """WIN-2, STR-2: the first occurrence of a key in batch order."""
    t = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("head"))
    return keyed.top_per_key(t, ["lang", "head"], ["doc_id"]).select("doc_id")


@query("""
, w as (select company_id, job_id, salary, row_number() over (partition by company_id order by salary desc, job_id) as rn, count(*) over (partition by company_id) as total,
  cast(sum(case when posted_at > timestamp '2001-08-02' - interval 100 day then 1 else 0 end) over (partition by company_id) as bigint) as fresh from jobs where status='ACTIVE')
select company_id, job_id, salary, rn, total, fresh from w where rn <= 5""")
def watchlist_roles(spark: SparkSession, d: str) -> DataFrame:
    """WIN-3: top five of each company beside its totals."""
    j = jobs(spark, d).where("status = 'ACTIVE'")
    w = Window.partitionBy("company_id")
    fresh = (F.col("posted_at") > C.as_of_lit(JOBS_AS_OF) - F.expr("INTERVAL 100 DAYS")).cast("int")
    j = j.withColumn("rn", F.row_number().over(w.orderBy(F.desc("salary"), "job_id"))).withColumn("total", F.count(L(1)).over(w)).withColumn("fresh", F.sum(fresh).over(w))
    return j.where("rn <= 5").select("company_id", "job_id", "salary", "rn", "total", "fresh")


@query("select user_id, event_id, row_number() over (partition by user_id order by score desc, event_id) as rank from actions where kind='SHOWN'")
def impression_rank(spark: SparkSession, d: str) -> DataFrame:
    """WIN-5, SNK-11: rank position within one rendered list (a user's)."""
    return keyed.ranked_per_key(actions(spark, d).where("kind = 'SHOWN'"), ["user_id"], [F.desc("score"), "event_id"], "rank").select("user_id", "event_id", "rank")


@query("select event_id, user_id, kind as to_status, lag(kind) over (partition by user_id order by ts, event_id) as from_status, kind='APPLIED' and count(*) filter (where kind='APPLIED') over (partition by user_id order by ts, event_id)=1 as stamps from actions")
def status_log(spark: SparkSession, d: str) -> DataFrame:
    """WIN-8, STR-13: from and to of each change; the first APPLIED stamps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    applied = F.col("kind") == "APPLIED"
    nth = F.sum(applied.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return actions(spark, d).select("event_id", "user_id", F.col("kind").alias("to_status"), F.lag("kind").over(w).alias("from_status"), (applied & (nth == 1)).alias("stamps"))


@query("select company_id, count(*) + 1 as next_version, max(job_id) as newest from jobs group by 1")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    """WIN-9: numbering within a key, and the next number."""
    j = keyed.ranked_per_key(jobs(spark, d).select("company_id", "job_id"), ["company_id"], ["job_id"], "version")
    return j.groupBy("company_id").agg((F.max("version") + 1).cast("long").alias("next_version"), F.max("job_id").alias("newest"))


# --- sorts ---------------------------------------------------------------------------


@query("select company_id, name, case when confidence>=80 then 'HOT' when confidence>=50 then 'WARM' when confidence>=20 then 'COLD' else 'DORMANT' end as tier from companies order by case when confidence>=80 then 0 when confidence>=50 then 1 when confidence>=20 then 2 else 3 end, name limit 400")
def tier_order(spark: SparkSession, d: str) -> DataFrame:
    """SRT-7: an enum sorts by its declaration."""
    conf = F.col("confidence")
    tier = F.when(conf >= 80, "HOT").when(conf >= 50, "WARM").when(conf >= 20, "COLD").otherwise("DORMANT")
    order = F.array_position(F.array(*map(L, ("HOT", "WARM", "COLD", "DORMANT"))), F.col("tier"))
    return companies(spark, d).select("company_id", "name", tier.alias("tier")).orderBy(order, "name").limit(400)


@query("""
, t as (select conv_id, max(turn) as nudges, count(*) filter (where role='user') as sent, cast(conv_id % 12 as int) as days from conversations group by 1),
a as (select *, case when nudges=0 then days>=3 else days>=5 end as due from t)
select conv_id, due, days, case when due and days >= 8 then 3 when due then 2 else 0 end as urgency from a order by due desc, urgency desc, days desc, conv_id limit 30""")
def outreach_inbox(spark: SparkSession, d: str) -> DataFrame:
    """SRT-8, SCO-24: due first, then urgency, then age."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("nudges")).withColumn("days", (F.col("conv_id") % 12).cast("int"))
    due = F.when(F.col("nudges") == 0, F.col("days") >= 3).otherwise(F.col("days") >= 5)
    a = t.withColumn("due", due).withColumn("urgency", F.when(due & (F.col("days") >= 8), 3).when(due, 2).otherwise(0))
    return a.select("conv_id", "due", "days", "urgency").orderBy(F.desc("due"), F.desc("urgency"), F.desc("days"), "conv_id").limit(30)


@query("""
, acts as (select 'apply' as kind, 0 as o, job_id as id, 3 as stars from jobs where status='ACTIVE' and salary > 495000 union all
 select 'follow_up', 1, event_id, 2 from actions where kind='APPLIED' and score > 40 union all select 'review', 2, company_id, 1 from companies where confidence > 98)
select kind, id, stars from acts order by stars desc, o, id limit 7""")
def action_plan(spark: SparkSession, d: str) -> DataFrame:
    """SRT-9, SET-7: producers appended, then one multi-key limit."""
    a = jobs(spark, d).where("status = 'ACTIVE' and salary > 495000").select(L("apply").alias("kind"), L(0).alias("o"), F.col("job_id").alias("id"), L(3).alias("stars"))
    b = actions(spark, d).where("kind = 'APPLIED' and score > 40").select(L("follow_up").alias("kind"), L(1).alias("o"), F.col("event_id").alias("id"), L(2).alias("stars"))
    c = companies(spark, d).where("confidence > 98").select(L("review").alias("kind"), L(2).alias("o"), F.col("company_id").alias("id"), L(1).alias("stars"))
    return a.unionByName(b).unionByName(c).orderBy(F.desc("stars"), "o", "id").limit(7).drop("o")


@query("select job_id from jobs where status='ACTIVE' and (posted_at < timestamp '1996-01-01' or (priority='1-URGENT' and posted_at < timestamp '1997-01-01')) order by posted_at asc nulls first, job_id limit 50")
def cooldown_due(spark: SparkSession, d: str) -> DataFrame:
    """FLT-10, FLT-11, FLT-18, SRT-4, STR-16: an OR of ANDs, never-processed rows first."""
    t = F.col("posted_at")
    due = (t < C.as_of_lit("1996-01-01 00:00:00")) | ((F.col("priority") == "1-URGENT") & (t < C.as_of_lit("1997-01-01 00:00:00")))
    return jobs(spark, d).where((F.col("status") == "ACTIVE") & due).orderBy(F.asc_nulls_first("posted_at"), "job_id").limit(50).select("job_id")


# --- sets over arrays ----------------------------------------------------------------


@query("""
, t as (select p_partkey, list_distinct(list_concat(string_split(p_name,' '), [lower(p_type)])) as want, ['red','bolt','small'] as have from part)
select p_partkey, len(want) as n, len(list_filter(want, lambda x: list_contains(have, x))) as strong, len(list_filter(want, lambda x: not list_contains(have, x))) as missing from t""")
def skill_partition(spark: SparkSession, d: str) -> DataFrame:
    """SET-1, SET-2, SET-3: union of arrays, split by another."""
    have = F.array(*map(L, ("red", "bolt", "small")))
    t = table(spark, d, "part").select("p_partkey", F.array_union(F.split("p_name", " "), F.array(F.lower("p_type"))).alias("want"))
    big = lambda c: F.size(c).cast("long")
    return t.select("p_partkey", big("want").alias("n"), big(F.array_intersect("want", have)).alias("strong"), big(F.array_except("want", have)).alias("missing"))


@query("""
, old as (select job_id, company_id, salary from jobs where job_id % 3 <> 0), new as (select job_id, company_id, salary + 1 as salary from jobs where job_id % 2 = 0)
select coalesce(n.job_id, o.job_id) as job_id, coalesce(n.salary, o.salary) as salary, o.job_id is null as inserted from old o full join new n on n.job_id=o.job_id""")
def upsert_jobs(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1, FN-17: full outer rebuild; inserted means the key was not there."""
    j = jobs(spark, d).select("job_id", "company_id", "salary")
    out = keyed.upsert(j.where("job_id % 3 <> 0"), j.where("job_id % 2 = 0").withColumn("salary", F.col("salary") + 1), ["job_id"], prefer_new_unless_null=("salary",))
    return out.select("job_id", "salary", "inserted")


@query("""
, crawled as (select job_id from jobs where job_id % 5 <> 0)
select j.job_id, case when status='ACTIVE' and c.job_id is null then 'REMOVED' when c.job_id is not null then 'ACTIVE' else status end as status from jobs j left join crawled c using (job_id)""")
def removal_sweep(spark: SparkSession, d: str) -> DataFrame:
    """SNK-2, SNK-3, STR-3: absent rows are removed, rows seen again come back."""
    from siftline.operators.ingest import sweep

    j = jobs(spark, d).select("job_id", "company_id", "status")
    return sweep(j, j.where("job_id % 5 <> 0").select("job_id"), ["job_id"]).select("job_id", "status")


@query("""
, s as (select user_id, event_id, ts, score, max(score) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before from actions where kind='SHOWN')
select event_id, before is null or score >= before + 5 as notify from s""")
def notification_memory(spark: SparkSession, d: str) -> DataFrame:
    """STR-5: once per key unless the score rose by 5 over anything shown before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    s = actions(spark, d).where("kind = 'SHOWN'").withColumn("before", F.max("score").over(w))
    return s.select("event_id", (F.col("before").isNull() | (F.col("score") >= F.col("before") + 5)).alias("notify"))


@query("select strftime(ts + interval 330 minute, '%Y-%m-%d') as local_day, extract(hour from ts + interval 330 minute)::int as local_hour, count(*) as n from actions group by 1, 2")
def local_hours(spark: SparkSession, d: str) -> DataFrame:
    """DT-9: fixed +5:30 local day and hour."""
    t = F.col("ts") + F.expr("INTERVAL 330 MINUTES")
    return actions(spark, d).groupBy(F.date_format(t, "yyyy-MM-dd").alias("local_day"), F.hour(t).alias("local_hour")).agg(F.count(L(1)).alias("n"))


@query("""
select job_id, date_diff('day', posted_at, timestamp '2001-08-02') as calendar_age, cast(floor((epoch_us(timestamp '2001-08-02 10:00:00') - epoch_us(posted_at))/86400000000.0) as bigint) as elapsed_age,
 round((epoch_us(timestamp '2001-08-02 10:00:00') - epoch_us(posted_at))/86400000000.0, 6) as fractional, strftime(date_trunc('month', posted_at), '%Y-%m') as month from jobs""")
def job_ages(spark: SparkSession, d: str) -> DataFrame:
    """DT-1..5, FLT-12."""
    at = C.as_of_lit("2001-08-02 10:00:00")
    return jobs(spark, d).select("job_id", C.calendar_age(at, "posted_at").cast("long").alias("calendar_age"), C.elapsed_days(at, "posted_at").alias("elapsed_age"), F.round(C.fractional_days(at, "posted_at"), 6).alias("fractional"), F.date_format(F.date_trunc("month", "posted_at"), "yyyy-MM").alias("month"))


@query("""
, b as (select event_id, ts, date_trunc('day', ts - interval 150 minute) + interval 150 minute as boundary from actions)
select boundary, count(*) as n from b where ts <= timestamp '2024-01-31' group by 1""")
def daily_boundary(spark: SparkSession, d: str) -> DataFrame:
    """DT-8: days that begin at 02:30 UTC."""
    b = F.date_trunc("day", F.col("ts") - F.expr("INTERVAL 150 MINUTES")) + F.expr("INTERVAL 150 MINUTES")
    return actions(spark, d).where(F.col("ts") <= C.as_of_lit(EVENTS_AS_OF)).groupBy(b.cast("timestamp_ntz").alias("boundary")).agg(F.count(L(1)).alias("n"))
