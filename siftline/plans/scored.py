"""Scores and decisions over the driver tables (SCO-*, FN-*, STR as batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import common as C
from siftline.functions import scoring as S
from siftline.plans.roles import JOBS_AS_OF, companies, jobs, sql
from siftline.session import table
from siftline.streaming.ingest import windowed_actions

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


_CLASSIFIED = """
, c as (select job_id, company_id, salary, case job_id % 5 when 0 then 'AMBIGUOUS' when 1 then 'DATA_ENGINEERING' else 'SOFTWARE_ENGINEERING' end as fun,
  case job_id % 7 when 0 then 'BACKEND' when 1 then 'SDE' when 2 then 'FRONTEND' when 3 then 'DATA_SCIENCE' when 4 then 'FULL_STACK' when 5 then 'REACT' else 'OTHER' end as family,
  case job_id % 4 when 0 then 'PRIMARY' when 1 then 'SUBSTANTIAL' when 2 then 'OCCASIONAL' else 'NONE' end as intensity, cast(job_id % 101 as int) as conf,
  case job_id % 6 when 0 then 'INTERN' when 1 then 'SENIOR' when 2 then 'MID' else 'JUNIOR' end as seniority, case when job_id % 3 = 0 then null else cast(job_id % 8 as int) end as min_years,
  case when job_id % 9 = 0 then null else cast(job_id % 100 as int) end as stack, job_id % 11 = 0 as foreign_tech, cast(company_id % 100 as int) as resume, cast(job_id % 7 as int) as gaps, posted_at from jobs),
f as (select *, case when fun='AMBIGUOUS' then 'AMBIGUOUS' when family='DATA_SCIENCE' then 'NON_TARGET' when family in ('BACKEND','FULL_STACK') then 'TARGET' when family='SDE' then case when foreign_tech then 'ADJACENT' else 'TARGET' end
   when family in ('FRONTEND','REACT') then 'ADJACENT' else 'NON_TARGET' end as fit from c),
r as (select *, cast(case when fit='ADJACENT' and stack is not null then floor(65*(0.6::double+0.4::double*(stack/100.0::double))+0.5) when fit='TARGET' then 100 when fit='ADJACENT' then 65 when fit='AMBIGUOUS' then 40 else 10 end as bigint) as role_fit,
   seniority='INTERN' as below, seniority='SENIOR' and (min_years is null or min_years > 3) as senior from f),
x as (select *, not below and not senior and (min_years is null or min_years - 2 <= 1) as ok, not below and not senior and min_years = 3 as caps,
   cast(floor(conf::double * case intensity when 'PRIMARY' then 1.0::double when 'SUBSTANTIAL' then 0.8::double when 'OCCASIONAL' then 0.4::double else 0.1::double end * (role_fit/100.0::double) + 0.5) as bigint) as relevance from r),
e as (select *, case when fit='NON_TARGET' then case when intensity in ('PRIMARY','SUBSTANTIAL') and conf>=70 then 'DEVELOPMENT_WRONG_SPECIALIZATION' else 'NOT_DEVELOPMENT' end
   when intensity not in ('PRIMARY','SUBSTANTIAL') then case when fit='AMBIGUOUS' and not (intensity='NONE' and conf<20) then 'AMBIGUOUS_NEEDS_REVIEW' when intensity='NONE' and conf<20 then 'NOT_DEVELOPMENT' else 'LOW_CODING_RESPONSIBILITY' end
   when not ok then case when below then 'TARGET_ROLE_BELOW_LEVEL' else 'TARGET_ROLE_TOO_SENIOR' end
   when fit='AMBIGUOUS' or conf<50 then 'AMBIGUOUS_NEEDS_REVIEW' when conf < case when fit='TARGET' then 70 else 80 end then 'LOW_CONFIDENCE'
   when fit='ADJACENT' and intensity<>'PRIMARY' then 'AMBIGUOUS_NEEDS_REVIEW' when caps then 'TARGET_ROLE_EXPERIENCE_STRETCH' else 'TARGET_ROLE_ELIGIBLE' end as code from x)
"""


def classified(spark: SparkSession, d: str) -> DataFrame:
    """A classification fixture: every field from the job id, so that all gates are reached."""
    j = jobs(spark, d)
    i = F.col("job_id")
    pick = lambda m, *v: F.element_at(F.array(*map(L, v)), (F.least(i % m, L(len(v) - 1)) + 1).cast("int"))
    c = j.select(
        "job_id", "company_id", "salary", "posted_at", pick(5, "AMBIGUOUS", "DATA_ENGINEERING", "SOFTWARE_ENGINEERING").alias("fun"),
        pick(7, "BACKEND", "SDE", "FRONTEND", "DATA_SCIENCE", "FULL_STACK", "REACT", "OTHER").alias("family"), pick(4, "PRIMARY", "SUBSTANTIAL", "OCCASIONAL", "NONE").alias("intensity"),
        (i % 101).cast("int").alias("conf"), pick(6, "INTERN", "SENIOR", "MID", "JUNIOR").alias("seniority"), F.when(i % 3 != 0, (i % 8).cast("int")).alias("min_years"),
        F.when(i % 9 != 0, (i % 100).cast("int")).alias("stack"), (i % 11 == 0).alias("foreign_tech"), (F.col("company_id") % 100).cast("int").alias("resume"), (i % 7).cast("int").alias("gaps"))
    c = c.withColumn("fit", S.target_fit(F.col("fun"), F.col("family"), F.col("foreign_tech")))
    c = c.withColumn("role_fit", S.target_role_fit(F.col("fit"), F.col("stack"))).withColumn("relevance", S.role_relevance(F.col("conf"), F.col("intensity"), F.col("role_fit")))
    c = c.withColumn("exp", S.experience_verdict(F.col("seniority"), F.col("min_years"), L(2)))
    return c.withColumn("code", S.eligibility_code(F.col("fit"), F.col("intensity"), F.col("conf"), F.col("exp")))


@query(_CLASSIFIED + "select job_id, fit, role_fit, relevance, ok as eligible_experience, coalesce(caps, false) as caps, code from e")
def eligibility_gate(spark: SparkSession, d: str) -> DataFrame:
    """SCO-11, 13, 14, 15."""
    return classified(spark, d).select("job_id", "fit", "role_fit", "relevance", F.col("exp.eligible").alias("eligible_experience"), F.col("exp.caps_at_consider").alias("caps"), "code")


@query(_CLASSIFIED + """
, s as (select *, salary/5000 as score, cast(date_diff('day', posted_at, timestamp '2001-08-02') % 100 as int) as age, company_id % 3 = 0 as hiring, code in ('TARGET_ROLE_ELIGIBLE','TARGET_ROLE_EXPERIENCE_STRETCH') as open from e),
v as (select *, floor(score + 0.5) as rs, resume<50 and gaps>=5 as core, age>60 and not hiring as stale, conf<35 or gaps>2 or (resume<50 and gaps>=5) or coalesce(caps,false) or (age>30 and not hiring) as blocked from s),
w as (select *, case when not open then case when code in ('AMBIGUOUS_NEEDS_REVIEW','LOW_CONFIDENCE') then 'NEEDS_REVIEW' else 'SKIP' end when core or stale then 'SKIP' when rs>=75 and not blocked then 'APPLY' when rs>=60 then 'CONSIDER' else 'SKIP' end as verdict from v)
select job_id, verdict, case when not open then code when core then 'CORE_STACK_MISMATCH' when stale then 'STALE' when rs>=75 and not blocked then 'TARGET_ROLE_ELIGIBLE' when rs>=60 then case when coalesce(caps,false) then 'TARGET_ROLE_EXPERIENCE_STRETCH' else 'TARGET_ROLE_ELIGIBLE' end else 'SCORE_BELOW_BAR' end as why,
 case when verdict='APPLY' then 'APPLY_NOW' when verdict='SKIP' then 'SKIP' when verdict='NEEDS_REVIEW' then 'REVIEW_FIRST' when role_fit>=85 and resume>=70 and coalesce(caps,false) then 'WORTH_APPLYING' when stack<50 then 'LOW_PRIORITY' when fit='ADJACENT' then 'REVIEW_FIRST' when role_fit>=85 and resume>=70 then 'WORTH_APPLYING' else 'REVIEW_FIRST' end as action from w""")
def decisions(spark: SparkSession, d: str) -> DataFrame:
    """SCO-16, SCO-18, SCO-34."""
    c = classified(spark, d).withColumn("age", (F.datediff(C.as_of_lit(JOBS_AS_OF), "posted_at") % 100).cast("int")).withColumn("hiring", F.col("company_id") % 3 == 0)
    caps = F.col("exp.caps_at_consider")
    c = c.withColumn("d", S.decision(F.col("salary") / 5000, F.col("code"), caps, F.col("resume"), F.col("gaps"), F.col("conf"), F.col("age"), F.col("hiring")))
    return c.select("job_id", F.col("d.verdict").alias("verdict"), F.col("d.code").alias("why"), S.action_for(F.col("d.verdict"), F.col("role_fit"), F.col("stack"), F.col("resume"), F.col("fit"), caps).alias("action"))


@query(_CLASSIFIED + "select code, count(*) as n, min(job_id) as first_job from e group by 1")
def eligibility_tally(spark: SparkSession, d: str) -> DataFrame:
    """SCO-34, SCO-36: the dry run's counts by gate."""
    return classified(spark, d).groupBy("code").agg(F.count(L(1)).alias("n"), F.min("job_id").alias("first_job"))


@query("""
, m as (select j.job_id, j.company_id % 100 as fit, cast(j.job_id % 101 as int) as exp, (epoch_us(timestamp '2001-08-02') - epoch_us(posted_at))/86400000000.0/30 as age, case when j.job_id % 4 = 0 then null when j.job_id % 4 = 1 then 100 else 25 end as remote,
   case when salary > 250000 then 100 when salary > 100000 then 30 end as pay, confidence, case when j.job_id % 3 = 0 then null else cast(j.company_id % 101 as int) end as growth, case when city in ('NATION_1','NATION_3') then 100 end as city_score, cast(j.job_id % 7 as int) as gaps, case when j.job_id % 5 = 0 then null else 70 + cast(j.job_id % 31 as int) end as trust
   from jobs j join companies using (company_id)),
p as (select *, case when age<=1 then 100 when age<=2 then 95 when age<=3 then 90 when age<=7 then 80 when age<=14 then 65 when age<=21 then 50 when age<=30 then 35 when age<=45 then 20 when age<=60 then 10 else 0 end as fresh,
   coalesce(growth::double, 30.0::double) as velocity, case when gaps=0 then 100 when gaps<=2 then 70 when gaps<=4 then 40 else 15 end as gap from m),
w as (select *, 35+15+20+(case when remote is null then 0 else 10 end)+(case when pay is null then 0 else 5 end)+5+5+(case when city_score is null then 0 else 5 end)+5 as tw,
  fit*35.0::double+exp*15.0::double+fresh*20.0::double+coalesce(remote*10.0::double,0)+coalesce(pay*5.0::double,0)+confidence*5.0::double+velocity*5.0::double+coalesce(city_score*5.0::double,0)+gap*5.0::double as pts from p),
q as (select *, floor(pts/tw*10+0.5)/10 as mean, greatest(-4, least(3, floor((trust-92)/4.0::double+0.5))) as nudge from w),
n as (select *, case when trust is not null and nudge<>0 then greatest(0.0::double, least(100.0::double, floor((mean+nudge)*10+0.5)/10)) else mean end as nudged from q)
select job_id, case when confidence < 40 then floor(nudged*0.85::double*10+0.5)/10 else nudged end as score from n""")
def opportunity_scores(spark: SparkSession, d: str) -> DataFrame:
    """SCO-3, SCO-4: nine weighted modules, those absent drop out."""
    j = jobs(spark, d).join(companies(spark, d), "company_id")
    i = F.col("job_id")
    age = C.fractional_days(C.as_of_lit(JOBS_AS_OF), "posted_at") / 30
    growth = F.when(i % 3 != 0, (F.col("company_id") % 101).cast("int"))
    scores = {
        "resumeFit": F.col("company_id") % 100, "experienceFit": i % 101, "freshness": S.freshness(age), "remotePreference": F.when(i % 4 == 1, 100).when(i % 4 != 0, 25),
        "salaryPreference": F.when(F.col("salary") > 250000, 100).when(F.col("salary") > 100000, 30), "companyQuality": F.col("confidence"), "hiringVelocity": S.velocity_score(growth, L(None).cast("string"), L(0)),
        "cityPreference": F.when(F.col("city").isin("NATION_1", "NATION_3"), 100), "skillGap": S.gap_score(i % 7),
    }
    trust = F.when(i % 5 != 0, 70 + i % 31)
    return j.select("job_id", S.weighted_score(scores, trust, F.col("confidence")).alias("score"))


@query("""
select job_id, salary/5000 as score, case when salary/5000>=75 then 'APPLY' when salary/5000>=60 then 'CONSIDER' else 'SKIP' end as verdict, cast(floor(salary/5000 - 50 + 0.5) as bigint) as js_rounded, round(salary/5000, 0) as sql_rounded from jobs""")
def verdict_bands(spark: SparkSession, d: str) -> DataFrame:
    """SCO-19, FN-2, FN-3, FN-5."""
    s = F.col("salary") / 5000
    return jobs(spark, d).select("job_id", s.alias("score"), S.verdict_band(s).alias("verdict"), C.js_round(s - 50).alias("js_rounded"), F.round(s, 0).alias("sql_rounded"))


@query("""
select company_id, cast(15 + case when confidence>20 then 20 else 0 end + case when confidence>40 then 25 else 0 end + case when confidence>60 then 25 else 0 end + case when confidence>80 then 15 else 0 end as bigint) as confidence_score,
 case when confidence>60 and company_id%4<>0 then 'MONITORED' when confidence>60 then 'UNRESOLVABLE' when confidence>40 then 'CAREER_PAGE_FOUND' when confidence>20 then 'WEBSITE_FOUND' else 'UNRESOLVABLE' end as stage from companies""")
def discovery_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """SCO-9, SCO-10."""
    c = F.col("confidence")
    return companies(spark, d).select("company_id", S.company_confidence(L(True), c > 20, c > 40, c > 60, c > 80).alias("confidence_score"), S.discovery_stage(c > 60, F.col("company_id") % 4 == 0, c > 40, c > 20).alias("stage"))


@query("""
, g as (select company_id as id, company_id%5=0 as member, company_id%7=0 as rec, company_id%11=0 as lead, company_id%3=0 as email, company_id%4=0 as blog, company_id%2=0 as soc, cast(company_id%6 as int) as shared, confidence>50 as hiring, city='NATION_1' as region, cast(company_id%40 as int) as contrib from companies)
select id, cast(case when member then 45 else 15 end + case when rec then 12 when lead then 10 else 0 end + case when email then 15 else 0 end + case when blog then 6 else 0 end + case when soc then 4 else 0 end + least(20, shared*5) + case when hiring then 8 else 0 end + case when region then 4 else 0 end + case when contrib>=20 then 4 else 0 end as bigint) as rank,
 case when shared>=6 then 'VERY_HIGH' when shared>=4 then 'HIGH' when shared>=2 then 'MEDIUM' else 'LOW' end as momentum from g""")
def referral_ranking(spark: SparkSession, d: str) -> DataFrame:
    """SCO-22, SCO-26."""
    i = F.col("company_id")
    return companies(spark, d).select(i.alias("id"), S.referral_rank(i % 5 == 0, i % 7 == 0, i % 11 == 0, i % 3 == 0, i % 4 == 0, i % 2 == 0, i % 6, F.col("confidence") > 50, F.col("city") == "NATION_1", i % 40).alias("rank"), S.momentum(i % 6).alias("momentum"))


@query("""
, h as (select job_id, company_id, salary/5000 as score, status, date_diff('day', posted_at, timestamp '2001-08-02') as age, priority from jobs)
select job_id, case when score < 70 then 'BELOW_SCORE' when status<>'ACTIVE' then 'NOT_ACTIVE' when age > 1500*case when priority='1-URGENT' then 2 else 1 end then 'TOO_OLD' when job_id%10=0 then 'ALREADY_NOTIFIED' when score < 75 then 'NOT_APPLY' end as hold_reason from h""")
def notify_gate(spark: SparkSession, d: str) -> DataFrame:
    """SCO-20, SCO-21, FLT-2..3: the first gate that holds a notification back, null if none does."""
    s, age = F.col("salary") / 5000, F.datediff(C.as_of_lit(JOBS_AS_OF), "posted_at")
    limit = F.when(F.col("priority") == "1-URGENT", 3000).otherwise(1500)
    hold = F.when(s < 70, "BELOW_SCORE").when(F.col("status") != "ACTIVE", "NOT_ACTIVE").when(age > limit, "TOO_OLD").when(F.col("job_id") % 10 == 0, "ALREADY_NOTIFIED").when(S.verdict_band(s) != "APPLY", "NOT_APPLY")
    return jobs(spark, d).select("job_id", hold.alias("hold_reason"))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def daily_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """STR-1 as a table: tumbling event-time windows; the same function runs on a stream."""
    w = windowed_actions(table(spark, d, "events").where("ts is not null"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
