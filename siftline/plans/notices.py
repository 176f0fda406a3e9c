"""Notifications and digests over scored matches (SCO-20, SCO-21, STR-5, STR-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import scoring as S
from siftline.operators import notifications as N
from siftline.session import cut, table

L = F.lit
#: Jobs up to which those that were scored go to the events, and not the events to them.
FEW = 50_000
QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


def _jobs(spark: SparkSession, d: str, orders: DataFrame | None = None) -> DataFrame:
    """job_id, company_id, first_seen, posted_at, external_id, monitored, evergreen, nation, all from orders and their customers."""
    o = (table(spark, d, "orders") if orders is None else orders).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    first = L("2023-12-20").cast("timestamp") + days(F.datediff("o_orderdate", L("1995-01-01").cast("date")) % 45)
    o = o.withColumn("first_seen", first)
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("company_id"), "first_seen", F.when(F.col("o_orderkey") % 5 > 0, F.col("first_seen") - days(F.floor("o_totalprice") % 50)).alias("posted_at"),
        F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", N.BOARD_COPY).otherwise(""), F.col("o_orderkey").cast("string")).alias("external_id"), (F.col("c_acctbal") > 3000).alias("monitored"), (F.col("c_mktsegment") == "BUILDING").alias("evergreen"), F.col("c_nationkey").alias("nation"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """user_id, job_id, event_id, ts, score, kind of every time a match was scored."""
    e = table(spark, d, "events").where("ts is not null")
    score = F.when(F.col("event_type") != "error", (F.floor(F.col("value") * 100) % 45 + 55).cast("double"))
    # most objects hold a whole number k and nothing else: these need no parser
    plain = F.regexp_extract("props", r'^\{"k": (0|[1-9][0-9]{0,17})\}$', 1)
    job = F.when(plain != "", plain.cast("long")).otherwise(F.get_json_object("props", "$.k").cast("long"))
    return e.select((F.col("user_id") % 30).alias("user_id"), job.alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), score.alias("score"), F.col("event_type").alias("kind"))


_BASE = f"""
jobs as (select *, case when job_id % 5 > 0 then first_seen - to_days(cast(floor(o_totalprice) % 50 as int)) end as posted_at from (select o_orderkey as job_id, o_custkey as company_id, o_totalprice,
   timestamp '2023-12-20' + to_days(cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) % 45 as int)) as first_seen,
   case when o_orderpriority = '1-URGENT' then '{N.BOARD_COPY}' else '' end || o_orderkey as external_id, c_acctbal > 3000 as monitored, c_mktsegment = 'BUILDING' as evergreen, c_nationkey as nation from orders join customer on o_custkey = c_custkey)),
scored as (select user_id % 30 as user_id, cast(json_extract_string(props, '$.k') as bigint) as job_id, event_id, ts, case when event_type <> 'error' then cast(cast(floor(value * 100) as bigint) % 45 + 55 as double) end as score, event_type as kind from events where ts is not null),
acted as (select user_id, job_id, min(ts) as acted_at from scored where kind = 'purchase' group by all)"""


def _with_jobs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    jobs, scored = _jobs(spark, d), _scored(spark, d)
    acted = scored.where("kind = 'purchase'").groupBy("user_id", "job_id").agg(F.min("ts").alias("acted_at"))
    return scored.join(jobs, "job_id").join(acted, ["user_id", "job_id"], "left"), jobs


@query(rf"""
with recursive {_BASE.strip()},
facts as (select s.*, coalesce(posted_at, first_seen) as since, external_id, monitored, evergreen, acted_at < ts as acted, (user_id % 3 = 0 or (nation + user_id) % 4 > 0) as wanted,
   (select count(*) from jobs r where r.company_id = j.company_id and r.first_seen <= s.ts and r.first_seen >= s.ts - interval 14 days) as recent from scored s join jobs j using (job_id) left join acted using (user_id, job_id)),
gates as (select *, case when score is null or score < 70 then 'BELOW_SCORE' when not wanted then 'OUTSIDE_COUNTRIES' when (epoch_us(ts) - epoch_us(since)) / 86400000000.0 > case when evergreen or recent >= 3 then 60 else 30 end then 'TOO_OLD'
    when starts_with(external_id, 'remoteok-') and monitored then 'BOARD_COPY' end as before, case when score is null or score < 75 or kind = 'signup' then 'NOT_APPLY' when acted then 'ACTED_ON' end as after,
    row_number() over (partition by user_id, job_id order by ts, event_id) as n from facts),
fold(user_id, job_id, event_id, score, n, hold, last) as (
  select user_id, job_id, event_id, score, n, coalesce(before, after), case when before is null and after is null then score end from gates where n = 1
  union all select g.user_id, g.job_id, g.event_id, g.score, g.n, case when g.before is not null then g.before when f.last is not null and g.score < f.last + 5 then 'ALREADY_NOTIFIED' else g.after end,
    case when g.before is null and not (f.last is not null and g.score < f.last + 5) and g.after is null then g.score else f.last end
  from fold f join gates g on g.user_id = f.user_id and g.job_id = f.job_id and g.n = f.n + 1)
select user_id, job_id, event_id, score, hold as hold_reason, last as last_told, case hold when 'BELOW_SCORE' then 'Score ' || coalesce(format('{{:.1f}}', score), 'none') || ' is below 70.' when 'ALREADY_NOTIFIED' then 'Told at ' || format('{{:.1f}}', last) || '; tells again from 5 points more.'
  when 'OUTSIDE_COUNTRIES' then 'Outside your countries.' when 'TOO_OLD' then 'Posted too long ago to interrupt you.' when 'BOARD_COPY' then 'Board copy held: the company is monitored and its own posting notifies.' when 'NOT_APPLY' then 'The verdict is not to apply now.'
  when 'ACTED_ON' then 'Already in your applications.' else 'You were notified.' end as why from fold""")
def notify_decisions(spark: SparkSession, d: str) -> DataFrame:
    """SCO-20, SCO-21, STR-5: every scoring of a match through all gates in order, with the memory of what was told."""
    scored, orders = _scored(spark, d), table(spark, d, "orders")
    # jobs that were never scored, and companies that have none of the others, are dropped before anything is joined to them
    asked = cut(scored.where("job_id is not null").select(F.col("job_id").alias("o_orderkey")).distinct())
    small = F.broadcast if asked.count() <= FEW else lambda df: df
    jobs = cut(_jobs(spark, d, small(orders.join(small(asked), "o_orderkey", "left_semi"))))
    companies = jobs.select(F.col("company_id").alias("o_custkey")).distinct()
    postings = _jobs(spark, d, orders.join(small(companies), "o_custkey", "left_semi")).select("company_id", "first_seen")
    facts = scored.join(small(jobs), "job_id")
    age = (F.unix_micros("ts") - F.unix_micros(F.coalesce("posted_at", "first_seen"))) / 86_400_000_000
    wanted = (F.col("user_id") % 3 == 0) | ((F.col("nation") + F.col("user_id")) % 4 > 0)
    open_ = N.recent_decides(F.col("score"), wanted, age, F.col("evergreen"))
    facts = N.recent_postings(facts.where(open_), postings).unionByName(facts.where(~open_).withColumn("recent", L(0).cast("long")))
    verdict = F.when(F.col("kind") == "signup", "NEEDS_REVIEW").otherwise(S.verdict_band(F.col("score")))
    events = facts.withColumn("before", N.gates_before_memory(F.col("score"), wanted, age, F.col("evergreen"), F.col("recent"), F.col("external_id"), F.col("monitored")))
    events = events.select("user_id", "job_id", "event_id", "ts", "score", "kind", "before", verdict.alias("verdict"))
    # exchanged and sorted once, as the memory needs them: an earlier purchase is known by then
    so_far = Window.partitionBy("user_id", "job_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("acted_at", F.min(F.when(F.col("kind") == "purchase", F.col("ts"))).over(so_far))
    events = events.withColumn("after", N.gates_after_memory(F.col("verdict"), F.col("user_id").isNotNull() & (F.col("acted_at") < F.col("ts"))))
    decided = N.decide(events)
    return decided.select("user_id", "job_id", "event_id", "score", "hold_reason", "last_told", N.why_not(F.col("hold_reason"), F.col("score"), F.col("last_told")).alias("why"))


_RUNS = ("2024-01-10 14:00:00", "2024-01-17 14:00:00", "2024-01-24 14:00:00")


def _sql_run(n: int, at: str) -> str:
    claimed = " union all ".join(f"select user_id, job_id from run{m}" for m in range(n)) or "select 0::bigint as user_id, 0::bigint as job_id where false"
    return f"""
latest{n} as (select * from scored where ts <= timestamp '{at}' qualify row_number() over (partition by user_id, job_id order by ts desc, event_id) = 1),
run{n} as (select user_id, job_id, score, row_number() over (partition by user_id order by score desc, job_id) as place from latest{n} l join jobs using (job_id) left join acted using (user_id, job_id)
  where score >= 60 and score < 75 and coalesce(posted_at, first_seen) >= timestamp '{at}' - interval 30 days and first_seen <= timestamp '{at}' and not coalesce(acted_at <= timestamp '{at}', false) and (user_id, job_id) not in ({claimed}) qualify place <= 8)"""


@query(f"with {_BASE.strip()}, {', '.join(_sql_run(n, at) for n, at in enumerate(_RUNS))} {' union all '.join(f'select {n} as run, user_id, cast(place as int) as place, job_id, score from run{n}' for n in range(len(_RUNS)))}")
def digest_runs(spark: SparkSession, d: str) -> DataFrame:
    """STR-9: three weekly digests of what is worth a look; what a run has claimed no later one repeats."""
    facts, _ = _with_jobs(spark, d)
    claimed = spark.createDataFrame([], "user_id long, job_id long")
    out = None
    for n, at in enumerate(_RUNS):
        now = L(at).cast("timestamp")
        seen = facts.where(F.col("ts") <= now)
        newest = F.max_by(F.struct("score", "posted_at", "first_seen", "acted_at"), F.struct("ts", -F.col("event_id")))
        latest = seen.groupBy("user_id", "job_id").agg(newest.alias("x")).select("user_id", "job_id", "x.*")
        since = F.coalesce("posted_at", "first_seen")
        fresh = (since >= now - F.make_dt_interval(L(N.DIGEST_DAYS))) & (F.col("first_seen") <= now) & ~F.coalesce(F.col("acted_at") <= now, L(False))
        run = N.claim(latest.where((S.verdict_band(F.col("score")) == "CONSIDER") & fresh), claimed).select(L(n).alias("run"), "user_id", "place", "job_id", "score")
        claimed = claimed.unionAll(run.select("user_id", "job_id"))
        out = run if out is None else out.unionAll(run)
    return out
