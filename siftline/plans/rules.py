"""Rules held against data: contacts, crawl queues, flags, documents (SCO-23, FLT-11, FLT-16, STR-16, SNK-14, SRC-8, TXT-29, SCO-29)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import cards as C
from siftline.functions import contacts as K
from siftline.functions import documents as D
from siftline.functions import text as X
from siftline.operators import queues
from siftline.plans.roles import jobs
from siftline.sources.boards import ORG_ID, keka_org_id
from siftline.session import table

L = F.lit
QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


@query("""
with c as (select (c_custkey % 15) * 7 as company, c_custkey as id, c_name as name, case c_mktsegment when 'BUILDING' then 'RECRUITER' when 'MACHINERY' then 'HIRING_MANAGER' else 'ENGINEER' end as role, cast(abs(floor(c_acctbal)) % 100 as bigint) as priority, c_custkey % 5 = 0 as member from customer),
r as (select *, case role when 'RECRUITER' then 5 when 'HIRING_MANAGER' then 4 else case when member then 4 else 2 end end as referral from c),
top as (select *, row_number() over (partition by company order by priority desc, id) as k, row_number() over (partition by company, role = 'RECRUITER' order by priority desc, id) as kr from r),
ref as (select * from top where kr = 1 and role <> 'RECRUITER'), rec as (select * from top where kr = 1 and role = 'RECRUITER'), pri as (select * from top where k = 1),
man as (select t.*, row_number() over (partition by t.company order by t.priority desc, t.id) as km from top t left join ref using (company) where t.role = 'HIRING_MANAGER' and t.id is distinct from ref.id),
sec as (select t.*, row_number() over (partition by t.company order by t.role = p.role, t.priority desc, t.id) as ks from top t join pri p using (company) where t.id <> p.id),
s as (select s_suppkey as company, case when s_suppkey % 3 = 0 then 'jobs@s' || s_suppkey end as jobs_mail, case when s_suppkey % 4 = 0 then 'info@s' || s_suppkey end as info_mail, case when s_acctbal > 2000 then 'https://s' || s_suppkey || '/careers' end as careers, case when s_acctbal < 0 then 'https://s' || s_suppkey || '/contact' end as contact from supplier)
select s.company, concat_ws(' > ', 'REFERRAL ' || ref.name || ' ' || ref.referral, 'RECRUITER ' || rec.name || ' ' || rec.referral, 'HIRING_MANAGER ' || man.name || ' ' || man.referral, 'COMPANY_EMAIL ' || jobs_mail || ' 3', 'CAREERS_PAGE ' || careers || ' 2', 'CONTACT_PAGE ' || coalesce(info_mail, contact) || ' 2', 'APPLY https://s' || s.company || '/1 2') as ladder,
 concat_ws(' > ', 'ASK_REFERRAL ' || case when pri.priority >= 75 then 5 when pri.priority >= 60 then 4 when pri.priority >= 45 then 3 when pri.priority is not null then 2 end, 'TAILOR 5', 'APPLY ' || case when pri.id is null then 5 else 4 end, case when pri.id is not null then 'FOLLOW_UP 4 > SECOND_NUDGE 3' end) as play, sec.name as secondary
from s left join ref using (company) left join rec using (company) left join pri using (company) left join (select * from man where km = 1) man using (company) left join (select * from sec where ks = 1) sec using (company)""")
def contact_ladders(spark: SparkSession, d: str) -> DataFrame:
    """SCO-23: who and what leads into each company, in order, and the play for a job there."""
    c = table(spark, d, "customer")
    role = F.when(F.col("c_mktsegment") == "BUILDING", "RECRUITER").when(F.col("c_mktsegment") == "MACHINERY", "HIRING_MANAGER").otherwise("ENGINEER")
    people = c.select(
        ((F.col("c_custkey") % 15) * 7).alias("company"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), role.alias("role"), (F.abs(F.floor("c_acctbal")) % 100).cast("long").alias("priority"),
        (F.col("c_custkey") % 5 == 0).alias("member"), (F.col("c_acctbal") > 5000).alias("email"), L(False).alias("site"), L(0).alias("shared"), L(0).alias("contributions"))
    i, k = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    mail = lambda cond, name, kind: F.when(cond, F.struct(F.concat(L(name), k).alias("address"), L(kind).alias("kind")))
    url = lambda cond, end: F.when(cond, F.concat(L("https://s"), k, L(end)))
    s = table(spark, d, "supplier").select(
        i.alias("company"), F.array_compact(F.array(mail(i % 3 == 0, "jobs@s", "RECRUITING"), mail(i % 4 == 0, "info@s", "GENERAL"))).alias("emails"), url(F.col("s_acctbal") > 2000, "/careers").alias("careers"), url(F.col("s_acctbal") < 0, "/contact").alias("contact"), url(L(True), "/1").alias("job"))
    both = s.join(K.best_contacts(people), "company", "left")
    none = F.array().cast("array<string>")
    ladder = K.ladder(F.col("emails"), F.col("careers"), F.col("contact"), none, L(None).cast("string"), F.col("job"))
    said = lambda *parts: F.concat_ws(" ", *parts)
    return both.select(
        "company", F.array_join(F.transform(ladder, lambda r: said(r["kind"], r["who"], r["confidence"].cast("string"))), " > ").alias("ladder"),
        F.array_join(F.transform(K.plan(F.coalesce(F.col("n") > 0, L(False))), lambda p: said(p["kind"], p["stars"].cast("string"))), " > ").alias("play"), F.col("secondary.name").alias("secondary"))


_PROVIDERS = ("GREENHOUSE", "LEVER", "ASHBY", "WORKDAY", "UNKNOWN", "KEKA", "TALEO")


@query(f"""
with c as (select c_custkey as company_id, ([{", ".join(f"'{p}'" for p in _PROVIDERS)}])[c_custkey % {len(_PROVIDERS)} + 1] as provider, case when c_acctbal > -500 then 'id' || c_custkey end as identifier, timestamp '2001-01-01' + to_days(cast(floor(c_acctbal) % 20 as int)) as next_crawl_at from customer)
select company_id, next_crawl_at, cast(row_number() over (order by next_crawl_at, company_id) as int) as place from c where provider in ({", ".join(f"'{p}'" for p in queues.CRAWLABLE)}) and identifier is not null and next_crawl_at <= timestamp '2001-01-10' qualify place <= 25""")
def crawl_batch(spark: SparkSession, d: str) -> DataFrame:
    """FLT-11, STR-16: the 25 companies whose crawl is longest due, of boards that can be crawled."""
    c = table(spark, d, "customer")
    provider = F.element_at(F.array(*map(L, _PROVIDERS)), (F.col("c_custkey") % len(_PROVIDERS) + 1).cast("int"))
    rows = c.select(F.col("c_custkey").alias("company_id"), provider.alias("provider"), F.when(F.col("c_acctbal") > -500, F.concat(L("id"), F.col("c_custkey").cast("string"))).alias("identifier"), (L("2001-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.floor("c_acctbal") % 20).cast("int"))).alias("next_crawl_at"))
    return queues.crawl_due(rows, L("2001-01-10").cast("timestamp_ntz"))


@query("""
select c_custkey as company_id, case when c_custkey % 3 > 0 then timestamp '2001-01-01' - to_days(cast(c_custkey % 20 as int)) end as derived_at from customer where c_acctbal > 0
 and c_custkey in (select o_custkey from orders where o_orderstatus = 'O') and (c_custkey % 3 = 0 or timestamp '2001-01-01' - to_days(cast(c_custkey % 20 as int)) < timestamp '2001-01-01' - interval 7 days)""")
def derivation_queue(spark: SparkSession, d: str) -> DataFrame:
    """FLT-16: monitored companies with an active job whose profile is missing or a week old."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.when(F.col("c_acctbal") > 0, "MONITORED").otherwise("DISCOVERED").alias("stage"))
    made = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("company_id"), (L("2001-01-01").cast("timestamp_ntz") - F.make_dt_interval((F.col("c_custkey") % 20).cast("int"))).alias("derived_at"))
    return queues.derivation_due(c, jobs(spark, d), made, L("2001-01-01").cast("timestamp_ntz"))


@query("""
with p as (select page_id, length(html) % 3 = 0 as needs_render, page_id in (select doc_id from documents where length(text) > 2000) as flagged from pages)
select page_id, needs_render or flagged as needs_render, flagged and not needs_render as changed from p""")
def render_flags(spark: SparkSession, d: str) -> DataFrame:
    """SNK-14: the flag of the rows that are named is raised, the others stay; ``changed`` says which were not raised before."""
    p = table(spark, d, "pages").select("page_id", (F.length("html") % 3 == 0).alias("needs_render"))
    named = table(spark, d, "documents").where("length(text) > 2000").select(F.col("doc_id").alias("page_id"))
    return queues.raise_flag(p, named, "page_id", "needs_render")


@query(rf"""
with h as (select page_id, html || case when page_id % 4 < 3 then '<img src="/ats/documents/' || lower(substring(m, 1, 8) || '-' || substring(m, 9, 4) || '-' || substring(m, 13, 4) || '-' || substring(m, 17, 4) || '-' || substring(m, 21, 12)) || case when page_id % 4 = 1 then '' else '/' end || 'logo.png">' else '' end as html from (select page_id, html, md5(url) as m from pages))
select page_id, nullif(regexp_extract(html, '{ORG_ID}', 1), '') as org_id from h""")
def keka_orgs(spark: SparkSession, d: str) -> DataFrame:
    """SRC-8: the organisation's id out of a board's page."""
    m = F.md5("url")
    uuid = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    image = F.concat(L('<img src="/ats/documents/'), uuid, F.when(F.col("page_id") % 4 == 1, "").otherwise("/"), L('logo.png">'))
    p = table(spark, d, "pages").select("page_id", F.concat("html", F.when(F.col("page_id") % 4 < 3, image).otherwise("")).alias("html"))
    return p.select("page_id", keka_org_id(F.col("html")).alias("org_id"))


@query(r"""select doc_id, nullif(regexp_extract(text, '[\w.+-]+@[\w-]+\.[\w.]+'), '') as email, nullif(trim(regexp_extract(text, '\+?\d[\d\s()-]{8,14}\d')), '') as phone from documents""")
def document_contacts(spark: SparkSession, d: str) -> DataFrame:
    """TXT-29: the first address and telephone number of every document."""
    return table(spark, d, "documents").select("doc_id", X.resume_email(F.col("text")).alias("email"), X.resume_phone(F.col("text")).alias("phone"))


_HEADS = ", ".join(f"'{h}'" for h in D.HEADINGS)


@query(rf"""
with d as (select doc_id, coalesce(text, '') || case doc_id % 3 when 0 then '' when 1 then chr(10) || 'Skills:' || chr(10) || 'x' || chr(10) || 'WORK EXPERIENCE' || chr(10) || 'Education & Training' else chr(10) || 'Education' || chr(10) || ' technical skills ' || chr(10) || 'Summary' || chr(10) || 'Projects' end as t from documents),
n as (select *, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) as letters, length(regexp_replace(t, '\s', '', 'g')) as printable, list_transform(string_split_regex(t, '\r?\n'), lambda x: trim(regexp_replace(upper(trim(x)), '[^A-Z& ]', '', 'g'))) as lines from d),
h as (select *, list_filter(list_transform([{_HEADS}], lambda h: list_position(list_transform(lines, lambda x: x in (h, 'WORK ' || h, 'PROFESSIONAL ' || h, 'TECHNICAL ' || h)), true)), lambda p: p > 0) as found,
  len(list_filter([{", ".join(f"'{w}'" for w in D.COMMON_WORDS)}], lambda w: contains(lower(t), w))) as common, case when printable > 0 then letters / printable else 0 end as ratio,
  regexp_matches(t, '[\w.+-]+@[\w-]+\.[\w.]+') and (regexp_matches(t, '\+?\d[\d\s-]{{8,}}') or regexp_matches(t, '(?i)linkedin|github')) as contact from n),
s as (select *, cast(floor((cast(printable >= 200 as int) + cast(ratio >= 0.7 as int) + cast(common >= 5 as int) + cast(len(found) >= 3 as int) + cast(len(found) >= 2 and len(list_distinct(found)) = len(found) and list_sort(found) = found as int) + cast(contact as int)) / 6 * 100 + 0.5) as int) as score from h)
select doc_id, score, case when ratio < 0.5 or printable < 200 then 'UNREADABLE' when score < 100 then 'RISKY' else 'SAFE' end as verdict, round(ratio, 3) as letter_ratio from s""")
def document_readability(spark: SparkSession, d: str) -> DataFrame:
    """SCO-29: the six checks of a resume on every document, two thirds of them with headings."""
    extra = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "\nSkills:\nx\nWORK EXPERIENCE\nEducation & Training").otherwise("\nEducation\n technical skills \nSummary\nProjects")
    return table(spark, d, "documents").select("doc_id", D.readability(F.concat(F.coalesce("text", L("")), extra)).alias("r")).select("doc_id", "r.score", "r.verdict", "r.letter_ratio")


_PLACES = ("Bengaluru, KA", "NEW DELHI", "Remote - India", "Berlin", "Delhi NCR", "pune / hybrid", "", "India (any)", "Kochi or Trivandrum", "remote", "Old Delhi", "Paris")
_GROUPED = "case when length({0}) <= 3 then {0} when length({0}) <= 5 then left({0}, length({0}) - 3) || ',' || right({0}, 3) else left({0}, length({0}) - 5) || ',' || substr({0}, length({0}) - 4, 2) || ',' || right({0}, 3) end"


@query(rf"""
with j as (select o_orderkey as job_id, case when o_orderkey % 17 > 0 then ([{", ".join(f"'{p}'" for p in _PLACES)}])[cast(floor(o_totalprice) as bigint) % {len(_PLACES)} + 1] end as place, case o_orderpriority when '1-URGENT' then 'HYBRID' when '2-HIGH' then 'ONSITE' when '3-MEDIUM' then 'REMOTE' end as mode,
  date_diff('day', o_orderdate, timestamp '2001-08-02') % 40 as age, case when o_orderkey % 4 > 0 then cast(floor(o_totalprice) as bigint)::varchar end as low, case when o_orderkey % 3 > 0 then cast(floor(o_totalprice * 1.5::double) as bigint)::varchar end as high, case when o_orderkey % 5 > 0 then 'INR' end as cur from orders),
c as (select *, list_filter([{", ".join(f"'{x}'" for x in C.CITIES)}], lambda x: contains(lower(place), lower(x)))[1] as city, coalesce(mode, case when regexp_matches(place, '(?i)remote') then 'REMOTE' end) as way from j)
select job_id, concat_ws(' · ', case when coalesce(place, '') = '' then null when city is not null then '📍 ' || city when regexp_matches(place, '(?i)india') then '📍 India' else '🌍 ' || place end, case way when 'REMOTE' then '🏠 Remote' when 'HYBRID' then '🏢 Hybrid' when 'ONSITE' then '🏢 Onsite' end) as tags,
 case when age <= 0 then '🔥 Posted today' when age = 1 then '🔥 Posted yesterday' when age <= 7 then '🟡 Posted ' || age || ' days ago' else '⚪ Posted ' || age || ' days ago' end as fresh,
 case when low is null and high is null then '💰 Salary not listed' else '💰 ' || coalesce(cur, '') || ' ' || case when low is not null and high is not null then {_GROUPED.format("low")} || '–' || {_GROUPED.format("high")} when low is not null then {_GROUPED.format("low")} || '+' else {_GROUPED.format("high")} end end as pay,
 array_to_string(case when age <= 3 then ['Fresh', 'Low competition'] when age <= 10 then ['Recent'] when age >= 25 then ['Older posting'] else [] end, ',') as chips from c""")
def posting_cards(spark: SparkSession, d: str) -> DataFrame:
    """TXT-26, SCO-26: tags, freshness, pay and competition of every posting."""
    o, i = table(spark, d, "orders"), F.col("o_orderkey")
    place = F.when(i % 17 > 0, F.element_at(F.array(*map(L, _PLACES)), (F.floor("o_totalprice") % len(_PLACES) + 1).cast("int")))
    p = F.col("o_orderpriority")
    mode = F.when(p == "1-URGENT", "HYBRID").when(p == "2-HIGH", "ONSITE").when(p == "3-MEDIUM", "REMOTE")
    age = F.datediff(L("2001-08-02").cast("date"), "o_orderdate") % 40
    low, high = F.when(i % 4 > 0, F.floor("o_totalprice")), F.when(i % 3 > 0, F.floor(F.col("o_totalprice") * 1.5))
    return o.select(
        i.alias("job_id"), C.location_tags(place, mode).alias("tags"), C.freshness(age).alias("fresh"), C.salary(low, high, F.when(i % 5 > 0, "INR")).alias("pay"), F.array_join(C.competition(age), ",").alias("chips"))


@query("""
with u as (select user_id, count(*) filter (event_type = 'purchase' and value > 150) as interviews, count(*) filter (event_type = 'click' and value > 120) as replies, count(*) filter (event_type = 'view' and value > 100) as outreach, count(*) filter (event_type = 'signup' and value > 90) as fresh,
  count(*) filter (event_type = 'error' and value > 60) as active from events where ts >= timestamp '2024-01-23' and ts < timestamp '2024-01-30' group by 1),
p as (select *, least(4, interviews * 3) + least(2, replies * 2) + least(2, outreach) + case when fresh > 0 then 1 else 0 end + case when active > 0 then 1 else 0 end as points from u)
select user_id, case when points >= 6 then 'VERY_HIGH' when points >= 4 then 'HIGH' when points >= 2 then 'MEDIUM' else 'LOW' end as level,
 case when interviews > 1 then interviews || ' interviews/assessments in progress' when interviews = 1 then '1 interview/assessment in progress' when replies > 1 then replies || ' replies waiting on you' when replies = 1 then '1 reply waiting on you'
  when outreach > 1 then outreach || ' outreach threads in flight' when outreach = 1 then '1 outreach thread in flight' when fresh > 1 then fresh || ' strong fresh matches to apply to' when fresh = 1 then '1 strong fresh match to apply to' else 'warming up — get an application or a referral in motion' end as reason from p""")
def week_momentum(spark: SparkSession, d: str) -> DataFrame:
    """SCO-26: each user's motion in one week of events, and what it rests on."""
    e = table(spark, d, "events").where((F.col("ts") >= L("2024-01-23").cast("timestamp_ntz")) & (F.col("ts") < L("2024-01-30").cast("timestamp_ntz")))
    n = lambda kind, least, name: F.count_if((F.col("event_type") == kind) & (F.col("value") > least)).alias(name)
    per = e.groupBy("user_id").agg(n("purchase", 150, "interviews"), n("click", 120, "replies"), n("view", 100, "outreach"), n("signup", 90, "fresh"), n("error", 60, "active"))
    return per.select("user_id", C.week_momentum(*(F.col(c) for c in ("interviews", "replies", "outreach", "fresh", "active"))).alias("m")).select("user_id", "m.level", "m.reason")


@query("""
with a as (select o_orderkey as job_id, o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') as referral, o_orderkey in (select l_orderkey from lineitem where l_linestatus = 'F') as tailored, date_diff('day', o_orderdate, timestamp '2001-08-02') as days from orders where o_orderstatus = 'O')
select job_id, concat_ws(' > ', case when not referral then 'FIND_REFERRAL 5' end, case when days >= 5 then 'FOLLOW_UP 4' end, case when not tailored then 'TAILOR_RESUME 4' end, 'APPLY_SIMILAR 3') as moves from a""")
def waiting_moves(spark: SparkSession, d: str) -> DataFrame:
    """SCO-25: the moves that are left while an application is live."""
    lines = table(spark, d, "lineitem")
    had = lambda cond, name: lines.where(cond).select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn(name, L(True))
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").join(had("l_returnflag = 'R'", "referral"), "o_orderkey", "left").join(had("l_linestatus = 'F'", "tailored"), "o_orderkey", "left")
    yes = lambda c: F.coalesce(c, L(False))
    moves = D.waiting_actions(yes("referral"), yes("tailored"), F.datediff(L("2001-08-02").cast("date"), "o_orderdate"), L(True))
    return o.select(F.col("o_orderkey").alias("job_id"), F.array_join(F.transform(moves, lambda m: F.concat_ws(" ", m["factor"], m["strength"].cast("string"))), " > ").alias("moves"))
