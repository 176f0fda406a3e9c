"""Document, name, outreach and review rules as queries over cases derived from the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import documents as D
from siftline.functions import text as X
from siftline.operators import keyed
from siftline.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
L = F.lit


def query(sql: str):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return add


def _s(c: Column) -> Column:
    return c.cast("string")


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[L(p) if isinstance(p, str) else p for p in parts])


def _case(key: Column, *values: str | None) -> Column:
    """The value at ``key`` mod the number of values."""
    return F.get(F.array(*[L(v) if v is not None else L(None).cast("string") for v in values]), (key % len(values)).cast("int"))


def _customers(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    return table(spark, d, "customer"), F.col("c_custkey")


@query("""with recursive x as (select p_partkey as id, p_name as s, 5381::bigint as h, 1 as p from part union all select id, s, (h * 33 + ascii(substr(s, p, 1))) % 4294967296, p + 1 from x where p <= length(s))
, last as (select id, h from x where p = length(s) + 1)
, dig as (select id, h as rest, '' as out from last union all select id, rest // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', (rest % 36 + 1)::int, 1) || out from dig where rest > 0)
select id as p_partkey, 'careerpage-' || out as short_id from dig where rest = 0""")
def short_ids(spark: SparkSession, d: str) -> DataFrame:
    """TXT-5."""
    return table(spark, d, "part").select("p_partkey", X.short_id(F.col("p_name")).alias("short_id"))


@query("""select c_custkey, case c_custkey % 9 when 0 then 'https://boards.greenhouse.io/t' || c_custkey when 1 then 'https://jobs.lever.co/t' || c_custkey when 2 then 'https://jobs.ashbyhq.com/t' || c_custkey when 3 then 'https://apply.workable.com/t' || c_custkey
 when 4 then 'https://jobs.smartrecruiters.com/t' || c_custkey when 5 then 'https://t' || c_custkey || '.recruitee.com' when 6 then 'https://t' || c_custkey || '.breezy.hr' when 7 then 'https://t' || c_custkey || '.keka.com/careers' end as root from customer""")
def board_roots(spark: SparkSession, d: str) -> DataFrame:
    """TXT-8."""
    c, i = _customers(spark, d)
    return c.select(i, X.board_root(_case(i, "GREENHOUSE", "LEVER", "ASHBY", "WORKABLE", "SMARTRECRUITERS", "RECRUITEE", "BREEZY", "KEKA", "WORKDAY"), _cat("t", _s(i))).alias("root"))


@query("""select c_custkey, c_name || chr(10) || 'a < b &amp; c' || chr(10) || 'one' || chr(10) || 'two' as text, c_name || ' a < b &amp; c one two' as line from customer""")
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """TXT-9, SRC-1: one layer of entities is decoded."""
    c, i = _customers(spark, d)
    html = _cat("<style>p {}</style><p>", F.col("c_name"), "</p><div>a &lt; b &amp;amp; c</div><ul><li>one</li><li>two</li></ul><SCRIPT>x</SCRIPT>")
    return c.select(i, X.html_to_text(html).alias("text"), X.html_to_line(html).alias("line"))


_PHRASES = "case c_custkey % 6 when 0 then 'We use Go and C++ daily' when 1 then 'going to work' when 2 then 'GO, then rest' when 3 then 'node.js-go' when 4 then 'c++20' else 'I know c++' end"


@query(f"""select c_custkey, c_custkey % 6 in (0, 2) as has_go, c_custkey % 6 in (0, 5) as has_cpp from (select c_custkey, {_PHRASES} as t from customer)""")
def literal_phrases(spark: SparkSession, d: str) -> DataFrame:
    """TXT-13: whole words, case aside; + # . _ - belong to words."""
    c, i = _customers(spark, d)
    text = _case(i, "We use Go and C++ daily", "going to work", "GO, then rest", "node.js-go", "c++20", "I know c++")
    return c.select(i, X.literal_phrase(text, "go").alias("has_go"), X.literal_phrase(text, "C++").alias("has_cpp"))


@query("""select c_custkey, case c_custkey % 4 when 0 then 'Ada Lovelace' when 1 then 'Grace Hopper,Alan M. Turing' when 2 then '' else 'Jean O''Brien' end as names from customer""")
def blog_authors(spark: SparkSession, d: str) -> DataFrame:
    """TXT-18, SRC-22: names of two or three words from metadata and bylines; labels of teams are no persons."""
    c, i = _customers(spark, d)
    html = F.when(i % 4 == 0, L('<script>{"@type":"BlogPosting","author":{"@type":"Person","name":"Ada Lovelace"}}</script><a rel="author">ada lovelace</a><a rel="author">Ada Lovelace</a>'))
    html = html.when(i % 4 == 1, L('<meta name="author" content="Grace Hopper"><a rel="author" href="/x">Alan M. Turing</a><a rel="author">The Team</a><a rel="author">One Two Three Four</a>'))
    html = html.when(i % 4 == 2, L('<meta name="author" content="Editorial Staff"><a rel="author">Postman Team</a><a rel="author">madonna</a>')).otherwise(L('<a rel="author" href="/j">Jean O\'Brien</a><a rel="author">Acme Labs</a>'))
    return c.select(i, F.array_join(D.author_names(html), ",").alias("names"))


@query("""select c_custkey, 'Title ' || c_custkey as title, case when c_custkey % 2 = 0 then 'About ' || c_custkey end as description, case when c_custkey % 3 = 0 then '/careers,https://x.example/jobs/1' else '' end as links from customer""")
def page_facts(spark: SparkSession, d: str) -> DataFrame:
    """TXT-19."""
    c, i = _customers(spark, d)
    html = _cat("<html><title> Title ", _s(i), " </title>", F.when(i % 2 == 0, _cat('<meta name="description" content="About ', _s(i), '">')).otherwise(""), '<a href="/about">x</a>', F.when(i % 3 == 0, '<a href="/careers">a</a><a href="/careers">b</a><a href=\'https://x.example/jobs/1\'>c</a>').otherwise(""))
    m = D.page_metadata(html)
    return c.select(i, m["title"].alias("title"), m["description"].alias("description"), F.array_join(m["career_links"], ",").alias("links"))


@query("""with a as (select l_orderkey, l_linenumber, floor(l_extendedprice)::bigint as n, (l_quantity::int - 2) as age from lineitem), s as (select *, n::varchar as v from a)
select l_orderkey, l_linenumber, case when age <= 0 then 'today' when age = 1 then 'yesterday' when age <= 7 then 'this week' else 'older' end as fresh,
case when length(v) <= 3 then v when length(v) <= 5 then left(v, length(v) - 3) || ',' || right(v, 3) else left(v, length(v) - 5) || ',' || substr(v, length(v) - 4, 2) || ',' || right(v, 3) end as pay from s""")
def posting_lines(spark: SparkSession, d: str) -> DataFrame:
    """TXT-26."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", D.freshness_line(F.col("l_quantity").cast("int") - 2).alias("fresh"), D.indian_number(F.floor("l_extendedprice")).alias("pay"))


@query("""select c_custkey, 'acme' || c_custkey || ',acme-' || c_custkey || ',acme' || c_custkey || 'hq,acme' || c_custkey || '-io,acme' as slugs, c_custkey % 3 = 0 as employed from customer""")
def account_slugs(spark: SparkSession, d: str) -> DataFrame:
    """TXT-28."""
    c, i = _customers(spark, d)
    field = F.when(i % 3 == 0, _cat("@Acme ", _s(i), " (ex Foo)")).when(i % 3 == 1, "Freelance").otherwise("")
    return c.select(i, F.array_join(D.slug_candidates(_cat("Acme ", _s(i), ", Inc")), ",").alias("slugs"), D.employer_matches(field, _cat("acme-", _s(i)), _cat("Acme ", _s(i))).alias("employed"))


@query("""select c_custkey, 'u' || c_custkey || '@mail.example' as email, '+91 98765 ' || (10000 + c_custkey % 80000) as phone from customer""")
def resume_contacts(spark: SparkSession, d: str) -> DataFrame:
    """TXT-29."""
    c, i = _customers(spark, d)
    text = _cat("Name ", F.col("c_name"), " mail u", _s(i), "@mail.example phone +91 98765 ", _s(10000 + i % 80000), " end")
    return c.select(i, X.first_match(text, D.EMAIL).alias("email"), X.first_match(text, X.PHONE).alias("phone"))


@query("""select c_custkey, '<h1>A &amp; B</h1><h2>Skills</h2><ul><li>x &lt; ' || c_custkey || '</li><li>y</li></ul>' as html, '<h2>Skills</h2><p>SQL, Go, K' || c_custkey || '</p>' as tailored from customer""")
def resume_html(spark: SparkSession, d: str) -> DataFrame:
    """TXT-30."""
    c, i = _customers(spark, d)
    sections = F.array(F.struct(L("Skills").alias("heading"), F.array(_cat("x < ", _s(i)), L("y")).alias("lines")))
    return c.select(i, D.master_html(L("A & B"), sections).alias("html"), D.with_keywords(L("<h2>Skills</h2><p>SQL</p>"), F.array(L("Go"), _cat("K", _s(i)))).alias("tailored"))


@query("""select doc_id, trim(lang || chr(10) || coalesce(source || chr(10), '') || substr(text, 1, 2000), ' ') as text from documents where text is not null""")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """TXT-31."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", X.embedding_text(F.col("lang"), F.col("source"), F.col("text")).alias("text"))


@query("""select c_custkey, case c_custkey % 5 when 0 then '{"a": 1}' when 1 then '{"a": "}", "b": {"c": 2}}' when 2 then '{"a":1}' when 3 then '{"k": "x {y"}' end as found from customer""")
def model_replies(spark: SparkSession, d: str) -> DataFrame:
    """TXT-25: the first whole object, braces in strings aside."""
    c, i = _customers(spark, d)
    return c.select(i, X.json_object(_case(i, '{"a": 1}', '```json\n{"a": "}", "b": {"c": 2}}\n```', '{"a":1}\n]\n}', 'Sure: {bad} {"k": "x {y"} done {', "no object")).alias("found"))


@query("""select c_custkey, case c_custkey % 3 when 0 then 'sql,GO,Rust' when 1 then 'a' else '' end as kept from customer""")
def keyword_spellings(spark: SparkSession, d: str) -> DataFrame:
    """SET-4: the last spelling wins, at the first place."""
    c, i = _customers(spark, d)
    words = F.when(i % 3 == 0, F.array(*map(L, ("SQL", " go ", "sql", "", "Rust", "GO")))).when(i % 3 == 1, F.array(L("A"), L("a"))).otherwise(F.array(L("  ")))
    return c.select(i, F.array_join(D.dedupe_keywords(words), ",").alias("kept"))


@query("""select c_custkey, case c_custkey % 4 when 0 then '' when 1 then '45%' when 2 then '3x' else '1200' end as invented from customer""")
def invented_metrics(spark: SparkSession, d: str) -> DataFrame:
    """SET-5: figures of a tailored text that the master does not hold."""
    c, i = _customers(spark, d)
    tailored = _case(i, "cut cost by 40% for 2,000 users", "cut cost by 45% for 2000 users", "made it 3x faster for 2,000 users", "reached 1,200 users, 40% more")
    return c.select(i, F.array_join(F.array_except(D.metrics(tailored), D.metrics(L("Cut cost by 40%, 2000 users"))), ",").alias("invented"))


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'a,b,c,d' else 'x,b' end as people, case when c_custkey % 2 = 0 then 'Lead,Dev' else 'Dev' end as titles from customer""")
def ordered_unions(spark: SparkSession, d: str) -> DataFrame:
    """SET-6, TXT-33: order kept, repeats dropped, capped."""
    c, i = _customers(spark, d)
    a, b = F.when(i % 2 == 0, F.array(L("a"), L("b"))).otherwise(F.array(L("x"))), F.when(i % 2 == 0, F.array(*map(L, "bcde"))).otherwise(F.array(L("b"), L("x")))
    return c.select(i, F.array_join(D.ordered_union(a, b, 4), ",").alias("people"), F.array_join(D.profile_seed(F.when(i % 2 == 0, L("Lead")), F.array(L("Dev"), L("Dev"))), ",").alias("titles"))


@query("""select c_custkey, case c_custkey % 3 when 0 then 'docker' when 1 then '' else 'kafka' end as suggested from customer""")
def suggested_skills(spark: SparkSession, d: str) -> DataFrame:
    """SET-8, TXT-12: parsed skills that are not confirmed and are named in the text."""
    c, i = _customers(spark, d)
    rows = c.select(i, _case(i, "I run Docker and go home", "nothing of it", "Kafka and Docker").alias("t"), F.array(L("docker"), L("kafka"), L("rust")).alias("parsed"), F.when(i % 3 == 2, F.array(L("Docker"))).otherwise(F.array(L("Rust"))).alias("confirmed"))
    return rows.select("c_custkey", F.array_join(D.suggested_skills(F.col("parsed"), F.col("confirmed"), F.col("t")), ",").alias("suggested"))


@query("""with n as (select c_custkey, c_custkey % 7 as e, c_custkey % 2 = 0 as m, c_custkey % 4 as r, c_custkey % 3 as s from customer)
select c_custkey, case when r = 0 then 5 when r = 1 then case when m then 4 else 4 end when m then 4 else 2 end as referral,
 least(5, 2 + case when e = 0 then 2 when s = 0 then 1 else 0 end + case when e > 4 then 1 else 0 end + case when c_custkey % 50 >= 20 then 1 else 0 end) as response from n""")
def contact_scores(spark: SparkSession, d: str) -> DataFrame:
    """SCO-23: confidence of a contact."""
    c, i = _customers(spark, d)
    s = D.contact_confidence(i % 2 == 0, _case(i, "RECRUITER", "HIRING_MANAGER", "PEER", "PEER"), i % 7 == 0, i % 3 == 0, F.when(i % 7 > 4, 1).otherwise(0), i % 50)
    return c.select(i, s["referral"].alias("referral"), s["response"].alias("response"))


@query("""with x as (select c_nationkey as company, c_custkey as id, case c_custkey % 3 when 0 then 'RECRUITER' when 1 then 'PEER' else 'HIRING_MANAGER' end as role, round(c_acctbal)::bigint as pr from customer),
r as (select *, row_number() over (partition by company order by pr desc, id) as rn from x), f as (select r.*, h.role as top from r join r h on h.company = r.company and h.rn = 1)
select company, min_by(id, rn) as "primary", coalesce(min_by(id, rn) filter (rn > 1 and role <> top), min_by(id, rn) filter (rn > 1)) as secondary, min_by(id, rn) filter (role = 'RECRUITER') as recruiter from f group by company""")
def contact_plans(spark: SparkSession, d: str) -> DataFrame:
    """SCO-23: the best contact of a company, another of a different role, the best recruiter."""
    c, i = _customers(spark, d)
    return D.contact_strategy(c.select(F.col("c_nationkey").alias("company"), i.alias("id"), _case(i, "RECRUITER", "PEER", "HIRING_MANAGER").alias("role"), F.floor(F.col("c_acctbal") + 0.5).alias("priority")))


@query("""with x as (select o_orderkey as id, o_orderkey % 6 as mn, o_custkey % 5 as yr, o_orderkey % 4 as mi, o_orderkey % 3 = 0 as ref, o_custkey % 40 as age, o_orderkey % 100 as fit from orders),
f as (select id, 0 as n, 'EXPERIENCE_STRETCH' as factor, case when mn - yr >= 2 then 4 else 3 end as st from x where yr < mn union all select id, 1, 'MISSING_SKILLS', case when mi >= 3 then 4 else 3 end from x where mi > 0 union all select id, 2, 'NO_REFERRAL', 3 from x where not ref
 union all select id, 3, 'APPLIED_LATE', case when age >= 30 then 3 else 2 end from x where age >= 14 union all select id, 4, 'PARTIAL_STACK', case when fit < 45 then 3 else 2 end from x where fit < 60),
k as (select * from f qualify row_number() over (partition by id order by st desc, n) <= 4)
select x.id, coalesce(string_agg(factor || ':' || st, ',' order by st desc, n), '') as causes from x left join k using (id) group by x.id""")
def likely_causes(spark: SparkSession, d: str) -> DataFrame:
    """SCO-25: what may have cost an application, strongest first."""
    o, i, u = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    found = D.likely_causes(i % 6, u % 5, i % 4, i % 3 == 0, u % 40, i % 100)
    return o.select(i.alias("id"), F.array_join(F.transform(found, lambda r: F.concat(r["factor"], L(":"), r["strength"].cast("string"))), ",").alias("causes"))


@query("""with x as (select c_custkey as id, c_custkey % 12 as n, c_custkey % 5 as r, c_custkey % 7 as t, c_custkey % 2 as iv from customer),
y as (select id, n, list_filter([case when floor(r / greatest(n, 1) * 100 + 0.5) < 34 then 'FEW_REFERRALS' end, case when floor(t / greatest(n, 1) * 100 + 0.5) < 50 then 'FEW_TAILORED' end, case when iv = 0 and n >= 8 then 'NO_INTERVIEWS' end], lambda v: v is not null)[1:2] as l from x)
select id, case when n >= 4 then array_to_string(l, ',') else '' end as insights from y""")
def funnel_insights(spark: SparkSession, d: str) -> DataFrame:
    """SCO-25: at most two insights, none below four applications."""
    c, i = _customers(spark, d)
    return c.select(i.alias("id"), F.array_join(D.funnel_insights(i % 12, i % 5, i % 7, i % 2), ",").alias("insights"))


@query("""select c_custkey, case c_custkey % 3 when 0 then 0 when 1 then 100 else 83 end as score, case c_custkey % 3 when 0 then 'UNREADABLE' when 1 then 'SAFE' else 'RISKY' end as verdict from customer""")
def readable_resumes(spark: SparkSession, d: str) -> DataFrame:
    """SCO-29: six checks of a resume's text."""
    c, i = _customers(spark, d)
    body = " ".join(["worked with the team and for the customers in the region of a large company"] * 6)
    good = f"Mail a.b@mail.example phone +91 9876543210\nSUMMARY\n{body}\nSKILLS\nSQL\nEXPERIENCE\n{body}"
    r = D.readability(F.when(i % 3 == 0, "#### 12").when(i % 3 == 1, good).otherwise(good.replace("a.b@mail.example", "none")))
    return c.select(i, r["score"].alias("score"), r["verdict"].alias("verdict"))


@query("""select c_custkey, case c_custkey % 4 when 0 then 100 when 1 then 70 when 2 then 85 else 87 end as score, case when c_custkey % 4 = 1 then 'FIX' else 'SEND' end as verdict, case c_custkey % 4 when 0 then '' when 1 then 'metrics' when 2 then 'format' else 'filler,contact' end as failed from customer""")
def tailoring_gate(spark: SparkSession, d: str) -> DataFrame:
    """SCO-30: checks of a tailored resume."""
    c, i = _customers(spark, d)
    text = _case(i, "Built it, cut cost 40% a@b.example", "Built it, cut cost 55% a@b.example", "Built it, cut cost 40% a@b.example", "Built it as a team player")
    html = F.when(i % 4 == 2, "<table><tr></tr></table><li>Built it</li>").otherwise("<ul><li>Built it</li><li>Led them</li></ul>")
    g = D.quality_gate(L("Cut cost by 40%"), text, html)
    return c.select(i, g["score"].alias("score"), g["verdict"].alias("verdict"), F.array_join(g["failed"], ",").alias("failed"))


@query("""with x as (select c_custkey, c_custkey % 8 as sk, c_custkey % 3 = 0 as y, c_custkey % 5 as n, c_custkey % 4 as p from customer)
select c_custkey, least(100, 40 + case when sk >= 6 then 20 else sk * 3 end + case when y then 15 else 0 end + case when n > 0 then 25 else 0 end)::int as recruiter, least(100, 35 + case when p >= 2 then 25 else p * 12 end + least(25, n * 5))::int as manager from x""")
def reader_scores(spark: SparkSession, d: str) -> DataFrame:
    """SCO-31: what a recruiter and a manager look for; every highlight is owned and has a figure."""
    c, i = _customers(spark, d)
    s = D.audience_scores(F.array_repeat(L("s"), (i % 8).cast("int")), F.when(i % 3 == 0, 4), F.array_repeat(L("Built 3 things"), (i % 5).cast("int")), i % 4)
    return c.select(i, s["recruiter"].cast("int").alias("recruiter"), s["manager"].cast("int").alias("manager"))


@query("""select c_custkey, case c_custkey % 3 when 0 then 'DEVOPS_SRE' when 1 then 'AMBIGUOUS' else 'SALES_PRE_SALES' end as function, case c_custkey % 2 when 0 then 'PRIMARY' else 'NONE' end as intensity, case c_custkey % 4 when 3 then 'UNKNOWN' else 'LEAD' end as seniority,
 case when c_custkey % 40 <= 30 then (c_custkey % 40)::int end as minimum_years, case when c_custkey % 5 = 0 then 'a,b,c,d,e,f,g,h' else '' end as skills from customer""")
def classifications(spark: SparkSession, d: str) -> DataFrame:
    """SCO-33: unknown values of a model's answer are replaced."""
    c, i = _customers(spark, d)
    skills = F.when(i % 5 == 0, F.array(*map(L, ["a", " ", "b", "c", "d", "e", "f", "g", "h", "i"])))
    n = D.normalized_classification(_case(i, "devops_sre", "wizard", "SALES_PRE_SALES"), _case(i, "primary", "huge"), _case(i, "Lead", "LEAD", "lead", None), (i % 40).cast("int"), skills)
    return c.select(i, *[n[k].alias(k) for k in ("function", "intensity", "seniority", "minimum_years")], F.array_join(n["skills"], ",").alias("skills"))


@query("""select c_custkey, c_custkey % 4 = 1 or c_custkey % 3 = 1 as by_place, upper(case c_custkey % 4 when 0 then 'in' when 1 then 'IN' else 'US' end) = 'IN' as by_code, true as no_wish, contains(lower(c_name || ' ' || c_mktsegment), 'build') as searched from customer""")
def country_gates(spark: SparkSession, d: str) -> DataFrame:
    """FLT-2, FLT-3, FLT-15: wanted countries by code or by place, and a search over some columns."""
    c, i = _customers(spark, d)
    country, place = _case(i, "in", "IN", "US", None), _case(i, "Berlin", "Pune, INDIA", None)
    return c.select(i, D.country_gate(country, place, ["IN"], "india").alias("by_place"), F.coalesce(D.country_gate_any_case(country, ["in"]), L(False)).alias("by_code"), D.country_gate(country, place, [], None).alias("no_wish"), D.client_search("BUILD", F.col("c_name"), F.col("c_mktsegment")).alias("searched"))


@query("""with m as (select o_orderkey as job_id, o_custkey as company_id, o_totalprice as score, o_orderstatus from orders where o_orderkey % 3 = 0), f as (select distinct l_orderkey as job_id from lineitem where l_returnflag = 'R'),
k as (select l_orderkey as job_id, l_shipdate as version, l_partkey as family from lineitem qualify row_number() over (partition by l_orderkey order by l_shipdate desc, l_partkey, l_linenumber) = 1)
select m.job_id, c_name as company, score, coalesce('F' || family, 'AMBIGUOUS') as family from m join customer on c_custkey = company_id left join k using (job_id) where o_orderstatus = 'O' and m.job_id not in (select job_id from f)""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """FLT-17: matches to look at, of active jobs without feedback, with the latest classification."""
    m = table(spark, d, "orders").where("o_orderkey % 3 = 0 and o_orderstatus = 'O'").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("company_id"), F.col("o_totalprice").alias("score"))
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "job_id")
    latest = keyed.latest_per_key(lines, ["job_id"], "l_shipdate", "l_partkey", "l_linenumber").select("job_id", _cat("F", _s(F.col("l_partkey"))).alias("family"))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company"))
    open_ = m.join(lines.where("l_returnflag = 'R'").select("job_id"), "job_id", "left_anti")
    return open_.join(names, "company_id").join(latest, "job_id", "left").select("job_id", "company", "score", F.coalesce("family", L("AMBIGUOUS")).alias("family")).orderBy(F.desc("score"), "job_id")


@query("""select c_custkey from customer where (c_custkey % 3 = 0 or date_diff('day', timestamp '2001-01-01' - to_days((c_custkey % 20)::int), timestamp '2001-01-01') >= 7) and (c_custkey % 2 = 0 or c_custkey % 10 < 5)""")
def crawl_due(spark: SparkSession, d: str) -> DataFrame:
    """FLT-11, FLT-16, STR-16: derivations never made or a week old, of companies whose next crawl is due or unset."""
    c, i = _customers(spark, d)
    now = L("2001-01-01 00:00:00").cast("timestamp")
    made = F.when(i % 3 > 0, now - F.make_dt_interval((i % 20).cast("int")))
    following = F.when(i % 2 == 1, now + F.make_dt_interval((i % 10 - 4).cast("int")))
    return c.where(made.isNull() | (made <= now - F.expr("interval 7 days"))).where(following.isNull() | (following <= now)).select(i)


@query("""select vec_id, len(embedding)::int as dims from embeddings""")
def vector_dims(spark: SparkSession, d: str) -> DataFrame:
    """FN-12."""
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dims"))


@query("""select c_custkey, case c_custkey % 3 when 0 then (c_custkey % 30)::double when 1 then 3.5 else 2.0 end as years, case c_custkey % 2 when 0 then 2 else 1 end as modules, case c_custkey % 4 when 0 then 'a,b' when 1 then 'c' else '' end as repos from customer""")
def json_shapes(spark: SparkSession, d: str) -> DataFrame:
    """FN-14..16: a path with fallbacks, an array or an object that holds it, strings or objects in one array."""
    c, i = _customers(spark, d)
    profile = F.when(i % 3 == 0, _cat('{"structured": {"totalYearsExperience": ', _s(i % 30), '}, "years": 9}')).when(i % 3 == 1, L('{"years": 3.5}')).otherwise(L("{}"))
    score = F.when(i % 2 == 0, L('[{"m": 1}, {"m": 2}]')).otherwise(L('{"modules": [{"m": 3}]}'))
    repos = F.when(i % 4 == 0, L('["a", {"name": "b"}]')).when(i % 4 == 1, L('[{"name": "c"}, {"x": 1}]')).when(i % 4 == 2, L("[]"))
    p, m = F.try_parse_json(profile), F.try_parse_json(score)
    years = F.coalesce(F.try_variant_get(p, "$.structured.totalYearsExperience", "double"), F.try_variant_get(p, "$.years", "double"), L(2.0))
    modules = F.coalesce(F.try_variant_get(m, "$", "array<variant>"), F.try_variant_get(m, "$.modules", "array<variant>"))
    each = F.transform(F.coalesce(F.try_variant_get(F.try_parse_json(repos), "$", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))))
    return c.select(i, years.alias("years"), F.size(modules).alias("modules"), F.array_join(F.array_compact(each), ",").alias("repos"))


@query("""select o_orderkey, o_orderpriority as family, case when o_custkey % 2 = 0 then 0.9::double else 0.4::double end as confidence from orders where o_orderpriority <> '5-LOW' and not (o_custkey % 2 = 0 and o_orderkey % 3 = 2) and not (o_custkey % 2 = 1 and o_orderkey % 3 = 0)""")
def copied_classifications(spark: SparkSession, d: str) -> DataFrame:
    """SCO-35: classifications are copied forward unless ambiguous or in conflict: sure of no coding, or unsure of mainly coding."""
    o = table(spark, d, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "AMBIGUOUS").otherwise(F.col("o_orderpriority")).alias("family"), F.when(F.col("o_custkey") % 2 == 0, 0.9).otherwise(0.4).alias("confidence"), _case(F.col("o_orderkey"), "PRIMARY", "SUBSTANTIAL", "NONE").alias("intensity"))
    return D.copied_forward(rows).select("o_orderkey", "family", "confidence")
