"""Career pages: postings, page summaries and replay (SRC-16..19, STR-7, TXT-20..24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import html as H
from siftline.functions import text as X
from siftline.operators import replay
from siftline.session import table

L = F.lit
QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


#: Titles, places and remarks from which cards of postings are drawn into the stored pages.
_TITLES = (
    "Senior Backend Engineer", "React Developer", "Red Hat Certified Engineer exam", "Data Analyst", "Executive Search", "QA Tester", "Read more", "Engineer", "Platform Architect &amp; Lead", "Outsourcing Consultant",
    "DevOps Specialist", "Blog Manager", "Senior Backend Engineer", "Marketing intern for the very long and winding title of no end", "RPO Recruiter", "Full-stack <b>developer</b>", "Associate, Product", "Technician | Night shift",
)
_PLACES = ("Pune", "Remote", "Bengaluru", "Paris", "hybrid", "Mumbai and Delhi", "Köln")
_REMARKS = ("3-5 years", "Full-time", "12 LPA", "no remark", "2 to 4 yrs, contract", "$ 90000", "INR 5", "infrastructure team", "&nbsp;")
_CARDS = 9
_ADDRESS = ("/careers/{}", "https://jobs.example.org/p/{}", "/team/{}", "//cdn.example.net/apply/{}")


def _one_of(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(L, values)), (F.pmod(at, L(len(values))) + 1).cast("int"))


def _card(i: Column) -> Column:
    """One list item, table row, link or bare text, drawn by the page's number and length."""
    n, p = F.col("n"), F.col("page_id")
    title, place, remark = _one_of(_TITLES, p * 5 + n + i * 7), _one_of(_PLACES, p + n * 3 + i), _one_of(_REMARKS, p * 2 + n + i * 5)
    address = F.replace(_one_of(_ADDRESS, p + i), L("{}"), F.concat(p.cast("string"), L("-"), i.cast("string")))
    link = F.concat(L("<a class='x' href=\""), address, L('">'), title, L("</a>"))
    return (
        F.when((p + i) % 4 == 0, F.concat(L("<li id='j'>"), link, L(" · "), place, L(" · "), remark, L("</li>"))).when((p + i) % 4 == 1, F.concat(L("<tr><td>"), title, L(", "), place, L("</td><td>"), remark, L("</td></tr>")))
        .when((p + i) % 4 == 2, link).otherwise(F.concat(L("<LI>"), title, L("</LI>"))))


def _sites(spark: SparkSession, d: str) -> DataFrame:
    """page_id, url, html: the stored pages, each with cards of postings put into it."""
    pages = table(spark, d, "pages").where("page_id is not null").withColumn("html", F.coalesce("html", L(""))).withColumn("n", F.length("html").cast("long"))
    shell = F.when(F.col("page_id") % 13 == 0, L('<div id="root"></div>')).otherwise("")
    body = F.when(F.col("page_id") % 13 == 0, L("<p>wait</p>")).otherwise(F.concat("html", F.array_join(F.transform(F.sequence(L(0), L(_CARDS - 1)), _card), "")))
    return pages.select("page_id", "url", F.concat(body, shell).alias("html"))


def _list(values: tuple) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: tuple, at: str) -> str:
    return f"({_list(values)})[cast(({at}) % {len(values)} + 1 as int)]"


def _sql_card(i: int) -> str:
    title, place, remark = _pick(_TITLES, f"page_id * 5 + n + {i * 7}"), _pick(_PLACES, f"page_id + n * 3 + {i}"), _pick(_REMARKS, f"page_id * 2 + n + {i * 5}")
    link = f"""'<a class=''x'' href="' || replace({_pick(_ADDRESS, f"page_id + {i}")}, '{{}}', page_id || '-{i}') || '">' || {title} || '</a>'"""
    return f"""case (page_id + {i}) % 4 when 0 then '<li id=''j''>' || {link} || ' · ' || {place} || ' · ' || {remark} || '</li>' when 1 then '<tr><td>' || {title} || ', ' || {place} || '</td><td>' || {remark} || '</td></tr>' when 2 then {link} else '<LI>' || {title} || '</LI>' end"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''").replace('\\"', '"') + "'"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&#?\\w+;', ' ', 'g'), '\\s+', ' ', 'g'))"


_BASE36 = "lower(to_base(cast({} as bigint), 36))"
_SITES = rf"""site as (select page_id, url, case when page_id % 13 = 0 then '<p>wait</p><div id="root"></div>' else html || {" || ".join(_sql_card(i) for i in range(_CARDS))} end as html
  from (select page_id, url, coalesce(html, '') as html, length(coalesce(html, '')) as n from pages where page_id is not null))"""
_FOUND = rf"""
pre as (select page_id, url, html, regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>|<svg\b.*?</svg>|<!--.*?-->', ' ', 'gis') as h from site),
blocks as (select page_id, url, regexp_extract_all(h, '(?is)<li\b[^>]*>.*?</li>|<tr\b[^>]*>.*?</tr>') as b from pre),
rows as (select page_id, url, unnest(range(1, len(b) + 1)) as pos, regexp_replace(unnest(b), '(?is)^<(?:li|tr)\b[^>]*>|</(?:li|tr)>$', '', 'g') as inner_html from blocks),
found as (select page_id, url, pos, coalesce(nullif(trim(string_split_regex({_clean("inner_html")}, {_q(H.SEGMENT)})[1]), ''), {_clean("inner_html")}) as title, nullif(regexp_extract(inner_html, {_q(H.HREF)}, 1), '') as href, {_clean("inner_html")} as context from rows
  union all select page_id, url, 4294967296 + pos, {_clean("t")}, h, {_clean("t")} from (select page_id, url, unnest(range(1, len(hs) + 1)) as pos, unnest(hs) as h, unnest(ts) as t
    from (select page_id, url, regexp_extract_all(h, {_q(H.ANCHOR)}, 1) as hs, regexp_extract_all(h, {_q(H.ANCHOR)}, 2) as ts from pre))),
addressed as (select *, case when href is null then null when regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:') then href when starts_with(href, '//') then regexp_extract(url, '^(https?:)', 1) || href when starts_with(href, '/') then regexp_extract(url, '^(https?://[^/]+)', 1) || href
  else coalesce(nullif(regexp_extract(url, '^(https?://[^?#]*/)', 1), ''), regexp_extract(url, '^(https?://[^/]+)', 1) || '/') || href end as job_url, nullif(regexp_extract(context, {_q(H.CITY)}), '') as location from found where title <> ''),
signs as (select *, len(string_split_regex(title, '\s+')) as words, case when job_url is null then 0 when regexp_matches(job_url, {_q(H.JOB_URL)}) then 25 else 8 end as s_url, case when location is not null then 12 else 0 end as s_place,
  case when regexp_matches(context, {_q(H.EXPERIENCE)}) then 10 else 0 end as s_exp, case when regexp_matches(context, {_q(H.EMPLOYMENT)}) then 8 else 0 end as s_emp, case when regexp_matches(context, {_q(H.DEPARTMENT)}) then 6 else 0 end as s_dep, case when regexp_matches(context, {_q(H.SALARY)}) then 8 else 0 end as s_pay from addressed),
judged as (select *, least(100, 45 + s_url + s_place + s_exp + s_emp + s_dep + s_pay) as score, case when words < 2 or words > 9 or length(title) < 4 or length(title) > 90 then 'bad-length' when regexp_matches(title, {_q(H.NEGATIVE)}) then 'negative-signal'
  when not regexp_matches(title, {_q(H.ROLE)}) then 'no-role' when s_url + s_place + s_exp + s_emp + s_dep + s_pay = 0 then 'insufficient-evidence' end as reject from signs),
told as (select *, case when reject is null and row_number() over (partition by page_id, lower(title), reject is null order by pos) > 1 then 'duplicate-title' else reject end as why from judged),
jobs as (select *, 'careerpage-' || {_BASE36.format("list_reduce(list_prepend(5381::bigint, list_transform(string_split(coalesce(job_url, title), ''), lambda c: unicode(c)::bigint)), lambda h, c: (h * 33 + c) % 4294967296)")} as external_id from told where why is null)
"""
_EXTRACTED, _STORED = (f"with {source},{_FOUND}" for source in (_SITES, "site as (select page_id, url, html from pages)"))


def _host(url: Column) -> Column:
    return X.bare_host(url)


@query(_EXTRACTED + """
select page_id, external_id, title, job_url, location, score, title || case when location is not null then ' · ' || location else '' end || ' — via ' || host || ' careers page.' as description, host as company,
 case when location is not null and lower(location) not in ('remote', 'hybrid') then 'IN' end as country, case when lower(location) = 'remote' then 'REMOTE' end as work_mode
from (select *, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') as host from jobs) where score >= 70 and regexp_matches(job_url, '(?i)^https?://') and host <> ''""")
def career_board_jobs(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16, TXT-22, TXT-23: strong postings of career pages under the site's name."""
    jobs = H.board_jobs(_sites(spark, d), _host(F.col("url")))
    return jobs.select("page_id", "external_id", "title", "job_url", "location", "score", "description", "company", "country", "work_mode")


_PAGES = rf"""
, page as (select page_id, count(*) filter (why is null) as jobs, count(*) filter (why is null and score >= 70 and job_url is not null) as strong, count(*) filter (why is not null) as rejected, sum(score) filter (why is null) as points,
  count(*) filter (why = 'bad-length') as bad_length, count(*) filter (why = 'negative-signal') as negative, count(*) filter (why = 'duplicate-title') as repeated from told group by 1)
"""
_RENDER = rf"""regexp_matches(html, {_q(H.SPA)}) and len(regexp_extract_all(html, '(?i)<a\b')) < 8 and length({_clean("regexp_replace(html, '<script\\b.*?</script>|<style\\b.*?</style>|<svg\\b.*?</svg>', ' ', 'gis')")}) < 1500"""
_CONFIDENCE = "cast(case when strong >= 3 then least(95, 60 + strong) when strong >= 1 then 55 when jobs > 0 then least(45, floor(points / jobs + 0.5)) else 0 end as bigint)"


@query(f"""{_EXTRACTED}{_PAGES}
select s.page_id, {_RENDER} as needs_render, coalesce(jobs, 0) as jobs, coalesce(strong, 0) as strong, coalesce(rejected, 0) as rejected, coalesce(bad_length, 0) as bad_length, coalesce(negative, 0) as negative, coalesce(repeated, 0) as repeated,
 {_CONFIDENCE} as confidence from site s left join page p using (page_id)""")
def career_page_summaries(spark: SparkSession, d: str) -> DataFrame:
    """SRC-17, SRC-19, TXT-20, TXT-21, TXT-24: what the extractor says of each page, with its reasons to reject and the pages that need rendering."""
    s = H.extract(_sites(spark, d))[1]
    why = lambda k: F.coalesce(F.try_element_at("rejections", L(k)), L(0).cast("long"))
    return s.select("page_id", "needs_render", "jobs", "strong", "rejected", why("bad-length").alias("bad_length"), why("negative-signal").alias("negative"), why("duplicate-title").alias("repeated"), "confidence")


@query(f"""{_STORED}{_PAGES}
select s.page_id, {_RENDER} as needs_render, coalesce(jobs, 0) as jobs, coalesce(strong, 0) as strong, coalesce(rejected, 0) as rejected, {_CONFIDENCE} as confidence from site s left join page p using (page_id)""")
def career_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16, SRC-17, TXT-20..24: the same summaries of the pages as they are stored."""
    return H.extract(table(spark, d, "pages"))[1].drop("rejections")


@query(_STORED + """
select page_id, title, job_url, location, score, list_filter(['title', case s_url when 25 then 'job-url' end, case s_url when 8 then 'link' end, case when s_place > 0 then 'location' end, case when s_exp > 0 then 'experience' end, case when s_emp > 0 then 'employment-type' end,
 case when s_dep > 0 then 'department' end, case when s_pay > 0 then 'salary' end], lambda e: e is not null) as evidence, external_id, case when location is not null and lower(location) not in ('remote', 'hybrid') then 'IN' end as country, case when lower(location) = 'remote' then 'REMOTE' end as work_mode from jobs""")
def career_page_jobs(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16: accepted candidates of the pages as they are stored."""
    return H.extract(table(spark, d, "pages"), 70)[0]


def _rule(threshold: int) -> replay.Rule:
    """A version of the extractor: postings at or above a threshold."""
    def run(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        jobs, summary = H.extract(pages, threshold)
        return jobs.where((F.col("score") >= threshold) & F.col("job_url").isNotNull()).select("page_id", "external_id", "title", "score"), summary

    return run


@query(_EXTRACTED + """
, version as (select page_id, case page_id % 3 when 0 then 'v2' when 1 then 'v1' else 'v0' end as v from site),
due as (select page_id from version where v <> 'v2'),
posting as (select page_id, external_id, score from jobs where job_url is not null),
old as (select distinct page_id, external_id from posting join due using (page_id) where score >= 78),
new as (select distinct page_id, external_id from posting join due using (page_id) where score >= 60),
change as (select coalesce(o.page_id, n.page_id) as page_id, case when o.page_id is null then 'ADDED' when n.page_id is null then 'REMOVED' else 'KEPT' end as change from old o full join new n on o.page_id = n.page_id and o.external_id = n.external_id)
select d.page_id, count(*) filter (change = 'ADDED') as added, count(*) filter (change = 'REMOVED') as removed, count(*) filter (change = 'KEPT') as kept from due d left join change using (page_id) group by 1""")
def page_replay(spark: SparkSession, d: str) -> DataFrame:
    """SRC-18, STR-7: rows behind the second version of the extractor are taken anew; what each page gains and loses."""
    pages = _sites(spark, d).withColumn("content", replay.content_key(F.col("html")))
    first, second = _rule(78), _rule(60)
    version = F.element_at(F.array(L("v2"), L("v1"), L("v0")), (F.col("page_id") % 3 + 1).cast("int"))
    never = L(None).cast("timestamp")
    zero = L(0).cast("long")
    snapshots = pages.select("page_id", "url", "content", version.alias("version"), zero.alias("jobs"), zero.alias("strong"), zero.alias("confidence"), never.alias("fetched_at"), never.alias("replayed_at"))
    behind = replay.behind(snapshots, "v2").select("page_id")
    held = replay.take(pages.join(behind, "page_id", "left_semi"), first)[0].withColumn("version", L("v1"))
    contents = pages.select("content", "html").dropDuplicates(["content"])
    _, _, changes = replay.replay(snapshots, contents, held, second, "v2", L("2026-01-01").cast("timestamp"))
    n = lambda k: F.count_if(F.col("change") == k).alias(k.lower())
    return behind.join(changes, "page_id", "left").groupBy("page_id").agg(n("ADDED"), n("REMOVED"), n("KEPT"))
