"""Outreach and the graph of pages behind it (SCO-24, SRT-8, SRC-22, TXT-17, TXT-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import outreach as O
from siftline.functions.html import ANCHOR
from siftline.functions.links import PARTS
from siftline.functions.text import EMAIL, GENERAL_LOCAL, JUNK_DOMAIN, JUNK_LOCAL, RECRUITING_LOCAL
from siftline.operators import graphs
from siftline.session import table

L = F.lit
QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


_NOW = "2026-01-15 12:00:00"
_MOVES = " ".join(f"when s.status = '{a}' and e.event = '{b}' then '{c}'" for (a, b), c in O.TRANSITIONS.items())


@query(rf"""
with recursive e as (select conv_id, timestamp '2026-01-01' + to_days(cast(coalesce(turn, 0) * (conv_id % 4 + 1) as int)) as moment, coalesce(turn, 0) as seq,
  case role when 'system' then 'DRAFT' when 'user' then case when length(text) % 11 = 0 then 'ARCHIVE' else 'SEND' end else case when length(text) % 3 = 0 then 'REPLY' else 'AUTO' end end as event,
  row_number() over (partition by conv_id order by moment, seq, event) as n from conversations where conv_id is not null),
s(conv_id, n, status, contacted_at, last_nudge_at, nudges, replied_at) as (
  select distinct conv_id, 0::bigint, 'SUGGESTED', null::timestamp, null::timestamp, 0, null::timestamp from e
  union all select s.conv_id, e.n, case {_MOVES} else s.status end, case when e.event = 'SEND' and s.status in ('SUGGESTED', 'DRAFTED') then e.moment else s.contacted_at end,
    case when e.event = 'SEND' and s.status = 'CONTACTED' then e.moment else s.last_nudge_at end, s.nudges + case when e.event = 'SEND' and s.status = 'CONTACTED' then 1 else 0 end, case when e.event = 'REPLY' and s.status = 'CONTACTED' then e.moment else s.replied_at end
  from s join e on e.conv_id = s.conv_id and e.n = s.n + 1),
f as (select *, greatest(0, (epoch_us(timestamp '{_NOW}') - epoch_us(coalesce(last_nudge_at, contacted_at, timestamp '{_NOW}'))) // 86400000000) as waited, case when nudges = 0 then 3 else 5 end as lim from s qualify row_number() over (partition by conv_id order by n desc) = 1),
a as (select *, case when status = 'REPLIED' then 'REPLIED' when status = 'DRAFTED' then 'CONTACT' when status <> 'CONTACTED' then 'NONE' when nudges >= 2 then 'RESTING' when waited < lim then 'AWAIT' when nudges = 1 then 'FOLLOW_UP_2' else 'FOLLOW_UP' end as action from f)
select conv_id, status, nudges, action, case action when 'REPLIED' then 'Replied — take it forward' when 'CONTACT' then 'Send your intro' when 'RESTING' then 'Two nudges sent — let it rest' when 'FOLLOW_UP_2' then 'Second nudge is due' when 'FOLLOW_UP' then 'Follow up — no reply yet'
  when 'AWAIT' then 'Follow up in ' || (lim - waited) || case when lim - waited = 1 then ' day' else ' days' end else '' end as label, action in ('REPLIED', 'CONTACT', 'FOLLOW_UP', 'FOLLOW_UP_2') as due,
 case when action = 'REPLIED' then 3 when action = 'CONTACT' then 2 when action like 'FOLLOW%' then case when waited >= lim + 3 then 3 else 2 end when action = 'AWAIT' then 1 else 0 end as urgency, case when status = 'CONTACTED' then waited end as days_since from a""")
def outreach_states(spark: SparkSession, d: str) -> DataFrame:
    """SCO-24: every conversation through the state machine of outreach, and what to do next."""
    c = table(spark, d, "conversations").where("conv_id is not null").withColumn("seq", F.coalesce("turn", L(0).cast("long")))
    n = F.length("text")
    event = F.when(F.col("role") == "system", "DRAFT").when(F.col("role") == "user", F.when(n % 11 == 0, "ARCHIVE").otherwise("SEND")).otherwise(F.when(n % 3 == 0, "REPLY").otherwise("AUTO"))
    at = L("2026-01-01").cast("timestamp") + F.make_dt_interval((F.col("seq") * (F.col("conv_id") % 4 + 1)).cast("int"))
    states = O.contact_states(c.select("conv_id", at.alias("at"), "seq", event.alias("event")), "conv_id")
    action = O.next_action(F.col("status"), F.col("contacted_at"), F.col("last_nudge_at"), F.col("nudges"), L(_NOW).cast("timestamp"))
    return states.select("conv_id", "status", "nudges", action.alias("x")).select("conv_id", "status", "nudges", "x.*")


_PATHS = ("/", "/a/", "/a/b?q=1", "/contact-us", "/c/d/e/", "/team", "/c/contact", "/x/y")
_LINKS = 4
_ANCHOR = "'" + ANCHOR.replace("'", "''").replace('\\"', '"') + "'"


def _sites(spark: SparkSession, d: str) -> DataFrame:
    """page_id, url, html: the stored pages as eight pages each of a site, linked among themselves in all forms an address can take."""
    p = table(spark, d, "pages").where("page_id is not null").select("page_id", F.coalesce("html", L("")).alias("html"))
    host = F.concat(L("www.site"), F.floor(F.col("page_id") / 8).cast("string"), L(".example.net"))
    path = lambda at: F.element_at(F.array(*map(L, _PATHS)), (F.pmod(at, L(8)) + 1).cast("int"))
    n = F.length("html").cast("long")

    def link(i: Column) -> Column:
        to, form = path(F.col("page_id") * 3 + i * 5 + n), F.pmod(F.col("page_id") + i + F.floor(n / 7), L(5))
        href = F.when(form == 0, to).when(form == 1, F.concat(L("//"), F.upper(host), to)).when(form == 2, F.concat(L("../../../../."), to)).when(form == 3, F.concat(L("./x/.."), to, L("#f"))).otherwise(F.concat(L("?p="), i.cast("string")))
        return F.concat(L("<a rel=x href=\""), href, L("\">"), F.when((F.col("page_id") + i) % 6 == 0, "Contact <b>the team</b>").otherwise("more"), L("</a>"))

    mails = F.concat(L("<p>jobs@site"), F.floor(F.col("page_id") / 8).cast("string"), L(".example.net, p"), (F.col("page_id") % 8).cast("string"), L("@"), F.regexp_replace(host, "^www\\.", ""), L(" a@other.example.net noreply@"), host, L("</p>"))
    body = F.concat("html", F.array_join(F.transform(F.sequence(L(0), L(_LINKS - 1)), link), ""), mails)
    return p.select("page_id", F.concat(L("https://"), host, path(F.col("page_id")), F.when(F.col("page_id") % 8 == 5, "#top").otherwise("")).alias("url"), body.alias("html"))


def _sql_resolved(href: str, base: str) -> str:
    g = lambda x, n: f"regexp_extract(trim({x}), '{PARTS}', {n})"
    own = f"coalesce(nullif({g(base, 5)}, ''), '/')"
    path = f"case when {g(href, 2)} <> '' or {g(href, 3)} <> '' then {g(href, 5)} when {g(href, 5)} = '' then {own} when starts_with({g(href, 5)}, '/') then {g(href, 5)} else regexp_replace({own}, '[^/]*$', '') || {g(href, 5)} end"
    segments = f"string_split(regexp_replace({path}, '^/', ''), '/')"
    walked = f"list_reduce(list_prepend('', {segments}), lambda acc, s: case s when '.' then acc when '..' then regexp_replace(acc, '/[^/]*$', '') else acc || '/' || s end)"
    query = f"case when {g(href, 2)} = '' and {g(href, 3)} = '' and {g(href, 5)} = '' and {g(href, 6)} = '' then {g(base, 6)} else {g(href, 6)} end"
    scheme = f"lower(case when {g(href, 2)} = '' then {g(base, 2)} else {g(href, 2)} end)"
    authority = f"lower(case when {g(href, 2)} = '' and {g(href, 3)} = '' then {g(base, 3)} else {g(href, 3)} end)"
    return f"case when {scheme} in ('http', 'https') and length({authority}) > 2 then {scheme} || ':' || {authority} || {walked} || case when {segments}[-1] in ('.', '..') then '/' else '' end || {query} end"


def _sql_link(i: int) -> str:
    to = f"({[*_PATHS]})[cast((page_id * 3 + {i * 5} + n) % 8 + 1 as int)]"
    href = f"case (page_id + {i} + n // 7) % 5 when 0 then {to} when 1 then '//' || upper(host) || {to} when 2 then '../../../../.' || {to} when 3 then './x/..' || {to} || '#f' else '?p={i}' end"
    return f"""'<a rel=x href="' || {href} || '">' || case when (page_id + {i}) % 6 = 0 then 'Contact <b>the team</b>' else 'more' end || '</a>'"""


_GRAPH = rf"""
with recursive base as (select page_id, coalesce(html, '') as html, length(coalesce(html, '')) as n, 'www.site' || page_id // 8 || '.example.net' as host from pages where page_id is not null),
site as (select page_id, 'https://' || host || ({[*_PATHS]})[cast(page_id % 8 + 1 as int)] || case when page_id % 8 = 5 then '#top' else '' end as url, html || {" || ".join(_sql_link(i) for i in range(_LINKS))} || '<p>jobs@site' || page_id // 8 || '.example.net, p' || page_id % 8 || '@' || regexp_replace(host, '^www\.', '') || ' a@other.example.net noreply@' || host || '</p>' as html from base),
known as (select page_id, html, {_sql_resolved("''", "url")} as address, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') as host from site),
rooted as (select *, first_value(page_id) over (partition by host order by not regexp_matches(address, '^https?://[^/]+/$'), page_id) as root from known),
raw as (select page_id, url, regexp_extract_all(html, {_ANCHOR}, 1) as hs, regexp_extract_all(html, {_ANCHOR}, 2) as ts from site),
link as (select page_id, {_sql_resolved("h", "url")} as url, t from (select page_id, url, unnest(hs) as h, unnest(ts) as t from raw))"""


@query(_GRAPH + """
select page_id, url, count(*) as n, min(trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) as least_text from link where url is not null group by all""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """TXT-19: every link of every page by its resolved address."""
    return graphs.links(_sites(spark, d)).groupBy("page_id", "url").agg(F.count(L(1)).alias("n"), F.min("text").alias("least_text"))


@query(_GRAPH + rf"""
, edge as (select distinct l.page_id as src, k.page_id as dst, contains(lower(t), 'contact') as says from link l join rooted s on s.page_id = l.page_id join rooted k on k.address = l.url and k.host = s.host),
walk(page_id, clicks) as (select distinct root, 0 from rooted union select dst, clicks + 1 from walk join edge on src = page_id where clicks < 9),
reached as (select page_id, min(clicks) as clicks from walk group by 1),
named as (select dst as page_id, bool_or(says) as says from edge group by 1),
site_rows as (select r.host, r.root, r.page_id, r.address, d.clicks, coalesce(n.says, false) or contains(lower(r.address), 'contact') as is_contact from rooted r join reached d using (page_id) left join named n using (page_id)),
per as (select host, root, count(*) as pages, arg_min(page_id, clicks * 1000000 + page_id) filter (is_contact) as contact_page, arg_min(address, clicks * 1000000 + page_id) filter (is_contact) as contact_url, min(clicks) filter (is_contact) as clicks from site_rows group by all),
mail as (select distinct p.host, regexp_replace(lower(a), '[.,;:]+$', '') as a from per p join known k on k.page_id in (p.root, p.contact_page), unnest(regexp_extract_all(k.html, '{EMAIL}')) as u(a)),
good as (select host, a, case when regexp_matches(split_part(a, '@', 1), '{RECRUITING_LOCAL}') then 0 when regexp_matches(split_part(a, '@', 1), '{GENERAL_LOCAL}') then 1 else 2 end as o from mail
  where not regexp_matches(split_part(a, '@', 1), '{JUNK_LOCAL}') and not regexp_matches(split_part(a, '@', 2), '{JUNK_DOMAIN}') and (split_part(a, '@', 2) = host or ends_with(split_part(a, '@', 2), '.' || host))),
six as (select host, string_agg(a, ',' order by o, a) as emails from (select *, row_number() over (partition by host order by o, a) as k from good) where k <= 6 group by 1)
select host, root, pages, contact_page, contact_url, clicks, coalesce(emails, '') as emails from per left join six using (host)""")
def contact_channels(spark: SparkSession, d: str) -> DataFrame:
    """SRC-22, TXT-17, TXT-19: each site's nearest contact page by clicks from its root, and the addresses found there."""
    return graphs.contact_channels(_sites(spark, d)).withColumn("emails", F.array_join("emails", ","))
