"""Board payloads, ingest and merges as queries: JSON built from the driver tables, read back by the declared schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import ingest, keyed
from siftline.session import table
from siftline.sources import boards as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
L = F.lit


def query(sql: str):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return add


_TYPES = {"salary_min": "bigint", "salary_max": "bigint", "posted_at": "timestamp"}
_ORDERS = """with o as (select o_orderkey as i, o_orderkey::varchar as k, 't' || o_custkey as t, o_orderdate as posted, o_totalprice as pay,
 'Engineer ' || o_orderpriority as title, case o_orderkey % 3 when 0 then 'Remote, India' when 1 then 'Pune (Hybrid)' else 'Delhi' end as place,
 case o_orderkey % 3 when 0 then 'REMOTE' when 1 then 'HYBRID' end as mode from orders where o_orderkey % 5 <> 4) """


def _expected(source: str, where: str = "true", **fields: str) -> str:
    fields = {"company": "t", "title": "title", "source": f"'{source}'", "description": "''"} | fields
    return _ORDERS + "select " + ", ".join(f"cast({fields.get(c, 'null')} as {_TYPES.get(c, 'varchar')}) as {c}" for c in B.POSTING) + f" from o where {where}"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    place = F.when(i % 3 == 0, "Remote, India").when(i % 3 == 1, "Pune (Hybrid)").otherwise("Delhi")
    # rows without a title go to quarantine
    title = F.when(i % 5 != 4, F.concat(L("Engineer "), "o_orderpriority"))
    return table(spark, d, "orders").select(i.alias("i"), i.cast("string").alias("k"), F.concat(L("t"), F.col("o_custkey").cast("string")).alias("t"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("pay"), title.alias("title"), place.alias("place"))


def _posted(spark: SparkSession, d: str, board: str, **fields: Column) -> DataFrame:
    """Postings of a board from payloads with these fields."""
    payload = _orders(spark, d).select(F.to_json(F.struct(F.col("t").alias("tenant"), *[c.alias(n) for n, c in fields.items()])).alias("line"))
    return B.normalize(payload.select(F.from_json("line", B.BOARDS[board].schema).alias("p")).select("p.*"), board)[0]


def _c(*parts: str | Column) -> Column:
    return F.concat(*[F.col(p) if isinstance(p, str) and p in ("i", "k", "t", "title", "place") else L(p) if isinstance(p, str) else p for p in parts])


def _iso() -> Column:
    return F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query(_expected("greenhouse", external_id="k", description="'Work on ' || k || ' & more' || chr(10) || 'Now'", url="'https://boards.greenhouse.io/' || t || '/jobs/' || k", location="place", work_mode="mode", posted_at="posted"))
def greenhouse_board(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1: content is HTML with its markup encoded, entities in it encoded once more."""
    content = _c("&lt;p&gt;Work on &lt;b&gt;", "k", "&lt;/b&gt; &amp;amp; more&lt;/p&gt;&lt;script&gt;x()&lt;/script&gt;Now")
    return _posted(spark, d, "greenhouse", id=F.col("i"), title=F.col("title"), absolute_url=_c("https://boards.greenhouse.io/", "t", "/jobs/", "k"), first_published=_iso(), location=F.struct(F.col("place").alias("name")), content=content)


@query(_expected("lever", external_id="'L' || k", description="'Plain ' || k", url="'https://jobs.lever.co/' || t || '/' || k", location="place", country="'IN'", posted_at="posted",
    work_mode="case i % 4 when 0 then 'REMOTE' when 1 then 'HYBRID' when 2 then 'ONSITE' else mode end", salary_min="floor(pay)", salary_max="floor(pay) + 5000", currency="'INR'"))
def lever_board(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2."""
    kind = F.when(F.col("i") % 4 == 0, "remote").when(F.col("i") % 4 == 1, "hybrid").when(F.col("i") % 4 == 2, "on-site").otherwise("unspecified")
    low = F.floor("pay").cast("double")
    return _posted(spark, d, "lever", id=_c("L", "k"), text=F.col("title"), hostedUrl=_c("https://jobs.lever.co/", "t", "/", "k"), createdAt=F.unix_millis(F.col("at").cast("timestamp")), country=L("IN"), workplaceType=kind, descriptionPlain=_c("Plain ", "k"),
        categories=F.struct(F.col("place").alias("location")), salaryRange=F.struct(low.alias("min"), (low + 5000).alias("max"), L("INR").alias("currency")))


@query(_expected("ashby", "i % 7 <> 3", external_id="'A' || k", description="case when i % 2 = 0 then 'About ' || k || chr(10) || chr(10) || 'Pay ' || k else 'About ' || k end", url="'https://jobs.ashbyhq.com/' || t || '/' || k",
    location="place", posted_at="posted", work_mode="case when i % 3 = 0 then 'REMOTE' end"))
def ashby_board(spark: SparkSession, d: str) -> DataFrame:
    """SRC-3: unlisted postings are left out."""
    return _posted(spark, d, "ashby", id=_c("A", "k"), title=F.col("title"), jobUrl=_c("https://jobs.ashbyhq.com/", "t", "/", "k"), location=F.col("place"), isRemote=F.col("i") % 3 == 0, isListed=F.when(F.col("i") % 7 == 3, False).when(F.col("i") % 7 == 1, True),
        publishedAt=_iso(), descriptionPlain=_c("About ", "k"), compensation=F.when(F.col("i") % 2 == 0, F.struct(_c("Pay ", "k").alias("compensationTierSummary"))))


@query(_expected("workable", external_id="'W' || k", description="'Hi ' || k", url="case when i % 2 = 0 then 'https://x.workable.com/' || k else 'https://apply.workable.com/' || t || '/j/W' || k || '/' end", location="case when i % 4 = 1 then 'Goa' else place end",
    country="case when i % 4 = 1 then 'IN' else 'India' end", work_mode="case when i % 6 = 0 then 'REMOTE' when i % 4 = 1 then null else mode end", posted_at="posted"))
def workable_board(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4: the first of ``locations`` where there is no location, an address made from the tenant where there is none."""
    i = F.col("i")
    return _posted(spark, d, "workable", shortcode=_c("W", "k"), title=F.col("title"), description=_c("<p>Hi ", "k", "</p>"), url=F.when(i % 2 == 0, _c("https://x.workable.com/", "k")), published_on=_iso(), remote=i % 6 == 0,
        location=F.when(i % 4 != 1, F.struct(F.col("place").alias("city"), L("India").alias("country"), L(False).alias("telecommuting"))), locations=F.array(F.struct(L("Goa").alias("city"), L("IN").alias("country"))))


@query(_expected("recruitee", "i % 7 <> 3", external_id="k", description="'Do ' || k || chr(10) || chr(10) || 'Know SQL'", url="'https://' || t || '.recruitee.com/o/' || k", location="place", country="'India'", posted_at="posted",
    work_mode="case i % 4 when 0 then 'REMOTE' when 1 then 'HYBRID' when 2 then 'ONSITE' else mode end"))
def recruitee_board(spark: SparkSession, d: str) -> DataFrame:
    """SRC-6: closed postings are left out."""
    i = F.col("i")
    return _posted(spark, d, "recruitee", id=i, title=F.col("title"), description=_c("<div>Do ", "k", "</div>"), requirements=L("<ul><li>Know SQL</li></ul>"), careers_url=F.when(i % 2 == 0, _c("https://", "t", ".recruitee.com/o/", "k")), location=F.col("place"), country=L("India"),
        remote=i % 4 == 0, hybrid=i % 4 == 1, on_site=i % 4 == 2, created_at=F.date_format("at", "yyyy-MM-dd HH:mm:ss 'UTC'"), status=F.when(i % 7 == 3, "closed").otherwise("published"))


@query(_expected("breezy", external_id="'B' || k", description="'Be ' || k", url="'https://' || t || '.breezy.hr/p/' || case when i % 2 = 0 then 'nice-' || k else 'B' || k end", location="place", country="'IN'", posted_at="posted", work_mode="case when i % 4 = 0 then 'REMOTE' else mode end"))
def breezy_board(spark: SparkSession, d: str) -> DataFrame:
    """SRC-7."""
    i = F.col("i")
    place = F.struct(F.col("place").alias("name"), L("City").alias("city"), F.struct(L("India").alias("name"), L("IN").alias("id")).alias("country"), (i % 4 == 0).alias("is_remote"))
    return _posted(spark, d, "breezy", id=_c("B", "k"), friendly_id=F.when(i % 2 == 0, _c("nice-", "k")), name=F.col("title"), description=_c("<p>Be ", "k", "</p>"), published_date=_iso(), location=place)


@query(_expected("keka", external_id="k", description="'See ' || k", url="'https://' || t || '.keka.com/careers/jobdetails/' || k", location="case when i % 2 = 0 then place else 'Goa' end", country="'IN'", posted_at="posted", work_mode="case when i % 2 = 0 then mode end"))
def keka_board(spark: SparkSession, d: str) -> DataFrame:
    """SRC-8."""
    spot = F.struct(F.when(F.col("i") % 2 == 0, F.col("place")).alias("name"), L("Goa").alias("city"), L("IN").alias("countryCode"))
    return _posted(spark, d, "keka", id=F.col("i"), title=F.col("title"), description=_c("<p>See ", "k", "</p>"), jobLocations=F.array(spot), publishedOn=_iso())


@query(_expected("smartrecruiters", external_id="'S' || k", description="'Role' || chr(10) || 'Do ' || k", url="case when i % 2 = 0 then 'https://apply.example.com/' || k else 'https://jobs.smartrecruiters.com/' || t || '/S' || k end", location="place", country="'IN'", posted_at="posted",
    work_mode="case i % 4 when 0 then 'REMOTE' when 1 then 'HYBRID' end"))
def smartrecruiters_board(spark: SparkSession, d: str) -> DataFrame:
    """SRC-5."""
    i = F.col("i")
    parts = F.create_map(L("job"), F.struct(L("Role").alias("title"), _c("<p>Do ", "k", "</p>").alias("text")))
    return _posted(spark, d, "smartrecruiters", id=_c("S", "k"), name=F.col("title"), releasedDate=_iso(), applyUrl=F.when(i % 2 == 0, _c("https://apply.example.com/", "k")), location=F.struct(F.col("place").alias("city"), L("in").alias("country"), (i % 4 == 0).alias("remote"), (i % 4 == 1).alias("hybrid")), sections=parts)


@query(_expected("remoteok", external_id="'remoteok-' || k", company="'Fish & Co ' || t", description="'All ' || k", url="case when i % 2 = 0 then 'https://remoteok.com/x/' || k else 'https://remoteok.com/remote-jobs/slug-' || k end", location="case when i % 3 = 0 then 'Remote' else place end",
    work_mode="'REMOTE'", salary_min="case when i % 4 > 0 then floor(pay) end", salary_max="case when i % 4 > 0 then floor(pay) + 10 end", currency="case when i % 4 > 0 then 'USD' end", posted_at="posted"))
def remoteok_board(spark: SparkSession, d: str) -> DataFrame:
    """SRC-9: salaries of 0 are none."""
    i = F.col("i")
    low = F.when(i % 4 > 0, F.floor("pay")).otherwise(0).cast("double")
    return _posted(spark, d, "remoteok", id=F.col("k"), slug=_c("slug-", "k"), company=_c("Fish &amp; Co ", "t"), position=F.col("title"), description=_c("<p>All ", "k", "</p>"), location=F.when(i % 3 == 0, "").otherwise(F.col("place")), salary_min=low, salary_max=F.when(low > 0, low + 10).otherwise(0.0),
        url=F.when(i % 2 == 0, _c("https://remoteok.com/x/", "k")).otherwise("/x"), date=_iso())


@query(_expected("adzuna", external_id="'adzuna-' || k", title="'Senior ' || title", company="'Acme ' || t", description="'Many words " + "& more'", url="case when i % 2 = 0 then 'https://www.adzuna.in/x/' || k else 'https://www.adzuna.in/details/' || k end", location="place", country="'IN'", work_mode="mode",
    salary_min="case when i % 4 > 0 then floor(pay + 0.5) end", salary_max="case when i % 4 > 0 then floor(pay + 0.5) end", currency="case when i % 4 > 0 then 'INR' end", posted_at="posted", where="i % 6 <> 1"))
def adzuna_board(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11: only titles of developers, emphasis of the search taken out."""
    i = F.col("i")
    pay = F.when(i % 4 > 0, F.col("pay")).otherwise(0.0)
    title = F.when(i % 6 == 1, L("Sales lead")).otherwise(_c("<strong>Senior</strong>  ", "title"))
    return _posted(spark, d, "adzuna", id=F.col("k"), title=title, description=L(" Many <b>words</b>&nbsp;&amp; more "), redirect_url=F.when(i % 2 == 0, _c("https://www.adzuna.in/x/", "k")), created=_iso(), company=F.struct(_c(" Acme ", "t").alias("display_name")), location=F.struct(F.col("place").alias("display_name")), salary_min=pay, salary_max=pay)


@query(_expected("jooble", external_id="case when i % 2 = 0 then 'jooble-' || k else 'jooble-https://jooble.org/d/' || k end", title="'Junior ' || title", company="'Acme'", description="'Do it'", url="'https://jooble.org/d/' || k", location="place", country="'IN'", work_mode="mode", posted_at="posted", where="i % 6 <> 1"))
def jooble_board(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13: rows without a company are left out."""
    i = F.col("i")
    return _posted(spark, d, "jooble", id=F.when(i % 2 == 0, F.col("k")), title=_c("<b>Junior</b> ", "title"), snippet=L("<b>Do</b> it"), link=_c("https://jooble.org/d/", "k"), company=F.when(i % 6 == 1, "  ").otherwise("Acme"), location=F.col("place"), updated=_iso())


@query(_expected("hn", where="i % 4 in (0, 1)", external_id="'hn-' || k", company="'Acme ' || i % 9", title="'Backend Engineer'", url="case when i % 4 = 0 then 'https://acme.example/jobs' else 'https://news.ycombinator.com/item?id=' || k end", location="case when i % 4 = 0 then 'Remote (worldwide)' else 'Bengaluru' end",
    country="case when i % 4 = 1 then 'IN' end", work_mode="case when i % 4 = 0 then 'REMOTE' end", description="case when i % 4 = 0 then 'Acme ' || i % 9 || ' | Backend Engineer | Remote (worldwide) We build things & more at https://acme.example/jobs .' else 'Acme ' || i % 9 || ' | Backend Engineer | Bengaluru We build very many things, write to us to learn more.' end")
    .replace("from orders where o_orderkey % 5 <> 4", "from orders"))
def hiring_thread(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10: comments of a hiring thread; other regions, short ones and those without a role give no row."""
    i = F.col("i")
    head = F.concat(L("Acme "), (i % 9).cast("string"), L(" | Backend Engineer | "))
    text = F.when(i % 4 == 0, F.concat(head, L('Remote (worldwide)<p>We build things &amp; more at <a href="https://acme.example/jobs">here</a>.'))).when(i % 4 == 1, F.concat(head, L("Bengaluru<p>We build very many things, write to us to learn more.")))
    text = text.when(i % 4 == 2, F.concat(head, L("Remote (worldwide)<p>We build things, US only, must be located in the US, sorry for that."))).otherwise(L("short"))
    return B.thread_postings(_orders(spark, d).select(F.col("k").alias("id"), text.alias("text")))


@query("""select 'Co ' || c_custkey as name, 'https://c' || c_custkey || '.example' as website, 'R' || c_nationkey as region, case when c_custkey % 3 = 0 then 'City' || c_nationkey end as city from customer where c_custkey % 4 <> 1 and c_custkey % 5 <> 2 and c_custkey % 7 <> 3""")
def directory_seed(spark: SparkSession, d: str) -> DataFrame:
    """SRC-14: companies that hire, are active and have a website."""
    i, k = F.col("c_custkey"), F.col("c_custkey").cast("string")
    raw = table(spark, d, "customer").select(_c("Co ", k).alias("name"), F.when(i % 4 != 1, _c("https://c", k, ".example")).alias("website"), (i % 5 != 2).alias("isHiring"), F.when(i % 7 == 3, "Inactive").when(i % 7 == 4, "Active").alias("status"),
        F.array(_c("R", F.col("c_nationkey").cast("string")), L("other")).alias("regions"), F.when(i % 3 == 0, _c(" City", F.col("c_nationkey").cast("string"), ", Land; Else, Land")).otherwise("").alias("all_locations"))
    return B.directory_companies(raw)


@query("""with p as (select c_custkey as pos, 'Place ' || c_custkey % 40 as name, case when c_custkey % 3 > 0 then 'https://p' || c_custkey || '.example' end as website from customer)
select pos, case when pos % 2 = 0 then upper(name) else name end as name, website from p qualify row_number() over (partition by name order by pos) = 1 and website is not null""")
def places_sweep(spark: SparkSession, d: str) -> DataFrame:
    """SRC-15: the first of a name, case aside; dropped if that one has no website."""
    i = F.col("c_custkey")
    name = _c("Place ", (i % 40).cast("string"))
    return B.swept_places(table(spark, d, "customer").select(i.alias("pos"), F.when(i % 2 == 0, F.upper(name)).otherwise(name).alias("name"), F.when(i % 3 > 0, _c("https://p", i.cast("string"), ".example")).alias("website")))


@query("""with m as (select distinct 'u' || c_custkey % 50 as login from customer where c_custkey % 4 = 0), c as (select 'u' || l_suppkey as login, sum(l_linenumber)::bigint as contributions, list_sort(list_distinct(list('r' || l_partkey % 5))) as repos from lineitem where l_quantity < 5 group by 1),
b as (select coalesce(m.login, c.login) as login, m.login is not null as public_member, coalesce(contributions, 0) as contributions, coalesce(array_to_string(repos, ','), '') as repos from m full join c using (login))
select * from b order by public_member desc, contributions desc, login limit 30""")
def public_people(spark: SparkSession, d: str) -> DataFrame:
    """SRC-21: public members and contributors of an organisation, the top 30."""
    members = table(spark, d, "customer").where("c_custkey % 4 = 0").select(_c("u", (F.col("c_custkey") % 50).cast("string")).alias("login"))
    given = table(spark, d, "lineitem").where("l_quantity < 5").select(_c("u", F.col("l_suppkey").cast("string")).alias("login"), F.col("l_linenumber").cast("long").alias("contributions"), _c("r", (F.col("l_partkey") % 5).cast("string")).alias("repo"))
    return B.public_people(members, given).withColumn("repos", F.array_join("repos", ","))


@query("""with s as (select o_custkey as company_id, 'x' || o_orderkey as external_id, 'f' || o_orderkey % 97 as fingerprint, o_orderpriority as title, 'seed' as source, case when o_orderkey % 10 = 0 then 'REMOVED' else 'ACTIVE' end as status, o_orderdate as first_seen, o_orderdate as last_seen from orders where o_orderkey % 3 > 0),
b as (select o_custkey as company_id, 'x' || (o_orderkey - o_orderkey % 2) as external_id, 'f' || o_orderkey % 97 as fingerprint, 'new ' || o_orderpriority as title, 'direct' as source, o_orderkey as pos from orders where o_orderkey % 4 > 1),
d1 as (select * from b qualify row_number() over (partition by company_id, external_id order by pos) = 1), d2 as (select * from d1 qualify row_number() over (partition by company_id, fingerprint order by pos) = 1),
own as (select company_id, fingerprint, min(external_id) as owner from s group by all),
j as (select d2.*, own.owner, s.external_id is not null as known from d2 left join own using (company_id, fingerprint) left join s on s.company_id = d2.company_id and s.external_id = d2.external_id),
dup as (select distinct company_id, owner as external_id from j where owner is not null and not known and owner <> external_id), fresh as (select * from j where not (owner is not null and not known and owner <> external_id)),
m as (select coalesce(f.company_id, s.company_id) as company_id, coalesce(f.external_id, s.external_id) as external_id, coalesce(f.fingerprint, s.fingerprint) as fingerprint, coalesce(f.title, s.title) as title, coalesce(f.source, s.source) as source,
 coalesce(s.status, 'ACTIVE') as status, coalesce(s.first_seen, timestamp '2002-01-01') as first_seen, case when f.company_id is not null then timestamp '2002-01-01' else s.last_seen end as last_seen, f.company_id is not null as touched from s full join fresh f on f.company_id = s.company_id and f.external_id = s.external_id)
select m.company_id, m.external_id, fingerprint, title, source, case when touched or dup.company_id is not null then 'ACTIVE' when c.company_id is not null and status = 'ACTIVE' then 'REMOVED' else status end as status, first_seen, case when touched or dup.company_id is not null then timestamp '2002-01-01' else last_seen end as last_seen
from m left join dup on dup.company_id = m.company_id and dup.external_id = m.external_id left join (select distinct company_id from b) c on c.company_id = m.company_id""")
def board_ingest(spark: SparkSession, d: str) -> DataFrame:
    """SNK-3, SNK-4, STR-2, STR-3: a full snapshot of boards into the state, two keys against duplicates, removal sweep."""
    o, i = table(spark, d, "orders"), F.col("o_orderkey")
    status = F.when(i % 10 == 0, "REMOVED").otherwise("ACTIVE")
    state = o.where(i % 3 > 0).select(F.col("o_custkey").alias("company_id"), _c("x", i.cast("string")).alias("external_id"), _c("f", (i % 97).cast("string")).alias("fingerprint"), F.col("o_orderpriority").alias("title"), L("seed").alias("source"), status.alias("status"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"))
    batch = o.where(i % 4 > 1).select(F.col("o_custkey").alias("company_id"), _c("x", (i - i % 2).cast("string")).alias("external_id"), _c("f", (i % 97).cast("string")).alias("fingerprint"), _c("new ", F.col("o_orderpriority")).alias("title"), L("direct").alias("source"), i.alias("batch_pos"))
    return ingest.apply_batch(state, batch, L("2002-01-01 00:00:00").cast("timestamp"), full_snapshot=True)


@query("""with e as (select c_custkey as id, 'Co ' || c_custkey as name, case when c_custkey % 2 = 0 then 'https://www.c' || c_custkey || '.example/' end as website, case when c_custkey % 3 = 0 then 'LEVER' end as p, case when c_custkey % 3 = 0 then 'co' || c_custkey end as ident from customer),
s as (select s_suppkey as k, s_suppkey % 4 as g from supplier)
select e.id, e.name, coalesce(e.website, case when g = 2 then 'https://n' || k || '.example' end) as website, coalesce(e.p, case when g in (1, 2) then 'ASHBY' end) as ats_provider, coalesce(e.ident, case when g in (1, 2) then 'n' || k end) as ats_identifier from e left join s on e.id = s.k and s.g < 3
 and ((g = 0 and e.p is not null) or (g = 1 and e.website is not null) or g = 2)
union all select null, 'New ' || k, 'https://new' || k || '.example', null, null from s where g = 3
union all select null, 'Other ' || k, null, 'LEVER', 'co' || k from s where g = 0 and k % 3 > 0
union all select null, 'Third ' || k, 'http://c' || k || '.example/jobs', 'ASHBY', 'n' || k from s where g = 1 and k % 2 > 0""")
def company_merge(spark: SparkSession, d: str) -> DataFrame:
    """SNK-5, SNK-6: found companies meet known ones by board id, host or name; blanks are filled, the rest is appended."""
    i, k = F.col("c_custkey"), F.col("c_custkey").cast("string")
    known = table(spark, d, "customer").select(i.alias("id"), _c("Co ", k).alias("name"), F.when(i % 2 == 0, _c("https://www.c", k, ".example/")).alias("website"), F.when(i % 3 == 0, L("LEVER")).alias("ats_provider"), F.when(i % 3 == 0, _c("co", k)).alias("ats_identifier"))
    g, s = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    found = table(spark, d, "supplier").select(
        F.when(g == 0, _c("Other ", s)).when(g == 1, _c("Third ", s)).when(g == 2, _c("CO ", s)).otherwise(_c("New ", s)).alias("name"),
        F.when(g == 1, _c("http://c", s, ".example/jobs")).when(g == 2, _c("https://n", s, ".example")).when(g == 3, _c("https://new", s, ".example")).alias("website"),
        F.when(g == 0, "LEVER").when(g.isin(1, 2), "ASHBY").alias("ats_provider"), F.when(g == 0, _c("co", s)).when(g.isin(1, 2), _c("n", s)).alias("ats_identifier"))
    return ingest.merge_companies(known, found)


@query("""select coalesce(n.k, o.k) as k, coalesce(n.score, o.score) as score, coalesce(o.created, n.created) as created, o.k is null as inserted, n.k is not null as touched from (select l_orderkey * 10 + l_linenumber as k, max(l_quantity) as score, min(l_shipdate) as created from lineitem where l_returnflag = 'A' group by 1) o
full join (select l_orderkey * 10 + l_linenumber as k, min(l_tax) as score, max(l_shipdate) as created from lineitem where l_linestatus = 'F' group by 1) n on o.k = n.k""")
def match_upsert(spark: SparkSession, d: str) -> DataFrame:
    """SNK-7, SNK-9, SNK-13, SNK-17: new values replace old ones, the time of creation stays."""
    rows = table(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    old = rows.where("l_returnflag = 'A'").groupBy("k").agg(F.max("l_quantity").alias("score"), F.min("l_shipdate").alias("created"))
    new = rows.where("l_linestatus = 'F'").groupBy("k").agg(F.min("l_tax").alias("score"), F.max("l_shipdate").alias("created"))
    return keyed.upsert(old, new, ["k"], keep_old=("created",))


@query("""select vec_id, label from embeddings where vec_id % 3 <> 1""")
def embedding_insert(spark: SparkSession, d: str) -> DataFrame:
    """SNK-8, SNK-16: vectors whose key has none yet."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return keyed.insert_if_absent(e.where("vec_id % 3 = 1"), e, ["vec_id"])


@query("""select c_custkey, c_name, coalesce(case when c_custkey % 2 = 0 then c_mktsegment end, 'filled ' || c_nationkey) as segment from customer""")
def flags_filled(spark: SparkSession, d: str) -> DataFrame:
    """SNK-14: blanks are filled, nothing is overwritten."""
    c = table(spark, d, "customer")
    known = c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    return keyed.fill_blanks(known, c.select("c_custkey", _c("filled ", F.col("c_nationkey").cast("string")).alias("segment")), ["c_custkey"])
