"""Text, URL, HTML and technology queries (TXT-*, SET-4..8, SRC-16..18, FLT-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import html as H
from siftline.functions import tech as T
from siftline.functions import text as X
from siftline.operators import phrases, search
from siftline.session import table

L = F.lit
QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_NORM = r"array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' and not list_contains(['a','an','the','of','for','and','to','in','at','with','on','our','we','are','is','hiring','job','role','position','opening','vacancy'], w)))), ' ')"


@query(f"select p_partkey, {_NORM.format('p_name || chr(32) || p_type')} as title from part")
def title_normal_form(spark: SparkSession, d: str) -> DataFrame:
    """TXT-1 on plain text."""
    return table(spark, d, "part").select("p_partkey", X.normalize_title(F.concat_ws(" ", "p_name", "p_type"), ascii_only=True).alias("title"))


@query(f"select p_partkey, substring(sha256(p_brand || '::' || {_NORM.format('p_name')} || '::' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) || '::' || 'REMOTE'), 1, 32) as fingerprint from part")
def job_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """TXT-2, TXT-3, FN-18."""
    return table(spark, d, "part").select("p_partkey", X.job_fingerprint(F.col("p_brand"), F.col("p_name"), F.col("p_type"), L("remote"), ascii_only=True).alias("fingerprint"))


@query("select p_partkey, substring(sha256(p_name || '|' || coalesce(cast(p_size as varchar), 'null') || '|' || coalesce(cast(case when p_size > 25 then p_size + 5 end as varchar), 'null')), 1, 16) as hash from part")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """TXT-4."""
    return table(spark, d, "part").select("p_partkey", X.content_hash(F.col("p_name"), F.col("p_size"), F.when(F.col("p_size") > 25, F.col("p_size") + 5)).alias("hash"))


@query("select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') as bare from pages where regexp_matches(url, '^[a-z]+://[a-z0-9.-]+[/?#]?')")
def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    """TXT-7."""
    p = table(spark, d, "pages").where(F.col("url").rlike("^[a-z]+://[a-z0-9.-]+[/?#]?"))
    return p.select("page_id", X.url_host(F.col("url")).alias("host"), X.bare_host(F.col("url")).alias("bare"))


@query("""
with u as (select o_orderkey as id, case o_orderkey % 8 when 0 then 'https://boards.greenhouse.io/acme'||o_orderkey when 1 then 'https://jobs.lever.co/co'||o_orderkey||'/x' when 2 then 'https://t'||o_orderkey||'.recruitee.com/o/1'
  when 3 then 'https://ten'||o_orderkey||'.wd5.myworkdayjobs.com/en-US/site' when 4 then 'https://www.keka.com/' when 5 then 'https://boards.greenhouse.io/embed/job_board?for=tok'||o_orderkey when 6 then 'https://apply.workable.com/api/v1' else 'https://example.com/jobs' end as url from orders)
select id, case id % 8 when 0 then 'GREENHOUSE' when 1 then 'LEVER' when 2 then 'RECRUITEE' when 3 then 'WORKDAY' when 5 then 'GREENHOUSE' when 6 then 'WORKABLE' else 'UNKNOWN' end as provider,
 case id % 8 when 0 then 'acme'||id when 1 then 'co'||id when 2 then 't'||id when 3 then 'ten'||id||'/site' when 5 then 'tok'||id end as identifier from u""")
def board_detection(spark: SparkSession, d: str) -> DataFrame:
    """TXT-6."""
    i, k = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    c = lambda *p: F.concat(*[L(x) if isinstance(x, str) else x for x in p])
    url = (
        F.when(i % 8 == 0, c("https://boards.greenhouse.io/acme", k)).when(i % 8 == 1, c("https://jobs.lever.co/co", k, "/x")).when(i % 8 == 2, c("https://t", k, ".recruitee.com/o/1"))
        .when(i % 8 == 3, c("https://ten", k, ".wd5.myworkdayjobs.com/en-US/site")).when(i % 8 == 4, L("https://www.keka.com/")).when(i % 8 == 5, c("https://boards.greenhouse.io/embed/job_board?for=tok", k))
        .when(i % 8 == 6, L("https://apply.workable.com/api/v1")).otherwise(L("https://example.com/jobs"))
    )
    return table(spark, d, "orders").select(i.alias("id"), X.detect_board(url).alias("b")).select("id", "b.provider", "b.identifier")


@query(r"""
select page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(?:style)\b.*?</style>|<(?:script)\b.*?</script>', ' ', 'gis'), '<[^>]+>', ' ', 'g'),
 '&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&apos;',''''),'&nbsp;',' '),'&amp;','&'), '\s+', ' ', 'g'))) as chars from pages""")
def page_text_length(spark: SparkSession, d: str) -> DataFrame:
    """TXT-10."""
    return table(spark, d, "pages").select("page_id", F.length(X.html_to_line(F.col("html"))).cast("long").alias("chars"))


@query(r"""
with p as (select page_id, regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>|<svg\b.*?</svg>|<!--.*?-->', ' ', 'gis') as h from pages)
select page_id, length(regexp_replace(h, '<li\b[^>]*>.*?</li>', '~', 'gis')) as without_items, len(regexp_extract_all(h, '(?is)<a\b[^>]*href=["'']([^"''#]+)["''][^>]*>', 1)) as anchors from p""")
def page_structure(spark: SparkSession, d: str) -> DataFrame:
    """TXT-20, TXT-22: scripts, styles and comments gone; items and links counted."""
    h = H.preprocess(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(F.regexp_replace(h, r"(?is)<li\b[^>]*>.*?</li>", "~")).cast("long").alias("without_items"), F.size(F.regexp_extract_all(h, L(r"(?is)<a\b[^>]*href=[\"']([^\"'#]+)[\"'][^>]*>"), L(1))).cast("long").alias("anchors"))


@query(r"""
with e as (select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda a: regexp_replace(lower(a), '[.,;:]+$', '')))) as a from documents)
select doc_id, count(*) as n, min(a) as first_address from e where not regexp_matches(regexp_replace(a, '@[^@]*$', ''), '^(example|user|name|email|your|yourname|firstname|lastname|no-?reply|noreply|donotreply|test|sentry|wixpress|abuse|postmaster|mailer-daemon)$') group by 1""")
def address_counts(spark: SparkSession, d: str) -> DataFrame:
    """TXT-17, SRC-22: distinct addresses without junk local parts (every domain of these texts is an example)."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", L(X.EMAIL), L(0)), lambda a: F.regexp_replace(F.lower(a), "[.,;:]+$", "")))
    good = F.filter(found, lambda a: ~F.regexp_replace(a, "@[^@]*$", "").rlike(X.JUNK_LOCAL))
    t = table(spark, d, "documents").select("doc_id", good.alias("g")).where(F.size("g") > 0)
    return t.select("doc_id", F.size("g").cast("long").alias("n"), F.array_min("g").alias("first_address"))


@query(r"""
select doc_id, case when length(text) > 300 then left(text, 300) || chr(10) || chr(10) || '[truncated]' else text end as capped, case when contains(lower(text), 'remote') then 'REMOTE' when contains(lower(text), 'hybrid') then 'HYBRID' end as mode from documents""")
def capped_text(spark: SparkSession, d: str) -> DataFrame:
    """TXT-15."""
    return table(spark, d, "documents").select("doc_id", X.cap_text(F.col("text"), 300).alias("capped"), X.work_mode(F.col("text")).alias("mode"))


@query(r"""
with h as (select doc_id, text, left(text, 200) as h from documents),
p as (select *, greatest(case when contains(h, '. ') then length(h) - strpos(reverse(h), ' .') else 0 end, case when contains(h, '.'||chr(10)) then length(h) - strpos(reverse(h), chr(10)||'.') else 0 end,
   case when contains(h, '! ') then length(h) - strpos(reverse(h), ' !') else 0 end, case when contains(h, '? ') then length(h) - strpos(reverse(h), ' ?') else 0 end) as stop,
   case when contains(h, ' ') then length(h) - strpos(reverse(h), ' ') + 1 else 0 end as sp from h)
select doc_id, case when length(text) <= 200 then text when stop > 80 then substring(h, 1, stop) when sp > 80 then substring(h, 1, sp - 1) || '…' else h || '…' end as short from p""")
def sentence_cut(spark: SparkSession, d: str) -> DataFrame:
    """TXT-16."""
    return table(spark, d, "documents").select("doc_id", X.truncate_at_sentence(F.col("text"), 200).alias("short"))


@query(r"""
select c_custkey, case when list_contains(['google','meta','apple','stripe','uber'], n) then 'BIG_TECH' else 'UNKNOWN' end as tier from
(select c_custkey, trim(regexp_replace(replace(replace(lower(case c_custkey % 7 when 0 then 'Google, Inc' when 1 then 'Meta' when 2 then 'Stripe LLC' when 3 then 'Apple Corp.' when 4 then 'uber ltd' else c_name end), ',', ''), '.', ''), '\s+(inc|llc|ltd|corp)$', '')) as n from customer)""")
def company_tiers(spark: SparkSession, d: str) -> DataFrame:
    """TXT-27."""
    i = F.col("c_custkey") % 7
    name = F.when(i == 0, "Google, Inc").when(i == 1, "Meta").when(i == 2, "Stripe LLC").when(i == 3, "Apple Corp.").when(i == 4, "uber ltd").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", X.company_tier(name).alias("tier"))


@query(r"""
select doc_id, length(text) >= 200 and (length(text) - length(regexp_replace(text, '[A-Za-z\s]', '', 'g')))::double/length(text) >= 0.7
 and len(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: w in ('the','and','of','in','to','with','for','a'))) >= 5 as readable from documents where length(text) > 0""")
def readable_text(spark: SparkSession, d: str) -> DataFrame:
    """TXT-32."""
    return table(spark, d, "documents").where("length(text) > 0").select("doc_id", X.looks_like_text(F.col("text")).alias("readable"))


@query(r"""
select b.item_id, count(*) as n from benchmark b join documents d on contains(lower(d.text), lower(b.text)) group by 1""")
def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """TXT-14: in how many texts each whole passage occurs, case aside."""
    return phrases.phrase_counts(table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("phrase")))


@query(r"""
with t as (select doc_id, lang, string_split_regex(lower(text), '[^a-z0-9]+') as w from documents)
select doc_id, len(list_filter(w, lambda x: x in ('the','thing'))) as tf from t where list_contains(w, 'the') and (list_contains(w, 'and') or list_contains(w, 'of')) and not list_contains(w, 'loser')""")
def full_text(spark: SparkSession, d: str) -> DataFrame:
    """FLT-13, FN-13: words, OR and exclusion on own tokens; the rank is a term count, without stemming."""
    t = table(spark, d, "documents").select("doc_id", search.tokens(F.col("text")).alias("w"))
    m = t.where(search.matches(F.col("w"), all_of=["the"], any_of=["and", "of"], none_of=["loser"]))
    return m.select("doc_id", search.term_count(F.col("w"), ["the", "thing"]).alias("tf"))


@query(r"""
with s as (select p_partkey, list_distinct([p_type, split_part(p_name, ' ', 2), case when p_size % 3 = 0 then 'React.js' else 'MySQL' end, case when p_size % 5 = 0 then 'go to market' else 'PostgreSQL' end, 'node js', case when p_size % 2 = 0 then 'Rust' else 'GraphQL' end]) as w, p_size from part),
k as (select p_partkey, 1 + 1 + 1 + (case when p_size % 5 = 0 then 0 else 1 end) as n, 1 + (case when p_size % 3 = 0 then 1 else 0 end) as strong,
  (case when p_size % 3 <> 0 then 0 else 0 end) as zero, (case when p_size % 5 <> 0 then 1 else 0 end) * 0 + (case when p_size % 2 <> 0 then 1 else 0 end) as bridged, p_size from s)
select p_partkey, cast(strong as bigint) as strong, cast(bridged as bigint) as transferable, cast(floor((strong + 0.5::double*bridged)/n*100+0.5) as bigint) as fit,
 case when p_size % 2 = 0 then 'rust' end as off_path from k""")
def specialization_fit(spark: SparkSession, d: str) -> DataFrame:
    """TXT-11, SCO-12, SCO-17 for a person who knows react, node and rest."""
    s = F.col("p_size")
    wanted = F.array("p_type", F.element_at(F.split("p_name", " "), 2), F.when(s % 3 == 0, "React.js").otherwise("MySQL"), F.when(s % 5 == 0, "go to market").otherwise("PostgreSQL"), L("node js"), F.when(s % 2 == 0, "Rust").otherwise("GraphQL"))
    t = T.specialization(table(spark, d, "part").select("p_partkey", wanted.alias("wanted")), "p_partkey", "wanted", ("react", "node", "rest"))
    return t.select("p_partkey", F.size("strong").cast("long").alias("strong"), F.size("transferable").cast("long").alias("transferable"), "fit", "off_path")


@query(r"""
with v as (select * from (values (0,'React.js',null,2.5,2.5),(1,'Next.js',null,2.0,2.0),(2,'TypeScript',null,2.0,2.0),(3,'JavaScript',1,2.5,2.5),(3,'GraphQL',0,2.0,2.0),(5,'REST API',null,2.0,2.5),(6,'Kafka',null,2.0,2.0)) t(pos, skill, parity, odd, even)),
k as (select p_partkey, p_size, case when p_size % 3 = 0 then 6 else 7 end as n from part),
g as (select p_partkey, skill, pos, cast(floor((case when p_size % 2 = 1 then odd else even end)::double/n*100+0.5) - floor(1.0::double/n*100+0.5) as bigint) as gain
  from k join v on (parity is null or parity = p_size % 2) and (skill <> 'REST API' or p_size % 3 <> 0)),
r as (select *, row_number() over (partition by p_partkey order by gain desc, pos) as place from g)
select p_partkey, cast(place as int) as place, skill, gain from r where place <= 5""")
def skill_gains(spark: SparkSession, d: str) -> DataFrame:
    """SCO-28 for a person who knows rust: the five skills that would raise the fit most."""
    s = F.col("p_size")
    wanted = F.array(*map(L, ("React.js", "Next.js", "TypeScript")), F.when(s % 2 == 1, "JavaScript").otherwise("GraphQL"), L("Rust"), F.when(s % 3 == 0, "go to market").otherwise("REST API"), L("Kafka"))
    t = T.what_if(table(spark, d, "part").select("p_partkey", wanted.alias("wanted")), "p_partkey", "wanted", ("rust",))
    return t.select("p_partkey", F.posexplode("what_if").alias("at", "x")).select("p_partkey", (F.col("at") + 1).alias("place"), "x.skill", "x.gain")
