"""A job's record for one person, and the skills of profile versions (SCO-37, SNK-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import scoring as S
from siftline.functions import tech
from siftline.operators import detail, keyed, skills
from siftline.plans.audits import ALIAS_CTE, CANON_SQL, NAMES, PRESENT_SQL, PRINTED_CTES, sql_list
from siftline.session import table

L = F.lit
QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


_SKILLS = ("React.js", "RESTful APIs", "MySQL", "JavaScript", "Node.js")
_TOKENS = ("javascript", "mysql", "node", "react", "rest")
_SAYS = "\nSKILLS React.js, RESTful APIs, MySQL, JavaScript, Node.js, Go, Docker"
_PATHS = ("java", "go", "react-native", "php", "python")
_SHAPES = {"required": (5, "a + {i} * {i} * 3"), "preferred": (3, "b * 5 + {i} * 7"), "specializations": (2, "a * b + {i}")}


def _named(count: int, at: str) -> Column:
    names = F.array(*map(L, NAMES))
    return F.array(*[F.element_at(names, (F.expr(at.format(i=i)) % len(NAMES) + 1).cast("int")) for i in range(count)])


_REACH = ", ".join(f"('{t}', '{f}')" for t, sources in tech.TRANSFERABLE.items() for f in sources)
_MINE = ", ".join(f"'{t}'" for t in _TOKENS)
_ORDER = ", ".join(f"('{t}', {n})" for n, t in enumerate(tech.DISCIPLINES))


@query(rf"""
with recursive line as (select l_orderkey as job_id, l_partkey * 100000 + l_suppkey as version, l_partkey as a, l_suppkey as b from lineitem qualify row_number() over (partition by l_orderkey order by version desc) = 1),
class as (select job_id, 'F' || (a % 7) as role_family, {", ".join(f"[{', '.join(f'({sql_list(NAMES)})[cast(({at.format(i=i)}) % {len(NAMES)} + 1 as int)]' for i in range(count))}] as {name}" for name, (count, at) in _SHAPES.items())} from line),
{ALIAS_CTE}, canon as (select raw, {CANON_SQL} as tech from (select unnest({sql_list(NAMES)}) as raw union select unnest({sql_list(_SKILLS)}))),
reach(tech, source) as (values {_REACH}), discipline(tech, place) as (values {_ORDER}),
wanted as (select job_id, list_concat(required, specializations) as w from class),
asked as (select job_id, raw, min(pos) as pos from (select job_id, unnest(w) as raw, unnest(range(1, len(w) + 1)) as pos from wanted) group by all),
kinds as (select a.*, c.tech, case when c.tech in ({_MINE}) then 'strong' when exists (select 1 from reach r where r.tech = c.tech and r.source in ({_MINE})) then 'transferable' else 'missing' end as kind from asked a join canon c using (raw) where c.tech is not null),
spec as (select job_id, cast(floor((count(*) filter (kind = 'strong') + 0.5::double * count(*) filter (kind = 'transferable')) / count(*) * 100 + 0.5) as bigint) as fit, string_agg(raw, ',' order by pos) filter (kind = 'strong') as strong,
  string_agg(raw, ',' order by pos) filter (kind = 'transferable') as transferable, string_agg(raw, ',' order by pos) filter (kind = 'missing') as missing,
  (select arg_min(d.tech, d.place) from kinds k2 join discipline d on d.tech = k2.tech where k2.job_id = kinds.job_id and d.tech not in ({_MINE})) as discipline from kinds group by job_id),
richer as (select c.job_id, c.raw, c.kind, c.pos, cast(floor(sum(case when a.kind = 'strong' or a.tech = c.tech then 1.0::double when a.kind = 'transferable' or exists (select 1 from reach r where r.tech = a.tech and r.source = c.tech) then 0.5::double else 0 end) / count(*) * 100 + 0.5) as bigint) as fit
  from kinds c join kinds a on a.job_id = c.job_id where c.kind <> 'strong' group by all),
gains as (select r.job_id, r.raw, r.fit - s.fit as gain, row_number() over (partition by r.job_id order by r.fit - s.fit desc, r.kind, r.pos) as k from richer r join spec s using (job_id) where r.fit > s.fit),
what_if as (select job_id, string_agg(raw || '+' || gain, ',' order by k) as what_if from gains where k <= 5 group by 1),
drawn as (select 0 as doc_id, (select text from documents order by doc_id limit 1) || {sql_list([_SAYS])}[1] as text), {PRINTED_CTES},
own as (select c.tech, arg_min(s.raw, s.p) as term from (select unnest({sql_list(_SKILLS)}) as raw, unnest(range(0, {len(_SKILLS)})) as p) s join canon c using (raw) where c.tech is not null group by 1),
cells as (select job_id, 0 as list, unnest(range(1, len(required) + 1)) as i, unnest(required) as k from class union all select job_id, 1, unnest(range(1, len(preferred) + 1)), unnest(preferred) from class),
kept as (select job_id, list, min(i) as i, arg_max(k, i) as keyword, lower(k) as low from cells group by job_id, list, lower(k)),
audit as (select q.*, case when {PRESENT_SQL} then 'PRESENT' when p.tech is null then 'MISSING' when contains(regexp_replace(low, '[^a-z0-9]', '', 'g'), regexp_replace(lower(o.term), '[^a-z0-9]', '', 'g')) or contains(regexp_replace(lower(o.term), '[^a-z0-9]', '', 'g'), regexp_replace(low, '[^a-z0-9]', '', 'g')) then 'ACCEPTED_VARIANT' else 'ADD_EXACT' end as status
  from kept q join drawn s on true left join canon c on c.raw = q.keyword left join printed p on p.tech = c.tech left join own o on o.tech = c.tech
  where q.list = 0 or not exists (select 1 from kept r where r.job_id = q.job_id and r.list = 0 and r.low = q.low)),
words as (select job_id, string_agg(keyword, ',' order by list, i) filter (status = 'ADD_EXACT') as add_exact, string_agg(keyword, ',' order by i) filter (status = 'MISSING' and list = 0) as missing_required,
  cast(floor(count(*) filter (list = 0 and status in ('PRESENT', 'ACCEPTED_VARIANT'))::double / count(*) filter (list = 0) * 100 + 0.5) as bigint) as match_pct from audit group by 1),
prefer as (select ({sql_list(_PATHS)})[r_regionkey + 1] as discipline, r_name as preference from region)
select o_orderkey as job_id, c.role_family, s.fit, coalesce(s.strong, '') as strong, coalesce(s.transferable, '') as transferable, coalesce(s.missing, '') as missing, coalesce(w.what_if, '') as what_if, coalesce(k.add_exact, '') as add_exact, coalesce(k.missing_required, '') as missing_required, k.match_pct,
 s.discipline, p.preference, case when o_orderkey % 3 = 0 then null when o_totalprice / 5000 >= 75 then 'APPLY' when o_totalprice / 5000 >= 60 then 'CONSIDER' else 'SKIP' end as verdict, case when o_orderkey % 3 > 0 then cast(floor(o_totalprice / 5000 + 0.5) as bigint) end as score, c_name as company
from orders left join class c on c.job_id = o_orderkey left join spec s on s.job_id = o_orderkey left join what_if w on w.job_id = o_orderkey left join words k on k.job_id = o_orderkey left join prefer p using (discipline) left join customer on c_custkey = o_custkey""")
def job_detail(spark: SparkSession, d: str) -> DataFrame:
    """SCO-37: the whole record of every job: classification, fit, what-if, keywords, career path, match and company."""
    o, text = table(spark, d, "orders"), table(spark, d, "documents").orderBy("doc_id").select("text").limit(1).first()
    # lines are exchanged as three numbers each; versions and lists are made behind the exchange, lists of an order's newest line only
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).repartition("job_id")
    lines = lines.withColumn("version", F.col("a") * 100_000 + F.col("b"))
    classes = keyed.latest_per_key(lines, ["job_id"], "version").select("job_id", "version", F.concat(L("F"), (F.col("a") % 7).cast("string")).alias("role_family"), *[_named(*how).alias(name) for name, how in _SHAPES.items()])
    score = F.col("o_totalprice") / 5000
    matches = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("job_id"), S.verdict_band(score).alias("verdict"), F.col("o_orderstatus").alias("code"), score.alias("score"))
    companies = table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    prefer = table(spark, d, "region").select(F.element_at(F.array(*map(L, _PATHS)), (F.col("r_regionkey") + 1).cast("int")).alias("discipline"), F.col("r_name").alias("preference"))
    person = detail.Person(_SKILLS, (text.text if text else "") + _SAYS, 4)
    r = detail.job_details(o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("company_id")), classes, matches, companies, prefer, person)
    words = lambda c: F.coalesce(F.array_join(c, ","), L(""))
    gains = F.transform("what_if", lambda w: F.concat(w["skill"], L("+"), w["gain"].cast("string")))
    return r.select(
        "job_id", "classification.role_family", "specialization.fit", *[words(f"specialization.{k}").alias(k) for k in ("strong", "transferable", "missing")], words(gains).alias("what_if"), words("keywords.add_exact").alias("add_exact"),
        words("keywords.missing_required").alias("missing_required"), "keywords.match_pct", "career_path.discipline", "career_path.preference", "match.verdict", "match.score", F.col("company.name").alias("company"))


@query("""
with had as (select p_size as version_id, lower(trim(split_part(p_name, ' ', 1))) as name, min(p_partkey)::double as years from part where p_partkey % 2 = 0 group by all),
said as (select cast(p_size as bigint) as version_id, p_partkey as pos, lower(trim(' ' || upper(split_part(p_name, ' ', 2)) || ' ')) as name, p_type as category, p_retailprice as years from part where p_size % 3 = 0),
old as (select distinct name, 'old' as category from had),
grown as (select name, category from old union all select name, arg_min(category, version_id * 1000000000 + pos) from said where name <> '' and name not in (select name from old) group by 1),
links as (select version_id, name, years from had where version_id % 3 > 0 union all select version_id, name, arg_max(years, pos) from said where name <> '' group by all)
select l.version_id, substring(sha256(l.name), 1, 32) as skill_id, l.name, g.category, l.years from links l join grown g using (name)""")
def skill_sync(spark: SparkSession, d: str) -> DataFrame:
    """SNK-16: the skills of every third version are parsed anew and take the place of its old ones; the vocabulary grows by key."""
    p = table(spark, d, "part").withColumn("version_id", F.col("p_size").cast("long"))
    word = lambda n: F.element_at(F.split("p_name", " "), n)
    had = p.where("p_partkey % 2 = 0").groupBy("version_id", F.lower(F.trim(word(1))).alias("name")).agg(F.min("p_partkey").cast("double").alias("years")).withColumn("skill_id", skills.skill_key(F.col("name")))
    known = had.select("skill_id", "name", L("old").alias("category")).distinct()
    said = p.where("p_size % 3 = 0").select("version_id", F.col("p_partkey").alias("pos"), F.concat(L(" "), F.upper(F.coalesce(F.get(F.split("p_name", " "), L(1)), L(""))), L(" ")).alias("name"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("years"))
    vocabulary, links = skills.sync(known, had.select("version_id", "skill_id", "years"), said, p.where("p_size % 3 = 0").select("version_id").distinct())
    return links.join(vocabulary, "skill_id").select("version_id", "skill_id", "name", "category", "years")
