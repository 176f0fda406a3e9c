"""Keyword audits of documents (SCO-27, TXT-11..14, SET-3, SET-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import documents as D
from siftline.functions import tech
from siftline.session import table

L = F.lit
QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


#: How people write technologies; documents draw what they name and what is asked of them from these.
NAMES = (
    "React.js", "REACT", "ReactJS", "node js", "Node", "NodeJS", "RESTful APIs", "REST API", "rest", "Go", "golang", "go", "Java Script", "JS", "TypeScript", "C++", "c#", "MySQL", "Postgres", "k8s",
    "Spring Boot", "GraphQL", "Machine Learning", "AWS", "core java", "java", "React Native", "react", "apis", "node.js", "Express", "PHP 8", "Figma",
)
_LISTS = {"skills": (6, 7, 3), "required": (7, 5, 7), "preferred": (4, 11, 5)}  # how many, and by which steps they are drawn


def _drawn(count: int, step: int, by: int) -> Column:
    at = lambda i: (F.col("doc_id") * step + L(i * i * by) + F.col("n")) % len(NAMES)
    return F.array(*[F.element_at(F.array(*map(L, NAMES)), (at(i) + 1).cast("int")) for i in range(count)])


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_drawn(count: int, step: int, by: int) -> str:
    return f"list_transform(range(0, {count}), lambda i: ({sql_list(NAMES)})[cast((doc_id * {step} + i * i * {by} + n) % {len(NAMES)} + 1 as int)])"


_W = r"[^A-Za-z0-9+#._-]"
_BY_LENGTH = sorted(tech.ALIASES, key=lambda a: -len(a))
#: Pieces of SQL for other audits: the table of spellings; the token of a name ``raw``; texts of ``drawn`` (doc_id, text) to ``printed`` (doc_id, tech); whether keyword q stands in text s.
ALIAS_CTE = f"""alias(name, tech, place) as (values {", ".join(f"('{a}', '{tech.ALIASES[a]}', {n})" for n, a in enumerate(_BY_LENGTH))})"""
_SPELLED = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '\(.*?\)', ' ', 'g'), '[^a-z0-9+#. \-]', ' ', 'g'), '\s+', ' ', 'g'))"
CANON_SQL = f"""coalesce((select tech from alias where name = {_SPELLED}), (select arg_min(tech, place) from alias where contains(' ' || {_SPELLED} || ' ', ' ' || name || ' ') and name not in ({", ".join(f"'{a}'" for a in tech.AMBIGUOUS)})))"""
PRINTED_CTES = rf"""spaced as (select doc_id, text, ' ' || regexp_replace(text, '({_W})', '\1\1', 'g') || ' ' as wide from drawn),
masked as (select doc_id, text, wide, list_reduce(list_prepend(wide, {sql_list(a for a in _BY_LENGTH if " " in a)}), lambda rest, a: regexp_replace(rest, '({_W})' || replace(regexp_replace(a, '([.+])', '\\\1', 'g'), ' ', '  ') || '({_W})', '\1~\2', 'gi')) as rest from spaced),
printed as (select m.doc_id, a.tech from masked m, alias a where case when contains(a.name, ' ') then false
   when a.name in ({", ".join(f"'{a}'" for a in tech.AMBIGUOUS)}) then len(list_filter(regexp_extract_all(rest, '(?i){_W}(' || a.name || '){_W}', 1), lambda x: x <> lower(x))) > 0
   else regexp_matches(rest, '(?i){_W}' || regexp_replace(a.name, '([.+])', '\\\1', 'g') || '{_W}') end
  union select m.doc_id, a.tech from masked m, alias a where contains(a.name, ' ') and regexp_matches(wide, '(?i){_W}' || replace(a.name, ' ', '  ') || '{_W}'))"""
PRESENT_SQL = rf"""regexp_matches(s.text, '(?i)(^|{_W})' || regexp_replace(q.keyword, '([.*+?^$(){{}}|\[\]\\])', '\\\1', 'g') || '({_W}|$)')"""
_SQL = rf"""
with base as (select doc_id, text, length(text) as n, string_split_regex(trim(text), '[^A-Za-z]+') as own from documents where length(text) > 0),
drawn as (select doc_id, {_sql_drawn(*_LISTS["skills"])} as skills, text || chr(10) || 'SKILLS ' || array_to_string({_sql_drawn(*_LISTS["skills"])}, ', ') as text,
  list_concat({_sql_drawn(*_LISTS["required"])}, [' ' || upper(coalesce(own[4], 'none')) || ' ', coalesce(own[9], 'none') || 'x']) as required, list_concat({_sql_drawn(*_LISTS["preferred"])}, [coalesce(own[6], 'none')]) as preferred from base),
cells as (select doc_id, 'required' as list, i, trim(required[i]) as k from (select doc_id, required, unnest(range(1, len(required) + 1)) as i from drawn)
  union all select doc_id, 'preferred', i, trim(preferred[i]) from (select doc_id, preferred, unnest(range(1, len(preferred) + 1)) as i from drawn)),
kept as (select doc_id, list, min(i) as i, arg_max(k, i) as keyword, lower(k) as low from cells where k <> '' group by doc_id, list, lower(k)),
asked as (select *, row_number() over (partition by doc_id, list order by i) - 1 as pos from kept p where list = 'required' or not exists (select 1 from kept r where r.doc_id = p.doc_id and r.list = 'required' and r.low = p.low)),
mine as (select doc_id, skills[i] as raw, i from (select doc_id, skills, unnest(range(1, len(skills) + 1)) as i from drawn)),
{ALIAS_CTE},
spelled as (select raw, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '\(.*?\)', ' ', 'g'), '[^a-z0-9+#. \-]', ' ', 'g'), '\s+', ' ', 'g')) as s from (select keyword as raw from asked union select raw from mine)),
canon as (select raw, coalesce((select tech from alias where name = s), (select arg_min(tech, place) from alias where contains(' ' || s || ' ', ' ' || name || ' ') and name not in ({", ".join(f"'{a}'" for a in tech.AMBIGUOUS)}))) as tech from spelled),
own as (select doc_id, tech, arg_min(raw, i) as term from mine join canon using (raw) where tech is not null group by all),
{PRINTED_CTES},
told as (select q.doc_id, q.list, q.pos, q.keyword, o.term, p.tech is not null as printed,
   {PRESENT_SQL} as literal,
   regexp_replace(lower(q.keyword), '[^a-z0-9]', '', 'g') as a, regexp_replace(lower(o.term), '[^a-z0-9]', '', 'g') as b
  from asked q join spaced s using (doc_id) left join canon c on c.raw = q.keyword left join own o on o.doc_id = q.doc_id and o.tech = c.tech left join printed p on p.doc_id = q.doc_id and p.tech = c.tech),
status as (select *, case when literal then 'PRESENT' when not printed then 'MISSING' when coalesce(a <> '' and b <> '' and (contains(a, b) or contains(b, a)), false) then 'ACCEPTED_VARIANT' else 'ADD_EXACT' end as status from told)
select doc_id, list, cast(pos as int) as pos, keyword, status, case when status in ('ACCEPTED_VARIANT', 'ADD_EXACT') then term end as your_term from status"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "documents").where("length(text) > 0").select("doc_id", "text", F.length("text").alias("n"), F.split(F.trim("text"), "[^A-Za-z]+").alias("own"))
    word = lambda i: F.coalesce(F.get("own", L(i)), L("none"))
    base = base.withColumns({name: _drawn(*how) for name, how in _LISTS.items()})
    return base.select(
        "doc_id", "skills", F.concat("text", L("\nSKILLS "), F.array_join("skills", ", ")).alias("text"),
        F.concat("required", F.array(F.concat(L(" "), F.upper(word(3)), L(" ")), F.concat(word(8), L("x")))).alias("required"), F.concat("preferred", F.array(word(5))).alias("preferred"))


@query(_SQL)
def keyword_audit(spark: SparkSession, d: str) -> DataFrame:
    """SCO-27: technologies and words asked of every document, present, spelled otherwise or missing."""
    return D.keyword_audit(_documents(spark, d), "doc_id", "required", "preferred", "text", "skills").withColumnRenamed("id", "doc_id")
