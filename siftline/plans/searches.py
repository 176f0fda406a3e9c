"""Search queries over positional indexes (FLT-13, FN-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.functions.stemming import STEPS, STOP_WORDS
from siftline.operators import fulltext
from siftline.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a benchmark item (by number) that make a search: (alternative, clause, excluded, places of the words).
_SHAPE = ((0, 0, False, (5, 6, 7)), (0, 1, False, (12,)), (1, 2, False, (20, 21)), (1, 3, True, (3,)), (2, 4, False, (9,)), (2, 5, False, (30,)), (3, 6, False, (14, 15, 16, 17)))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """A search for each benchmark item: ``"w5 w6 w7" w12 or "w20 w21" -w3 or w9 w30 or "w14 w15 w16 w17"``."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0))
    pieces: list = []
    for n, (alt, _, excluded, places) in enumerate(_SHAPE):
        if n and alt != _SHAPE[n - 1][0]:
            pieces.append(F.lit("or"))
        words = F.array_join(F.array_compact(F.array(*[F.get("w", F.lit(p - 1)) for p in places])), " ")
        pieces.append(F.concat(F.lit('-"' if excluded else '"'), words, F.lit('"')) if len(places) > 1 or excluded else words)
    return table(spark, d, "benchmark").select("item_id", w.alias("w")).select("item_id", F.concat_ws(" ", *pieces).alias("search"))


def _stem_steps(source: str) -> str:
    """CTEs s0, s1, ... that run the suffix rules over column w of ``source``; the last one has (word, w)."""
    ctes, before = [], f"select w as word, w from (select distinct w from {source})"
    for n, step in enumerate(STEPS):
        whens = " ".join(f"when regexp_matches(w, '{t}') then regexp_replace(w, '{p}', '{r}', 'g')" for t, p, r in step)
        ctes.append(f"s{n} as ({before})")
        before = f"select word, case when not regexp_matches(word, '^[a-z]{{3,}}$') then w {whens} else w end as w from s{n}"
    return ", ".join(ctes) + f", stem as ({before})"


def _oracle(texts: str, out: str) -> str:
    """``texts`` gives (doc, title, body) in lower case."""
    shape = ", ".join(f"({a}, {c}, {str(x).lower()}, {n}, {p})" for a, c, x, places in _SHAPE for n, p in enumerate(places))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
with texts as ({texts}),
toks as (select doc, regexp_extract_all(title, '{_TERM}') as t, regexp_extract_all(body, '{_TERM}') as b from texts),
occ as (select doc, unnest(list_concat(t, b)) as w, unnest(range(1, len(t) + len(b) + 1)) as pos, len(t) as in_title from toks),
items as (select item_id, regexp_extract_all(lower(text), '{_TERM}') as w from benchmark),
shape(alt, clause, excluded, off, place) as (values {shape}),
asked as (select item_id, alt, clause, excluded, off, i.w[place] as w from items i, shape where i.w[place] is not null and i.w[place] not in ({stop})),
words as (select w from occ where w not in ({stop}) union all select w from asked), {_stem_steps("words")},
post as (select doc, pos, s.w as term, case when pos <= in_title then 1.0::double else 0.4::double end as weight from occ join stem s on s.word = occ.w where occ.w not in ({stop})),
terms as (select item_id, alt, clause, excluded, off, s.w as term, count(*) over (partition by item_id, clause) as n from asked join stem s on s.word = asked.w),
needed as (select item_id, alt, count(distinct clause) filter (not excluded) as n from terms group by all),
met as (select distinct item_id, alt, clause, excluded, doc from (select item_id, alt, clause, excluded, n, doc, pos - off as start, count(*) as k from terms join post using (term) group by all) where k = n),
good as (select n.item_id, n.alt, m.doc from needed n join met m on m.item_id = n.item_id and m.alt = n.alt group by n.item_id, n.alt, m.doc, n.n having count(*) filter (not m.excluded) = n.n and count(*) filter (m.excluded) = 0 and n.n > 0
  union all select n.item_id, n.alt, t.doc from needed n, texts t where n.n = 0 and not exists (select 1 from met m where m.item_id = n.item_id and m.alt = n.alt and m.doc = t.doc)),
part as (select doc, term, sum(weight / (j * j)) / 1.64493406685::double as s from (select *, row_number() over (partition by doc, term order by pos) as j from post) group by all),
mine as (select distinct item_id, term from terms where not excluded),
size as (select item_id, count(*) as terms from mine group by 1),
ranked as (select g.item_id, g.doc, round(coalesce(sum(p.s) / any_value(z.terms), 0.0::double), 6) as rank
  from (select distinct item_id, doc from good) g left join size z using (item_id) left join mine m on m.item_id = g.item_id left join part p on p.term = m.term and p.doc = g.doc group by 1, 2)
select item_id, cast(row_number() over (partition by item_id order by rank desc, doc) as int) as place, doc as {out}, rank from ranked qualify place <= 2000"""


@query(_oracle("select doc_id as doc, lower(split_part(coalesce(text, ''), chr(10), 1)) as title, lower(substring(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 1)) as body from documents where doc_id is not null", "doc_id"))
def document_search(spark: SparkSession, d: str) -> DataFrame:
    """FLT-13, FN-13: a search for each benchmark item in all documents; the first line weighs as a title."""
    first = F.substring_index("text", "\n", 1)
    index = fulltext.build_index(table(spark, d, "documents"), "doc_id", first, F.expr("substring(text, length(substring_index(text, '\n', 1)) + 1)"))
    return fulltext.search(index, _asked(spark, d), "item_id", "search").select(F.col("query").alias("item_id"), "place", F.col("doc").alias("doc_id"), "rank")


_PLAIN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '<(?:style)\b.*?</style>|<(?:script)\b.*?</script>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),'&apos;',''''),'&nbsp;',' '),'&amp;','&'), '\s+', ' ', 'g'))".replace('\\"', '"')


@query(_oracle(rf"select page_id as doc, lower(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)) as title, lower({_PLAIN}) as body from pages where page_id is not null", "page_id"))
def page_search(spark: SparkSession, d: str) -> DataFrame:
    """FLT-13, FN-13: the same searches in the titles and texts of stored pages."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1)
    index = fulltext.build_index(table(spark, d, "pages"), "page_id", title, X.html_to_line(F.coalesce("html", F.lit(""))))
    return fulltext.search(index, _asked(spark, d), "item_id", "search").select(F.col("query").alias("item_id"), "place", F.col("doc").alias("page_id"), "rank")
