"""The operators over their whole tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import exact_dedup, forest, lexical, lines, mixing, packing, pivots, secrets, simhash, substrings, tokens, toxicity, turns


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), secrets.train(secrets.generated_findings(spark)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_partners", F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), digest_all=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(found.fp).alias("fingerprint"), "component_id")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(_table(spark, sf_dir, "embeddings"), "id % 50 = 0")


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_token_counts": op2_token_counts,
    "op3_pivots": op3_pivots,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_substrings": op6_substrings,
    "op7_lines": op7_lines,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simhash": op10_simhash,
    "op11_lexical": op11_lexical,
    "op12_turns": op12_turns,
    "op13_forest": op13_forest,
}

ORACLE_SQL = {
    "op9_exact_dedup": """
with n as (select doc_id, sha256(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents),
g as (select h, max(doc_id) as keep_id, count(*) as group_size from n group by h)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, n.h as text_sha256 from n join g using (h)""",
    "op11_lexical": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
q as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
c as (select count(*)::bigint as n_docs, sum(len(w))::bigint as n_terms from d where len(w) > 0),
tf as (select doc_id, len, term, count(*)::bigint as tf from (select doc_id, len(w)::bigint as len, unnest(w) as term from d) group by all),
df as (select term, count(*)::bigint as df from tf group by term),
qt as (select item_id, term, count(*)::bigint as r from q group by all),
s as (select item_id, doc_id, sum(r * cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len * n_docs) // n_terms))))::bigint as score
 from qt join tf using (term) join df using (term), c group by all)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10""",
    "op12_turns": r"""
with ids as (select distinct conv_id as c from conversations where conv_id is not null),
crc as (select c, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(c as varchar), ''), lambda ch: ascii(ch)::bigint)),
   lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), [0::bigint, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) as r from ids),
h as (select c, xor(r, 4294967295) % 4 as h from crc),
t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as turn from conversations where conv_id is not null),
own as (select c, list(turn order by pos) as turns from t group by c),
built as (select o.c, list_concat(coalesce(b.turns, [])[1:h.h], o.turns[h.h + 1:]) as turns from own o join h using (c) left join own b on b.c = o.c - o.c % 20),
walk as (select c, turns, unnest(range(0, len(turns) + 1)) as depth from built),
node as (select turns[1:depth] as path, depth, min(c) as conv_id, count(*) as n,
   sha256(coalesce(string_agg(case when len(turns) = depth then cast(c as varchar) end, ',' order by c), '')) as ends from walk group by 1, 2),
own_sum as (select *, (n - 1) * coalesce(len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')), 0) as saved from node),
kids as (select path[1:depth - 1] as path, count(*) as n_children from node where depth > 0 group by 1),
told as (select o.*, coalesce(k.n_children, 0) as n_children from own_sum o left join kids k using (path)),
sums as (select unnest(list_transform(range(0, depth + 1), lambda i: path[1:i])) as path, saved, n_children from told),
subtree as (select path, sum(saved) as saved_tokens, sum(case when n_children = 0 then 1 else 0 end) as n_leaves from sums group by path)
select t.conv_id, cast(t.depth as bigint) as depth, p.conv_id as parent_conv_id, t.n as n_convs, cast(t.n_children as bigint) as n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, t.ends as ends_sha256
from told t join subtree s using (path) left join node p on t.depth > 0 and p.path = t.path[1:t.depth - 1]""",
}
