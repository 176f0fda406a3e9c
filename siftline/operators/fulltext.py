"""Full-text search over a positional inverted index (FLT-13, FN-13).

The index has a row for each term of each document: its positions and the field of each.  It
is built by one pass over the texts, without a shuffle; saved, it is sorted by term, so that a
query reads the row groups of its own terms.  Queries are a table as well: words, "phrases",
``or`` and ``-`` become rows of (alternative, clause, offset, term), and matching is an
equi-join on the term, an intersection of positions for phrases, and counts of clauses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.stemming import STOP_WORDS, stem, stems

#: Letters, digits and everything beyond ASCII make words.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Weights of the fields of a document, and the limit of the sum of 1/j^2.
WEIGHTS = (1.0, 0.4, 0.2, 0.1)
RANK_LIMIT = 1.64493406685
#: Every document holds this term, so that a query of exclusions alone has something to exclude from.
ANY = ""

_POSTING = "term string, doc long, positions array<int>, fields array<int>"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, stop = re.compile(TERM), frozenset(STOP_WORDS)
    for batch in batches:
        terms, docs, positions, fields = [], [], [], []

        def out() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((terms, docs, positions, fields), kinds, strict=True)], names=["term", "doc", "positions", "fields"])

        for doc, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, held = 0, {ANY: ([0], [0])}
            for field, text in enumerate(texts):
                for word in words.findall(text or ""):
                    at += 1
                    if word not in stop:
                        mine = held.setdefault(stem(word), ([], []))
                        mine[0].append(at)
                        mine[1].append(field)
            for term, (p, f) in held.items():
                terms.append(term)
                docs.append(doc)
                positions.append(p)
                fields.append(f)
            if len(terms) > 50_000:
                yield out()
                terms, docs, positions, fields = [], [], [], []
        yield out()


def build_index(docs: DataFrame, id_col: str, *fields: Column) -> DataFrame:
    """(term, doc, positions, fields): ``fields`` in order of weight, the heaviest first; positions count through all of them.

    Words are lower-cased and stemmed; stop words have positions but no postings.  Ids are
    expected to be unique, a null id is left out.
    """
    texts = [F.lower(F.coalesce(f, F.lit(""))).alias(f"f{n}") for n, f in enumerate(fields)]
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *texts).mapInArrow(_postings, _POSTING)


def save_index(index: DataFrame, path: str, partitions: int) -> None:
    """Write an index in order of term; a term with very many documents may span files."""
    index.repartitionByRange(partitions, "term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_POSTING).parquet(path)


def parse(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (query, alt, clause, negated, offset, term, words, needed, terms) of queries in the syntax of web searches.

    Words must all occur; words in quotes, or joined by signs, in this order and distance;
    ``or`` parts alternatives (it binds less than what stands side by side), ``-`` before a
    word or quote excludes.  Stop words count only as distance within a phrase.  ``words`` is
    the number of a clause's terms, ``needed`` that of an alternative's clauses to be met,
    ``terms`` that of the query's different terms without the excluded ones.
    """
    pieces = F.posexplode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0)))
    q = queries.select(F.col(id_col).alias("query"), pieces.alias("clause", "piece"))
    so_far = W.partitionBy("query").orderBy("clause").rowsBetween(W.unboundedPreceding, W.currentRow)
    q = q.withColumn("alt", F.sum((F.col("piece") == "or").cast("int")).over(so_far)).where("piece <> 'or'").withColumn("negated", F.startswith("piece", F.lit("-")))
    q = q.select("query", "alt", "clause", "negated", F.posexplode(F.regexp_extract_all("piece", F.lit(TERM), F.lit(0))).alias("offset", "word"))
    q = q.where(~F.col("word").isin(*STOP_WORDS)).withColumn("term", stems("word")).drop("word")
    q = q.withColumn("words", F.count(F.lit(1)).over(W.partitionBy("query", "clause")))
    positive = ~F.col("negated")
    q = q.withColumn("needed", F.size(F.collect_set(F.when(positive, F.col("clause"))).over(W.partitionBy("query", "alt"))))
    q = q.withColumn("terms", F.size(F.collect_set(F.when(positive, F.col("term"))).over(W.partitionBy("query"))))
    alone = q.where("needed = 0").select("query", "alt", F.lit(-1).alias("clause"), F.lit(False).alias("negated"), F.lit(0).alias("offset"), F.lit(ANY).alias("term"), F.lit(1).cast("long").alias("words"), F.lit(1).alias("needed"), "terms").distinct()
    return q.withColumn("needed", F.greatest("needed", F.lit(1))).unionByName(alone)


def term_rank(fields: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    """What one term adds to a document's rank: the weight of each of its places over the square of its number, first places first."""
    w = F.array(*map(F.lit, weights))
    return F.aggregate(F.transform(fields, lambda f, j: F.element_at(w, f + 1) / ((j + 1) * (j + 1))), F.lit(0.0), lambda a, x: a + x) / RANK_LIMIT


def search(index: DataFrame, queries: DataFrame, id_col: str, text_col: str, *, limit: int = 2000, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(query, place, doc, rank): the ``limit`` highest-ranked documents of each query, ties by document.

    The rank is the mean over the query's terms (those not excluded) of ``term_rank``.
    """
    asked = parse(queries, id_col, text_col)
    gain = F.when(~F.col("negated") & (F.col("term") != ANY), F.struct("term", term_rank(F.col("fields"), weights).alias("rank")))
    # one shuffle: all that follows groups within (query, doc)
    hits = asked.join(index, "term").withColumn("gain", gain).repartition("query", "doc")
    starts = F.collect_list(F.transform("positions", lambda p: p - F.col("offset")))
    same = [F.first(c).alias(c) for c in ("negated", "needed", "words", "terms")]
    clauses = hits.groupBy("query", "doc", "alt", "clause").agg(*same, starts.alias("starts"), F.collect_set("gain").alias("gains"))
    common = F.aggregate(F.slice("starts", 2, F.size("starts")), F.get("starts", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    clauses = clauses.withColumn("met", (F.size("starts") == F.col("words")) & (F.size(common) > 0))
    per_alt = clauses.groupBy("query", "doc", "alt").agg(
        (F.count_if(F.col("met") & ~F.col("negated")) == F.first("needed")).alias("all"), F.bool_or(F.col("met") & F.col("negated")).alias("excluded"), F.flatten(F.collect_list("gains")).alias("gains"), F.first("terms").alias("terms"))
    per_doc = per_alt.groupBy("query", "doc").agg(F.bool_or(F.col("all") & ~F.col("excluded")).alias("found"), F.array_distinct(F.flatten(F.collect_list("gains"))).alias("gains"), F.first("terms").alias("terms")).where("found")
    total = F.aggregate("gains", F.lit(0.0), lambda a, g: a + g["rank"])
    ranked = per_doc.select("query", "doc", F.round(total / F.greatest("terms", F.lit(1)), 6).alias("rank"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("rank"), "doc"))
    return ranked.withColumn("place", place).where(F.col("place") <= limit).select("query", "place", "doc", "rank")
