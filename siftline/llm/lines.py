"""Line dedup by pairwise alignment of overlapping documents.

A line that at most ``rare`` documents hold is a signature of all of them: every two that
share it are a pair, so such a line makes at most rare * (rare - 1) / 2 pairs.  A line, or two
lines in a row, that more documents hold leads each of them to the first one that has it, so
that frequent passages go too, without pairs that grow with the square of a group.  Documents
with the same lines are folded first: the one with the smallest id stands for all, and the
others are aligned with it alone.  A pair is aligned by patience diff on line hashes, and
aligned common blocks go from the later document (the one with the larger id).

Joins that shuffle at any real size are asked to do so at small ones too, so that figures
taken there hold.  Lines are compared without spaces at their ends; blank lines are no signature and go only
within a block.  Only hashes travel: the earlier document of a pair's run once for up to RUN
later ones, the later ones once for each pair.  Texts are joined at the end for documents
that lose lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.bitmaps import bitmap, with_maybe
from siftline.llm.scratch import discard, stage

BLANK = 0
#: Holders up to which a line is rare.
RARE = 50
#: Later documents that are aligned with an earlier one in one run.
RUN = 256


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) whose second ones increase."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            ends.append(n)
        else:
            tops[at], ends[at] = b, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b) of equal lines, by patience diff."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: n for n, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        unique = [(n, where[x]) for n, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in where]
        last_a, last_b = a0, b0
        for n, m in _increasing(unique):
            todo.append((last_a, n, last_b, m))
            out.append((n, m))
            last_a, last_b = n + 1, m + 1
        if unique:
            todo.append((last_a, a1, last_b, b1))
    return sorted(out)


def common_lines(later: list[int], earlier: list[int]) -> list[int]:
    """Places in ``later`` of aligned blocks that hold a line which is not blank."""
    places, block, out = patience(later, earlier), [], []
    for n, m in [*places, (-1, -1)]:
        if block and (n != block[-1][0] + 1 or m != block[-1][1] + 1):
            if any(later[i] != BLANK for i, _ in block):
                out += [i for i, _ in block]
            block = []
        block.append((n, m))
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tag, gone): rows come as runs, an earlier document and then the later ones that are aligned with it."""
    earlier: list[int] = []
    for batch in batches:
        docs, tags, gone = [], [], []
        for later, doc, tag, lines in zip(*(batch.column(i) for i in range(4)), strict=True):
            if not later.as_py():
                earlier = lines.as_py()
            elif found := common_lines(lines.as_py(), earlier):
                docs.append(doc.as_py())
                tags.append(tag.as_py())
                gone.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tags, pa.int32()), pa.array(gone, pa.list_(pa.int32()))], names=["doc", "tag", "gone"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n_removed = [], []
        for text, gone in zip(batch.column(2), batch.column(3), strict=True):
            drop = set(gone.as_py() or ())
            kept.append("\n".join(line for i, line in enumerate(text.as_py().split("\n")) if i not in drop))
            n_removed.append(len(drop))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), batch.column(4), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "n_partners", "kept"])


def _pairs(lined: DataFrame, rare: int) -> DataFrame:
    """(doc, tag, earlier): pairs of documents to align."""
    single = F.array_remove(F.array_distinct("lines"), F.lit(BLANK).cast("long"))
    pair_at = F.transform(F.sequence(F.lit(1), F.size("lines") - 1), lambda i: F.when((F.element_at("lines", i) != BLANK) & (F.element_at("lines", i + 1) != BLANK), F.xxhash64(F.element_at("lines", i), F.element_at("lines", i + 1))))
    double = F.when(F.size("lines") > 1, F.array_distinct(F.array_compact(pair_at))).otherwise(F.array().cast("array<long>"))
    signs = lined.select("doc", "tag", F.explode(single).alias("sign"), F.lit(True).alias("alone")).unionAll(lined.select("doc", "tag", F.explode(double).alias("sign"), F.lit(False).alias("alone")))
    held = signs.groupBy("sign", "alone").agg(F.min(F.struct("doc", "tag")).alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("holders"))
    # two lines that few documents hold are told by each of the two
    held = stage(held.where((F.col("last") > F.col("first.doc")) & (F.col("alone") | (F.col("holders") > rare))).select("sign", "alone", "first", "holders"), "line-signs")
    # signatures without a second holder stay where they are
    told = with_maybe(signs, F.col("sign"), bitmap(held, F.col("sign"))).where("__maybe").drop("__maybe").join(held.hint("merge"), ["sign", "alone"])
    told = stage(told, "line-holders")
    frequent = told.where((F.col("holders") > rare) & (F.col("doc") > F.col("first.doc"))).select("doc", "tag", F.col("first").alias("earlier"))
    # at most ``rare`` rows in a group
    few = told.where(F.col("holders") <= rare).groupBy("sign").agg(F.collect_list(F.struct("doc", "tag")).alias("all"))
    few = few.select(F.explode("all").alias("x"), "all").select("x.doc", "x.tag", F.explode(F.filter("all", lambda h: h.doc < F.col("x.doc"))).alias("earlier"))
    pairs = stage(frequent.unionAll(few).distinct(), "line-pairs")
    discard(held, told)
    return pairs


def _aligned(pairs: DataFrame, lined: DataFrame) -> DataFrame:
    """(doc, tag, gone) of pairs whose later document loses lines."""
    runs = pairs.groupBy("earlier").agg(F.ceil(F.count(F.lit(1)) / RUN).alias("runs"))
    one = F.xxhash64(F.col("earlier.doc"), F.col("earlier.tag"), "n").alias("run")
    late = pairs.join(runs.hint("merge"), "earlier").withColumn("n", F.pmod(F.xxhash64("doc", "tag"), F.col("runs"))).select(one, "earlier", F.lit(True).alias("later"), "doc", "tag")
    early = runs.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1))).select(one, "earlier", F.lit(False).alias("later"), F.col("earlier.doc").alias("doc"), F.col("earlier.tag").alias("tag"))
    rows = late.unionAll(early).join(lined.hint("merge"), ["doc", "tag"])
    rows = rows.repartition("run").sortWithinPartitions("run", "earlier", "later").select("later", "doc", "tag", "lines")
    return rows.mapInArrow(_align, "doc long, tag int, gone array<int>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rare: int = RARE) -> DataFrame:
    """doc_id, n_lines, n_removed, n_partners, kept (the text that stays) for every row.

    n_partners counts the earlier documents it loses lines to, 1 for a document with the same
    lines as an earlier one.  Null text is empty, one blank line.  Rows with a null id
    are kept whole and are no partner.  Rows that repeat an id are no partners of each other.
    Pairs are judged on the input.  A very long text is one array of line hashes.  Other
    columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("tag"), text.alias("text"))
    hashed = F.transform(F.split("text", "\n"), lambda x: F.when(F.trim(F.translate(x, "\t\r", "  ")) == "", F.lit(BLANK).cast("long")).otherwise(F.xxhash64(F.trim(x))))
    every = stage(rows.where("doc is not null").select("doc", "tag", hashed.alias("lines")).distinct(), "lines")
    alike = every.select("doc", "tag", F.xxhash64("lines").alias("k1"), F.xxhash64(F.lit(1), "lines").alias("k2"), F.exists("lines", lambda x: x != BLANK).alias("told"))
    least = alike.groupBy("k1", "k2").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2", "least")
    copies = stage(alike.where("told").join(least.hint("merge"), ["k1", "k2"]).where("doc > least").select("doc", "tag"), "line-copies")
    marked = with_maybe(every, F.xxhash64("doc", "tag"), bitmap(copies, F.xxhash64("doc", "tag")))
    lined = stage(marked.where("not __maybe").drop("__maybe").unionAll(marked.where("__maybe").drop("__maybe").join(copies.hint("merge"), ["doc", "tag"], "left_anti")), "line-documents")

    pairs = _pairs(lined, rare)
    aligned = stage(_aligned(pairs, lined), "line-blocks")
    lost = aligned.select("doc", "tag", F.explode("gone").alias("line")).distinct()
    # as many lines as the document has, at most
    gone = lost.groupBy("doc", "tag").agg(F.collect_list("line").alias("gone"))
    partners = aligned.groupBy("doc", "tag").agg(F.count(F.lit(1)).alias("n_partners"))
    whole = copies.select("doc", "tag", F.lit(None).cast("array<int>").alias("gone"), F.lit(True).alias("told"), F.lit(1).cast("long").alias("n_partners"))
    gone = stage(partners.join(gone.hint("merge"), ["doc", "tag"]).select("doc", "tag", "gone", F.lit(False).alias("told"), "n_partners").unionAll(whole), "line-removals")
    discard(every, copies, lined, pairs, aligned)

    n_lines = F.size(F.split("text", "\n")).cast("long")
    marked = with_maybe(rows, F.xxhash64("doc", "tag"), bitmap(gone, F.xxhash64("doc", "tag")))
    zero = F.lit(0).cast("long")
    clear = marked.where("not __maybe").select(F.col("doc").alias("doc_id"), n_lines.alias("n_lines"), zero.alias("n_removed"), zero.alias("n_partners"), F.col("text").alias("kept"))
    # a copy loses all its lines
    places = F.when(F.col("told"), F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1)).otherwise(F.col("gone"))
    doubt = marked.where("__maybe").join(gone.hint("merge"), ["doc", "tag"], "left").select("doc", n_lines.alias("n_lines"), "text", places.alias("gone"), F.coalesce("n_partners", zero).alias("n_partners"))
    return clear.unionAll(doubt.mapInArrow(_remove, "doc_id long, n_lines long, n_removed long, n_partners long, kept string"))
