"""Exact duplicates by progressive refinement: length, then a hash of a prefix, then a hash of all.

Every step is an aggregation over short keys, so a group of copies of any size is folded
on the map side and no text is ever shuffled:

1. lengths: rows per byte length (folded into ``length_classes`` residues, which bounds the
   table that is broadcast); a row alone in its class is unique;
2. prefixes: for the others, rows per (length, hash of the first ``prefix_chars``
   characters).  The keys that more than one row has are kept as a bitmap of fixed size, so
   what is broadcast does not grow with the data; a crowded bitmap only lets more rows
   through to the last step, never fewer;
3. contents: rows that are still in doubt get SHA-256 of the whole normalised text, and the
   groups of that.

Null text counts as the empty text.  All functions here are built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.bitmaps import FILTER_BITS, bitmap, packed, with_maybe
from siftline.llm.scratch import stage
from siftline.llm.textops import lower_ascii

#: Residues of the byte length; bounds the broadcast of step 1 to this many longs.
LENGTH_CLASSES = 1 << 16
PREFIX_CHARS = 128


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest_all: bool = False,
                 length_classes: int = LENGTH_CLASSES, filter_bits: int = FILTER_BITS, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  Of each group the row with the
    largest id is kept; of repeated rows with that id exactly one, whichever; a null id
    counts as smaller than any other.  ``text_sha256`` is of the normalised text, null for
    texts that an earlier step proved unique unless ``digest_all``.  Texts of any length are
    compared whole, one at a time in the JVM.  An empty table gives an empty result; other
    columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("__id"), text.alias("__t"))
    n = F.octet_length("__t")
    length_class = F.pmod(n, F.lit(length_classes))
    crowded = base.groupBy(length_class.alias("__lc")).agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select("__lc")

    with_length = base.withColumn("__n", n).withColumn("__lc", length_class)
    prefix = F.xxhash64("__n", lower_ascii(F.left("__t", F.lit(prefix_chars))))
    shared = with_length.join(F.broadcast(crowded), "__lc").select(prefix.alias("__p")).groupBy("__p").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1")
    in_doubt = with_maybe(with_length, prefix, bitmap(shared, F.col("__p"), filter_bits), filter_bits)
    full = F.sha2(lower_ascii(F.col("__t")), 256)
    rows = stage(
        in_doubt.select("__id", "__maybe", (full if digest_all else F.when(F.col("__maybe"), full)).alias("__sha"), F.monotonically_increasing_id().alias("__row")),
        "exact-digests",
    )
    top = F.max(F.struct("__id", "__row"))
    groups = rows.where("__maybe").groupBy("__sha").agg(top.alias("__top"), F.count(F.lit(1)).alias("__size")).where("__size > 1").withColumnRenamed("__sha", "__key")
    #: Rows proved unique get a key of their own, so that they spread over all tasks of the join.
    key = F.when(F.col("__maybe"), F.col("__sha")).otherwise(F.concat(F.lit("~"), F.col("__row").cast("string")))
    return rows.withColumn("__key", key).join(groups, "__key", "left").select(
        F.col("__id").alias(id_col),
        F.when(F.col("__top").isNull(), F.col("__id")).otherwise(F.col("__top.__id")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("__top").isNull() | (F.col("__top.__row") == F.col("__row"))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest id.

    Rows to drop are found by id and digest.  Rows that repeat both are one document: one
    of them is returned.
    """
    found = exact_groups(docs, id_col, text_col)
    # one row per group that has copies, with the number of rows that share id and text with the row that stays
    grouped = found.where("group_size > 1").select(F.col("text_sha256").alias("__sha"), F.col("keep_id").alias("__keep"), (F.col(id_col).eqNullSafe(F.col("keep_id"))).cast("int").alias("__same"))
    grouped = stage(grouped.groupBy("__sha").agg(F.first("__keep").alias("__keep"), F.sum("__same").alias("__n")), "exact-groups")
    digest = F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)
    # only rows that may have copies are shuffled with their text
    rows = packed(docs, F.col(id_col).alias("__id"), digest.alias("__key"))
    marked = with_maybe(rows, F.xxhash64("__key"), bitmap(grouped, F.xxhash64("__sha")))
    clear = marked.where("not __maybe").select("__row.*")
    joined = marked.where("__maybe").join(grouped.withColumnRenamed("__sha", "__key"), "__key", "left").where(F.col("__n").isNull() | F.col("__id").eqNullSafe(F.col("__keep")))
    once = clear.unionAll(joined.where("__n is null or __n = 1").select("__row.*"))
    if grouped.where("__n > 1").isEmpty():
        return once
    return once.unionAll(joined.where("__n > 1").dropDuplicates(["__key"]).select("__row.*"))
