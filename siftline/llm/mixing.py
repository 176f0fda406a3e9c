"""Mixing sources to target weights by capped water-filling.

Each source asks for a share of the total by weight.  Sources whose share exceeds
``max_epochs`` times their size are clamped there; what they leave is shared among the
others by weight, until none is above its cap.  A source with target/size = 2.4 then takes
every document twice and a seeded 0.4 of its words once more: documents are ordered by a
seeded hash and taken until the fraction is reached; the document on the boundary is taken
in part.  So each source hits its target within one word per repeated row.

Only DataFrame operations.  A hot source is never gathered: sizes are summed by (source,
hash bucket), the running sum goes over at most ``buckets`` rows of a source, and single
documents are ordered only within the one bucket that holds the boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.scratch import discard, stage
from siftline.llm.textops import word_count

MAX_EPOCHS, SEED, BUCKETS = 3.0, 42, 4096


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, weight): weights repeat over the sources by code point, null last.

    Sources are few against documents; they are numbered in one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")
    return sources.select("source").distinct().select("source", F.get(F.array(*[F.lit(float(w)) for w in weights]), place).alias("weight"))


def water_fill(sizes: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, size, weight) -> the same with ``target``.

    Each round clamps the sources above their cap and reads three sums back; the number of
    rounds is at most the number of sources and in practice a handful.  Sources with a null
    or non-positive weight get nothing.  Where all are clamped the targets sum to less than
    the total.
    """
    s = sizes.withColumn("weight", F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0)))
    cap = F.col("size").cast("double") * F.lit(float(max_epochs))
    total = s.agg(F.sum("size")).first()[0] or 0
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        left, free = s.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        fresh = (float(total) - (left or 0.0)) / free if free else None
        if fresh is None or (level is not None and fresh <= level):
            break
        level = fresh
    if level is None:
        return s.withColumn("target", F.lit(0.0))
    return s.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
        max_epochs: float = MAX_EPOCHS, seed: int = SEED, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(plan, documents): the plan has a row per source, the second a row per row of ``docs``.

    plan: source, source_size, target, whole, cut_* (the boundary in the seeded order) and
    partial.  documents: id, source, size, source_size, target, taken, repeats.  ``weights``:
    (source, weight), by default 5, 2, 1 repeating.  Size is the number of words, 0 for null
    text.  Documents of size 0 take nothing.  A null source is a source.  Ties in the seeded
    order go by id, then size; rows equal in all three share what is left evenly, rounded
    down.  Reruns agree, as the order depends on seed and id alone.  A text of any length is
    counted whole and may be cut: the last repetition takes part of it.  An empty table gives
    empty results.
    """
    rows = stage(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
        .withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")),
        "mix-sizes",
    )
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key")
    by_bucket = stage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")).withColumn("key", key), "mix-buckets")
    sizes = by_bucket.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("size"))
    weights = cyclic_weights(sizes) if weights is None else weights.select("source", "weight")
    weighted = sizes.join(weights.select(key, "weight"), "key", "left")
    filled = stage(weighted, "mix-weights")
    targets = water_fill(filled, max_epochs)
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(ratio), F.lit(int(max_epochs)).cast("long"))
    # words still to take after the whole repetitions
    rest = F.greatest(F.round(F.col("target") - F.col("size") * F.col("whole")).cast("long"), F.lit(0).cast("long"))
    plan = targets.withColumn("whole", whole).withColumn("rest", F.when(F.col("size") > 0, rest).otherwise(F.lit(0).cast("long")))

    running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = by_bucket.select("key", "bucket", F.sum("size").over(running).alias("upto"), F.col("size").alias("in_bucket")).join(plan.select("key", "rest"), "key")
    edge = along.where("upto - in_bucket < rest and rest <= upto").select("key", "bucket", (F.col("rest") - F.col("upto") + F.col("in_bucket")).alias("need"))
    # the one bucket of each source in which the fraction ends: order its documents
    same = rows.withColumn("key", key).where("size > 0").join(edge, ["key", "bucket"]).groupBy("key", "bucket", "need", "h", "id", "size").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("key").orderBy("h", "id", "size")
    walked = same.withColumn("upto", F.sum(F.col("size") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = walked.where("upto - size * copies < need and need <= upto").select(
        "key", F.col("bucket").alias("cut_bucket"), F.col("h").alias("cut_h"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"),
        F.floor((F.col("need") - F.col("upto") + F.col("size") * F.col("copies")) / F.col("copies")).alias("partial"))
    plan = stage(plan.join(cut, "key", "left").withColumnRenamed("size", "source_size"), "mix-plan")
    discard(by_bucket, filled)

    documents = _taken(rows.withColumn("key", key).join(plan.drop("source"), "key"))
    return plan, documents.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "repeats")


def _taken(rows: DataFrame) -> DataFrame:
    """rows: id, size, h, bucket and a source's plan -> with ``once_more``, ``taken`` and ``repeats``."""
    id_before = F.coalesce(F.col("id") < F.col("cut_id"), F.col("id").isNull() & F.col("cut_id").isNotNull())
    same_id = F.col("id").eqNullSafe(F.col("cut_id"))
    before = (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & (
        (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (id_before | (same_id & (F.col("size") < F.col("cut_size")))))))
    at = (F.col("h") == F.col("cut_h")) & same_id & (F.col("size") == F.col("cut_size"))
    once_more = F.when(F.col("cut_bucket").isNull(), F.lit(0)).when(before, F.col("size")).when(at, F.col("partial")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("once_more", once_more)
    return rows.withColumn("taken", F.col("size") * F.col("whole") + F.col("once_more")).withColumn("repeats", (F.col("whole") + (F.col("once_more") > 0).cast("int")).cast("long"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
          max_epochs: float = MAX_EPOCHS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it, the one on a source's boundary cut to its first words.

    Where a text is cut, its words are joined by single spaces and a column ``n_chars``, if
    there is one, becomes the length of what is left.  Documents of size 0 are left out.
    """
    plan, _ = mix(docs, weights, id_col, text_col, source_col, max_epochs=max_epochs, seed=seed, buckets=buckets)
    cols = docs.columns
    rows = docs.select(F.struct(*cols).alias("__doc"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("key"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    taken = _taken(rows.join(plan.drop("source"), "key")).where("size > 0 and repeats > 0")
    each = taken.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    part = (F.col("nth") > F.col("whole")) & (F.col("once_more") < F.col("size"))
    text = F.col("__doc").getField(text_col)
    first_words = F.array_join(F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, F.col("once_more").cast("int")), " ")
    out = {c: F.col("__doc").getField(c) for c in cols}
    out[text_col] = F.when(part, first_words).otherwise(text)
    if "n_chars" in cols:
        out["n_chars"] = F.when(part, F.length(first_words).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return each.select(*[out[c].alias(c) for c in cols])
