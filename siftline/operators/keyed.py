"""Latest-per-key, first-per-key, as-of and upsert operators.

None of them collects; each is one window or one join on its key.  Ties are broken by the
extra ``order`` columns, which callers make unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_per_key(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark prunes each partition before the shuffle (window group limit)."""
    return ranked_per_key(df, keys, order, "__rn").where(F.col("__rn") <= n).drop("__rn")


def latest_per_key(df: DataFrame, keys: list[str], time: str, *ties: str) -> DataFrame:
    return top_per_key(df, keys, [F.desc_nulls_last(time), *ties])


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the newest right row of its key at or before its time.

    Both sides are stacked and swept once by (key, time), so there is no range join; at equal
    times right rows come first.
    """
    none = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    tagged = left.select(F.struct(*left.columns).alias("__row"), *keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), *none)
    stacked = right.select(F.lit(None).cast(tagged.schema["__row"].dataType).alias("__row"), *keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), *values).unionByName(tagged)
    seen = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("__side") == 0, F.struct(*values)), ignorenulls=True).over(seen)
    return stacked.withColumn("__hit", hit).where("__side = 1").select("__row.*", *[F.col("__hit").getField(v).alias(v) for v in values])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = (), prefer_new_unless_null: tuple[str, ...] = ()) -> DataFrame:
    """Rebuild of a keyed table: new rows replace old ones; ``inserted`` marks keys that were not there.

    Columns in ``keep_old`` stay as they were for keys that exist; those in
    ``prefer_new_unless_null`` change only to non-null values.  New rows must be unique by key.
    """
    o = old.select(*[F.col(c).alias(f"__o_{c}") for c in old.columns], F.lit(True).alias("__had"))
    n = new.select(*[F.col(c).alias(f"__n_{c}") for c in new.columns], F.lit(True).alias("__has"))
    cond = [F.col(f"__o_{k}") == F.col(f"__n_{k}") for k in keys]
    joined = o.join(n, cond, "full_outer")
    out = []
    for c in old.columns:
        if c not in new.columns:
            out.append(F.col(f"__o_{c}").alias(c))
            continue
        had, has = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        if c in keep_old:
            out.append(F.when(F.col("__had"), had).otherwise(has).alias(c))
        elif c in prefer_new_unless_null or c in keys:
            out.append(F.coalesce(has, had).alias(c))
        else:
            out.append(F.when(F.col("__has"), has).otherwise(had).alias(c))
    return joined.select(*out, F.col("__had").isNull().alias("inserted"), F.coalesce("__has", F.lit(False)).alias("touched"))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def fill_blanks(existing: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with nulls filled from ``found``; nothing is overwritten."""
    extra = [c for c in found.columns if c not in keys]
    f = found.select(*keys, *[F.col(c).alias(f"__f_{c}") for c in extra])
    joined = existing.join(f, keys, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"__f_{c}")).alias(c) if c in extra else F.col(c) for c in existing.columns])
