"""Digest runs that send nothing twice, and batches that go on without their bad rows (STR-9, STR-11, STR-14).

A run claims before it sends and stamps after it has sent.  Claims and stamps are tables named
by the run, each complete or absent, so wherever a run dies it is known what it had done: a
claim without a stamp is handed on again under its own number, a run with a stamp is over,
and no later run claims what an earlier one has.  What delivers must take the same run twice
as once, as a sink of micro-batches does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import notifications

CLAIM = "user_id long, place int, job_id long, score double"


class Ledger:
    """Claims and stamps of digest runs under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self, kind: str) -> list[int]:
        """Numbers of complete runs of ``claims`` or ``stamps``."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(str(p.getName())[4:]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def claims(self, *runs: int) -> DataFrame:
        """Claims of these runs, of all if none is named."""
        wanted = runs or tuple(self.runs("claims"))
        return self.spark.read.schema(CLAIM).parquet(*[f"{self.path}/claims/run={r}" for r in wanted]) if wanted else self.spark.createDataFrame([], CLAIM)

    def run(self, number: int, candidates: DataFrame, deliver: Callable[[DataFrame, int], None]) -> list[int]:
        """Deliver every claimed run that has no stamp, then claim and deliver run ``number`` unless it is over.  Returns the runs delivered."""
        delivered = [r for r in self.runs("claims") if r not in self.runs("stamps")]
        for r in delivered:
            self._send(r, deliver)
        if number not in self.runs("claims"):
            mine = notifications.claim(candidates, self.claims())
            mine.select("user_id", F.col("place").cast("int"), "job_id", F.col("score").cast("double")).write.mode("overwrite").parquet(f"{self.path}/claims/run={number}")
            self._send(number, deliver)
            delivered.append(number)
        return delivered

    def _send(self, number: int, deliver: Callable[[DataFrame, int], None]) -> None:
        deliver(self.claims(number), number)
        self.spark.range(1).select(F.lit(number).alias("run")).write.mode("overwrite").parquet(f"{self.path}/stamps/run={number}")


@dataclass
class Contained:
    """What came of a batch: rows done, rows set aside (with the error of each), tries it took."""

    done: int
    rejects: list[tuple[dict, str]]
    tries: int


def contained(rows: DataFrame, key: list[str], action: Callable[[DataFrame], None], most_bad: int = 100) -> Contained:
    """Run ``action`` on ``rows``; where it fails, on the halves of what failed, until the bad rows stand alone.

    Halves are ranges of a hash of ``key`` (the columns that tell rows apart), so each try is
    a filter and reads nothing to the driver but counts and the bad rows themselves; a bad
    row costs one try for each halving.  ``action`` must take rows again that it has taken.  More than
    ``most_bad`` bad rows are no accident and raise the last error.  Rows of equal key fail together.
    """
    hashed = rows.withColumn("__h", F.xxhash64(*key))
    waiting, out = [(-(1 << 63), (1 << 63) - 1)], Contained(0, [], 0)
    while waiting:
        low, high = waiting.pop()
        part = hashed.where(F.col("__h").between(low, high))
        span = part.agg(F.count(F.lit(1)).alias("n"), F.min("__h").alias("low"), F.max("__h").alias("high")).first()
        if not span.n:
            continue
        out.tries += 1
        try:
            action(part.drop("__h"))
            out.done += span.n
        except (PySparkException, ValueError, ArithmeticError) as error:
            if span.low == span.high:
                bad = part.drop("__h").limit(most_bad + 1).collect()
                out.rejects += [(r.asDict(), str(error).split("\n", 1)[0][:300]) for r in bad]
                if len(out.rejects) > most_bad:
                    raise
            else:
                middle = (span.low + span.high) // 2
                waiting += [(span.low, middle), (middle + 1, span.high)]
    return out
