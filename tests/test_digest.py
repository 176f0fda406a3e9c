"""Digest runs that die between claim and stamp, and batches with bad rows."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import notifications as N
from siftline.streaming import digest

CANDIDATES = "user_id long, job_id long, score double"


class Killed(Exception):
    pass


def outbox(path, die=False):
    """A delivery that takes the same run twice as once: a folder named by the run."""

    def deliver(df, run):
        if die == "before":
            raise Killed
        df.write.mode("overwrite").parquet(f"{path}/run={run}")
        if die == "after":
            raise Killed

    return deliver


def sent(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(f"{path}/*").select("user_id", "job_id").collect())


def rows(spark, n):
    return spark.createDataFrame([(u, j, 60.0 + j % 7) for u in (1, 2) for j in range(n)], CANDIDATES)


def test_claim_takes_the_best_that_no_run_had(spark):
    had = spark.createDataFrame([(1, 6), (1, 6), (2, 5)], "user_id long, job_id long")
    got = sorted((r.user_id, r.place, r.job_id) for r in N.claim(rows(spark, 8).unionAll(rows(spark, 3)), had, 2).collect())
    assert got == [(1, 1, 5), (1, 2, 4), (2, 1, 6), (2, 2, 4)]


@pytest.mark.parametrize("where", ["before", "after"])
def test_killed_between_claim_and_stamp(spark, tmp_path, where):
    ledger, box = digest.Ledger(spark, f"file://{tmp_path}/ledger"), str(tmp_path / "out")
    assert ledger.run(1, rows(spark, 8), outbox(box)) == [1]
    with pytest.raises(Killed):
        ledger.run(2, rows(spark, 30), outbox(box, where))
    assert (ledger.runs("claims"), ledger.runs("stamps")) == ([1, 2], [1])
    assert ledger.run(2, rows(spark, 99), outbox(box)) == [2]  # the same claim, whatever the candidates are now
    assert ledger.run(2, rows(spark, 99), outbox(box)) == []
    all_sent = sent(spark, box)
    assert len(all_sent) == len(set(all_sent)) == 32
    assert ledger.run(3, rows(spark, 20), outbox(box)) == [3]
    all_sent = sent(spark, box)
    assert len(all_sent) == len(set(all_sent)) and set(all_sent) >= {(u, j) for u in (1, 2) for j in range(20)}


def test_a_later_run_finishes_the_one_that_died(spark, tmp_path):
    ledger, box = digest.Ledger(spark, f"file://{tmp_path}/ledger"), str(tmp_path / "out")
    with pytest.raises(Killed):
        ledger.run(1, rows(spark, 8), outbox(box, "before"))
    assert ledger.run(2, rows(spark, 12), outbox(box)) == [1, 2]
    assert len(sent(spark, box)) == len(set(sent(spark, box))) == 24


def test_bad_rows_are_found_and_set_aside(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" if i in (7, 400) else str(i)) for i in range(500)], "id long, v string").repartition(3)

    def store(part):
        part.select("id", F.col("v").cast("long").alias("v")).write.mode("append").parquet(str(tmp_path / "stored"))

    got = digest.contained(df, ["id"], store)
    assert got.done == 498
    assert sorted(r["id"] for r, _ in got.rejects) == [7, 400] and all("CAST_INVALID_INPUT" in e for _, e in got.rejects)
    assert got.tries < 60
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "stored")).select("id").distinct().collect()) == [i for i in range(500) if i not in (7, 400)]


def test_a_batch_that_is_all_bad_raises(spark):
    df = spark.range(40)

    def fail(part):
        raise ValueError("down")

    with pytest.raises(ValueError):
        digest.contained(df, ["id"], fail, most_bad=3)
    assert digest.contained(df.limit(0), ["id"], fail) == digest.Contained(0, [], 0)


def test_repeated_bad_rows_fail_together(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "2")], "id long, v string")
    got = digest.contained(df, ["id"], lambda p: p.select(F.sum(F.col("v").cast("long"))).collect())
    assert (got.done, len(got.rejects)) == (1, 2)
