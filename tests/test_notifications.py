"""Gates with memory: the fold on tables and on streams, and plain evaluation."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.operators import notifications as N

T0 = dt.datetime(2026, 1, 1)
EVENTS = "user_id long, job_id long, event_id long, ts timestamp, score double, before string, after string"


def events(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(4), rng.randrange(6), i, T0 + dt.timedelta(hours=i // 3), rng.choice([None, 60.0, 72.0, 75.0, 78.0, 81.0, 90.0]), rng.choice([None, None, None, "TOO_OLD"]), rng.choice([None, None, "NOT_APPLY"])) for i in range(n)]


def plain(rows):
    told, out = {}, {}
    for user, job, event, ts, score, before, after in sorted(rows, key=lambda r: (r[3], r[2])):
        before = before or ("BELOW_SCORE" if score is None else None)
        last = told.get((user, job))
        hold = before or ("ALREADY_NOTIFIED" if last is not None and score < last + 5 else after)
        if hold is None:
            told[user, job] = score
        out[event] = (hold, told.get((user, job)))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, EVENTS)
    return df.withColumn("before", F.coalesce("before", F.when(F.col("score").isNull(), "BELOW_SCORE")))


def test_table_equals_plain_evaluation(spark):
    rows = events(1, 400)
    got = {r.event_id: (r.hold_reason, r.last_told) for r in N.decide(frame(spark, rows).repartition(7)).collect()}
    assert got == plain(rows)
    assert {h for h, _ in got.values()} == {None, "BELOW_SCORE", "TOO_OLD", "ALREADY_NOTIFIED", "NOT_APPLY"}


def test_stream_equals_table_for_any_split(spark, tmp_path):
    rows = events(2, 60)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", N.STATE_STORE)
    try:
        src = tmp_path / "in"
        got = []
        for at in (0, 25, 26):
            part = rows[at : {0: 25, 25: 26, 26: 60}[at]]
            frame(spark, part).coalesce(1).write.mode("append").parquet(str(src))
            stream = N.decide_stream(spark.readStream.schema(EVENTS).parquet(str(src)))
            q = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {r.event_id: (r.hold_reason, r.last_told) for r in got} == plain(rows)
    assert len(got) == 60


@pytest.mark.parametrize("size", [1, 3, 10000])
def test_memory_is_kept_from_batch_to_batch(spark, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        # with a score in every event that comes to memory, and without
        rows = [r[:4] + (60.5 if r[4] is None and seed == 3 else r[4],) + r[5:] for seed in (3, 4) for r in events(seed, 300)]
        rows = [(*((u, j + 10 * (n >= 300)) if j else (None, None)), e + 1000 * (n >= 300), *x) for n, (u, j, e, *x) in enumerate(rows)]
        got = {r.event_id: (r.hold_reason, r.last_told) for r in N.decide(frame(spark, rows).repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows)


def test_batch_at_once_equals_one_by_one():
    for seed in range(60):
        rng = random.Random(seed)
        n = rng.choice([1, 2, 40])
        columns = [pa.array(rng.choices([70.0, 72.0, 75.0, 80.0, 86.0], k=n)), pa.array(rng.choices([None, None, "TOO_OLD"], k=n), pa.string()), pa.array(rng.choices([None, None, "NOT_APPLY"], k=n), pa.string())]
        batch, new = pa.RecordBatch.from_arrays(columns, names=["score", "before", "after"]), np.array(rng.choices([False, False, True], k=n))
        last = rng.choice([None, 71.0])
        a, b = N._at_once(batch, new, last), N._one_by_one(batch, new, last)
        assert a[0].equals(b[0]) and a[1].equals(b[1]) and a[2] == b[2]


def test_recent_postings_in_one_pass_over_a_company(spark):
    # a frame that slides is summed anew for each event: 10 ** 10 steps here
    asked = spark.range(200_000).selectExpr("1L as company_id", "timestamp_micros(1700000000000000 + id) as ts", "id as n").unionByName(spark.sql("select null as company_id, timestamp '2026-01-01' as ts, -1L as n union all select 1, null, -2"))
    jobs = spark.range(200_000).selectExpr("1L as company_id", "timestamp_micros(1700000000000000 + id - 1209600000000) as first_seen").unionByName(spark.sql("select null as company_id, timestamp '2026-01-01' as first_seen union all select 1, null"))
    recent = N.recent_postings(asked, jobs)
    assert "rangeframe" not in recent._jdf.queryExecution().executedPlan().toString().lower().replace(" ", "")
    got = recent.agg(F.count(F.when(F.col("n") >= 0, 1)), F.count_if((F.col("n") >= 0) & (F.col("recent") != 200_000 - F.col("n"))), F.sum(F.when(F.col("n") < 0, F.col("recent")))).first()
    assert tuple(got) == (200_000, 0, 0)


def test_recent_decides_where_gates_differ(spark):
    rows = [(score, ok, age, ever) for score in (None, 69.0, 70.0) for ok in (None, False, True) for age in (None, 30.0, 30.1, 60.0, 60.1) for ever in (None, False, True)]
    df = spark.createDataFrame(rows, "score double, ok boolean, age double, ever boolean")
    gate = lambda n: F.coalesce(N.gates_before_memory(F.col("score"), F.col("ok"), F.col("age"), F.col("ever"), F.lit(n), F.lit("x"), F.lit(False)), F.lit(""))
    got = df.select((gate(0) != gate(3)).alias("differ"), N.recent_decides(F.col("score"), F.col("ok"), F.col("age"), F.col("ever")).alias("told")).collect()
    assert all(r.differ == r.told for r in got) and sum(r.told for r in got) == 4


def test_recent_postings(spark):
    day = dt.timedelta(days=1)
    jobs = spark.createDataFrame([(1, T0), (1, T0 + 3 * day), (1, T0 + 3 * day), (2, T0)], "company_id long, first_seen timestamp")
    asked = spark.createDataFrame([(1, T0 - day, 0), (1, T0, 1), (1, T0 + 3 * day, 2), (1, T0 + 14 * day, 3), (1, T0 + 14 * day + dt.timedelta(microseconds=1), 4), (1, T0 + 18 * day, 5), (3, T0, 6), (1, T0 + 3 * day, 7)], "company_id long, ts timestamp, n int")
    got = {r.n: r.recent for r in N.recent_postings(asked, jobs).collect()}
    assert got == {0: 0, 1: 1, 2: 3, 3: 3, 4: 2, 5: 0, 6: 0, 7: 3}


@pytest.mark.parametrize(("row", "want"), [
    ((None, True, 1.0, False, 0, "x", False), "BELOW_SCORE"), ((69.9, True, 1.0, False, 0, "x", False), "BELOW_SCORE"), ((70.0, False, 99.0, False, 0, "x", False), "OUTSIDE_COUNTRIES"), ((70.0, True, 30.1, False, 2, "x", False), "TOO_OLD"),
    ((70.0, True, 30.1, False, 3, "x", False), None), ((70.0, True, 60.0, True, 0, "x", False), None), ((70.0, True, 60.1, True, 9, "x", False), "TOO_OLD"), ((70.0, True, 1.0, False, 0, "remoteok-1", True), "BOARD_COPY"), ((70.0, True, 1.0, False, 0, "remoteok-1", False), None)])
def test_gates_in_order(spark, row, want):
    df = spark.createDataFrame([row], "score double, ok boolean, age double, ever boolean, recent long, ext string, mon boolean")
    assert df.select(N.gates_before_memory(*(F.col(c) for c in df.columns))).first()[0] == want
