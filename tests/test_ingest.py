import datetime as dt

from pyspark.sql import functions as F

from siftline.operators import ingest, keyed
from siftline.streaming import ingest as stream

T0 = dt.datetime(2026, 1, 1)
POSTS = "company_id string, external_id string, fingerprint string, title string, source string, batch_pos int"


def state(rows, spark):
    return spark.createDataFrame(rows, stream.STATE)


def shown(df):
    return sorted((r.company_id, r.external_id, r.status, r.first_seen.day, r.last_seen.day, r.source) for r in df.collect())


def test_apply_batch(spark):
    old = state([("c", "1", "f1", "t", "lever", "ACTIVE", T0, T0), ("c", "2", "f2", "t", "lever", "ACTIVE", T0, T0), ("c", "3", "f3", "t", "lever", "REMOVED", T0, T0), ("d", "9", "f9", "t", "hn", "ACTIVE", T0, T0)], spark)
    batch = spark.createDataFrame([("c", "1", "f1", "t", None, 0), ("c", "3", "f3", "t", "lever", 1), ("c", "4", "f4", "t", "lever", 2), ("c", "4", "f4b", "t", "lever", 3), ("c", "5", "f4", "t", "lever", 4), ("c", "6", "f2", "dup", "lever", 5)], POSTS)
    now = F.lit(dt.datetime(2026, 1, 5))
    got = shown(ingest.apply_batch(old, batch, now, full_snapshot=True))
    assert got == [("c", "1", "ACTIVE", 1, 5, "lever"), ("c", "2", "ACTIVE", 1, 5, "lever"), ("c", "3", "ACTIVE", 1, 5, "lever"), ("c", "4", "ACTIVE", 5, 5, "lever"), ("d", "9", "ACTIVE", 1, 1, "hn")]
    gone = shown(ingest.apply_batch(old, batch.where("external_id = '1'"), now, full_snapshot=True))
    assert [g[:3] for g in gone] == [("c", "1", "ACTIVE"), ("c", "2", "REMOVED"), ("c", "3", "REMOVED"), ("d", "9", "ACTIVE")]
    kept = shown(ingest.apply_batch(old, batch.where("external_id = '1'"), now, full_snapshot=False))
    assert kept[1][:3] == ("c", "2", "ACTIVE")


def test_merge_companies(spark):
    cols = "name string, website string, ats_provider string, ats_identifier string"
    old = spark.createDataFrame([(1, "Acme", None, "LEVER", "acme"), (2, "Beta", "https://www.beta.example/x", None, None), (3, "Gamma", None, None, None)], "id long, " + cols)
    new = spark.createDataFrame([("ACME Inc", "https://acme.example", "LEVER", "acme"), ("Other", "https://beta.example", "ASHBY", "beta"), ("gamma", "https://g.example", None, None), ("Delta", None, None, None), ("delta", None, None, None)], cols)
    got = sorted((r.id or 0, r.name, r.website, r.ats_provider) for r in ingest.merge_companies(old, new).collect())
    assert got[1:] == [(1, "Acme", "https://acme.example", "LEVER"), (2, "Beta", "https://www.beta.example/x", "ASHBY"), (3, "Gamma", "https://g.example", None)]
    assert got[0][0] == 0 and got[0][1].lower() == "delta"


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("b", 4, 99)], "k string, at int, v int")
    got = sorted(tuple(r) for r in keyed.as_of_join(left, right, ["k"], "t", "at", ["v"]).collect())
    assert got == [("a", 1, 10), ("a", 5, 40), ("b", 3, None)]


def test_stream_and_replay(spark, tmp_path):
    src, schema = tmp_path / "in", POSTS + ", crawled_at timestamp"
    table = stream.VersionedTable(spark, f"file://{tmp_path}/state", stream.STATE)
    new_keys = []

    def feed(name, rows, day):
        spark.createDataFrame([(*r, dt.datetime(2026, 1, day)) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(src))

    def run(checkpoint):
        q = stream.ingest_stream(spark.readStream.schema(schema).parquet(str(src)), table, str(tmp_path / checkpoint), full_snapshot=True, on_new=lambda df, _: new_keys.append(sorted(r.external_id for r in df.collect())))
        q.awaitTermination()

    feed("1", [("c", "1", "f1", "t", "lever", 0), ("c", "2", "f2", "t", "lever", 1)], 1)
    run("cp")
    feed("2", [("c", "1", "f1", "t", "lever", 0), ("c", "3", "f3", "t", "lever", 1)], 2)
    run("cp")
    first = shown(table.latest())
    assert [x[:3] for x in first] == [("c", "1", "ACTIVE"), ("c", "2", "REMOVED"), ("c", "3", "ACTIVE")]
    assert new_keys == [["1", "2"], ["3"]]
    # the last batch again: the same version is read and written, and the state is the same
    batch = spark.createDataFrame([("c", "1", "f1", "t", "lever", 0), ("c", "3", "f3", "t", "lever", 1)], POSTS)
    table.write(1, ingest.apply_batch(table.before(1), batch, F.lit(dt.datetime(2026, 1, 2)), full_snapshot=True))
    assert shown(table.latest()) == first
    # a third batch needs the second one's version alone
    feed("3", [("c", "1", "f1", "t", "lever", 0)], 3)
    run("cp")
    assert table._versions() == [1, 2]
    assert [x[2] for x in shown(table.latest())] == ["ACTIVE", "REMOVED", "REMOVED"]


def test_quarantine_and_windows(spark):
    raw = spark.createDataFrame([('{"a": 1}',), ("{bad",), (None,)], "j string")
    good, bad = stream.quarantine(raw, "j", "a int")
    assert [r.a for r in good.collect()] == [1] and bad.count() == 2
    e = spark.createDataFrame([(dt.datetime(2026, 1, 1, 1), "view", 1.0), (dt.datetime(2026, 1, 1, 23), "view", 2.0), (dt.datetime(2026, 1, 2), "view", 4.0)], "ts timestamp, event_type string, value double")
    assert sorted((r.n, r.total) for r in stream.windowed_actions(e).collect()) == [(1, 4.0), (2, 3.0)]
