"""State in layers: equal to the state written whole, for any split of the input."""

import datetime as dt
import random
from pathlib import Path

import pytest

from siftline.operators import ingest
from siftline.streaming import ingest as stream
from siftline.streaming.layers import LayeredTable

POSTS = "company_id string, external_id string, fingerprint string, title string, source string, batch_pos int, crawled_at timestamp"


def batches(seed, n, rows):
    rng = random.Random(seed)
    return [[(f"c{rng.randrange(9)}", str(rng.randrange(12)), rng.choice([None, f"f{rng.randrange(9)}"]), f"t{rng.randrange(3)}", rng.choice([None, "lever"]), i, dt.datetime(2026, 1, b + 1)) for i in range(rows)] for b in range(n)]


def shown(df):
    return sorted(map(str, df.select("company_id", "external_id", "fingerprint", "title", "source", "status", "first_seen", "last_seen").collect()))


def layered(spark, path, **kw):
    return LayeredTable(spark, f"file://{path}", stream.STATE, ingest.JOB_KEYS, "company_id", **kw)


def feed(spark, tables, data, tmp_path, full):
    src = tmp_path / "in"
    for batch in data:
        spark.createDataFrame(batch, POSTS).coalesce(1).write.mode("append").parquet(str(src))
        for n, t in enumerate(tables):
            stream.ingest_stream(spark.readStream.schema(POSTS).parquet(str(src)), t, str(tmp_path / f"cp{n}"), full_snapshot=full).awaitTermination()


@pytest.mark.parametrize(("full", "every"), [(True, 3), (False, 100)])
def test_equals_state_written_whole(spark, tmp_path, full, every):
    whole, layers = stream.VersionedTable(spark, f"file://{tmp_path}/whole", stream.STATE), layered(spark, tmp_path / "layers", buckets=4, compact_every=every)
    for batch in batches(1, 5, 25):
        feed(spark, (whole, layers), [batch], tmp_path, full)
        assert shown(layers.latest()) == shown(whole.latest())
    assert (layers.versions("base") != []) == (every == 3)


def test_a_batch_done_again_after_compaction(spark, tmp_path):
    layers = layered(spark, tmp_path / "layers", buckets=4, compact_every=2)
    data = batches(2, 4, 20)
    step = lambda n: lambda old: ingest.apply_batch(old, frames[n].drop("crawled_at"), stream.F.lit(dt.datetime(2026, 1, n + 1)), full_snapshot=True)
    frames = [spark.createDataFrame(b, POSTS) for b in data]
    for n in range(4):
        layers.advance(n, frames[n], step(n))
    want = shown(layers.latest())
    layers.advance(3, frames[3], step(3))
    assert shown(layers.latest()) == want
    assert layers.versions("base") == [1, 3] and layers.versions("layers") == [2, 3]


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_bytes_written_follow_the_batch(spark, tmp_path):
    layers = layered(spark, tmp_path / "layers", buckets=8)
    big = [(f"c{i % 500}", str(i), f"f{i}", f"title {i * 7919}", "lever", i, dt.datetime(2026, 1, 1)) for i in range(20_000)]
    small = [("c3", "3", "f3", "new title", "lever", 0, dt.datetime(2026, 1, 2))]
    for n, rows in enumerate((big, small)):
        df = spark.createDataFrame(rows, POSTS)
        old, new = layers.advance(n, df, lambda s, df=df: ingest.apply_batch(s, df.drop("crawled_at"), stream.F.lit(dt.datetime(2026, 1, 2)), full_snapshot=False))
    assert size(tmp_path / "layers/layers/v=1") < size(tmp_path / "layers/layers/v=0") / 50
    assert layers.latest().count() == 20_000 and layers.latest().where("title = 'new title'").count() == 1
    assert "bucket" in layers.before(2, [1])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1][:40]
