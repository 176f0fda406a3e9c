"""Stored pages taken anew by another version of the rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftline.functions import html as H
from siftline.operators import replay



def as_of():
    return F.lit(dt.datetime(2026, 3, 1))


POSTING = "page_id long, external_id string, title string, version string"


def rule(threshold):
    def run(pages):
        jobs, summary = H.extract(pages, threshold)
        return jobs.where((F.col("score") >= threshold) & F.col("job_url").isNotNull()).select("page_id", "external_id", "title"), summary

    return run


def page(*titles, place=""):
    return "<html>" + "".join(f'<li><a href="/{"careers" if i % 2 else "team"}/{i}">{t}</a> · {place}</li>' for i, t in enumerate(titles)) + "</html>"


PAGES = [
    (1, "https://a.example/x", page("Backend Engineer", "Data Analyst", place="Pune")), (2, "https://a.example/x", page("Backend Engineer", "Data Analyst", place="Pune")), (3, "https://b.example/", page("Backend Engineer", "Data Analyst", place="Pune")),
    (4, "https://c.example/", page("QA Tester", "React Developer")), (5, "https://d.example/", None), (6, "https://e.example/", page("About us")),
]


@pytest.fixture()
def store(spark, tmp_path):
    s = replay.SnapshotStore(spark, f"file://{tmp_path}/store", POSTING)
    s.capture(0, spark.createDataFrame(PAGES, "page_id long, url string, html string"), rule(60), "v1", as_of())
    return s


def shown(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_capture_keeps_contents_once(spark, store):
    assert store.contents().count() == 4
    assert shown(store.snapshots.latest(), "page_id", "version", "jobs", "strong") == [(1, "v1", 2, 2), (2, "v1", 2, 2), (3, "v1", 2, 2), (4, "v1", 2, 1), (5, "v1", 0, 0), (6, "v1", 0, 0)]
    assert [p for p, _ in shown(store.postings.latest(), "page_id", "title")] == [1, 1, 2, 2, 3, 3, 4]
    store.capture(1, spark.createDataFrame([(6, "https://e.example/", PAGES[0][2])], "page_id long, url string, html string"), rule(60), "v1", as_of())
    assert store.contents().count() == 4
    assert [p for p, _ in shown(store.postings.latest(), "page_id", "title")] == [1, 1, 2, 2, 3, 3, 4, 6, 6]


def test_replay_adds_and_removes_and_then_rests(store):
    first = shown(store.postings.latest(), "page_id", "title")
    stricter = shown(store.replay(1, rule(80), "v2", as_of()), "page_id", "change")
    assert stricter == [(1, "KEPT"), (1, "REMOVED"), (2, "KEPT"), (2, "REMOVED"), (3, "KEPT"), (3, "REMOVED"), (4, "REMOVED")]
    assert shown(store.postings.latest(), "page_id", "title", "version") == [(i, "Data Analyst", "v2") for i in (1, 2, 3)]
    assert {r.version for r in store.snapshots.latest().collect()} == {"v2"}
    before = shown(store.postings.latest(), "page_id", "title"), shown(store.snapshots.latest(), "page_id", "version", "replayed_at")
    assert store.replay(2, rule(80), "v2", as_of()).count() == 0
    assert before == (shown(store.postings.latest(), "page_id", "title"), shown(store.snapshots.latest(), "page_id", "version", "replayed_at"))
    assert {c for _, c in shown(store.replay(3, rule(60), "v3", as_of()), "page_id", "change")} == {"KEPT", "ADDED"}
    assert shown(store.postings.latest(), "page_id", "title") == first


def test_a_run_that_is_done_again_writes_the_same(store):
    store.replay(1, rule(80), "v2", as_of())
    once = shown(store.postings.latest(), "page_id", "title")
    assert shown(store.replay(1, rule(80), "v2", as_of()), "page_id", "change")[0] == (1, "KEPT")
    assert shown(store.postings.latest(), "page_id", "title") == once


def test_backlog_rotates_in_portions(store):
    for run in (1, 2, 3):
        store.replay(run, rule(80), "v2", as_of(), limit=2)
        assert store.snapshots.latest().where("version = 'v2'").count() == 2 * run
    assert replay.behind(store.snapshots.latest(), "v2").count() == 0


def test_copies_are_read_once(spark):
    seen = []

    def watching(pages):
        seen.append(sorted(r.page_id for r in pages.select("page_id").collect()))
        return rule(60)(pages)

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("content", replay.content_key(F.col("html")))
    postings, _ = replay.take(pages, watching)
    assert seen == [[1, 3, 4, 5, 6]]
    assert [p for p, _ in shown(postings, "page_id", "title")] == [1, 1, 2, 2, 3, 3, 4]


def test_word_edges_are_ascii_and_rpo_is_rejected(spark):
    df = spark.createDataFrame([(1, "https://x.example/", '<a href="/jobs/1">RPO Recruiter lead</a><a href="/jobs/2">Ingénieur qa tester</a><a href="/jobs/3">éqa personne là</a>')], "page_id long, url string, html string")
    c = {r.title: r.reject for r in H.classified(H.candidates(df)).collect()}
    assert c == {"RPO Recruiter lead": "negative-signal", "Ingénieur qa tester": None, "éqa personne là": None}
