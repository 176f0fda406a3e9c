"""Stems, the syntax of searches, and matching against plain evaluation."""

import re

import pytest

from siftline.functions.stemming import STOP_WORDS, stem
from siftline.operators import fulltext

STEMS = {
    "consistency": "consist", "running": "run", "hopping": "hop", "hoped": "hope", "flies": "fli", "ties": "tie", "caresses": "caress", "agreed": "agre", "feed": "feed", "sing": "sing", "luxuriated": "luxuri",
    "happy": "happi", "say": "say", "by": "by", "relational": "relat", "rational": "ration", "operator": "oper", "hopefulness": "hope", "electricity": "electr", "adjustment": "adjust", "adoption": "adopt", "rate": "rate",
    "cease": "ceas", "controlling": "control", "roll": "roll", "knightly": "knight", "engineers": "engin", "engineering": "engin", "gas": "gas", "gaps": "gap", "boy": "boy", "enjoying": "enjoy", "c3po": "c3po", "größe": "größe",
}


@pytest.mark.parametrize("word", STEMS)
def test_stems(word):
    assert stem(word) == STEMS[word]


DOCS = [
    (1, "Backend Engineer", "Building REST APIs in Node. The team runs Kafka."), (2, "Frontend engineers", "react and the REST of the team"), (3, "Data", "apis rest, building engineering pipelines with kafka kafka kafka"),
    (4, "", ""), (5, None, None), (6, "Engineer", "engineer engineer"), (None, "Engineer", "lost"), (7, "of the", "the big big team"), (8, "Größe", "straße 10-20"),
]
QUERIES = {
    1: "engineer", 2: '"rest apis"', 3: "kafka -react", 4: '"rest api" or react', 5: "engineer -kafka or straße", 6: "-engineer", 7: "the", 8: '"rest of the team"', 9: '"big big"', 10: "10-20", 11: 'build "unclosed team', 12: "", 13: None,
    14: "team -\"big big\"", 15: "kafka kafka pipeline", 16: "größe -\"straße 10\"", 17: "rest apis -\"rest apis\"", 18: "or", 19: '"the team" runs',
}


def plain(text):
    """Terms with positions from 0, stop words gone."""
    return [(i, stem(w)) for i, w in enumerate(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())) if w not in STOP_WORDS]


def matches(query, doc):
    spots = plain((doc[1] or "") + "\n" + (doc[2] or ""))
    held = set(spots)
    alternatives, clauses = [], []
    for piece in [*re.findall(r'-?"[^"]*"|[^\s"]+', (query or "").lower()), "or"]:
        if piece == "or":
            alternatives.append(clauses)
            clauses = []
        elif plain(piece):
            clauses.append((piece[0] == "-", plain(piece)))
    for alt in alternatives:
        hit = lambda c: any(all((at + i - c[0][0], t) in held for i, t in c) for at, t in spots if t == c[0][1])
        if alt and all(hit(c) != negated for negated, c in alt):
            return True
    return False


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "id long, title string, body string").repartition(3)
    return fulltext.build_index(docs, "id", docs.title, docs.body)


def test_matches_equal_plain_evaluation(spark, index):
    queries = spark.createDataFrame(list(QUERIES.items()), "q long, search string")
    got = {}
    for r in fulltext.search(index, queries, "q", "search").collect():
        got.setdefault(r["query"], set()).add(r.doc)
    want = {q: found for q, text in QUERIES.items() if (found := {d[0] for d in DOCS if d[0] is not None and matches(text, d)})}
    assert got == want


def test_rank_prefers_titles_and_repeats(spark, index):
    queries = spark.createDataFrame([(1, "engineer"), (2, "kafka")], "q long, search string")
    rows = fulltext.search(index, queries, "q", "search", limit=3).orderBy("query", "place").collect()
    first = (1.0 + 0.4 / 4 + 0.4 / 9) / fulltext.RANK_LIMIT
    assert [(r["query"], r.place, r.doc) for r in rows if r["query"] == 1] == [(1, 1, 6), (1, 2, 1), (1, 3, 2)]
    assert rows[0]["rank"] == pytest.approx(first, abs=1e-6)
    assert [r.doc for r in rows if r["query"] == 2] == [3, 1]


def test_saved_index_is_read_by_term(spark, index, tmp_path):
    fulltext.save_index(index, str(tmp_path / "ix"), 2)
    saved = fulltext.load_index(spark, str(tmp_path / "ix"))
    assert sorted(map(str, saved.collect())) == sorted(map(str, index.collect()))
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,kafka)]" in saved.where("term = 'kafka'")._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_once(spark, index):
    queries = spark.createDataFrame([(1, '"rest api" -kafka or react')], "q long, search string")
    plan = fulltext.search(index, queries, "q", "search")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
