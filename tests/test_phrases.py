"""Phrases by one automaton, and the keyword audit built on it."""

import re

import pytest

from siftline.functions import documents as D
from siftline.functions import tech
from siftline.operators import phrases

RESUME = "\nSKILLS\nBackend: JavaScript (ES6+), Node.js, Express.js, RESTful APIs, Socket.io, Strapi\nDatabases: MySQL\nFrontend: React.js, HTML5, CSS3\n"
SKILLS = ["JavaScript", "Node.js", "Express.js", "RESTful APIs", "MySQL", "React.js", "HTML5", "CSS3"]


@pytest.fixture(scope="module")
def audit(spark):
    def run(required, preferred=(), text=RESUME, skills=SKILLS):
        df = spark.createDataFrame([(1, list(required), list(preferred), text, list(skills))], "id long, r array<string>, p array<string>, t string, s array<string>")
        rows = D.keyword_audit(df, "id", "r", "p", "t", "s").orderBy("list", "pos").collect()
        return [(r.list, r.keyword, r.status, r.your_term) for r in rows]

    return run


def test_present_variant_exact_and_missing(audit):
    assert audit(["Node.js", "REST API", "ExpressJS", "React", "Docker"]) == [
        ("required", "Node.js", "PRESENT", None), ("required", "REST API", "ADD_EXACT", "RESTful APIs"), ("required", "ExpressJS", "ACCEPTED_VARIANT", "Express.js"), ("required", "React", "ACCEPTED_VARIANT", "React.js"), ("required", "Docker", "MISSING", None)]


def test_preferred_leaves_out_what_is_required(audit):
    assert audit(["Docker", "docker ", ""], ["DOCKER", "GraphQL"]) == [("preferred", "GraphQL", "MISSING", None), ("required", "docker", "MISSING", None)]


def test_texts_without_words(audit):
    assert audit(["c++ (17)"], text=None) == [("required", "c++ (17)", "MISSING", None)]
    assert audit(["(17)"], text="C++ (17)") == [("required", "(17)", "PRESENT", None)]


def slow(text):
    """Longest spelling first, each taken out of the text before the next is sought."""
    found, rest, word = set(), text, "A-Za-z0-9+#._-"
    for alias in sorted(tech.ALIASES, key=lambda a: -len(a)):
        for m in list(re.finditer(f"(?<![{word}]){re.escape(alias)}(?![{word}])", rest, re.IGNORECASE)):
            if alias not in tech.AMBIGUOUS or m.group() != m.group().lower():
                found.add(tech.ALIASES[alias])
                rest = rest[: m.start()] + " " * len(m.group()) + rest[m.end() :]
    return sorted(found)


@pytest.mark.parametrize("text", ["React Native and React", "react native, Rest API. REST apis GO go", "Core Java; java", "Spring Boot spring", "node js Node.js node", "C c# c++ C", "İstanbul React.js ES6+ es6", "api API rest api", "machine learning ML", "", "Kubernetes/k8s|Docker-compose"])
def test_consumption_equals_taking_out_in_turn(text):
    assert D._consumed(text) == slow(text)


def test_counts_rows_not_ids_in_any_number_of_blocks(spark):
    docs = spark.createDataFrame([(1, "one PASSAGE here"), (1, "one passage again passage"), (2, None), (3, ""), (4, "aab ab b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "Passage"), (2, "ab"), (3, "passage"), (4, "absent"), (5, ""), (6, None), (7, "b"), (8, "one passage")], "item_id long, phrase string")
    for size in (1, 1 << 20):
        assert sorted(map(tuple, phrases.phrase_counts(docs, asked, size).collect())) == [(1, 2), (2, 1), (3, 2), (7, 1), (8, 2)]
    assert phrases.phrase_counts(docs, asked.limit(0)).collect() == []


def test_more_phrases_than_any_list(spark):
    docs = spark.createDataFrame([(i, f"start w{i} end") for i in range(50)], "doc_id long, text string")
    asked = spark.range(3000).selectExpr("id as item_id", "concat('w', id, ' e') as phrase")
    assert phrases.phrase_counts(docs, asked).count() == 50
