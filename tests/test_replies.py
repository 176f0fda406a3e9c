"""JSON out of model replies, and companies that meet by board, host and name."""

import pytest

from siftline.functions import text as X
from siftline.operators import ingest


@pytest.mark.parametrize(("reply", "want"), [
    ('{"a": 1}', '{"a": 1}'), ('[{"a":1},{"a":2}]', '[{"a":1},{"a":2}]'), ('```json\n[1, 2]\n```', "[1, 2]"), ('```\n{"a": "```"}\n```', '{"a": "```"}'), ('{"a":1}\n ]\n}\n ]\n}', '{"a":1}'), ('we use {} for "blocks {', "{}"),
    ('then {"k": "x } \\" y"} end', '{"k": "x } \\" y"}'), ('{"a": NaN}', None), ('{"a": Infinity}', None), ("{" * 100_000, None), ('{"a":' * 200_000, None), ('{"a":' * 200_000 + "1" + "}" * 200_000, None), ("}{" * 50_000, "{}"), ("no", None), ("", None), (None, None), ('"text"', '"text"'),
    ('Sure: {bad} {"k": 1}', '{"k": 1}'),
])
def test_replies(reply, want):
    assert X._reply(reply) == want


COLS = "name string, website string, ats_provider string, ats_identifier string"


def merged(spark, old, new):
    got = ingest.merge_companies(spark.createDataFrame(old, "id long, " + COLS), spark.createDataFrame(new, COLS).coalesce(1)).collect()
    return sorted(((r.id, r.name, r.website, r.ats_provider, r.ats_identifier) for r in got), key=str)


def test_hosts_meet_by_their_endings(spark):
    old = [(1, "A", "https://careers.acme.example/jobs", None, None), (2, "B", "https://acme.example", None, None), (3, "C", "http://www.x.beta.example:8080/p?q", None, None), (4, "D", "https://notgamma.example", None, None), (5, "E", "no address", None, None)]
    new = [("n1", "http://acme.example/about", "LEVER", "acme"), ("n2", "https://beta.example", "LEVER", "beta"), ("n3", "https://gamma.example", None, None), ("n4", "https://example", None, None)]
    assert merged(spark, old, new) == sorted([
        (1, "A", "https://careers.acme.example/jobs", None, None), (2, "B", "https://acme.example", "LEVER", "acme"), (3, "C", "http://www.x.beta.example:8080/p?q", "LEVER", "beta"), (4, "D", "https://notgamma.example", None, None), (5, "E", "no address", None, None),
        (None, "n3", "https://gamma.example", None, None), (None, "n4", "https://example", None, None)], key=str)


def test_unknown_boards_are_upgraded_together_with_their_identifier(spark):
    old = [(1, "Acme", None, "UNKNOWN", None), (2, "Beta", None, "LEVER", None), (3, "Gamma", None, "ASHBY", "gamma")]
    new = [("ACME", None, "UNKNOWN", "x"), ("acme", None, "LEVER", "acme"), ("acme", None, "ASHBY", "other"), ("beta", None, "WORKABLE", "beta"), ("gamma", "https://g.example", "LEVER", "g")]
    assert merged(spark, old, new) == [(1, "Acme", None, "LEVER", "acme"), (2, "Beta", None, "WORKABLE", "beta"), (3, "Gamma", "https://g.example", "ASHBY", "gamma")]


def test_nameless_finds_stay_apart_and_hot_names_do_not_multiply(spark):
    old = [(i, "Same", None, None, None) for i in range(5, 60)]
    new = [(None, "https://one.example", None, None), (None, "https://two.example", None, None), (None, None, None, None), (None, None, None, None), ("same", None, None, None)] + [("SAME", "https://s.example", None, None)] * 50
    got = merged(spark, old, new)
    assert len(got) == 55 + 4
    assert [g for g in got if g[2]] == [(5, "Same", "https://s.example", None, None), (None, None, "https://one.example", None, None), (None, None, "https://two.example", None, None)]
    assert ingest.match_companies(spark.createDataFrame(old, "id long, " + COLS), spark.createDataFrame(new, COLS).selectExpr("*", "monotonically_increasing_id() as f"), "f").count() == 51
