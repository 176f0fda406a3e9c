import pytest
from pyspark.sql import functions as F

from siftline.functions import common as C
from siftline.functions import scoring as S

L = F.lit


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first().v


@pytest.mark.parametrize(("score", "verdict"), [(75, "APPLY"), (74.9, "CONSIDER"), (60, "CONSIDER"), (59.9, "SKIP")])
def test_verdict(value, score, verdict):
    assert value(S.verdict_band(L(float(score)))) == verdict


@pytest.mark.parametrize(("age", "want"), [(1, "LOW"), (8, "MEDIUM"), (40, "HIGH"), (None, "MEDIUM")])
def test_competition(value, age, want):
    assert value(S.competition(L(age).cast("int"))) == want


@pytest.mark.parametrize(("source", "want"), [("ashby", 100), ("adzuna", 92), ("jooble", 90), ("career-page:acme", 94), ("elsewhere", 85), (None, 85)])
def test_baseline(value, source, want):
    assert value(S.source_baseline(L(source).cast("string"))) == want


@pytest.mark.parametrize(("base", "active", "stale", "fresh", "want"), [(94, 80, 80, 0, 82), (92, 0, 0, 0, 92), (100, 10, 0, 10, 100), (45, 10, 10, 0, 40), (90, 10, 0, 10, 95)])
def test_trust(value, base, active, stale, fresh, want):
    assert value(S.source_trust_score(L(base), L(active), L(stale), L(fresh))) == want


@pytest.mark.parametrize(("recent", "prior", "enough", "want"), [(5, 0, False, "INSUFFICIENT_DATA"), (0, 0, True, "INSUFFICIENT_DATA"), (10, 4, True, "GROWING"), (3, 0, True, "GROWING"), (1, 0, True, "STABLE"), (2, 10, True, "DECLINING"), (5, 5, True, "STABLE"), (5, 5, None, "INSUFFICIENT_DATA")])
def test_trend(value, recent, prior, enough, want):
    assert value(S.hiring_trend(L(recent), L(prior), L(enough).cast("boolean"))) == want


@pytest.mark.parametrize(("new14", "active", "days", "attempts", "watched", "want"), [(0, 0, None, 10, False, "DORMANT"), (0, 0, None, 2, False, "COLD"), (0, 4, 300, 10, False, "COLD"), (5, 4, 1, 10, False, "HOT"), (1, 4, 10, 10, False, "WARM"), (0, 4, 20, 10, False, "WARM"), (0, 4, 60, 10, False, "COLD"), (0, 0, None, 10, True, "HOT")])
def test_tier(value, new14, active, days, attempts, watched, want):
    assert value(S.crawl_tier(L(new14), L(active), L(days).cast("int"), L(attempts), L(watched))) == want


def test_ranking(value):
    s = lambda **k: [L(x) if x is not None else L(None).cast(t) for x, t in zip(({"fit": 80, "age": 5, "ref": "NONE", "w": False, "t": None, "a": False, "trust": None} | k).values(), ("int", "int", "string", "boolean", "string", "boolean", "int"))]
    assert value(S.ranking_score(*s())) == 54  # 49 for the fit and 5 for a recent posting
    assert value(S.ranking_score(*s(ref="CONTACTED", w=True))) == 74
    assert value(S.ranking_score(*s(a=True))) == 36
    assert value(S.ranking_score(*s(fit=100, age=0, ref="CONTACTED", w=True, t="GROWING", trust=100))) == 100
    factors = value(S.ranked_factors(*s(a=True, t="DECLINING")))
    assert [(f.factor, f.delta) for f in factors] == [("resume_fit", 49), ("applied", -18), ("freshness", 5), ("trend", -3)]


def test_weighted_score_renormalises_and_damps(value):
    scores = {"resumeFit": L(80), "skillGap": L(100), "cityPreference": L(None).cast("int")}
    assert value(S.weighted_score(scores, L(None).cast("int"), L(90))) == 82.5
    assert value(S.weighted_score(scores, L(100), L(90))) == 84.5
    assert value(S.weighted_score(scores, L(None).cast("int"), L(10))) == 70.1
    assert len(value(S.modules(scores))) == 2


@pytest.mark.parametrize(("nudges", "since", "nudged", "replied", "want"), [(0, 1, None, False, ("AWAIT", 0)), (0, 4, None, False, ("FOLLOW_UP", 2)), (0, 7, None, False, ("FOLLOW_UP", 3)), (1, 9, 2, False, ("AWAIT", 0)), (1, 9, 5, False, ("FOLLOW_UP", 2)), (2, 20, 6, False, ("CLOSE", 0)), (0, 1, None, True, ("RESPOND", 3))])
def test_outreach(value, nudges, since, nudged, replied, want):
    assert tuple(value(S.next_outreach(L("CONTACTED"), L(since), L(nudged).cast("int"), L(replied), L(nudges)))) == want


@pytest.mark.parametrize(("seniority", "minimum", "want"), [("INTERN", None, (False, False, True)), ("SENIOR", None, (False, False, False)), ("SENIOR", 3, (True, True, False)), ("MID", None, (True, False, False)), ("MID", 2, (True, False, False)), ("MID", 3, (True, True, False)), ("MID", 4, (False, False, False))])
def test_experience(value, seniority, minimum, want):
    assert tuple(value(S.experience_verdict(L(seniority), L(minimum).cast("int"), L(2)))) == want


def test_rounding(value):
    assert value(C.js_round(L(-2.5))) == -2
    assert value(C.round1(L(84.25))) == 84.3
    assert value(C.pct1(L(1), L(0))) is None
    assert value(S.token_cost(L(0.3), L(2.5), L(1000), L(100))) == pytest.approx(__import__("decimal").Decimal("0.000550"))
    assert value(S.token_cost(L(None).cast("double"), L(2.5), L(1000), L(100))) is None
