"""Physical plans: what must be pushed down, pruned or kept out of Python."""

import re
from pathlib import Path

import pytest

from siftline.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plan(spark, name):
    df = registry.queries()[name](spark, DATA)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["top_growing", "nearest_vectors", "city_coverage", "watched_first", "outreach_inbox", "action_plan", "jobs_page"])
def test_top_k_is_one_operator(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


#: A scan of replies for whole JSON objects, automata over texts and the postings of an index run in Arrow batches.
IN_PYTHON = {"model_replies", "suggested_skills", "document_search", "page_search", "phrase_hits", "keyword_audit", "notify_decisions", "job_detail"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - IN_PYTHON))
def test_no_python_on_executors(spark, name):
    assert not re.search("Python|Pandas|Arrow(?!Eval)", plan(spark, name))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "jobs_with_company")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(o_totalprice,400000", text)
    scan = next(s for s in re.findall(r"ReadSchema: struct<[^>]*>", text) if "o_orderkey" in s)
    assert "o_orderpriority" not in scan and "o_orderdate" not in scan


@pytest.mark.parametrize(("name", "most"), [("extraction_health", 2), ("signal_lift", 2), ("recommendation_quality", 1), ("rejection_buckets", 2), ("daily_headline", 1)])
def test_grouped_reports_shuffle_once(spark, name, most):
    assert len(re.findall(r"Exchange (hash|range|Single)", plan(spark, name))) <= most


def test_top_per_key_is_pruned_before_the_shuffle(spark):
    text = plan(spark, "latest_turn")
    assert text.index("WindowGroupLimit") < text.rindex("WindowGroupLimit")
