"""Skills replaced by version, and a job's record."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import detail, skills

PARSED = "version_id long, pos int, name string, category string, years double"


def state(store):
    names = {r.skill_id: (r.name, r.category) for r in store.read("vocabulary", skills.VOCABULARY).collect()}
    links = sorted((r.version_id, names[r.skill_id][0], r.years) for r in store.read("links", skills.LINKS).collect())
    vectors = sorted((r.version_id, r.model, r.vector) for r in store.read("vectors", skills.VECTORS).collect())
    return dict(names.values()), links, vectors


def step(spark, store, parsed, versions, vectors):
    store.step(spark.createDataFrame(parsed, PARSED), spark.createDataFrame([(v,) for v in versions], "version_id long"), spark.createDataFrame(vectors, skills.VECTORS))


@pytest.mark.parametrize("buckets", [1, 16])
def test_second_version_takes_the_place_of_the_first(spark, tmp_path, buckets):
    store = skills.SkillStore(spark, f"file://{tmp_path}/s", buckets)
    step(spark, store, [(1, 0, " React ", "frontend", 2.0), (1, 1, "SQL", None, None), (1, 2, "sql", "data", 3.0), (1, 3, " ", "x", 1.0), (2, 0, "Go", "lang", 1.0)], [1, 2], [(1, "m1", [1.0]), (2, "m1", [2.0])])
    assert state(store) == ({"react": "frontend", "sql": None, "go": "lang"}, [(1, "react", 2.0), (1, "sql", 3.0), (2, "go", 1.0)], [(1, "m1", [1.0]), (2, "m1", [2.0])])
    second = ([(1, 0, "REACT", "other", 4.0), (1, 1, "Rust", "lang", None)], [1], [(1, "m2", [9.0])])
    step(spark, store, *second)
    want = ({"react": "frontend", "sql": None, "go": "lang", "rust": "lang"}, [(1, "react", 4.0), (1, "rust", None), (2, "go", 1.0)], [(1, "m2", [9.0]), (2, "m1", [2.0])])
    assert state(store) == want
    step(spark, store, *second)
    assert state(store) == want
    step(spark, store, [], [1, 2], [])
    assert state(store)[1:] == ([], want[2])


def test_a_step_that_died_after_the_vocabulary_is_done_again(spark, tmp_path, monkeypatch):
    store = skills.SkillStore(spark, f"file://{tmp_path}/s", 4)
    rows = ([(1, 0, "React", "f", 1.0)], [1], [(1, "m", [1.0])])
    whole = skills.SkillStore._replace
    monkeypatch.setattr(skills.SkillStore, "_replace", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        step(spark, store, *rows)
    monkeypatch.setattr(skills.SkillStore, "_replace", whole)
    step(spark, store, *rows)
    assert state(store) == ({"react": "f"}, [(1, "react", 1.0)], [(1, "m", [1.0])])
    assert store.read("vocabulary", skills.VOCABULARY).count() == 1


def test_job_details(spark):
    jobs = spark.createDataFrame([(1, 10), (2, 10), (3, 99)], "job_id long, company_id long")
    classes = spark.createDataFrame([(1, 1, ["Docker"], [], [], "OLD"), (1, 2, ["React", "REST API", "Kafka", "Postgres"], ["react", "Docker"], ["Java"], "BACKEND"), (2, 1, None, None, None, None)], "job_id long, version int, required array<string>, preferred array<string>, specializations array<string>, role_family string")
    matches = spark.createDataFrame([(1, "APPLY", "OK", 77.5)], "job_id long, verdict string, code string, score double")
    companies = spark.createDataFrame([(10, "Acme", 80)], "company_id long, name string, confidence int")
    person = detail.Person(("React.js", "RESTful APIs", "MySQL"), "I know React.js, RESTful APIs and MySQL", 3)
    got = {r.job_id: r for r in detail.job_details(jobs, classes, matches, companies, spark.createDataFrame([("java", "AVOID")], "discipline string, preference string"), person).collect()}
    one = got[1]
    assert one.classification.role_family == "BACKEND" and one.specialization.strong == ["React", "REST API"] and one.specialization.transferable == ["Postgres"] and one.specialization.missing == ["Kafka", "Java"] and one.specialization.fit == 50
    assert [(w.skill, w.gain) for w in one.what_if] == [("Kafka", 20), ("Java", 20), ("Postgres", 10)]
    assert [(k.keyword, k.status) for k in one.keywords.required] == [("React", "ACCEPTED_VARIANT"), ("REST API", "ADD_EXACT"), ("Kafka", "MISSING"), ("Postgres", "MISSING")]
    assert [k.keyword for k in one.keywords.preferred] == ["Docker"] and one.keywords.add_exact == ["REST API"] and one.keywords.missing_required == ["Kafka", "Postgres"] and one.keywords.match_pct == 25
    assert tuple(one.match) == ("APPLY", "OK", 78) and one.career_path.discipline and one.company.name == "Acme" and one.years == 3
    assert (got[2].specialization.fit, got[2].keywords, got[2].match) == (None, None, None) and got[3].classification is None and got[3].company is None


def test_parts_are_joined_where_they_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jobs = spark.range(100).selectExpr("id as job_id", "id % 7 as company_id")
        classes = spark.range(100).selectExpr("id as job_id", "1 as version", "array('React') as required", "array('Go') as preferred", "array('x') as specializations", "'F' as role_family")
        matches, companies = jobs.selectExpr("job_id", "'A' as verdict", "'B' as code", "1.0D as score"), spark.range(7).selectExpr("id as company_id", "'n' as name")
        df = detail.job_details(jobs, classes, matches, companies, spark.createDataFrame([("go", "x")], "discipline string, preference string"), detail.Person(("React",), "React", 1))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = plan[plan.index("SortMergeJoin [off_path"):]
    assert "Exchange" not in joined[joined.index("SortMergeJoin [job_id") : joined.index("SortMergeJoin [job_id") + 80]
    assert df.where(F.col("match").isNotNull()).count() == 100


@pytest.mark.parametrize("few", [0, detail.FEW_BYTES])
def test_lists_are_told_once_however_many_jobs_have_them(spark, monkeypatch, few):
    seen = []
    whole = detail.tech.what_if
    monkeypatch.setattr(detail.tech, "what_if", lambda df, *a: seen.append(df.count()) or whole(df, *a))
    jobs = spark.range(300).selectExpr("id as job_id", "id % 7 as company_id")
    # lists whose words are alike when they are strung together, with nulls, and versions that tie
    shapes = "case id % 4 when 0 then array('Go', 'React') when 1 then array('Go') when 2 then array('Go', null) end"
    classes = spark.range(600).selectExpr("id % 300 as job_id", "1 as version", f"{shapes} as required", "if(id % 4 = 1, array('React'), array()) as preferred", "if(id < 300, array('Kafka'), array('Java')) as specializations", "'F' as role_family")
    matches, companies = jobs.selectExpr("job_id", "'A' as verdict", "'B' as code", "1.0D as score"), spark.range(7).selectExpr("id as company_id", "'n' as name")
    got = detail.job_details(jobs, classes, matches, companies, spark.createDataFrame([("go", "x")], "discipline string, preference string"), detail.Person(("React",), "React", 1), few).collect()
    assert seen and seen[0] <= 8 and len(got) == 300
    for r in got:
        want = {0: ["Go", "React"], 1: ["Go"], 2: ["Go"], 3: []}[r.job_id % 4]
        words = [*want, *({"Kafka", "Java"} & {*r.specialization.missing})]
        assert len(words) == len(want) + 1 and sorted(r.specialization.strong + r.specialization.missing) == sorted(words)
        assert (r.keywords is None) == (r.job_id % 4 == 3)
        if r.keywords:
            assert [k.keyword for k in r.keywords.required if k.keyword] == want and [k.keyword for k in r.keywords.preferred] == (["React"] if r.job_id % 4 == 1 else [])
