import pytest
from pyspark.sql import functions as F

from siftline.functions import documents as D

L = F.lit
GOOD = "\n".join(["Jane Doe jane@acme.io +91 98765 43210", "SUMMARY", "An engineer with experience building and using systems for the management of data", "SKILLS", "Python and SQL", "EXPERIENCE", "Built the pipelines with care as a developer and engineer for many teams", "EDUCATION", "A degree in the arts of computing and such things"])


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first().v


def test_readability(value):
    assert tuple(value(D.readability(L(GOOD))))[:2] == (100, "SAFE")
    assert value(D.readability(L("x")))["verdict"] == "UNREADABLE"
    assert value(D.readability(L(None).cast("string")))["verdict"] == "UNREADABLE"
    assert value(D.readability(L(GOOD.replace("SKILLS", "ZZZ").replace("EDUCATION", "YYY").replace("SUMMARY", "XXX"))))["verdict"] == "RISKY"


def test_quality_gate(value):
    master, html = "Grew sales 40% over 3 years, mail a@b.io", "<ul><li>Built things that grew 40%</li><li>Led a team</li></ul>"
    ok = value(D.quality_gate(L(master), L("Grew sales 40% a@b.io"), L(html)))
    assert (ok.score, ok.verdict, ok.failed) == (100, "SEND", [])
    bad = value(D.quality_gate(L(master), L("Grew sales 90% as a team player"), L("<table></table>" + html + html)))
    assert bad.verdict == "FIX" and set(bad.failed) == {"metrics", "format", "filler", "duplicates", "contact"} and bad.score == 100 - 30 - 15 - 3 - 8 - 10


def test_keywords(spark, value):
    assert value(D.dedupe_keywords(F.array(*map(L, (" React ", "sql", "REACT", ""))))) == ["REACT", "sql"]
    df = spark.createDataFrame([(1, ["React.js", "Node.js", "Rust", "SQL"], ["react.js", "Docker"], "I use React and Node.js with SQL", ["React", "Node.js"])], "id long, r array<string>, p array<string>, t string, s array<string>")
    audit = D.keyword_audit(df, "id", "r", "p", "t", "s")
    got = {(x.list, x.keyword): x.status for x in audit.collect()}
    assert got == {("required", "React.js"): "ACCEPTED_VARIANT", ("required", "Node.js"): "PRESENT", ("required", "Rust"): "MISSING", ("required", "SQL"): "PRESENT", ("preferred", "Docker"): "MISSING"}
    assert D.required_match(audit).first().pct == 75


@pytest.mark.parametrize(("text", "want"), [("we go to market", []), ("Go and React Native apps", ["go", "react-native"]), ("react native", ["react-native"]), ("Java, JavaScript", ["java", "javascript"]), (None, [])])
def test_printed(text, want):
    assert D._consumed(text) == want


def test_causes(value):
    c = value(D.likely_causes(L(4), L(1), L(0), L(False), L(20), L(50)))
    assert [(x.factor, x.strength) for x in c] == [("EXPERIENCE_STRETCH", 4), ("NO_REFERRAL", 3), ("APPLIED_LATE", 2), ("PARTIAL_STACK", 2)]
    assert value(D.likely_causes(L(None).cast("int"), L(1), L(0), L(True), L(None).cast("int"), L(None).cast("int"))) == []
    assert [x.factor for x in value(D.waiting_actions(L(True), L(False), L(6), L(True)))] == ["FOLLOW_UP", "TAILOR_RESUME", "APPLY_SIMILAR"]
    assert value(D.funnel_insights(L(8), L(1), L(8), L(0))) == ["FEW_REFERRALS", "NO_INTERVIEWS"]
    assert value(D.funnel_insights(L(3), L(0), L(0), L(0))) == []


def test_contacts(spark, value):
    assert tuple(value(D.contact_confidence(L(True), L("ENGINEER"), L(True), L(False), L(2), L(30)))) == (4, 5)
    assert tuple(value(D.contact_confidence(L(False), L("RECRUITER"), L(False), L(True), L(0), L(0)))) == (5, 3)
    c = spark.createDataFrame([("a", 1, "ENGINEER", 90), ("a", 2, "ENGINEER", 80), ("a", 3, "RECRUITER", 10), ("b", 4, "ENGINEER", 1)], "company string, id int, role string, priority int")
    assert sorted(tuple(r) for r in D.contact_strategy(c).collect()) == [("a", 1, 3, 3), ("b", 4, None, None)]


def test_small_text(value):
    assert value(D.indian_number(L(1234567))) == "12,34,567" and value(D.indian_number(L(999))) == "999" and value(D.indian_number(L(12345678))) == "1,23,45,678"
    assert value(D.author_names(L('<meta name="author" content="Jane Doe"><a rel="author">JANE DOE</a><a rel="author">admin</a>'))) == ["Jane Doe"]
    m = value(D.page_metadata(L('<title> Acme </title><a href="/careers">x</a><a href="/about">y</a>')))
    assert (m.title, m.description, m.career_links) == ("Acme", None, ["/careers"])
    assert value(D.slug_candidates(L("Acme Labs, Inc")))[0] == "acme"
    assert value(D.employer_matches(L("@AcmeLabs"), L("acme-labs"), L("Acme Labs Inc")))
    assert value(D.profile_seed(L("Dev"), F.array(L("Dev"), L(None).cast("string"), L("Lead")))) == ["Dev", "Lead"]
    assert value(D.with_keywords(L("<h2>Skills</h2><p>SQL</p>"), F.array(L("Go")))) == "<h2>Skills</h2><p>SQL, Go</p>"
    assert value(D.master_html(L("A & B"), F.array(F.struct(L("H").alias("heading"), F.array(L("x<y")).alias("lines"))))) == "<h1>A &amp; B</h1><h2>H</h2><ul><li>x&lt;y</li></ul>"
    c = value(D.normalized_classification(L("design"), L("huh"), L(None).cast("string"), L(99), F.array(L("a"), L(" "))))
    assert tuple(c) == ("DESIGN", "NONE", "UNKNOWN", None, ["a"])
    assert value(D.country_gate(L(None).cast("string"), L("Pune, India"), ["IN"], "india")) and not value(D.country_gate(L("in"), L(None).cast("string"), ["IN"], None))
    assert value(D.country_gate_any_case(L("in"), ["IN"])) and value(D.country_gate(L(None).cast("string"), L("x"), [], None))
