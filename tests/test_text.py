import pytest
from pyspark.sql import functions as F

from siftline.functions import tech as T
from siftline.functions import text as X

L = F.lit


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first().v


def test_titles(value):
    t = lambda s: value(X.normalize_title(L(s)))
    assert t("Senior Backend Engineer") == t("Backend Engineer (Senior)")
    assert t("Full-Stack Developer") == t("Developer, Full Stack")
    assert t("We are hiring: an Engineer") == "engineer"
    assert t("Déjà Vu") == "a de j vu".replace("a ", "") or "de" in t("Déjà Vu")


def test_locations(value):
    assert value(X.normalize_location(L("Bangalore, India"))) == "bangalore india"
    assert value(X.normalize_location(L(None).cast("string"))) == ""


def test_fingerprint(value):
    f = lambda c, t, m: value(X.job_fingerprint(L(c), L(t), L("Pune"), L(m).cast("string")))
    base = f("c1", "Backend Engineer", None)
    assert len(base) == 32 and base == f("c1", "engineer BACKEND", None)
    assert len({base, f("c2", "Backend Engineer", None), f("c1", "Senior Backend Engineer", None), f("c1", "Backend Engineer", "REMOTE")}) == 4


@pytest.mark.parametrize(("url", "want"), [
    ("https://boards.greenhouse.io/acme", ("GREENHOUSE", "acme")), ("https://boards.greenhouse.io/embed/job_board?for=acme", ("GREENHOUSE", "acme")), ("https://jobs.lever.co/acme/1", ("LEVER", "acme")),
    ("https://acme.wd5.myworkdayjobs.com/en-US/careers", ("WORKDAY", "acme/careers")), ("https://acme.recruitee.com/o/x", ("RECRUITEE", "acme")), ("https://apply.workable.com/api/v1", ("WORKABLE", None)),
    ("https://www.workable.com/x", ("UNKNOWN", None)), ("https://app.breezy.hr", ("UNKNOWN", None)), ("https://acme.keka.com/careers", ("KEKA", "acme")), ("not a url", ("UNKNOWN", None)), ("https://example.com", ("UNKNOWN", None)),
])
def test_boards(value, url, want):
    assert tuple(value(X.detect_board(L(url)))) == want


def test_short_id(value):
    h = 5381
    for c in "https://a.example/jobs/1":
        h = (h * 33 + ord(c)) % 2**32
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while h:
        h, r = divmod(h, 36)
        out = digits[r] + out
    assert value(X.short_id(L("https://a.example/jobs/1"))) == "careerpage-" + out


def test_html(value):
    assert value(X.html_to_text(L("<style>x</style><p>A &amp; B</p><div>C<br/>D</div>"))) == "A & B\nC\nD"
    assert value(X.html_to_line(L("<p>A</p>\n<p>B</p>"))) == "A B"


def test_truncate(value):
    t = "First sentence here. Second sentence goes on and on"
    assert value(X.truncate_at_sentence(L(t), 30)) == "First sentence here."
    assert value(X.truncate_at_sentence(L("word " * 20), 30)).endswith("…")
    assert value(X.truncate_at_sentence(L("short"), 30)) == "short"


def test_emails(value):
    html = "mail info@acme.io or careers@acme.io, noreply@acme.io x@other.com logo@2x.png"
    got = value(X.company_emails(L(html), L("acme.io")))
    assert [(e.address, e.kind) for e in got] == [("careers@acme.io", "RECRUITING"), ("info@acme.io", "GENERAL")]


def test_json(value):
    assert value(X.json_object(L('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(X.json_object(L('Sure: {"a": {"b": 2}} done'))) == '{"a": {"b": 2}}'
    assert value(X.json_object(L("nothing"))) is None


def test_phrases(value):
    assert value(X.literal_phrase(L("uses Node.js daily"), "node.js"))
    assert not value(X.literal_phrase(L("uses Node.jsx daily"), "node.js"))


@pytest.mark.parametrize(("skill", "want"), [("JavaScript", "javascript"), ("Java", "java"), ("react native", "react-native"), ("React.js (Hooks)", "react"), ("go to market strategy", None), ("advanced PostgreSQL tuning", "postgres"), ("C++", "cpp"), ("css", "css"), ("", None), ("OTP (Twilio)", None)])
def test_canonical(value, skill, want):
    assert value(T.canonical(L(skill))) == want


def test_specialization(spark):
    df = spark.createDataFrame([(1, ["React.js", "PostgreSQL", "Rust", "basket weaving"]), (2, []), (3, ["unknown"])], "id long, w array<string>")
    got = {r.id: r for r in T.specialization(df, "id", "w", ("react", "mysql")).collect()}
    assert (got[1].fit, got[1].strong, got[1].transferable, got[1].missing, got[1].off_path) == (50, ["React.js"], ["PostgreSQL"], ["Rust"], "rust")
    assert got[2].fit is None and got[3].missing == []
    gains = {r.id: r.what_if for r in T.what_if(df, "id", "w", ("react", "mysql")).collect()}
    # half of what PostgreSQL would give is there already
    assert [(g.gain, g.skill) for g in gains[1]] == [(33, "Rust"), (17, "PostgreSQL")]
    assert gains[2] == gains[3] == []
    df = spark.createDataFrame([(1, ["TypeScript", "JS", "JavaScript", "Rust"])], "id long, w array<string>")
    assert [(g.gain, g.skill) for g in T.what_if(df, "id", "w", ("go",)).first().what_if] == [(63, "JS"), (63, "JavaScript"), (25, "TypeScript"), (25, "Rust")]


def test_tier(value):
    assert value(X.company_tier(L("Google, Inc"))) == "BIG_TECH"
    assert value(X.company_tier(L("Googley"))) == "UNKNOWN"
