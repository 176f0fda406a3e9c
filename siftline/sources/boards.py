"""Job-board payloads to normalised postings (SRC-1..11, 13, 14).

Input: JSON lines, one posting each, with the board's tenant in ``tenant``; the schema of
each board is declared, so unknown fields are skipped and a missing one is null.  Output:
``POSTING`` columns.  Rows without an id, title or url go to quarantine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import cap_text, decode_entities, html_to_text, work_mode
from siftline.operators.keyed import top_per_key

L = F.lit
POSTING = ("external_id", "company", "title", "description", "url", "location", "country", "work_mode", "salary_min", "salary_max", "currency", "posted_at", "source")
# Titles that aggregators may deliver, and what makes a thread comment relevant.
DEV_ROLE = r"(?i)engineer|developer|programmer|\bsde\b|full.?stack|back.?end|front.?end|software|\bmern\b"
THREAD_ROLE = r"(?i)engineer|developer|\bsde\b|programmer|full.?stack|back.?end|front.?end|software|architect"
INDIA = r"(?i)india|bangalore|bengaluru|mumbai|pune|hyderabad|delhi|gurgaon|gurugram|noida|chennai"
WORLDWIDE = r"(?i)remote\s*\(?\s*(worldwide|anywhere|global)|worldwide|(fully|100%)\s*remote|remote,?\s*(worldwide|anywhere)"
REGION_LOCKED = r"(?i)\bus[\s-]?only|usa[\s-]?only|u\.s\.?[\s-]?only|\bus[- ]based|must be (located |based )?in the (us|usa|united states|uk|eu)|us citizen|us work authoriz|authoriz\w* to work in the (us|uk|eu)|remote\s*\(?\s*(us|usa|united states|eu|europe|uk|canada|north america|americas|us/canada|us & canada|us, canada)|(us|eu|uk|canada|europe|north america)[\s-]?(only|based|remote)|est timezone|pst timezone|within the (us|uk|eu)"
NO_COMPANY = (r"(?i)^https?:", r"(?i)\$|\d{2,3}\s?k\b|\d{2,3}[-–]\d{2,3}\s?k|salary|equity|benefits", r"(?i)^(remote|onsite|hybrid|full.?time|part.?time|contract|intern)", r"^[A-Za-z .]+,\s*[A-Z]{2}$")


def _one_line(text: Column) -> Column:
    t = F.regexp_replace(text, "<[^>]+>", " ")
    for name, ch in (("&amp;", "&"), ("&nbsp;", " "), ("&#39;", "'"), ("&#x27;", "'"), ("&quot;", '"')):
        t = F.replace(t, L(name), L(ch))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _joined(*parts: Column) -> Column:
    """Non-empty parts with a blank line between them."""
    return F.array_join(F.filter(F.array(*[F.coalesce(p, L("")) for p in parts]), lambda p: p != ""), "\n\n")


def _time(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, " UTC$", "Z"), r"^(\d{4}-\d\d-\d\d) (\d\d:)", "$1T$2"))


def _modes(*cases: tuple[Column, str]) -> Column:
    out = None
    for cond, mode in cases:
        out = F.when(cond, mode) if out is None else out.when(cond, mode)
    return out


@dataclass(frozen=True)
class Board:
    schema: str
    fields: Callable[[], dict[str, Column]]
    keep: Callable[[], Column] | None = None


def _c(name: str) -> Column:
    return F.col(name)


def _text(name: str) -> Column:
    return html_to_text(F.coalesce(_c(name), L("")))


BOARDS: dict[str, Board] = {
    "greenhouse": Board(
        "tenant string, id long, title string, absolute_url string, updated_at string, first_published string, location struct<name: string>, content string",
        lambda: {"external_id": _c("id"), "title": _c("title"), "description": html_to_text(decode_entities(F.coalesce(_c("content"), L("")))), "url": _c("absolute_url"), "location": _c("location.name"),
                 "work_mode": work_mode(_c("location.name")), "posted_at": _time(F.coalesce("first_published", "updated_at"))}),
    "lever": Board(
        "tenant string, id string, text string, hostedUrl string, createdAt long, country string, workplaceType string, descriptionPlain string, categories struct<location: string>, salaryRange struct<min: double, max: double, currency: string>",
        lambda: {"external_id": _c("id"), "title": _c("text"), "description": _c("descriptionPlain"), "url": _c("hostedUrl"), "location": _c("categories.location"), "country": _c("country"),
                 "work_mode": F.coalesce(_modes((_c("workplaceType") == "remote", "REMOTE"), (_c("workplaceType") == "hybrid", "HYBRID"), (_c("workplaceType") == "on-site", "ONSITE")), work_mode(_c("categories.location"))),
                 "salary_min": _c("salaryRange.min"), "salary_max": _c("salaryRange.max"), "currency": _c("salaryRange.currency"), "posted_at": F.timestamp_millis(_c("createdAt"))}),
    "ashby": Board(
        "tenant string, id string, title string, jobUrl string, location string, isRemote boolean, isListed boolean, publishedAt string, descriptionPlain string, compensation struct<compensationTierSummary: string>",
        lambda: {"external_id": _c("id"), "title": _c("title"), "description": _joined(_c("descriptionPlain"), _c("compensation.compensationTierSummary")), "url": _c("jobUrl"), "location": _c("location"),
                 "work_mode": F.when(_c("isRemote"), "REMOTE"), "posted_at": _time(_c("publishedAt"))},
        lambda: F.coalesce(_c("isListed"), L(True))),
    "workable": Board(
        "tenant string, shortcode string, title string, description string, url string, published_on string, location struct<city: string, country: string, telecommuting: boolean>, locations array<struct<city: string, country: string>>, remote boolean",
        lambda: {"external_id": _c("shortcode"), "title": _c("title"), "description": _text("description"), "url": F.coalesce(_c("url"), F.format_string("https://apply.workable.com/%s/j/%s/", "tenant", "shortcode")),
                 "location": F.when(_c("location").isNotNull(), _c("location.city")).otherwise(F.get("locations", 0)["city"]), "country": F.when(_c("location").isNotNull(), _c("location.country")).otherwise(F.get("locations", 0)["country"]),
                 "work_mode": F.when(_c("remote") | _c("location.telecommuting"), "REMOTE").otherwise(work_mode(F.coalesce("location.city", F.get("locations", 0)["city"]))), "posted_at": _time(_c("published_on"))}),
    "smartrecruiters": Board(
        "tenant string, id string, name string, releasedDate string, applyUrl string, location struct<city: string, country: string, remote: boolean, hybrid: boolean>, sections map<string, struct<title: string, text: string>>",
        lambda: {"external_id": _c("id"), "title": _c("name"), "description": F.trim(F.array_join(F.transform(F.map_values(F.coalesce("sections", F.from_json(L("{}"), "map<string, struct<title: string, text: string>>"))), lambda s: F.concat(F.coalesce(s["title"], L("")), L("\n"), html_to_text(F.coalesce(s["text"], L(""))))), "\n\n")),
                 "url": F.coalesce(_c("applyUrl"), F.format_string("https://jobs.smartrecruiters.com/%s/%s", "tenant", "id")), "location": _c("location.city"), "country": F.upper("location.country"),
                 "work_mode": _modes((_c("location.remote"), "REMOTE"), (_c("location.hybrid"), "HYBRID")), "posted_at": _time(_c("releasedDate"))}),
    "recruitee": Board(
        "tenant string, id long, title string, description string, requirements string, careers_url string, location string, country string, remote boolean, hybrid boolean, on_site boolean, created_at string, status string",
        lambda: {"external_id": _c("id"), "title": _c("title"), "description": _joined(_text("description"), _text("requirements")), "url": F.coalesce(_c("careers_url"), F.format_string("https://%s.recruitee.com/o/%d", "tenant", "id")),
                 "location": _c("location"), "country": _c("country"), "work_mode": F.coalesce(_modes((_c("remote"), "REMOTE"), (_c("hybrid"), "HYBRID"), (_c("on_site"), "ONSITE")), work_mode(_c("location"))), "posted_at": _time(_c("created_at"))},
        lambda: F.coalesce(_c("status") != "closed", L(True))),
    "breezy": Board(
        "tenant string, id string, friendly_id string, name string, description string, url string, published_date string, location struct<name: string, city: string, country: struct<name: string, id: string>, is_remote: boolean>",
        lambda: {"external_id": _c("id"), "title": _c("name"), "description": _text("description"), "url": F.coalesce(_c("url"), F.format_string("https://%s.breezy.hr/p/%s", F.col("tenant"), F.coalesce("friendly_id", "id"))),
                 "location": F.coalesce("location.name", "location.city"), "country": _c("location.country.id"), "work_mode": F.when(_c("location.is_remote"), "REMOTE").otherwise(work_mode(_c("location.name"))), "posted_at": _time(_c("published_date"))}),
    "keka": Board(
        "tenant string, id long, title string, description string, jobLocations array<struct<name: string, city: string, countryCode: string>>, publishedOn string",
        lambda: {"external_id": _c("id"), "title": _c("title"), "description": _text("description"), "url": F.format_string("https://%s.keka.com/careers/jobdetails/%d", "tenant", "id"),
                 "location": F.coalesce(F.get("jobLocations", 0)["name"], F.get("jobLocations", 0)["city"]), "country": F.get("jobLocations", 0)["countryCode"],
                 "work_mode": work_mode(F.concat_ws(" ", "title", F.coalesce(F.get("jobLocations", 0)["name"], F.get("jobLocations", 0)["city"], L("")))), "posted_at": _time(_c("publishedOn"))}),
    "remoteok": Board(
        "tenant string, id string, slug string, company string, position string, description string, location string, salary_min double, salary_max double, url string, apply_url string, date string",
        lambda: {"external_id": F.concat(L("remoteok-"), "id"), "company": decode_entities(_c("company")), "title": decode_entities(_c("position")), "description": _text("description"),
                 "url": F.when(F.try_parse_url("url", L("HOST")).isNotNull(), _c("url")).otherwise(F.concat(L("https://remoteok.com/remote-jobs/"), F.coalesce("slug", "id"))), "location": F.coalesce(F.nullif("location", L("")), L("Remote")), "work_mode": L("REMOTE"),
                 "salary_min": F.nullif("salary_min", L(0.0)), "salary_max": F.nullif("salary_max", L(0.0)), "currency": F.when(_c("salary_min") > 0, "USD"), "posted_at": _time(_c("date"))},
        lambda: _c("id").isNotNull() & _c("position").isNotNull() & _c("company").isNotNull()),
    "adzuna": Board(
        "tenant string, id string, title string, description string, redirect_url string, created string, company struct<display_name: string>, location struct<display_name: string>, salary_min double, salary_max double",
        lambda: {"external_id": F.concat(L("adzuna-"), "id"), "company": F.trim("company.display_name"), "title": _one_line(_c("title")), "description": _one_line(F.coalesce("description", L(""))), "url": F.coalesce("redirect_url", F.concat(L("https://www.adzuna.in/details/"), "id")),
                 "location": _c("location.display_name"), "country": L("IN"), "work_mode": work_mode(F.concat_ws(" ", _one_line(_c("title")), F.coalesce("location.display_name", L("")))), "salary_min": F.floor(F.nullif("salary_min", L(0.0)) + 0.5), "salary_max": F.floor(F.nullif("salary_max", L(0.0)) + 0.5),
                 "currency": F.when(_c("salary_min") > 0, "INR"), "posted_at": _time(_c("created"))},
        lambda: _c("id").isNotNull() & (F.trim("company.display_name") != "") & _one_line(_c("title")).rlike(DEV_ROLE)),
    "jooble": Board(
        "tenant string, id string, title string, snippet string, link string, company string, location string, updated string",
        lambda: {"external_id": F.concat(L("jooble-"), F.coalesce("id", "link")), "company": F.trim("company"), "title": _one_line(_c("title")), "description": _one_line(F.coalesce("snippet", L(""))), "url": _c("link"), "location": _c("location"), "country": L("IN"),
                 "work_mode": work_mode(F.concat_ws(" ", _one_line(_c("title")), F.coalesce("location", L("")))), "posted_at": _time(_c("updated"))},
        lambda: (F.trim("company") != "") & F.try_parse_url("link", L("HOST")).isNotNull() & _one_line(_c("title")).rlike(DEV_ROLE)),
}
#: Boards that list other companies' postings: the first row of an id wins, and nothing is ever removed for them.
AGGREGATORS = ("remoteok", "adzuna", "jooble", "hn")


def read_board(spark: SparkSession, board: str, path: str) -> DataFrame:
    """Raw postings of a board from JSON lines, by its declared schema."""
    return spark.read.schema(BOARDS[board].schema).json(path)


def normalize(raw: DataFrame, board: str) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantine) of a board's raw rows."""
    spec = BOARDS[board]
    kept = raw.where(spec.keep()) if spec.keep else raw
    f = {"company": F.col("tenant")} | spec.fields()
    types = {"salary_min": "long", "salary_max": "long", "posted_at": "timestamp"}
    f["description"] = cap_text(F.coalesce(f.get("description", L("")), L("")))
    out = kept.select(*[(f[c] if c in f else L(board) if c == "source" else L(None)).cast(types.get(c, "string")).alias(c) for c in POSTING], F.monotonically_increasing_id().alias("__pos"))
    ok = (F.coalesce("external_id", L("")) != "") & (F.coalesce("title", L("")) != "") & F.try_parse_url("url", L("HOST")).isNotNull()
    good = out.where(ok)
    if board in AGGREGATORS:
        good = top_per_key(good, ["external_id"], ["__pos"])
    return good.drop("__pos"), out.where(~F.coalesce(ok, L(False))).drop("__pos")


# Places of a thread's header, the shapes of its links and loose ends, entities of its texts, and lengths that a posting has.
ANYWHERE = r"(?i)remote|worldwide|anywhere"
THREAD_LINK, LINK_END, THREAD_HOST = r"(?i)https?://[^\s)|]+", "[.,]$", "news.ycombinator.com"
OPEN_BRACKET, LOOSE_ENDS = r"\s*\([^)]*$", r"^\W+|\W+$"
COMMENT_ANCHOR, PARAGRAPH = r"(?is)<a[^>]*href=\"([^\"]+)\"[^>]*>.*?</a>", "<p>|\n"
COMMENT_ENTITIES = {"&amp;": "&", "&#x2F;": "/", "&gt;": ">", "&lt;": "<", "&quot;": '"', "&#39;": "'", "&#x27;": "'"}
LEAST_COMMENT, MOST_COMPANY, MOST_TITLE, PLACE_NAME = 60, 60, 160, 30


def _comment_text(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, COMMENT_ANCHOR, " $1 "), "<[^>]+>", " ")
    for entity, character in COMMENT_ENTITIES.items():
        bare = F.replace(bare, L(entity), L(character))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def thread_tests(comments: DataFrame) -> DataFrame:
    """Hiring-thread comments (id, text) as text, segments (text, role, place), company, title, link, and ``failed``, the names of the tests that a comment fails.

    A header's segments are told apart once by what they hold; company, title and place are
    then picks among them, and the tests are a table of named conditions.
    """
    tidy = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, OPEN_BRACKET, ""), LOOSE_ENDS, ""))
    segment = lambda s: F.struct(F.trim(s).alias("text"), s.rlike(THREAD_ROLE).alias("role"), (s.rlike(ANYWHERE) | s.rlike(INDIA)).alias("place"))
    head = _comment_text(F.get(F.split("text", PARAGRAPH), 0))
    c = comments.select("id", F.filter(F.transform(F.split(head, r"\|"), segment), lambda s: s["text"] != "").alias("segments"), _comment_text(F.col("text")).alias("text"))
    role = F.get(F.filter("segments", lambda s, n: (n > 0) & s["role"]), 0)["text"]
    c = c.withColumns({
        "company": F.left(tidy(F.get("segments", 0)["text"]), L(MOST_COMPANY)), "title": F.left(tidy(role), L(MOST_TITLE)),
        "link": F.nullif(F.regexp_replace(F.regexp_extract("text", THREAD_LINK, 0), LINK_END, ""), L(""))})
    company = F.col("company")
    tests = {
        "short": F.length("text") >= LEAST_COMMENT, "no role": F.col("text").rlike(THREAD_ROLE), "closed region": ~F.col("text").rlike(REGION_LOCKED), "no place": F.col("text").rlike(WORLDWIDE) | F.col("text").rlike(INDIA),
        "no header": F.size("segments") >= 2, "no title": F.col("title").isNotNull(), "no company": F.length(company).between(2, MOST_COMPANY), "place as company": ~(company.rlike(ANYWHERE) & (F.length(company) < PLACE_NAME)),
    } | {f"no company {n}": ~company.rlike(p) for n, p in enumerate(NO_COMPANY)}
    return c.withColumn("failed", F.array_compact(F.array(*[F.when(~F.coalesce(ok, L(False)), L(name)) for name, ok in tests.items()])))


def thread_postings(comments: DataFrame) -> DataFrame:
    """Hiring-thread comments (id, text) to postings; a comment that fails a test gives no row."""
    good = thread_tests(comments).where(F.size("failed") == 0)
    key, outside = F.col("id").cast("string"), F.when(~F.col("link").contains(THREAD_HOST), F.col("link"))
    found = {
        "source": L("hn"), "external_id": F.concat(L("hn-"), key), "company": F.col("company"), "title": F.col("title"), "description": cap_text(F.col("text")), "url": F.coalesce(outside, F.concat(L(f"https://{THREAD_HOST}/item?id="), key)),
        "location": F.get(F.filter("segments", lambda s: s["place"]), 0)["text"], "country": F.when(F.col("text").rlike(INDIA), "IN"), "work_mode": F.when(F.col("text").rlike(ANYWHERE), "REMOTE"),
    }
    types = {"salary_min": "long", "salary_max": "long", "posted_at": "timestamp"}
    return good.select(*[found.get(n, L(None)).cast(types.get(n, "string")).alias(n) for n in POSTING])


def directory_companies(raw: DataFrame) -> DataFrame:
    """Directory rows (name, website, isHiring, status, regions array, all_locations) to companies to seed."""
    kept = raw.where("isHiring and website is not null and website <> '' and coalesce(status, '') <> 'Inactive'")
    city = F.nullif(F.trim(F.get(F.split(F.get(F.split("all_locations", ";"), 0), ","), 0)), L(""))
    return kept.select("name", "website", F.get("regions", 0).alias("region"), city.alias("city"))


def swept_places(raw: DataFrame) -> DataFrame:
    """Places rows (pos, name, website): the first of a name, case aside, with a website."""
    return top_per_key(raw.withColumn("__n", F.lower("name")), ["__n"], ["pos"]).where("website is not null and website <> ''").drop("__n")


ORG_ID = r"(?i)/ats/documents/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})/"


def keka_org_id(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, ORG_ID, 1), L(""))


def public_people(members: DataFrame, contributors: DataFrame, most: int = 30) -> DataFrame:
    """login, public_member, contributions, repos: members joined with contributors' sums over repositories."""
    m = members.select("login").distinct().withColumn("public_member", L(True))
    c = contributors.groupBy("login").agg(F.sum("contributions").alias("contributions"), F.array_sort(F.collect_set("repo")).alias("repos"))
    both = m.join(c, "login", "full_outer")
    none = F.array().cast("array<string>")
    return both.select("login", F.coalesce("public_member", L(False)).alias("public_member"), F.coalesce("contributions", L(0)).alias("contributions"), F.coalesce("repos", none).alias("repos")).orderBy(F.desc("public_member"), F.desc("contributions"), "login").limit(most)
