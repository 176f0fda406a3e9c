"""Career-page extraction: HTML to scored job candidates (SRC-16, TXT-20..24).

A page becomes rows by exploding regex matches; every test is a column expression, so no
page leaves the JVM.  Boundaries of words are those of ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import short_id

L = F.lit

# Patterns of the extractor.
ROLE = r"(?i)\b(engineer|developer|sde|programmer|architect|analyst|designer|qa|tester|devops|sre|administrator|consultant|specialist|scientist|technician|lead|manager|intern|trainee|associate|executive|recruiter|full.?stack|back.?end|front.?end)\b"
NEGATIVE = r"(?i)\b(certified|certification|certificate|exam|training|course|bootcamp|webinar|workshop|executive search|staff augmentation|\brpo\b|recruitment process|outsourc|consulting|advisory|case study|white ?paper|\bblog\b|about us|about|contact|privacy|cookie|partner|resources?|newsletter|ebook|guide|demo|pricing|login|log in|sign ?up|register|read more|learn more|view all|see all|apply now|home|careers?|jobs?|our team|culture|benefits|life at|why join)\b"
CITY = r"(?i)\b(bengaluru|bangalore|mumbai|pune|hyderabad|chennai|delhi|noida|gurgaon|gurugram|indore|kolkata|ahmedabad|jaipur|kochi|coimbatore|chandigarh|remote|hybrid)\b"
EXPERIENCE = r"(?i)\b\d{1,2}\s*[-–to]{1,3}\s*\d{1,2}\s*(?:\+?\s*)?(?:years?|yrs?)\b"
EMPLOYMENT = r"(?i)\b(full[\s-]?time|part[\s-]?time|contract|permanent|internship|freelance)\b"
DEPARTMENT = r"(?i)\b(engineering|technology|product|design|data|infrastructure|platform|backend|frontend|devops|qa)\b"
SALARY = r"(?i)(₹|\bINR\b|\bLPA\b|\$\s?\d|\d\s?(?:lpa|lakhs?))"
JOB_URL = r"(?i)(job|career|position|opening|vacanc|apply|requisition|/jd|/p/|posting)"
SPA = r"(?i)id=[\"'](root|__next|app|application)[\"']|__NEXT_DATA__|data-reactroot|ng-app|window\.__NUXT__|data-server-rendered"
LIST_ITEM = r"(?is)<(li|tr)\b[^>]*>(.*?)</\1>"
ANCHOR = r"(?is)<a\b[^>]*href=[\"']([^\"'#]+)[\"'][^>]*>(.*?)</a>"
HREF = r"(?i)href=[\"']([^\"'#]+)[\"']"
SEGMENT = r"·|—|\||,|\s{2,}"
UNSEEN, COMMENT = r"<(script|style|svg)\b.*?</\1>", "<!--.*?-->"
TAG, ENTITY = "<[^>]+>", r"&#?\w+;"
KNOWN_ENTITIES = {"&nbsp;": " ", "&amp;": "&"}
# A page with a script's marker, fewer links and less text than these is rendered by script.
SHELL_LINKS, SHELL_TEXT = 8, 1500

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    r"""A pattern whose ``\b`` are edges of ASCII words; the engine's own also see letters beyond ASCII."""
    return pattern.replace(r"\b", _EDGE)


def preprocess(html: Column) -> Column:
    """A page without what no reader sees."""
    return F.regexp_replace(html, f"(?is){UNSEEN}|{COMMENT}", " ")


def clean(fragment: Column) -> Column:
    """Text of a piece of HTML in one line; entities but the commonest are blanks."""
    text = F.regexp_replace(fragment, TAG, " ")
    for entity, character in KNOWN_ENTITIES.items():
        text = F.replace(text, L(entity), L(character))
    return F.trim(F.regexp_replace(text, rf"(?:{ENTITY}|\s)+", " "))


def looks_rendered_by_script(html: Column) -> Column:
    seen = {"links": F.regexp_count(html, L(r"(?i)<a\b")), "text": F.length(clean(F.regexp_replace(html, f"(?is){UNSEEN}", " ")))}
    return html.rlike(SPA) & (seen["links"] < SHELL_LINKS) & (seen["text"] < SHELL_TEXT)


def absolute(href: Column, base: Column) -> Column:
    """href against the page's URL."""
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(
        F.concat(F.coalesce(F.nullif(F.regexp_extract(base, r"^(https?://[^?#]*/)", 1), L("")), F.concat(root, L("/"))), href))


def candidates(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, title, href, context of every list item or row, then of every link."""
    p = pages.select("page_id", "url", preprocess(F.col("html")).alias("__h"))
    items = p.select("page_id", "url", F.posexplode(F.regexp_extract_all("__h", L(LIST_ITEM), L(2))).alias("pos", "inner"))
    text = clean(F.col("inner"))
    first = F.trim(F.get(F.split(text, SEGMENT), 0))
    items = items.select("page_id", "url", F.col("pos").cast("long").alias("pos"), F.coalesce(F.nullif(first, L("")), text).alias("title"), F.nullif(F.regexp_extract("inner", HREF, 1), L("")).alias("href"), text.alias("context"))
    links = p.select("page_id", "url", F.posexplode(F.arrays_zip(F.regexp_extract_all("__h", L(ANCHOR), L(1)).alias("h"), F.regexp_extract_all("__h", L(ANCHOR), L(2)).alias("t"))).alias("pos", "z"))
    links = links.select("page_id", "url", (F.col("pos") + L(1 << 32)).alias("pos"), clean(F.col("z.t")).alias("title"), F.col("z.h").alias("href"), clean(F.col("z.t")).alias("context"))
    return items.unionByName(links).where("title <> ''")


def classified(found: DataFrame) -> DataFrame:
    """Candidates with job_url, location, evidence, score and reject (null if accepted)."""
    words = F.size(F.split("title", r"\s+"))
    url = F.when(F.col("href").isNotNull(), absolute(F.col("href"), F.col("url")))
    c = found.withColumn("job_url", url).withColumn("location", F.nullif(F.regexp_extract("context", ascii_words(CITY), 0), L("")))
    signs = [
        ("job-url", F.coalesce(F.col("job_url").rlike(JOB_URL), L(False)), 25),
        ("link", F.col("job_url").isNotNull() & ~F.coalesce(F.col("job_url").rlike(JOB_URL), L(False)), 8),
        ("location", F.col("location").isNotNull(), 12),
        ("experience", F.col("context").rlike(ascii_words(EXPERIENCE)), 10),
        ("employment-type", F.col("context").rlike(ascii_words(EMPLOYMENT)), 8),
        ("department", F.col("context").rlike(ascii_words(DEPARTMENT)), 6),
        ("salary", F.col("context").rlike(ascii_words(SALARY)), 8),
    ]
    evidence = F.array_compact(F.array(L("title"), *[F.when(cond, L(n)) for n, cond, _ in signs]))
    score = L(45)
    for _, cond, points in signs:
        score = score + F.when(cond, points).otherwise(0)
    c = c.withColumn("evidence", evidence).withColumn("score", F.least(L(100), score))
    reject = (
        F.when((words < 2) | (words > 9) | (F.length("title") < 4) | (F.length("title") > 90), "bad-length").when(F.col("title").rlike(ascii_words(NEGATIVE)), "negative-signal")
        .when(~F.col("title").rlike(ascii_words(ROLE)), "no-role").when(F.size("evidence") < 2, "insufficient-evidence")
    )
    c = c.withColumn("reject", reject)
    # a title that was accepted earlier on the page is a duplicate
    nth = F.row_number().over(Window.partitionBy("page_id", F.lower("title"), F.col("reject").isNull()).orderBy("pos"))
    return c.withColumn("reject", F.when(F.col("reject").isNull() & (nth > 1), "duplicate-title").otherwise(F.col("reject")))


def extract(pages: DataFrame, threshold: int = 70) -> tuple[DataFrame, DataFrame]:
    """(jobs, summary per page): accepted jobs with ids; confidence, counts of jobs and of what was rejected, and why."""
    c = classified(candidates(pages))
    strong = F.col("reject").isNull() & (F.col("score") >= threshold) & F.col("job_url").isNotNull()
    why = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reject").isNotNull(), F.struct("reject", "n")))))
    counted = c.groupBy("page_id", "reject").agg(F.count(L(1)).alias("n"), F.count_if(strong).alias("strong"), F.sum("score").alias("points"))
    accepted = F.col("reject").isNull()
    per = counted.groupBy("page_id").agg(
        F.sum(F.when(accepted, F.col("n"))).alias("jobs"), F.sum("strong").alias("strong"), F.sum(F.when(accepted, F.col("points"))).alias("points"), F.sum(F.when(~accepted, F.col("n"))).alias("rejected"), why.alias("rejections"))
    none = L(0).cast("long")
    mean = F.when(F.col("jobs") > 0, F.floor(F.col("points") / F.col("jobs") + 0.5)).otherwise(0)
    confidence = F.when(F.col("strong") >= 3, F.least(L(95), 60 + F.col("strong"))).when(F.col("strong") >= 1, 55).otherwise(F.least(L(45), mean))
    summary = pages.select("page_id", looks_rendered_by_script(F.col("html")).alias("needs_render")).join(per, "page_id", "left")
    summary = summary.select("page_id", "needs_render", *[F.coalesce(x, none).alias(x) for x in ("jobs", "strong", "rejected")], F.coalesce(confidence, none).cast("long").alias("confidence"), F.coalesce("rejections", F.create_map().cast("map<string,bigint>")).alias("rejections"))
    jobs = c.where("reject is null").select("page_id", "title", "job_url", "location", "score", "evidence", short_id(F.coalesce("job_url", "title")).alias("external_id"),
        F.when(F.col("location").isNotNull() & ~F.lower("location").isin("remote", "hybrid"), "IN").alias("country"), F.when(F.lower("location") == "remote", "REMOTE").alias("work_mode"))
    return jobs, summary


def board_jobs(pages: DataFrame, company: Column, threshold: int = 70) -> DataFrame:
    """Postings that a page may hand on: strong, with a web address, under the name of their company, with a description."""
    jobs = extract(pages, threshold)[0].where((F.col("score") >= threshold) & F.col("job_url").rlike("(?i)^https?://"))
    named = jobs.join(pages.select("page_id", company.alias("company")), "page_id").where("company <> ''")
    place = F.when(F.col("location").isNotNull(), F.concat(L(" · "), F.col("location"))).otherwise("")
    return named.withColumn("description", F.concat("title", place, L(" — via "), "company", L(" careers page.")))
