"""Resume, outreach and application functions: audits, gates, causes, picks (SCO-23, 25, 27, 29..31, 33; SET-4..8; TXT-12, 18, 19, 26, 28, 30, 33)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from siftline.functions import tech
from siftline.functions.common import js_round, once
from siftline.operators import phrases

L = F.lit

# Word lists and patterns of the document checks.
COMMON_WORDS = ("the", "and", "with", "for", "using", "experience", "developer", "engineer", "built", "management")
HEADINGS = ("SUMMARY", "SKILLS", "EXPERIENCE", "PROJECTS", "EDUCATION", "ACHIEVEMENTS")
STRONG_VERBS = r"(?i)^(built|led|owned|designed|architected|shipped|scaled|launched|delivered|improved|reduced|increased|drove|created|developed|implemented|engineered|automated|optimi[sz]ed|migrated|integrated|deployed|managed|mentored|spearheaded|streamlined|refactored|established)\b"
FILLER = r"(?i)\b(directly relevant to|well[- ]suited|perfectly aligned|proven track record|team player|hard[- ]?working|results[- ]driven|go[- ]getter|synergy|detail[- ]oriented|responsible for|self[- ]starter|think outside the box|hit the ground running|dynamic professional)\b"
METRIC = r"(?i)\b\d{1,3}(?:,\d{3})+\b|\b\d+%|\b\d+x\b|\b\d+\+|\b\d{3,}\b|\$\s?\d+|\b\d+\s?(?:years?|yrs?|months?)\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
STOPWORDS = ("the", "and", "with", "for", "using", "from", "that", "this", "into", "are", "was", "were", "has", "have", "our", "their", "its", "via", "per", "not", "but", "all")
WORD = "A-Za-z0-9+#._-"
LINE = "[^\\n]*"


# --- readability (SCO-29) ------------------------------------------------------------


def readability(text: Column) -> Column:
    """struct(score, verdict, letter_ratio): six checks; little or garbled text is UNREADABLE."""
    t = F.coalesce(text, L(""))
    letters = F.length(t) - F.length(F.regexp_replace(t, "[A-Za-z]", ""))
    printable = F.length(F.regexp_replace(t, r"\s", ""))
    ratio = F.when(printable > 0, letters / F.greatest(printable, L(1))).otherwise(0.0)
    common = sum((F.lower(t).contains(w).cast("int") for w in COMMON_WORDS), L(0))
    lines = F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.upper(F.trim(x)), "[^A-Z& ]", "")))
    heads = lambda h: F.transform(lines, lambda x: x.isin(h, f"WORK {h}", f"PROFESSIONAL {h}", f"TECHNICAL {h}"))
    where = [F.array_position(heads(h), True) for h in HEADINGS]
    found = F.filter(F.array(*where), lambda p: p > 0)
    ordered = F.size(found) == F.size(F.array_distinct(found))
    ordered = ordered & (F.array_sort(found) == found)
    contact = t.rlike(r"[\w.+-]+@[\w-]+\.[\w.]+") & (t.rlike(r"\+?\d[\d\s-]{8,}") | t.rlike("(?i)linkedin|github"))
    checks = [printable >= 200, ratio >= 0.7, common >= 5, F.size(found) >= 3, (F.size(found) >= 2) & ordered, contact]
    score = js_round(sum((c.cast("int") for c in checks), L(0)) / 6 * 100)
    verdict = F.when((ratio < 0.5) | (printable < 200), "UNREADABLE").when(score < 100, "RISKY").otherwise("SAFE")
    return F.struct(score.cast("int").alias("score"), verdict.alias("verdict"), F.round(ratio, 3).alias("letter_ratio"))


# --- quality gate (SCO-30, SET-5) ------------------------------------------------------


def metrics(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, L(METRIC), L(0)), lambda m: F.regexp_replace(F.lower(m), r"[\s,]", "")))


def bullets(html: Column) -> Column:
    items = F.regexp_extract_all(html, L(r"(?is)<li[^>]*>(.*?)</li>"), L(1))
    return F.transform(items, lambda b: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(b, "<[^>]+>", " "), "(?i)&[a-z#0-9]+;", " "), r"\s+", " ")))


def _repeats(items: Column) -> Column:
    """How many values occur more than once."""
    return F.size(F.filter(F.array_distinct(items), lambda x: F.size(F.filter(items, lambda y: y == x)) > 1))


def quality_gate(master: Column, tailored: Column, html: Column) -> Column:
    """struct(score, verdict, failed): eight checks; an invented number fails the gate."""
    invented = F.size(F.array_except(metrics(tailored), metrics(master)))
    risks = html.rlike(r"(?i)<table[\s>]") | html.rlike(r"(?i)<img[\s>]") | html.rlike(r"(?i)column-count|columns\s*:|display\s*:\s*flex|float\s*:")
    fillers = F.size(F.array_distinct(F.transform(F.regexp_extract_all(tailored, L(FILLER), L(0)), lambda x: F.lower(x))))
    items = bullets(html)
    n = F.size(items)
    long_ = F.size(F.filter(items, lambda b: F.size(F.split(b, r"\s+")) > 45))
    weak = F.size(F.filter(items, lambda b: (b != "") & ~b.rlike(STRONG_VERBS)))
    dups = _repeats(F.filter(F.transform(items, lambda b: F.left(F.regexp_replace(F.lower(b), "[^a-z0-9]", ""), L(60))), lambda b: b != ""))
    words = F.filter(F.regexp_extract_all(F.lower(tailored), L("[a-z][a-z0-9.+#-]{2,}"), L(0)), lambda w: ~w.isin(*STOPWORDS))
    stuffed = F.exists(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda v: v == w)) >= 9)
    found = [
        ("metrics", invented > 0, L(30)), ("format", risks, L(15)), ("filler", fillers > 0, F.least(L(12), fillers * 3)), ("long", long_ > 0, F.least(L(10), long_ * 2)),
        ("verbs", weak > F.greatest(L(1.0), n * 0.4), L(8)), ("duplicates", dups > 0, F.least(L(12), dups * 4)), ("stuffing", stuffed, L(8)), ("contact", ~tailored.rlike(EMAIL), L(10)),
    ]
    score = L(100)
    for _, bad, points in found:
        score = score - F.when(bad, points).otherwise(0)
    score = F.greatest(L(0), score)
    failed = F.array_compact(F.array(*[F.when(bad, L(name)) for name, bad, _ in found]))
    verdict = F.when(invented > 0, "FIX").when(score >= 85, "SEND").otherwise("REVIEW")
    return F.struct(score.alias("score"), verdict.alias("verdict"), failed.alias("failed"))


# --- keywords (SCO-27, TXT-12..14, SET-3, SET-4) ---------------------------------------


_SPELLINGS = sorted(tech.ALIASES, key=lambda a: -len(a))
_AUTOMATON = phrases.automaton(_SPELLINGS)


def _consumed(text: str | None) -> list[str]:
    """Canonical technologies printed in a text; longer spellings take their place before shorter ones are sought."""
    text = text or ""
    hits = [h for h in phrases.whole_hits(_AUTOMATON, _SPELLINGS, phrases.lower_in_place(text)) if _SPELLINGS[h[0]] not in tech.AMBIGUOUS or text[h[1] : h[2]] != text[h[1] : h[2]].lower()]
    return sorted({tech.ALIASES[_SPELLINGS[n]] for n, _, _ in phrases.longest_first(hits, range(len(_SPELLINGS)))})


@F.pandas_udf(ArrayType(StringType()))
def printed_technologies(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """An ordinary word that is also a technology counts only if it is not all lower case."""
    for s in texts:
        yield s.map(_consumed)


def dedupe_keywords(words: Column) -> Column:
    """Distinct without case; the first place is kept, the last spelling wins."""
    trimmed = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
    lower = F.array_distinct(F.transform(trimmed, lambda w: F.lower(w)))
    return F.transform(lower, lambda k: F.element_at(F.filter(trimmed, lambda w: F.lower(w) == k), -1))


def keyword_audit(df: DataFrame, id_col: str, required: str, preferred: str, text: str, skills: str) -> DataFrame:
    """id, list, pos, keyword, status, your_term: PRESENT, ACCEPTED_VARIANT, ADD_EXACT or MISSING for each keyword.

    Keywords are rows: their spellings are looked up by joins, and all of them are sought in
    the texts by one automaton.  your_term is the person's own first spelling of a variant.
    """
    base = once(df.select(F.col(id_col).alias("id"), F.col(skills).alias("skills"), F.col(required).alias("req"), F.col(preferred).alias("pref")), "skills", "req", "pref")
    base = once(base.select("id", "skills", dedupe_keywords(F.col("req")).alias("req"), dedupe_keywords(F.col("pref")).alias("pref")), "req", "pref")
    req_lower = F.transform("req", lambda w: F.lower(w))
    base = base.withColumn("pref", F.filter("pref", lambda w: ~F.array_contains(req_lower, F.lower(w))))
    asked = base.select("id", L("required").alias("list"), F.posexplode("req").alias("pos", "keyword")).unionAll(base.select("id", L("preferred").alias("list"), F.posexplode("pref").alias("pos", "keyword")))
    asked = asked.withColumn("phrase", F.lower("keyword"))
    mine = base.select("id", F.posexplode("skills").alias("p", "raw"))
    table = tech.canonical_table(asked.select(F.col("keyword").alias("raw")).unionAll(mine.select("raw")))
    own = mine.join(table, "raw").groupBy("id", "tech").agg(F.min_by("raw", "p").alias("term"))
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    literal = phrases.whole_phrases(texts, asked, "phrase").withColumn("literal", L(True))
    printed = texts.select("id", F.explode(printed_technologies("text")).alias("tech")).withColumn("printed", L(True))
    rows = asked.join(table.withColumnRenamed("raw", "keyword"), "keyword", "left").join(literal, ["id", "phrase"], "left").join(printed, ["id", "tech"], "left").join(own, ["id", "tech"], "left")
    a, b = (F.regexp_replace(F.lower(x), "[^a-z0-9]", "") for x in ("keyword", "term"))
    trivial = F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), L(False))
    status = F.when(F.col("literal"), "PRESENT").when(F.col("printed"), F.when(trivial, "ACCEPTED_VARIANT").otherwise("ADD_EXACT")).otherwise("MISSING")
    rows = rows.withColumn("status", status)
    return rows.select("id", "list", "pos", "keyword", "status", F.when(F.col("status").isin("ACCEPTED_VARIANT", "ADD_EXACT"), F.col("term")).alias("your_term"))


def required_match(audit: DataFrame) -> DataFrame:
    """id, pct of required keywords present or accepted; null without any."""
    ok = F.col("status").isin("PRESENT", "ACCEPTED_VARIANT")
    return audit.groupBy("id").agg(F.count_if(F.col("list") == "required").alias("n"), F.count_if((F.col("list") == "required") & ok).alias("k")).select("id", F.when(F.col("n") > 0, js_round(F.col("k") / F.greatest("n", L(1)) * 100)).alias("pct"))


def audience_scores(skills: Column, years: Column, highlights: Column, projects: Column) -> Column:
    """struct(recruiter, manager) from counts of what a reader looks for (SCO-31)."""
    n = F.size(highlights)
    quantified = F.size(F.filter(highlights, lambda b: b.rlike(r"\d")))
    owned = F.size(F.filter(highlights, lambda b: b.rlike("(?i)built|led|owned|designed|architect|shipped|scaled")))
    clamp = lambda c: F.greatest(L(0), F.least(L(100), js_round(c)))
    share = F.when(n > 0, js_round(quantified / F.greatest(n, L(1)) * 25)).otherwise(0)
    recruiter = 40 + F.when(F.size(skills) >= 6, 20).otherwise(F.size(skills) * 3) + F.when(years.isNotNull(), 15).otherwise(0) + share
    manager = 35 + F.when(projects >= 2, 25).otherwise(projects * 12) + F.least(L(25), owned * 5) + F.when(n >= 6, 15).otherwise(0)
    return F.struct(clamp(recruiter).alias("recruiter"), clamp(manager).alias("manager"))


# --- applications and outreach (SCO-23, SCO-25) ----------------------------------------


def _ranked(parts: list[tuple[str, Column, Column]], most: int) -> Column:
    """array<struct<factor, strength>> of what holds, strongest first, then as listed."""
    rows = F.array(*[F.when(F.coalesce(cond, L(False)), F.struct((-strength).alias("o"), L(n).alias("n"), L(name).alias("factor"), strength.alias("strength"))) for n, (name, cond, strength) in enumerate(parts)])
    kept = F.slice(F.array_sort(F.array_compact(rows)), 1, most)
    return F.transform(kept, lambda r: F.struct(r["factor"].alias("factor"), r["strength"].alias("strength")))


def likely_causes(minimum: Column, years: Column, missing: Column, referral: Column, age: Column, fit: Column) -> Column:
    return _ranked([
        ("EXPERIENCE_STRETCH", years < minimum, F.when(minimum - years >= 2, 4).otherwise(3)), ("MISSING_SKILLS", missing > 0, F.when(missing >= 3, 4).otherwise(3)), ("NO_REFERRAL", ~referral, L(3)),
        ("APPLIED_LATE", age >= 14, F.when(age >= 30, 3).otherwise(2)), ("PARTIAL_STACK", fit < 60, F.when(fit < 45, 3).otherwise(2))], 4)


def waiting_actions(referral: Column, tailored: Column, waited: Column, has_job: Column) -> Column:
    return _ranked([("FIND_REFERRAL", ~referral & has_job, L(5)), ("FOLLOW_UP", F.coalesce(waited, L(0)) >= 5, L(4)), ("TAILOR_RESUME", ~tailored & has_job, L(4)), ("APPLY_SIMILAR", L(True), L(3))], 4)


def funnel_insights(applied: Column, with_referral: Column, tailored: Column, interviews: Column) -> Column:
    """At most two; none below four applications."""
    n = F.greatest(applied, L(1))
    told = F.array_compact(F.array(F.when(js_round(with_referral / n * 100) < 34, L("FEW_REFERRALS")), F.when(js_round(tailored / n * 100) < 50, L("FEW_TAILORED")), F.when((interviews == 0) & (applied >= 8), L("NO_INTERVIEWS"))))
    return F.when(applied >= 4, F.slice(told, 1, 2)).otherwise(F.slice(told, 1, 0))


def contact_confidence(member: Column, role: Column, email: Column, site: Column, shared: Column, contributions: Column) -> Column:
    """struct(referral, response), each 1 to 5."""
    base = F.when(member, 4).otherwise(2)
    referral = F.when(role == "RECRUITER", 5).when(role == "HIRING_MANAGER", F.greatest(base, L(4))).otherwise(base)
    response = 2 + F.when(email, 2).when(site, 1).otherwise(0) + F.when(shared > 0, 1).otherwise(0) + F.when(contributions >= 20, 1).otherwise(0)
    return F.struct(referral.alias("referral"), F.least(L(5), response).alias("response"))


def contact_strategy(contacts: DataFrame) -> DataFrame:
    """company, primary, secondary, recruiter from (company, id, role, priority): the best, another of a different role if there is one, the best recruiter."""
    w = Window.partitionBy("company")
    ranked = contacts.withColumn("rn", F.row_number().over(w.orderBy(F.desc("priority"), "id")))
    ranked = ranked.withColumn("first_role", F.first("role").over(w.orderBy("rn")))
    other = F.when((F.col("rn") > 1), F.struct((F.col("role") == F.col("first_role")).alias("same"), "rn", "id"))
    return ranked.groupBy("company").agg(F.min_by("id", "rn").alias("primary"), F.min(other)["id"].alias("secondary"), F.min(F.when(F.col("role") == "RECRUITER", F.struct("rn", "id")))["id"].alias("recruiter"))


# --- classification input (SCO-33) -------------------------------------------------------

FUNCTIONS = ("SOFTWARE_ENGINEERING", "DATA_ENGINEERING", "DEVOPS_SRE", "QA_TEST_ENGINEERING", "PRODUCT_MANAGEMENT", "PROJECT_PROGRAM_MANAGEMENT", "BUSINESS_ANALYTICS", "DATA_ANALYTICS", "MARKETING_GROWTH", "IMPLEMENTATION_SERVICES", "CUSTOMER_SUPPORT", "SALES_PRE_SALES", "DESIGN", "OTHER", "AMBIGUOUS")
INTENSITIES = ("PRIMARY", "SUBSTANTIAL", "OCCASIONAL", "INCIDENTAL", "NONE")
SENIORITIES = ("INTERN", "JUNIOR", "MID", "SENIOR", "LEAD", "STAFF", "PRINCIPAL", "UNKNOWN")


def normalized_classification(function: Column, intensity: Column, seniority: Column, minimum: Column, skills: Column) -> Column:
    """Unknown values become AMBIGUOUS, NONE and UNKNOWN; years outside 0 to 30 null; at most 8 non-empty skills."""
    one_of = lambda c, allowed, default: F.when(F.upper(c).isin(*allowed), F.upper(c)).otherwise(default)
    return F.struct(one_of(function, FUNCTIONS, "AMBIGUOUS").alias("function"), one_of(intensity, INTENSITIES, "NONE").alias("intensity"), one_of(seniority, SENIORITIES, "UNKNOWN").alias("seniority"),
        F.when(minimum.between(0, 30), minimum).alias("minimum_years"), F.slice(F.filter(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.trim(s) != ""), 1, 8).alias("skills"))


# --- names, places, pages (TXT-18, TXT-19, TXT-26, TXT-28, TXT-33, SET-6, SET-8) -----------


def page_metadata(html: Column) -> Column:
    """struct(title, description, career_links)."""
    title = F.left(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), L(200))
    about = F.left(F.trim(F.regexp_extract(html, r"(?is)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']*)", 1)), L(500))
    links = F.filter(F.array_distinct(F.regexp_extract_all(html, L(r"(?i)href=[\"']([^\"'#]+)[\"']"), L(1))), lambda h: h.rlike("(?i)career|job|join|hiring|work-with|opening"))
    return F.struct(F.nullif(title, L("")).alias("title"), F.nullif(about, L("")).alias("description"), links.alias("career_links"))


# Names that are labels of teams or roles.
NOT_A_PERSON = r"(?i)^(the |our )?(team|staff|editor(ial)?|admin|guest|contributor|engineering|marketing|content|blog|company|community|newsroom|press|careers?|hr|people|talent)\b"
LABEL_WORD = r"(?i)(^|\s)(team|staff|editor(ial)?|admin|guest|bot|official|hq|inc|llc|blog|news|press|careers?|hr|marketing|engineering|content|community|labs)(\s|$)"
NAME_WORDS = r"^[A-Z][A-Za-z'.\-]+(\s+[A-Z][A-Za-z'.\-]+){1,2}$"


def author_names(html: Column, most: int = 8) -> Column:
    """Distinct person names from author metadata and bylines: two or three capitalised words, 4 to 40 characters, no label of a team."""
    raw = F.concat(F.regexp_extract_all(html, L(r"(?is)\"author\"\s*:\s*\{[^}]*?\"name\"\s*:\s*\"([^\"]+)\""), L(1)), F.regexp_extract_all(html, L(r"(?i)<meta[^>]+name=[\"']author[\"'][^>]+content=[\"']([^\"]+)"), L(1)), F.regexp_extract_all(html, L(r"(?i)rel=[\"']author[\"'][^>]*>([^<]+)<"), L(1)))
    named = F.filter(F.transform(raw, lambda n: F.trim(n)), lambda n: F.length(n).between(4, 40) & n.rlike(NAME_WORDS) & ~n.rlike(NOT_A_PERSON) & ~n.rlike(LABEL_WORD))
    lower = F.array_distinct(F.transform(named, lambda n: F.lower(n)))
    return F.slice(F.transform(lower, lambda k: F.get(F.filter(named, lambda n: F.lower(n) == k), 0)), 1, most)


def suggested_skills(parsed: Column, confirmed: Column, text: Column) -> Column:
    """Parsed skills (canonical names) that are not confirmed, case aside, and that the text names."""
    known = F.transform(confirmed, lambda w: F.lower(w))
    return F.array_intersect(F.filter(parsed, lambda w: ~F.array_contains(known, F.lower(w))), printed_technologies(text))


def copied_forward(rows: DataFrame) -> DataFrame:
    """Classifications (family, confidence, intensity) fit to be copied: not ambiguous, and confidence does not contradict intensity."""
    sure = F.col("confidence") >= 0.7
    conflict = (sure & F.col("intensity").isin("NONE", "INCIDENTAL")) | (~sure & (F.col("intensity") == "PRIMARY"))
    return rows.where((F.col("family") != "AMBIGUOUS") & ~conflict)


def slug_candidates(name: Column) -> Column:
    """Possible account names of an organisation."""
    base = F.trim(F.regexp_replace(F.lower(name), r"[,.]|\b(inc|llc|ltd|limited|corp|technologies|labs|pvt|private)\b", ""))
    joined, dashed = F.regexp_replace(base, "[^a-z0-9]", ""), F.regexp_replace(F.trim(F.regexp_replace(base, "[^a-z0-9]+", " ")), " ", "-")
    return F.filter(F.array_distinct(F.array(joined, dashed, F.concat(joined, L("hq")), F.concat(joined, L("-io")), F.substring_index(dashed, "-", 1))), lambda s: F.length(s) >= 2)


def employer_matches(field: Column, slug: Column, name: Column) -> Column:
    """Whether a profile's company field names the employer."""
    plain = F.regexp_replace(F.lower(field), "[^a-z0-9]", "")
    return F.coalesce((plain != "") & (F.contains(plain, F.regexp_replace(F.lower(slug), "[^a-z0-9]", "")) | F.contains(plain, F.regexp_replace(F.lower(name), "[^a-z0-9]", ""))), L(False))


def freshness_line(age_days: Column) -> Column:
    return F.when(age_days <= 0, "today").when(age_days == 1, "yesterday").when(age_days <= 7, "this week").otherwise("older")


def indian_number(n: Column) -> Column:
    """Grouping of the last three digits, then by two."""
    s = n.cast("long").cast("string")
    head = F.regexp_replace(F.reverse(F.regexp_replace(F.reverse(F.left(s, F.length(s) - 3)), r"(\d\d)(?=\d)", "$1,")), "^,", "")
    return F.when(F.length(s) <= 3, s).otherwise(F.concat(head, L(","), F.right(s, L(3))))


def ordered_union(a: Column, b: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.concat(a, b)), 1, most)


def profile_seed(headline: Column, titles: Column) -> Column:
    return F.array_distinct(F.array_compact(F.concat(F.array(headline), titles)))


def master_html(name: Column, sections: Column) -> Column:
    """sections: array<struct<heading, lines>>."""
    from siftline.functions.text import escape_html

    body = F.transform(sections, lambda s: F.concat(L("<h2>"), escape_html(s["heading"]), L("</h2><ul>"), F.array_join(F.transform(s["lines"], lambda x: F.concat(L("<li>"), escape_html(x), L("</li>"))), ""), L("</ul>")))
    return F.concat(L("<h1>"), escape_html(name), L("</h1>"), F.array_join(body, ""))


def with_keywords(html: Column, keywords: Column) -> Column:
    """Adds keywords to the paragraph after the skills heading."""
    return F.regexp_replace(html, L(r"(?is)(<h2>\s*skills\s*</h2>\s*<p>)(.*?)(</p>)"), F.concat(L("$1$2, "), F.array_join(keywords, ", "), L("$3")))


# --- company lists (FLT-2, FLT-3, FLT-15) ------------------------------------------------


def country_gate(country: Column, location: Column, wanted: list[str], pattern: str | None) -> Column:
    """True without a preference; else the country is wanted or the location matches the pattern."""
    if not wanted:
        return L(True)
    hit = country.isin(*wanted)
    return F.coalesce(hit, L(False)) if pattern is None else F.coalesce(hit, L(False)) | F.coalesce(location.rlike(f"(?i){pattern}"), L(False))


def country_gate_any_case(country: Column, wanted: list[str]) -> Column:
    return L(True) if not wanted else F.coalesce(F.upper(country).isin(*[w.upper() for w in wanted]), L(False))


def client_search(text: str, *columns: Column) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), L(text.lower()))
