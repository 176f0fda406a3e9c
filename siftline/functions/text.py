"""Text, hash and URL functions as column expressions (TXT-*)."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftline.functions.common import col

L = F.lit

# Words that say nothing in a job title.
TITLE_NOISE = (
    "a", "an", "the", "of", "for", "and", "to", "in", "at", "with", "on", "our", "we", "are", "is",
    "hiring", "job", "role", "position", "opening", "vacancy",
)

# Company names of the top tier.
TOP_TIER = (
    "google", "alphabet", "microsoft", "amazon", "aws", "meta", "apple", "netflix", "openai", "anthropic", "nvidia", "adobe", "salesforce", "oracle",
    "ibm", "intel", "uber", "airbnb", "atlassian", "stripe", "cloudflare", "databricks", "snowflake", "palantir", "linkedin", "spotify", "shopify",
    "coinbase", "dropbox", "github", "gitlab", "figma", "notion", "vercel", "datadog", "mongodb", "elastic", "twilio", "plaid", "ramp", "brex",
)

# Local parts of addresses by kind, and what is no address of a company.
RECRUITING_LOCAL = r"(?i)^(careers?|jobs?|hiring|recruit(ing|ment)?|talent|hr|people|joinus|join|work|apply|hello-careers)$"
GENERAL_LOCAL = r"(?i)^(info|hello|contact|hi|team|hey|reach|enquir(y|ies)|hola)$"
JUNK_LOCAL = r"(?i)^(example|user|name|email|your|yourname|firstname|lastname|no-?reply|noreply|donotreply|test|sentry|wixpress|abuse|postmaster|mailer-daemon)$"
JUNK_DOMAIN = r"(?i)(example\.(com|org)|sentry\.io|wixpress\.com|domain\.com|email\.com|yourcompany\.com|sentry-next\.wixpress\.com)$"
ASSET = r"(?i)\.(png|jpg|jpeg|gif|svg|webp)$"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@F.pandas_udf(StringType())
def nfkd(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition; Spark has no built-in for it."""
    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def _decomposed(text: Column, ascii_only: bool) -> Column:
    """``ascii_only`` promises plain text and keeps Python out of the plan."""
    return text if ascii_only else F.when(F.length(text) == F.octet_length(text), text).otherwise(nfkd(text))


def _letters_and_digits(text: Column, ascii_only: bool) -> Column:
    return F.regexp_replace(_decomposed(F.lower(text), ascii_only), r"[^\p{L}\p{N}]+", " ")


def normalize_title(title: Column | str, ascii_only: bool = False) -> Column:
    """Distinct words without noise words, sorted: word order and repeats do not matter."""
    words = F.filter(F.split(_letters_and_digits(col(title), ascii_only), r"\s+"), lambda w: (w != "") & ~w.isin(*TITLE_NOISE))
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def normalize_location(location: Column | str, ascii_only: bool = False) -> Column:
    return F.coalesce(F.trim(_letters_and_digits(col(location), ascii_only)), L(""))


def job_fingerprint(company: Column, title: Column, location: Column, mode: Column, ascii_only: bool = False) -> Column:
    """32 hex digits; equal for postings that differ in word order, case or punctuation only."""
    basis = F.concat_ws("::", company, normalize_title(title, ascii_only), normalize_location(location, ascii_only), F.upper(F.coalesce(mode, L(""))))
    return F.substring(F.sha2(basis, 256), 1, 32)


def content_hash(title: Column, low: Column, high: Column) -> Column:
    """16 hex digits over title and salary bounds; nulls print as ``null``."""
    shown = lambda c: F.coalesce(c.cast("string"), L("null"))
    return F.substring(F.sha2(F.concat_ws("|", shown(title), shown(low), shown(high)), 256), 1, 16)


def short_id(text: Column, prefix: str = "careerpage-") -> Column:
    """32-bit multiplicative hash (5381, times 33 plus code) in base 36; for texts of the basic plane."""
    units = F.filter(F.split(text, ""), lambda c: c != "")
    code = F.aggregate(units, L(5381).cast("long"), lambda h, c: F.pmod(h * 33 + F.ascii(c), L(1 << 32)))
    return F.concat(L(prefix), F.lower(F.conv(code.cast("string"), 10, 36)))


# --- URLs ----------------------------------------------------------------------------

# Hosts of hosted boards. Exact hosts name the board in the first path segment ...
BOARD_HOSTS = {
    "boards.greenhouse.io": "GREENHOUSE", "job-boards.greenhouse.io": "GREENHOUSE", "jobs.lever.co": "LEVER", "jobs.ashbyhq.com": "ASHBY",
    "jobs.smartrecruiters.com": "SMARTRECRUITERS", "careers.smartrecruiters.com": "SMARTRECRUITERS", "apply.workable.com": "WORKABLE",
}
# ... and these in the first label of the host, unless it is one of the names that are no tenant.
BOARD_SUFFIXES = {
    ".recruitee.com": ("RECRUITEE", ()), ".teamtailor.com": ("TEAMTAILOR", ()), ".workable.com": ("WORKABLE", ("www",)), ".breezy.hr": ("BREEZY", ("app", "www")),
    ".keka.com": ("KEKA", ("www", "app", "cdn")), ".darwinbox.in": ("DARWINBOX", ("www", "app")), ".darwinbox.com": ("DARWINBOX", ("www", "app")),
    ".zohorecruit.com": ("ZOHO_RECRUIT", ("www",)), ".freshteam.com": ("FRESHTEAM", ("www",)),
}


def url_host(url: Column) -> Column:
    """Host in lower case; null where the URL does not parse."""
    return F.lower(F.try_parse_url(url, L("HOST")))


def bare_host(url: Column) -> Column:
    """Host without a leading www.; the input itself where it does not parse."""
    return F.coalesce(F.regexp_replace(url_host(url), r"^www\.", ""), url)


def detect_board(url: Column) -> Column:
    """struct(provider, identifier) of a hosted job board; UNKNOWN and null otherwise."""
    host = url_host(url)
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, L("PATH")), L("")), "/"), lambda s: s != "")
    first, tenant = F.get(parts, 0), F.substring_index(host, ".", 1)
    provider = F.element_at(F.create_map(*[L(x) for kv in BOARD_HOSTS.items() for x in kv]), host)
    named = F.when((provider == "GREENHOUSE") & (first == "embed"), F.try_parse_url(url, L("QUERY"), L("for"))).when((host == "apply.workable.com") & (first == "api"), L(None)).otherwise(first)
    site = F.get(F.filter(parts, lambda s: ~s.isin("en-US", "wday")), 0)
    out = F.when(host.isin(*BOARD_HOSTS), F.struct(provider.alias("provider"), named.alias("identifier")))
    out = out.when(host.endswith(".myworkdayjobs.com"), F.struct(L("WORKDAY").alias("provider"), F.concat_ws("/", tenant, site).alias("identifier")))
    for suffix, (name, not_tenants) in BOARD_SUFFIXES.items():
        mine = host.endswith(suffix)
        out = out.when(mine & ~tenant.isin(*not_tenants) if not_tenants else mine, F.struct(L(name).alias("provider"), tenant.alias("identifier")))
    return out.otherwise(F.struct(L("UNKNOWN").alias("provider"), L(None).cast("string").alias("identifier")))


BOARD_ROOTS = {
    "GREENHOUSE": "https://boards.greenhouse.io/%s", "LEVER": "https://jobs.lever.co/%s", "ASHBY": "https://jobs.ashbyhq.com/%s", "WORKABLE": "https://apply.workable.com/%s",
    "SMARTRECRUITERS": "https://jobs.smartrecruiters.com/%s", "RECRUITEE": "https://%s.recruitee.com", "BREEZY": "https://%s.breezy.hr", "KEKA": "https://%s.keka.com/careers",
}


def board_root(provider: Column, identifier: Column) -> Column:
    template = F.element_at(F.create_map(*[L(x) for kv in BOARD_ROOTS.items() for x in kv]), provider)
    return F.replace(template, L("%s"), identifier)


# --- HTML and plain text ---------------------------------------------------------------

ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))


def decode_entities(text: Column) -> Column:
    """Named entities; the ampersand first, so that a double-encoded one is decoded whole."""
    for name, ch in ENTITIES:
        text = F.replace(text, L(name), L(ch))
    return text


def html_to_text(html: Column) -> Column:
    """Text with line ends where blocks end."""
    t = F.regexp_replace(html, r"(?is)<(style|script)\b.*?</\1>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>", "\n")
    t = decode_entities(F.regexp_replace(t, "<[^>]+>", ""))
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_to_line(html: Column) -> Column:
    """Text on one line."""
    t = F.regexp_replace(html, r"(?is)<(style|script)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(t, "<[^>]+>", " ")), r"\s+", " "))


def escape_html(text: Column) -> Column:
    for ch, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, L(ch), L(name))
    return text


def work_mode(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("remote"), "REMOTE").when(t.contains("hybrid"), "HYBRID")


def cap_text(text: Column, most: int = 30_000, marker: str = "\n\n[truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, L(most)), L(marker))).otherwise(text)


def truncate_at_sentence(text: Column, most: int) -> Column:
    """Cut after the last sentence end beyond 40 % of ``most``, else after the last word there, else hard."""
    head = F.left(text, L(most))
    last = lambda what: F.when(F.locate(what, F.reverse(head)) > 0, most - F.locate(what, F.reverse(head)) + 1 - (len(what) - 1)).otherwise(0)
    stop = F.greatest(*[last(e[::-1]) for e in (". ", ".\n", "! ", "? ")])
    space = last(" ")
    cut = F.when(stop > most * 0.4, F.substring(head, L(1), stop)).when(space > most * 0.4, F.concat(F.substring(head, L(1), space - 1), L("…"))).otherwise(F.concat(head, L("…")))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def literal_phrase(text: Column, phrase: str) -> Column:
    """Whether the phrase occurs as whole words, case aside; + # . _ - belong to words."""
    import re

    return text.rlike(rf"(?i)(?<![A-Za-z0-9+#._-]){re.escape(phrase)}(?![A-Za-z0-9+#_-])")


def email_kind(local: Column) -> Column:
    return F.when(local.rlike(RECRUITING_LOCAL), "RECRUITING").when(local.rlike(GENERAL_LOCAL), "GENERAL").otherwise("OTHER")


def company_emails(html: Column, site_host: Column | None = None, most: int = 6) -> Column:
    """array<struct<o, address, kind>> of distinct addresses, recruiting ones first, then general, then by address."""
    plain = F.regexp_replace(html, r"\\u[0-9a-fA-F]{4}", " ")
    found = F.array_distinct(F.transform(F.regexp_extract_all(plain, L(EMAIL), L(0)), lambda a: F.regexp_replace(F.lower(a), "[.,;:]+$", "")))

    def good(a: Column) -> Column:
        local, domain = F.regexp_replace(a, "@[^@]*$", ""), F.substring_index(a, "@", -1)
        ok = ~local.rlike(JUNK_LOCAL) & ~domain.rlike(JUNK_DOMAIN) & ~domain.rlike(ASSET)
        return ok if site_host is None else ok & (site_host.isNull() | (domain == site_host) | F.endswith(domain, F.concat(L("."), site_host)))

    def told(a: Column) -> Column:
        kind = email_kind(F.regexp_replace(a, "@[^@]*$", ""))
        return F.struct(F.when(kind == "RECRUITING", 0).when(kind == "GENERAL", 1).otherwise(2).alias("o"), a.alias("address"), kind.alias("kind"))

    return F.slice(F.array_sort(F.transform(F.filter(found, good), told)), 1, most)


def company_tier(name: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[,.]", ""), r"\s+(inc|llc|ltd|corp)$", ""))
    return F.when(plain.isin(*TOP_TIER), "BIG_TECH").otherwise("UNKNOWN")


def looks_like_text(text: Column) -> Column:
    """At least 200 characters, 70 % letters and spaces, five occurrences of the commonest words."""
    letters = F.length(text) - F.length(F.regexp_replace(text, r"[A-Za-z\s]", ""))
    common = F.regexp_count(F.lower(text), L(r"(?<![a-z0-9_])(the|and|of|in|to|with|for|a)(?![a-z0-9_])"))
    return (F.length(text) >= 200) & (letters / F.length(text) >= 0.7) & (common >= 5)


def embedding_text(title: Column, location: Column, description: Column) -> Column:
    return F.trim(F.concat_ws("\n", title, location, F.substring(description, 1, 2000)))


def first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), L(""))


# Address and telephone number of a resume.
RESUME_EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
RESUME_PHONE = r"\+?\d[\d\s()-]{8,14}\d"


def resume_email(text: Column) -> Column:
    """First address in a resume's text, null if there is none."""
    return first_match(text, RESUME_EMAIL)


def resume_phone(text: Column) -> Column:
    return F.trim(first_match(text, RESUME_PHONE))


# Fences around a reply, and telephone numbers.
FENCE_START = r"(?i)^\s*```(?:json)?\s*"
FENCE_END = r"\s*```\s*$"
PHONE = r"\+?\d[\d\s().-]{8,}\d"


def _is_json(text: str) -> bool:
    def refuse(name: str) -> None:
        raise ValueError(name)  # NaN and Infinity are no JSON

    try:
        json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):  # nested deeper than any reply of use
        return False
    return True


def balanced_objects(text: str) -> Iterator[str]:
    """Spans from a brace to the one that closes it, in one pass over the text; braces inside string literals do not count."""
    depth, start = 0, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', text, re.DOTALL):
        if m.group() == "{":
            if depth == 0:
                start = m.start()
            depth += 1
        elif m.group() == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[start : m.end()]


def _readings(text: str) -> Iterator[str]:
    yield text
    bare = re.sub(FENCE_END, "", re.sub(FENCE_START, "", text))
    yield bare
    at = bare.find("{")
    objects = balanced_objects(bare[at:]) if at >= 0 else iter(())  # quotes before the first brace open no string
    yield next(objects, "")
    yield text[text.find("{") : text.rfind("}") + 1]
    yield from objects


def _reply(text: str | None) -> str | None:
    """The JSON of a reply, by the first reading that parses: all of it, without its fences, its first balanced object, its outermost braces, a later object."""
    return None if text is None else next((r.strip() for r in _readings(text) if r and _is_json(r)), None)


@F.pandas_udf(StringType())
def json_object(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON of a model's reply as text, whatever stands around it; null if there is none."""
    for s in texts:
        yield s.map(_reply)
