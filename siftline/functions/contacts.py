"""Ladders of ways to reach a company, and the plan for a job (SCO-23).

Rungs are an array built by one grouping on the company: who is best in each role is an
aggregate, so contacts need no window and no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.documents import contact_confidence

L = F.lit
# Least priority of a contact for five, four and three stars.
STARS = ((75, 5), (60, 4), (45, 3))


def stars(priority: Column) -> Column:
    out = F.lit(2)
    for least, n in STARS[::-1]:
        out = F.when(priority >= least, n).otherwise(out)
    return out


def best_contacts(contacts: DataFrame) -> DataFrame:
    """company, n, referrer, recruiter, manager, primary, secondary (structs or null) of contacts (company, id, name, role, priority, member, email, site, shared, contributions).

    The referrer is the best contact that is no recruiter, the manager the best hiring
    manager beside the referrer, the secondary the best whose role differs from the primary's, or
    else the next one.  Ties go by id.
    """
    c = contacts.withColumn("c", F.struct("id", "name", "role", "priority", contact_confidence(F.col("member"), F.col("role"), F.col("email"), F.col("site"), F.col("shared"), F.col("contributions"))["referral"].alias("referral")))
    order = F.struct(-F.col("priority"), "id")
    first = lambda cond: F.min(F.when(cond, F.struct(order.alias("o"), "c")))["c"]
    is_role = lambda r: F.col("role") == r
    per = c.groupBy("company").agg(F.count(L(1)).alias("n"), first(~is_role("RECRUITER")).alias("referrer"), first(is_role("RECRUITER")).alias("recruiter"), first(L(True)).alias("primary"))
    told = c.join(per.select("company", F.col("primary.id").alias("__p"), F.col("primary.role").alias("__r"), F.col("referrer.id").alias("__f")), "company")
    second = F.min(F.when(F.col("id") != F.col("__p"), F.struct((F.col("role") == F.col("__r")).alias("same"), order.alias("o"), "c")))["c"]
    others = told.groupBy("company").agg(first(is_role("HIRING_MANAGER") & ~F.equal_null("id", "__f")).alias("manager"), second.alias("secondary"))
    return per.join(others, "company", "left")


def ladder(emails: Column, careers_url: Column, contact_url: Column, authors: Column, blog_url: Column, job_url: Column) -> Column:
    """array<struct<kind, who, confidence>> over a row of ``best_contacts`` and a company's channels; the last rung is always to apply.

    ``emails`` is an array of struct(address, kind).
    """
    rung = lambda kind, who, confidence: F.struct(L(kind).alias("kind"), who.cast("string").alias("who"), confidence.cast("int").alias("confidence"))
    person = lambda c, kind: F.when(F.col(c).isNotNull(), rung(kind, F.col(f"{c}.name"), F.col(f"{c}.referral")))
    recruiting = F.get(F.filter(emails, lambda e: e["kind"] == "RECRUITING"), 0)["address"]
    general = F.get(F.filter(emails, lambda e: e["kind"] != "RECRUITING"), 0)["address"]
    by_blog = F.when((F.size(authors) > 0) & blog_url.isNotNull(), rung("ENG_BLOG", F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, " +more").otherwise("")), L(3)))
    return F.array_compact(F.array(
        person("referrer", "REFERRAL"), person("recruiter", "RECRUITER"), person("manager", "HIRING_MANAGER"), by_blog, F.when(recruiting.isNotNull(), rung("COMPANY_EMAIL", recruiting, L(3))),
        F.when(careers_url.isNotNull(), rung("CAREERS_PAGE", careers_url, L(2))), F.when(general.isNotNull() | contact_url.isNotNull(), rung("CONTACT_PAGE", F.coalesce(general, contact_url), L(2))), rung("APPLY", job_url, L(2))))


def plan(has_contacts: Column) -> Column:
    """array<struct<step, kind, stars>> of the play for a job: a referral first where there is somebody, two nudges at most."""
    step = lambda kind, n: F.struct(L(kind).alias("kind"), n.cast("int").alias("stars"))
    steps = F.array_compact(F.array(
        F.when(has_contacts, step("ASK_REFERRAL", stars(F.col("primary.priority")))), step("TAILOR", L(5)), step("APPLY", F.when(has_contacts, 4).otherwise(5)), F.when(has_contacts, step("FOLLOW_UP", L(4))), F.when(has_contacts, step("SECOND_NUDGE", L(3)))))
    return F.transform(steps, lambda s, i: F.struct((i + 1).alias("step"), s["kind"].alias("kind"), s["stars"].alias("stars")))
