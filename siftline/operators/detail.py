"""Everything known of a job in one record (SCO-37).

What is told of a job's skills depends on its lists alone, so it is made once for each
distinct set of lists, and jobs find it by half of the lists' SHA-256.  Each other part is
brought to one row per job by one exchange on the job's id, and these are then joined where
they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import documents as D
from siftline.functions import tech
from siftline.functions.common import js_round, once
from siftline.operators import keyed, phrases
from siftline.session import cut

L = F.lit
#: Bytes of distinct lists up to which what is told of them goes to the jobs, and not the jobs to it.
FEW_BYTES = 4 << 20


@dataclass(frozen=True)
class Person:
    """Whose view of the job it is: confirmed skills as written, the resume's text, years of work."""

    skills: tuple[str, ...]
    text: str
    years: int | None = None

    def known(self, like: DataFrame) -> tuple[str, ...]:
        """Canonical tokens of the skills."""
        rows = like.sparkSession.createDataFrame([(s,) for s in self.skills], "raw string")
        return tuple(sorted({r.tech for r in tech.canonical_table(rows).collect()}))


def resume_audit(asked: DataFrame, person: Person) -> DataFrame:
    """job_id, required, preferred (arrays of keyword, status, your_term), add_exact, missing_required, match_pct of jobs (job_id, required, preferred).

    The text is one person's, so every distinct keyword is sought in it once, and what is
    found there is small whatever the number of jobs.
    """
    spark = asked.sparkSession
    none = F.array().cast("array<string>")
    base = once(asked.select("job_id", F.coalesce("required", none).alias("req"), F.coalesce("preferred", none).alias("pref")), "req", "pref")
    base = once(base.select("job_id", D.dedupe_keywords(F.col("req")).alias("req"), D.dedupe_keywords(F.col("pref")).alias("pref")), "req", "pref")
    lower = F.transform("req", lambda w: F.lower(w))
    base = base.withColumn("pref", F.filter("pref", lambda w: ~F.array_contains(lower, F.lower(w))))
    rows = base.select("job_id", L(0).alias("list"), F.posexplode("req").alias("pos", "keyword")).unionAll(base.select("job_id", L(1).alias("list"), F.posexplode("pref").alias("pos", "keyword")))
    spellings = rows.select("keyword").distinct().withColumn("phrase", F.lower("keyword"))
    resume = spark.createDataFrame([(0, person.text)], "id int, text string")
    literal = phrases.whole_phrases(resume, spellings, "phrase").select("phrase", L(True).alias("literal"))
    own = spark.createDataFrame([(n, s) for n, s in enumerate(person.skills)], "p int, raw string")
    terms = own.join(tech.canonical_table(own), "raw").groupBy("tech").agg(F.min_by("raw", "p").alias("term"))
    printed = D._consumed(person.text)
    told = spellings.join(tech.canonical_table(spellings.select(F.col("keyword").alias("raw"))).withColumnRenamed("raw", "keyword"), "keyword", "left").join(literal, "phrase", "left").join(terms, "tech", "left")
    a, b = (F.regexp_replace(F.lower(x), "[^a-z0-9]", "") for x in ("keyword", "term"))
    trivial = F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), L(False))
    has = F.coalesce(F.col("tech").isin(*printed), L(False)) if printed else L(False)
    told = told.withColumn("status", F.when(F.col("literal"), "PRESENT").when(has, F.when(trivial, "ACCEPTED_VARIANT").otherwise("ADD_EXACT")).otherwise("MISSING"))
    told = told.select("keyword", "status", F.when(F.col("status").isin("ACCEPTED_VARIANT", "ADD_EXACT"), F.col("term")).alias("your_term"))
    per = rows.join(told, "keyword").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("list", "pos", "keyword", "status", "your_term"))).alias("all"))
    of = lambda n: F.filter("all", lambda x: x["list"] == n)
    item = lambda x: F.struct(x["keyword"].alias("keyword"), x["status"].alias("status"), x["your_term"].alias("your_term"))
    named = lambda keep: F.transform(F.filter("all", keep), lambda x: x["keyword"])
    covered = F.size(F.filter(of(0), lambda x: x["status"].isin("PRESENT", "ACCEPTED_VARIANT")))
    return per.select(
        "job_id", F.transform(of(0), item).alias("required"), F.transform(of(1), item).alias("preferred"), named(lambda x: x["status"] == "ADD_EXACT").alias("add_exact"),
        named(lambda x: (x["status"] == "MISSING") & (x["list"] == 0)).alias("missing_required"), F.when(F.size(of(0)) > 0, js_round(covered / F.greatest(F.size(of(0)), L(1)) * 100)).alias("match_pct"))


def job_details(jobs: DataFrame, classifications: DataFrame, matches: DataFrame, companies: DataFrame, preferences: DataFrame, person: Person, few: int = FEW_BYTES) -> DataFrame:
    """One row for each job (job_id, company_id): classification, specialization, what_if, keywords, career_path, match, company.

    Parts that a job has not are null.  ``classifications`` (job_id, version, required,
    preferred, specializations, role_family) may hold several versions, the highest counts;
    ``matches`` (job_id, verdict, code, score) is unique by job, ``companies`` by company_id,
    ``preferences`` (discipline, preference) by discipline.
    """
    lists = ("required", "preferred", "specializations")
    newest = keyed.latest_per_key(classifications.withColumn("lists", F.unhex(F.substring(F.sha2(F.to_json(F.struct(*lists)), 256), 1, 32))), ["job_id"], "version", "lists")
    mine = person.known(jobs)
    # read several times below; as many rows as there are different lists
    distinct = cut(newest.groupBy("lists").agg(*[F.first(c).alias(c) for c in lists]))
    both = F.concat(F.coalesce("required", F.array().cast("array<string>")), F.coalesce("specializations", F.array().cast("array<string>")))
    asked = distinct.select("lists", both.alias("wanted"))
    fit = tech.specialization(asked, "lists", "wanted", mine)
    more = tech.what_if(asked, "lists", "wanted", mine)
    audit = resume_audit(distinct.withColumnRenamed("lists", "job_id"), person).withColumnRenamed("job_id", "lists")
    told = fit.select("lists", "off_path", F.struct("fit", "strong", "transferable", "missing").alias("specialization")).join(more, "lists", "left")
    told = told.join(audit.select("lists", F.struct("required", "preferred", "add_exact", "missing_required", "match_pct").alias("keywords")), "lists", "left")
    if (distinct.agg(F.sum(F.octet_length(F.to_json(F.struct(*lists))))).first()[0] or 0) <= few:
        told = F.broadcast(told)
    known = companies.select("company_id", F.struct(*[c for c in companies.columns if c != "company_id"]).alias("company"))
    scored = matches.select("job_id", F.struct("verdict", "code", js_round(F.col("score")).alias("score")).alias("match"))
    # narrow rows are exchanged before the lists' parts make them wide
    out = jobs.select("job_id", "company_id").join(known, "company_id", "left").drop("company_id")
    out = out.join(newest.select("job_id", "lists", F.struct("role_family", "version", "required", "preferred").alias("classification")), "job_id", "left").join(scored, "job_id", "left")
    path = preferences.select(F.col("discipline").alias("off_path"), "preference")
    out = out.join(told, "lists", "left").join(path, "off_path", "left")
    career = F.when(F.col("off_path").isNotNull(), F.struct(F.col("off_path").alias("discipline"), "preference"))
    return out.select("job_id", "classification", "specialization", "what_if", "keywords", career.alias("career_path"), "match", "company", L(person.years).cast("int").alias("years"))
