"""Deterministic row-level scores and decisions as column expressions.

Every function takes columns and returns a column, so a score is part of the plan of
whatever query uses it.  Thresholds and weights are fixed values of the scoring rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.common import clamp, js_round, round1

L = F.lit


def steps(value: Column, bounds: list[tuple[float, float]], beyond: float) -> Column:
    """First y whose x satisfies value <= x; ``beyond`` otherwise, also for null."""
    out = None
    for x, y in bounds:
        out = F.when(value <= x, L(y)) if out is None else out.when(value <= x, L(y))
    return out.otherwise(L(beyond))


# --- sources -----------------------------------------------------------------------

#: Baseline trust of a source by name (fixed values); others by prefix, else 85.
SOURCE_BASELINES = {
    "greenhouse": 100, "lever": 100, "ashby": 100, "workable": 100, "smartrecruiters": 100, "recruitee": 100, "breezy": 100, "keka": 100,
    "adzuna": 92, "jooble": 90, "career-page": 94, "remoteok": 92, "hn": 88,
}


def source_baseline(source: Column, table: dict[str, int] | None = None, default: int = 85) -> Column:
    """Baseline by exact name, then by the name before the first ':'; default for unknown and null."""
    table = SOURCE_BASELINES if table is None else table
    known = F.create_map(*[L(x) for kv in table.items() for x in kv])
    name = F.lower(source)
    return F.coalesce(F.try_element_at(known, name), F.try_element_at(known, F.substring_index(name, ":", 1)), L(default)).cast("long")


def source_trust_score(baseline: Column, active: Column, stale: Column, fresh: Column) -> Column:
    """Baseline, up to +5 for the fresh share, up to -12 for the stale share, within 40..100.

    With nothing active the baseline stands.
    """
    share = lambda part, most: js_round(F.least(L(float(most)), part.cast("double") / active * most))
    moved = baseline.cast("long") + share(fresh, 5) - share(stale, 12)
    return F.when(active == 0, baseline.cast("long")).otherwise(clamp(moved, 40, 100)).cast("long")


# --- companies ---------------------------------------------------------------------


def hiring_trend(recent: Column, prior: Column, enough_history: Column) -> Column:
    quiet = (recent == 0) & (prior == 0)
    return (
        F.when(~F.coalesce(enough_history, L(False)) | quiet, "INSUFFICIENT_DATA")
        .when(prior == 0, F.when(recent >= 2, "GROWING").otherwise("STABLE"))
        .when(recent > prior * 1.25, "GROWING").when(recent < prior * 0.75, "DECLINING").otherwise("STABLE")
    )


def growth_score(active: Column, recent: Column, trend: Column, days_since_last: Column) -> Column:
    size = F.least(L(35), active * 4) + F.least(L(35), recent * 7)
    direction = F.when(trend == "GROWING", 20).when(trend == "STABLE", 10).when(trend == "DECLINING", -5).otherwise(0)
    warmth = F.when(days_since_last <= 7, 10).when(days_since_last <= 21, 4).when(days_since_last > 60, -10).otherwise(0)
    return clamp(size + direction + warmth, 0, 100).cast("long")


def crawl_tier(recent14: Column, active: Column, days_since_new: Column, attempts: Column, watched: Column) -> Column:
    dead = (attempts >= 5) & (active == 0) & (days_since_new.isNull() | (days_since_new > 120))
    return (
        F.when(F.coalesce(watched, L(False)), "HOT").when(dead, "DORMANT").when(recent14 >= 3, "HOT")
        .when((recent14 >= 1) | (days_since_new <= 30), "WARM").otherwise("COLD")
    )


TIER_MINUTES = {"HOT": 30, "WARM": 240, "COLD": 1440, "DORMANT": 43200}


def tier_minutes(tier: Column) -> Column:
    return F.element_at(F.create_map(*[L(x) for kv in TIER_MINUTES.items() for x in kv]), tier)


def next_due(as_of: Column, tier: Column, failed: Column) -> Column:
    """as_of plus the tier's interval, or an hour after a failure."""
    return as_of + F.make_interval(mins=F.when(failed, L(60)).otherwise(tier_minutes(tier)))


def company_confidence(website: Column, career_page: Column, ats: Column, monitored: Column, recent_jobs: Column) -> Column:
    """15 + 20 + 25 + 25 + 15 for the five signs of a real company."""
    points = ((website, 15), (career_page, 20), (ats, 25), (monitored, 25), (recent_jobs, 15))
    total = L(0)
    for flag, value in points:
        total = total + F.when(flag, value).otherwise(0)
    return total.cast("long")


def discovery_stage(monitorable: Column, claimed: Column, career_page: Column, website: Column) -> Column:
    return (
        F.when(monitorable & ~claimed, "MONITORED").when(monitorable, "UNRESOLVABLE")
        .when(career_page, "CAREER_PAGE_FOUND").when(website, "WEBSITE_FOUND").otherwise("UNRESOLVABLE")
    )


# --- ranking and opportunity ---------------------------------------------------------


def competition(age_days: Column) -> Column:
    return F.when(age_days.isNull(), "MEDIUM").when(age_days <= 2, "LOW").when(age_days <= 10, "MEDIUM").otherwise("HIGH")


def ranking_factors(fit: Column, age_days: Column, referral: Column, watched: Column, trend: Column, applied: Column, trust: Column) -> list[tuple[str, Column]]:
    """(name, rounded points) of the browse ranking; absent factors are 0."""
    base = F.greatest(L(0.0), F.least(L(68.0), (fit.cast("double") - 55) / 35 * 68))
    fresh = F.when(age_days <= 1, 12).when(age_days <= 3, 9).when(age_days <= 7, 5).when(age_days > 45, -8).when(age_days > 21, -4).otherwise(0)
    return [
        ("resume_fit", js_round(base)),
        ("freshness", fresh),
        ("referral", F.when(referral == "CONTACTED", 12).when(referral == "FOUND", 6).otherwise(0)),
        ("watched", F.when(watched, 8).otherwise(0)),
        ("trend", F.when(trend == "GROWING", 5).when(trend == "DECLINING", -3).otherwise(0)),
        ("trust", F.when(trust >= 95, 3).when(trust <= 75, -5).otherwise(0)),
        ("applied", F.when(applied, -18).otherwise(0)),
    ]


def ranking_score(*signals: Column) -> Column:
    total = L(0).cast("long")
    for _, points in ranking_factors(*signals):
        total = total + points.cast("long")
    return clamp(total, 0, 100).cast("long")


def ranked_factors(*signals: Column) -> Column:
    """Non-zero factors as array of (factor, delta), largest magnitude first, ties by name."""
    parts = F.array(*[F.struct((-F.abs(p.cast("long"))).alias("o"), L(n).alias("factor"), p.cast("long").alias("delta")) for n, p in ranking_factors(*signals)])
    kept = F.array_sort(F.filter(parts, lambda s: s["delta"] != 0))
    return F.transform(kept, lambda s: F.struct(s["factor"].alias("factor"), s["delta"].alias("delta")))


FRESH_STEPS = [(1, 100), (2, 95), (3, 90), (7, 80), (14, 65), (21, 50), (30, 35), (45, 20), (60, 10)]


def freshness(age_days: Column) -> Column:
    return steps(age_days, FRESH_STEPS, 0)


def gap_score(gaps: Column) -> Column:
    return F.when(gaps == 0, 100).when(gaps <= 2, 70).when(gaps <= 4, 40).otherwise(15)


def velocity_score(growth: Column, trend: Column, recent14: Column) -> Column:
    by_trend = F.when(trend == "GROWING", 100).when(trend == "STABLE", 60).when(trend == "DECLINING", 25)
    by_count = F.when(recent14 >= 10, 95).when(recent14 >= 3, 75).when(recent14 >= 1, 55).otherwise(30)
    return F.coalesce(growth.cast("double"), by_trend.cast("double"), by_count.cast("double"))


MODULE_WEIGHTS = {
    "resumeFit": 35, "experienceFit": 15, "freshness": 20, "remotePreference": 10, "salaryPreference": 5,
    "companyQuality": 5, "hiringVelocity": 5, "cityPreference": 5, "skillGap": 5,
}


def modules(scores: dict[str, Column]) -> Column:
    """array<struct<module, score, weight>> of the modules whose score is not null."""
    parts = [F.struct(L(m).alias("module"), s.cast("double").alias("score"), L(MODULE_WEIGHTS[m]).alias("weight")) for m, s in scores.items()]
    return F.filter(F.array(*parts), lambda m: m["score"].isNotNull())


def weighted_score(scores: dict[str, Column], trust: Column, confidence: Column) -> Column:
    """Weighted mean over the modules present, nudged by source trust, damped for unverified companies."""
    weight, points = L(0.0), L(0.0)
    for m, s in scores.items():
        weight = weight + F.when(s.isNotNull(), float(MODULE_WEIGHTS[m])).otherwise(0.0)
        points = points + F.coalesce(s.cast("double") * MODULE_WEIGHTS[m], L(0.0))
    mean = round1(points / weight)
    nudge = F.greatest(L(-4), F.least(L(3), js_round((trust.cast("double") - 92) / 4)))
    nudged = F.when(trust.isNotNull() & (nudge != 0), clamp(round1(mean + nudge), 0.0, 100.0)).otherwise(mean)
    return F.when(confidence < 40, round1(nudged * 0.85)).otherwise(nudged)


def verdict_band(score: Column) -> Column:
    """On the unrounded score."""
    return F.when(score >= 75, "APPLY").when(score >= 60, "CONSIDER").otherwise("SKIP")


# --- role classification -------------------------------------------------------------

#: Role families by how they fit the default profile (fixed values).
TARGET_FAMILIES = ("FULL_STACK", "BACKEND", "NODEJS_BACKEND", "MERN", "WEB_SOFTWARE_ENGINEERING", "GENERAL_SOFTWARE_ENGINEERING", "SDE")
ADJACENT_FAMILIES = ("FRONTEND", "REACT", "APPLICATION_ENGINEERING", "INTEGRATION_ENGINEERING", "SOLUTIONS_ENGINEERING", "PLATFORM_ENGINEERING")
EXCLUDED_FAMILIES = (
    "NATIVE_ANDROID", "NATIVE_IOS", "DATA_ENGINEERING", "DATA_SCIENCE", "MACHINE_LEARNING", "DEVOPS_SRE", "MANUAL_QA", "AUTOMATION_QA",
    "PRODUCT_MANAGEMENT", "BUSINESS_ANALYTICS", "DATA_ANALYTICS", "DIGITAL_MARKETING", "SUPPORT", "SALES", "ENGINEERING_MANAGEMENT",
)
CATCH_ALL_FAMILIES = ("SDE", "GENERAL_SOFTWARE_ENGINEERING", "WEB_SOFTWARE_ENGINEERING")


def target_fit(function: Column, family: Column, foreign: Column, target=TARGET_FAMILIES, adjacent=ADJACENT_FAMILIES, excluded=EXCLUDED_FAMILIES) -> Column:
    """``foreign``: the job names a technology that marks another discipline."""
    wide = family.isin(*CATCH_ALL_FAMILIES) & F.coalesce(foreign, L(False))
    return (
        F.when((function == "AMBIGUOUS") | (family == "AMBIGUOUS"), "AMBIGUOUS").when(family.isin(*excluded), "NON_TARGET")
        .when(family.isin(*target), F.when(wide, "ADJACENT").otherwise("TARGET")).when(family.isin(*adjacent), "ADJACENT").otherwise("NON_TARGET")
    )


def target_role_fit(fit: Column, stack: Column) -> Column:
    base = F.when(fit == "TARGET", 100).when(fit == "ADJACENT", 65).when(fit == "AMBIGUOUS", 40).otherwise(10)
    return F.when((fit == "ADJACENT") & stack.isNotNull(), js_round(base * (0.6 + 0.4 * (stack.cast("double") / 100)))).otherwise(base).cast("long")


def coding_weight(intensity: Column) -> Column:
    return F.when(intensity == "PRIMARY", 1.0).when(intensity == "SUBSTANTIAL", 0.8).when(intensity == "OCCASIONAL", 0.4).otherwise(0.1)


def role_relevance(confidence: Column, intensity: Column, role_fit: Column) -> Column:
    return js_round(confidence.cast("double") * coding_weight(intensity) * (role_fit.cast("double") / 100)).cast("long")


def experience_verdict(seniority: Column, minimum: Column, years: Column) -> Column:
    """struct(eligible, caps_at_consider, below_level)."""
    below = (seniority == "INTERN") & (years >= 1)
    senior = seniority.isin("SENIOR", "LEAD", "STAFF", "PRINCIPAL") & (minimum.isNull() | (minimum > years + 1))
    gap = minimum - years
    eligible = ~F.coalesce(below, L(False)) & ~F.coalesce(senior, L(False)) & (minimum.isNull() | (gap <= 1))
    caps = eligible & F.coalesce((gap > 0) & (gap <= 1), L(False))
    return F.struct(eligible.alias("eligible"), caps.alias("caps_at_consider"), F.coalesce(below, L(False)).alias("below_level"))


def eligibility_code(fit: Column, intensity: Column, confidence: Column, experience: Column) -> Column:
    """The first gate that decides."""
    builds = intensity.isin("PRIMARY", "SUBSTANTIAL")
    nothing = (intensity == "NONE") & (confidence < 20)
    bar = F.when(fit == "TARGET", 70).otherwise(80)
    return (
        F.when(fit == "NON_TARGET", F.when(builds & (confidence >= 70), "DEVELOPMENT_WRONG_SPECIALIZATION").otherwise("NOT_DEVELOPMENT"))
        .when(~builds, F.when((fit == "AMBIGUOUS") & ~nothing, "AMBIGUOUS_NEEDS_REVIEW").when(nothing, "NOT_DEVELOPMENT").otherwise("LOW_CODING_RESPONSIBILITY"))
        .when(~experience["eligible"], F.when(experience["below_level"], "TARGET_ROLE_BELOW_LEVEL").otherwise("TARGET_ROLE_TOO_SENIOR"))
        .when((fit == "AMBIGUOUS") | (confidence < 50), "AMBIGUOUS_NEEDS_REVIEW")
        .when(confidence < bar, "LOW_CONFIDENCE")
        .when((fit == "ADJACENT") & (intensity != "PRIMARY"), "AMBIGUOUS_NEEDS_REVIEW")
        .when(experience["caps_at_consider"], "TARGET_ROLE_EXPERIENCE_STRETCH").otherwise("TARGET_ROLE_ELIGIBLE")
    )


def is_eligible(code: Column) -> Column:
    return code.isin("TARGET_ROLE_ELIGIBLE", "TARGET_ROLE_EXPERIENCE_STRETCH")


def needs_review(code: Column) -> Column:
    return code.isin("AMBIGUOUS_NEEDS_REVIEW", "LOW_CONFIDENCE")


def decision(score: Column, code: Column, caps: Column, resume_match: Column, gaps: Column, experience: Column, age_days: Column, hiring: Column) -> Column:
    """struct(verdict, code): gates, then score and blockers, then staleness, then core mismatch."""
    rounded, age = js_round(score), F.coalesce(age_days, L(0))
    core = (resume_match < 50) & (gaps >= 5)
    stale = (age > 60) & ~hiring
    blocked = F.coalesce(experience < 35, L(False)) | (gaps > 2) | core | caps | ((age > 30) & ~hiring)
    verdict = F.when(core | stale, "SKIP").when((rounded >= 75) & ~blocked, "APPLY").when(rounded >= 60, "CONSIDER").otherwise("SKIP")
    why = (
        F.when(core, "CORE_STACK_MISMATCH").when(stale, "STALE").when((rounded >= 75) & ~blocked, "TARGET_ROLE_ELIGIBLE")
        .when(rounded >= 60, F.when(caps, "TARGET_ROLE_EXPERIENCE_STRETCH").otherwise("TARGET_ROLE_ELIGIBLE")).otherwise("SCORE_BELOW_BAR")
    )
    shut = ~is_eligible(code)
    return F.struct(
        F.when(shut, F.when(needs_review(code), "NEEDS_REVIEW").otherwise("SKIP")).otherwise(verdict).alias("verdict"),
        F.when(shut, code).otherwise(why).alias("code"),
    )


def action_for(verdict: Column, role_fit: Column, stack: Column, resume_fit: Column, fit: Column, caps: Column) -> Column:
    strong = (role_fit >= 85) & (resume_fit >= 70)
    return (
        F.when(verdict == "APPLY", "APPLY_NOW").when(verdict == "SKIP", "SKIP").when(verdict == "NEEDS_REVIEW", "REVIEW_FIRST")
        .when(strong & caps, "WORTH_APPLYING").when(stack < 50, "LOW_PRIORITY").when(fit == "ADJACENT", "REVIEW_FIRST")
        .when(strong, "WORTH_APPLYING").otherwise("REVIEW_FIRST")
    )


# --- outreach, momentum, cost --------------------------------------------------------


def next_outreach(status: Column, days_since_contact: Column, days_since_nudge: Column, replied: Column, nudges: Column) -> Column:
    """struct(action, urgency): first nudge after 3 days, second 5 days later, then close."""
    waited = F.when(nudges == 0, days_since_contact).otherwise(F.coalesce(days_since_nudge, days_since_contact))
    due = F.when(nudges == 0, 3).otherwise(5)
    action = (
        F.when(replied, "RESPOND").when(status == "NEW", "CONTACT").when(status.isin("CLOSED", "DECLINED"), "NONE")
        .when(nudges >= 2, F.when(waited >= 5, "CLOSE").otherwise("AWAIT")).when(waited >= due, "FOLLOW_UP").otherwise("AWAIT")
    )
    urgency = F.when(action == "RESPOND", 3).when(action == "FOLLOW_UP", F.when(waited >= due + 3, 3).otherwise(2)).when(action == "CONTACT", 1).otherwise(0)
    return F.struct(action.alias("action"), urgency.alias("urgency"))


def momentum(points: Column) -> Column:
    return F.when(points >= 6, "VERY_HIGH").when(points >= 4, "HIGH").when(points >= 2, "MEDIUM").otherwise("LOW")


def token_cost(kind_price_in: Column, kind_price_out: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Decimal cost from prices per million tokens; null if a price is unknown."""
    return ((kind_price_in * tokens_in + kind_price_out * tokens_out) / L(1_000_000)).cast("decimal(10,6)")


def referral_rank(member: Column, recruiter: Column, leader: Column, email: Column, blog: Column, social: Column, shared: Column, hiring: Column, region: Column, contributions: Column) -> Column:
    role = F.when(recruiter, 12).when(leader, 10).otherwise(0)
    reach = F.when(email, 15).otherwise(0) + F.when(blog, 6).otherwise(0) + F.when(social, 4).otherwise(0)
    rest = F.least(L(20), shared * 5) + F.when(hiring, 8).otherwise(0) + F.when(region, 4).otherwise(0) + F.when(contributions >= 20, 4).otherwise(0)
    return (F.when(member, 45).otherwise(15) + role + reach + rest).cast("long")
