"""Short lines for people: places, freshness, pay, competition, the week's momentum (TXT-26, SCO-26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.documents import indian_number

L = F.lit
# Cities in the order in which they are looked for, and the tags of ways to work.
CITIES = (
    "Bengaluru", "Bangalore", "Mumbai", "Pune", "New Delhi", "Delhi NCR", "Delhi", "Hyderabad", "Chennai", "Noida", "Gurgaon", "Gurugram", "Indore", "Kolkata", "Ahmedabad", "Jaipur", "Kochi", "Trivandrum", "Chandigarh",
)
MODES = {"REMOTE": "🏠 Remote", "HYBRID": "🏢 Hybrid", "ONSITE": "🏢 Onsite"}
# Most points that interviews, replies and threads give, points of one, and the points of the levels.
MOMENTUM_POINTS = {"interviews": (3, 4), "replies": (2, 2), "outreach": (1, 2)}
MOMENTUM_LEVELS = (("VERY_HIGH", 6), ("HIGH", 4), ("MEDIUM", 2))


def location_tags(location: Column, mode: Column) -> Column:
    """The first known city, else India, else the place itself, then how one works there."""
    place = F.nullif(location, L(""))
    city = F.get(F.filter(F.array(*map(L, CITIES)), lambda c: F.contains(F.lower(place), F.lower(c))), 0)
    where = F.when(place.isNull(), None).when(city.isNotNull(), F.concat(L("📍 "), city)).when(place.rlike("(?i)india"), "📍 India").otherwise(F.concat(L("🌍 "), place))
    way = F.coalesce(mode, F.when(place.rlike("(?i)remote"), "REMOTE"))
    return F.concat_ws(" · ", where, F.try_element_at(F.create_map(*[L(x) for kv in MODES.items() for x in kv]), way))


def freshness(age_days: Column) -> Column:
    """From whole days since posting."""
    told = F.concat(L("Posted "), age_days.cast("string"), L(" days ago"))
    return F.when(age_days <= 0, "🔥 Posted today").when(age_days == 1, "🔥 Posted yesterday").when(age_days <= 7, F.concat(L("🟡 "), told)).otherwise(F.concat(L("⚪ "), told))


def salary(low: Column, high: Column, currency: Column) -> Column:
    """Pay as listed, never estimated."""
    start = F.concat(L("💰 "), F.coalesce(currency, L("")), L(" "))
    one = F.concat(start, indian_number(F.coalesce(low, high)), F.when(low.isNotNull(), "+").otherwise(""))
    both = F.concat(start, indian_number(low), L("–"), indian_number(high))
    return F.when(low.isNull() & high.isNull(), "💰 Salary not listed").when(low.isNotNull() & high.isNotNull(), both).otherwise(one)


def competition(age_days: Column) -> Column:
    return F.when(age_days <= 3, F.array(L("Fresh"), L("Low competition"))).when(age_days <= 10, F.array(L("Recent"))).when(age_days >= 25, F.array(L("Older posting"))).otherwise(F.array().cast("array<string>"))


def impact(stars: Column, first: Column) -> Column:
    return F.when(first, "DO_FIRST").when(stars >= 4, "HIGH").when(stars == 3, "MEDIUM").otherwise("LOW")


def week_momentum(interviews: Column, replies: Column, outreach: Column, fresh: Column, active: Column) -> Column:
    """struct(level, reason): motion of the week, never a number that pretends to be a probability."""
    counts = {"interviews": interviews, "replies": replies, "outreach": outreach}
    points = F.when(fresh > 0, 1).otherwise(0) + F.when(active > 0, 1).otherwise(0)
    for name, (each, most) in MOMENTUM_POINTS.items():
        points = points + F.least(L(most), counts[name] * each)
    level = L("LOW")
    for name, least in MOMENTUM_LEVELS[::-1]:
        level = F.when(points >= least, name).otherwise(level)
    many = lambda n, one, more: F.concat(n.cast("string"), F.when(n > 1, more).otherwise(one))
    reason = (
        F.when(interviews > 0, many(interviews, " interview/assessment in progress", " interviews/assessments in progress")).when(replies > 0, many(replies, " reply waiting on you", " replies waiting on you"))
        .when(outreach > 0, many(outreach, " outreach thread in flight", " outreach threads in flight")).when(fresh > 0, many(fresh, " strong fresh match to apply to", " strong fresh matches to apply to"))
        .otherwise("warming up — get an application or a referral in motion"))
    return F.struct(level.alias("level"), reason.alias("reason"))
