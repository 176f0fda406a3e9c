"""Technology names: aliases to canonical tokens, and what a job asks against what a person has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.common import js_round

L = F.lit

# Spelling -> canonical token.
ALIASES: dict[str, str] = {
    "js": "javascript", "javascript": "javascript", "java script": "javascript", "ecmascript": "javascript", "es6": "javascript", "es6+": "javascript",
    "es2015": "javascript", "ts": "typescript", "typescript": "typescript", "node": "node", "nodejs": "node", "node.js": "node", "node js": "node", "express": "express",
    "expressjs": "express", "express.js": "express", "express js": "express", "react": "react", "reactjs": "react", "react.js": "react", "react js": "react",
    "react native": "react-native", "react-native": "react-native", "reactnative": "react-native", "nextjs": "nextjs", "next.js": "nextjs", "java": "java",
    "core java": "java", "j2ee": "java", "spring": "java", "spring boot": "java", "hibernate": "java", "kotlin": "kotlin", "swift": "swift", "c": "c", "c++": "cpp",
    "cpp": "cpp", "c#": "csharp", "csharp": "csharp", ".net": "dotnet", "dotnet": "dotnet", "asp.net": "dotnet", "go": "go", "golang": "go", "rust": "rust",
    "scala": "scala", "python": "python", "django": "python", "flask": "python", "fastapi": "python", "php": "php", "ruby": "ruby", "rails": "ruby", "sql": "sql",
    "mysql": "mysql", "postgres": "postgres", "postgresql": "postgres", "mongodb": "mongodb", "mongo": "mongodb", "redis": "redis", "cassandra": "cassandra",
    "elasticsearch": "elasticsearch", "aerospike": "aerospike", "dynamodb": "dynamodb", "html": "html", "html5": "html", "css": "css", "css3": "css", "sass": "css",
    "rest": "rest", "rest api": "rest", "rest apis": "rest", "restful api": "rest", "restful apis": "rest", "api": "rest", "apis": "rest", "graphql": "graphql",
    "socket.io": "socketio", "socketio": "socketio", "websockets": "socketio", "jwt": "jwt", "oauth": "oauth", "oauth 2.0": "oauth", "aws": "aws", "ec2": "aws",
    "azure": "azure", "gcp": "gcp", "google cloud": "gcp", "docker": "docker", "kubernetes": "kubernetes", "k8s": "kubernetes", "nginx": "nginx", "pm2": "pm2",
    "terraform": "terraform", "jenkins": "jenkins", "git": "git", "linux": "linux", "android": "android", "gradle": "android", "ios": "ios", "xcode": "ios",
    "flutter": "flutter", "llm": "llm", "llms": "llm", "openai": "llm", "anthropic": "llm", "langchain": "llm", "crewai": "llm", "prompt engineering": "llm",
    "pytorch": "ml", "tensorflow": "ml", "machine learning": "ml", "kafka": "kafka", "spark": "spark", "hadoop": "hadoop", "airflow": "airflow", "dbt": "dbt",
    "power bi": "powerbi", "powerbi": "powerbi", "tableau": "tableau", "sap": "sap", "salesforce": "salesforce",
}
# Spellings that are ordinary words and count only as a whole skill.
AMBIGUOUS = ("go", "c", "api", "apis", "express", "node", "rest", "sql", "ml", "spring", "swift", "rails", "flask", "ruby", "php", "java", "react", "js", "ts")
# What partly prepares for what.
TRANSFERABLE: dict[str, tuple[str, ...]] = {
    "react-native": ("react", "javascript", "flutter"), "postgres": ("mysql", "sql"), "sql": ("mysql", "postgres"), "mongodb": ("mysql",), "typescript": ("javascript",),
    "nextjs": ("react",), "graphql": ("rest",), "azure": ("aws",), "gcp": ("aws",),
}
# Disciplines in order of precedence.
DISCIPLINES = {
    "dotnet": ".NET / C#", "php": "PHP", "java": "Java", "python": "Python", "ruby": "Ruby / Rails", "go": "Go", "rust": "Rust", "scala": "Scala", "cpp": "C / C++",
    "react-native": "React Native (mobile)", "android": "Android (mobile)", "ios": "iOS (mobile)", "flutter": "Flutter (mobile)", "ml": "Machine Learning / AI", "llm": "LLM / AI",
    "kafka": "Data / Streaming", "spark": "Big Data", "hadoop": "Big Data", "salesforce": "Salesforce", "sap": "SAP",
}
# Technologies that mark another discipline.
MARKERS = (
    "react-native", "android", "ios", "swift", "kotlin", "flutter", "java", "python", "go", "rust", "scala", "cpp", "csharp", "dotnet", "php", "ruby",
    "llm", "ml", "kafka", "spark", "hadoop", "powerbi", "tableau", "sap", "salesforce",
)

_MOST_WORDS = max(len(a.split(" ")) for a in ALIASES)
_PHRASES = sorted((a for a in ALIASES if a not in AMBIGUOUS), key=lambda a: -len(a))


def _map(pairs: dict) -> Column:
    return F.create_map(*[L(x) for kv in pairs.items() for x in kv])


def canonical(skill: Column) -> Column:
    """Canonical token of a skill, null if unknown: the whole text, else its longest unambiguous alias phrase.

    Phrases are looked up by the runs of words that the text has, as many words as an alias
    may have, and not one after another in the text.
    """
    s = F.regexp_replace(F.lower(F.trim(skill)), r"\(.*?\)", " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9+#. \-]", " "), r"\s+", " "))
    words, ranks = F.split(s, " "), _map({a: n for n, a in enumerate(_PHRASES)})
    runs = [F.when(F.size(words) >= n, F.transform(F.sequence(L(1), F.size(words) - (n - 1)), lambda i, n=n: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>")) for n in range(1, _MOST_WORDS + 1)]
    longest = F.array_min(F.transform(F.concat(*runs), lambda run: F.try_element_at(ranks, run)))
    return F.coalesce(F.try_element_at(_map(ALIASES), s), F.when(F.size(words) > 1, F.try_element_at(_map({n: ALIASES[a] for n, a in enumerate(_PHRASES)}), longest)))


def canonical_all(skills: Column) -> Column:
    """Distinct known tokens of an array of skills."""
    return F.array_distinct(F.array_compact(F.transform(skills, canonical)))


def canonical_table(skills: DataFrame) -> DataFrame:
    """(raw, tech) of the distinct spellings in column ``raw``: each is looked up once, however many rows have it."""
    known = F.array_compact(F.array(canonical(F.col("raw"))))  # a filter would take the token twice
    return skills.select("raw").distinct().select("raw", F.explode(known).alias("tech"))


def _asked(df: DataFrame, id_col: str, wanted_col: str, mine: tuple[str, ...]) -> DataFrame:
    """id, pos, raw, tech, kind of the known skills of each row, distinct by spelling."""
    asked = df.select(id_col, F.posexplode(F.array_distinct(wanted_col)).alias("pos", "raw"))
    reach = tuple(k for k, v in TRANSFERABLE.items() if set(v) & set(mine))
    tech = F.col("tech")
    return asked.join(canonical_table(asked), "raw").withColumn("kind", F.when(tech.isin(*mine), "strong").when(tech.isin(*reach), "transferable").otherwise("missing"))


def specialization(df: DataFrame, id_col: str, wanted_col: str, mine: tuple[str, ...]) -> DataFrame:
    """id, fit, strong, transferable, missing, off_path of each row's array of skills against canonical tokens ``mine``.

    Skills are distinct by spelling; unknown ones do not count; fit is null if none is
    known.  off_path is the first discipline, in order, that is asked for and not in ``mine``.
    """
    known, tech = _asked(df, id_col, wanted_col, mine), F.col("tech")
    order = F.when(~tech.isin(*mine), F.try_element_at(_map({k: n for n, k in enumerate(DISCIPLINES)}), tech))
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "raw")))), lambda s: s["raw"]).alias(k)
    per = known.withColumn("order", order).groupBy(id_col).agg(F.count(L(1)).alias("n"), *[listed(k) for k in ("strong", "transferable", "missing")], F.min("order").alias("order"))
    none = F.array().cast("array<string>")
    out = df.select(id_col).join(per, id_col, "left")
    fit = js_round((F.size("strong") + 0.5 * F.size("transferable")) / F.col("n") * 100)
    off = F.get(F.array(*map(L, DISCIPLINES)), F.col("order"))
    return out.select(id_col, fit.alias("fit"), *[F.coalesce(k, none).alias(k) for k in ("strong", "transferable", "missing")], off.alias("off_path"))


def names_foreign_discipline(wanted: Column) -> Column:
    return F.arrays_overlap(canonical_all(wanted), F.array(*map(L, MARKERS)))


def what_if(df: DataFrame, id_col: str, wanted_col: str, mine: tuple[str, ...], most: int = 5) -> DataFrame:
    """id, what_if: array<struct<gain, skill>>: what each skill not in ``mine`` would add to the fit, gains above 0.

    The fit is taken anew with each skill: other spellings of it become strong too, and
    missing skills that it prepares for become transferable.  Largest gains first; of equal
    ones missing skills before transferable ones, each in the order asked for.
    """
    prepares = F.create_map(*[x for k, v in TRANSFERABLE.items() for x in (L(k), F.array(*map(L, v)))])
    rows = _asked(df, id_col, wanted_col, mine).withColumn("near", F.coalesce(F.try_element_at(prepares, F.col("tech")), F.array().cast("array<string>")))
    rank = F.when(F.col("kind") == "missing", 0).otherwise(1).alias("rank")
    per = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(rank, "pos", "raw", "tech", "kind", "near"))).alias("all"))

    def fit(strong, transferable):
        count = lambda of: F.size(F.filter("all", of))
        return js_round((count(strong) + 0.5 * count(lambda s: ~strong(s) & transferable(s))) / F.size("all") * 100)

    has = lambda s: s["kind"] == "strong"
    half = lambda s: s["kind"] == "transferable"
    per = per.withColumn("now", fit(has, half))
    lost = lambda c: F.col("now") - fit(lambda s: has(s) | (s["tech"] == c["tech"]), lambda s: half(s) | F.array_contains(s["near"], c["tech"]))
    told = F.transform(F.filter("all", lambda c: ~has(c)), lambda c, at: F.struct(lost(c).alias("lost"), at.alias("at"), c["raw"].alias("skill")))
    best = F.slice(F.array_sort(F.filter(told, lambda x: x["lost"] < 0)), 1, most)
    gains = F.transform(best, lambda x: F.struct((-x["lost"]).alias("gain"), x["skill"].alias("skill")))
    return df.select(id_col).join(per.select(id_col, gains.alias("what_if")), id_col, "left").withColumn("what_if", F.coalesce("what_if", F.array().cast("array<struct<gain:bigint,skill:string>>")))
