"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a whole run of 12 or more characters of A-Z a-z 0-9 + / _ - that holds a digit.
The forest sees its length, its character transitions (between classes, and pairs of letters
that are common in words), how much of it dictionary words cover, the path it lies in (of
the document, or the last one named before it) and the neighbouring words.  It is trained from labelled
findings; a seeded set of them is generated where none is given.

DataFrame and SQL functions and the JVM's own forest only; no text is shuffled and no
Python runs on executors.
"""

from __future__ import annotations

from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.scratch import stage

#: Looked for only where a run begins, so that a long run is read once.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{12,}"
#: A word that names a place in a file tree.
PATH_WORD = r"(?i)^[\"'(\[]?(\.{0,2}/)?([\w.\-]+/)+[\w\-]+\.[a-z]{1,5}\b"
WHITE = r"[\x20\x09-\x0D]+"
TREES, DEPTH, SEED, FINDINGS, THRESHOLD = 24, 7, 42, 6000, 0.5
#: Words before a candidate among which a path is looked for.
PATH_WORDS = 12

#: Words whose letters speak against a random string (fixed values).
DICTIONARY = (
    "about", "access", "account", "address", "admin", "after", "article", "backup", "before", "build", "cache", "chapter", "client", "config", "content",
    "copyright", "customer", "data", "database", "date", "default", "demo", "detail", "document", "domain", "download", "dummy", "edition", "email", "error",
    "event", "example", "fake", "field", "file", "folder", "format", "group", "header", "home", "house", "image", "index", "info", "invoice", "item",
    "label", "language", "level", "library", "license", "list", "local", "machine", "mail", "manager", "message", "model", "module", "name", "network", "news",
    "node", "number", "object", "office", "option", "order", "output", "page", "paragraph", "part", "people", "phone", "picture", "place", "placeholder", "point",
    "position", "product", "profile", "project", "public", "record", "reference", "release", "report", "request", "result", "route", "sample", "school", "script", "search",
    "section", "server", "service", "session", "source", "state", "status", "street", "string", "student", "style", "system", "table", "template", "test", "text",
    "thing", "time", "title", "update", "upload", "user", "value", "version", "video", "view", "water", "week", "window", "word", "work", "world", "year",
)
#: Pairs of letters that begin at least three places of dictionary words.
COMMON_PAIRS = tuple(sorted(p for p, n in Counter(w[i : i + 2] for w in DICTIONARY for i in range(len(w) - 1)).items() if n >= 3))
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "symbol": r"+/_\-"}
KEYWORD = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private|signing|aws|key)"
HARMLESS = r"(?i)(example|sample|dummy|test|fake|placeholder|commit|md5|sha1|sha256|checksum|digest|uuid|guid|version|build|isbn|page|order|invoice|ref|id|hash|etag|trace|request|phone|tel)"
TEST_PATH = r"(?i)(^|/)(tests?|examples?|samples?|docs?|fixtures?|mocks?|vendor|node_modules)(/|$)"
FEATURES = (
    "length", "digits", "uppers", "lowers", "symbols", "changes", "case_changes", "digit_runs", "vowels", "distinct_share", "hexadecimal", "covered",
    "common_pairs", *(f"{a}_to_{b}" for a in CLASSES for b in CLASSES), "test_path", "has_path", "inside_path", "keyword_here", "keyword_before", "keyword_near", "assigned", "quoted", "harmless_before", "harmless_after", "at_sign", "known_form",
)


def _share(text: Column, pattern: str, of: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / of


def features(candidate: Column, word: Column, before: Column, before2: Column, after: Column, path: Column) -> dict[str, Column]:
    """Feature columns; ``word`` is the run of non-space characters that holds the candidate."""
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    lead = F.call_function("substring_index", word, candidate, F.lit(1))
    covered = 1 - F.length(F.regexp_replace(F.lower(candidate), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / n
    changes = F.regexp_count(candidate, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")) / n
    case = F.regexp_count(candidate, F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z]{2})(?=[a-z])")) / n
    return {
        "length": n,
        "digits": _share(candidate, "[0-9]", n),
        "uppers": _share(candidate, "[A-Z]", n),
        "lowers": _share(candidate, "[a-z]", n),
        "symbols": _share(candidate, r"[+/_\-]", n),
        "changes": changes,
        "case_changes": case,
        "digit_runs": F.regexp_count(candidate, F.lit("[0-9]+")) / n,
        "vowels": _share(candidate, "[aeiouAEIOU]", n),
        "distinct_share": F.size(F.array_distinct(F.split(candidate, ""))) / n,
        "hexadecimal": flag(candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "covered": covered,
        "common_pairs": F.regexp_count(F.lower(candidate), F.lit(f"(?=({'|'.join(COMMON_PAIRS)}))")) / n,
        **{f"{a}_to_{b}": F.regexp_count(candidate, F.lit(f"(?<=[{x}])(?=[{y}])")) / n for a, x in CLASSES.items() for b, y in CLASSES.items()},
        "test_path": flag(path.rlike(TEST_PATH)),
        "has_path": flag(path.isNotNull()),
        "inside_path": flag(lead.rlike(r"[./\\]$")),
        "keyword_here": flag(lead.rlike(KEYWORD)),
        "keyword_before": flag(before.rlike(KEYWORD)),
        "keyword_near": flag(before2.rlike(KEYWORD)),
        "assigned": flag(lead.rlike(r"[=:]['\"]?$") | before.rlike(r"[=:]['\"]?$")),
        "quoted": flag(lead.rlike(r"['\"]$")),
        "harmless_before": flag(before.rlike(HARMLESS) | before2.rlike(HARMLESS) | lead.rlike(HARMLESS)),
        "harmless_after": flag(after.rlike(HARMLESS)),
        "at_sign": flag(word.contains("@")),
        "known_form": flag(candidate.rlike(r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk_(live|test)_[A-Za-z0-9]{16,}$|^AIza[0-9A-Za-z_\-]{35}$|^xox[abp]-")),
    }


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """doc_id, word_pos (from 0), nth (within the word), candidate, word, before, before2, after, path."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__t"), path.alias("path")).where(F.col("__t").rlike(CANDIDATE))
    words = F.split(F.regexp_replace("__t", f"^{WHITE}", ""), WHITE)
    numbered = F.filter(F.transform("__w", lambda w, i: F.when(F.length(w) >= 12, F.when(w.rlike(CANDIDATE), i))), lambda i: i.isNotNull())
    hits = rows.select("doc_id", "path", words.alias("__w")).withColumn("word_pos", F.explode(numbered))
    at = lambda d: F.coalesce(F.get("__w", F.col("word_pos") + d), F.lit(""))
    # without a path of the document, the last path among the words before
    lately = F.filter(F.slice("__w", F.greatest(F.col("word_pos") - PATH_WORDS + 1, F.lit(1)), F.least(F.col("word_pos"), F.lit(PATH_WORDS))), lambda w: w.rlike(PATH_WORD))
    told = F.coalesce("path", F.when(F.col("word_pos") > 0, F.element_at(lately, F.when(F.size(lately) > 0, -1))))
    hits = hits.select("doc_id", told.alias("path"), F.col("word_pos").cast("long").alias("word_pos"), at(0).alias("word"), at(-1).alias("before"), at(-2).alias("before2"), at(1).alias("after"))
    return hits.select("*", F.posexplode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).alias("nth", "candidate"))


def generated_findings(spark: SparkSession, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """Labelled findings (candidate, word, before, before2, after, path, label) by rule from a seed.

    Secrets: random keys of common forms, mostly beside a word that names them.  Others:
    checksums and commits, request ids, numbers, dates, file names, versions, dictionary
    words with digits, placeholders.
    """
    pick = lambda k, *options: F.element_at(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(len(options))) + 1).cast("int"))
    hexa = lambda k: F.sha2(F.concat(F.lit(f"{seed}/{k}/"), F.col("id").cast("string")), 512)
    base = F.regexp_replace(F.concat(F.base64(F.unhex(hexa("b"))), F.base64(F.unhex(hexa("c")))), "=", "")
    alnum = F.regexp_replace(base, r"[+/]", "")
    upper = F.upper(alnum)
    word = lambda k: pick(k, *DICTIONARY[::3])
    number = lambda k, m: F.regexp_replace(F.conv(F.substring(hexa(k), 1, 15), 16, 10), r"^", "").substr(1, m)
    secret_word = pick("sw", "token", "password", "secret", "api_key", "access_key", "auth", "passwd", "apikey", "credential")
    plain = pick("plain", "the", "of", "and", "in", "la", "und", "de", "with", "was", "to")
    plain2 = pick("plain2", "the", "of", "and", "in", "la", "und", "de", "with", "was", "to")
    benign = pick("benign", "commit", "md5", "sha256", "checksum", "uuid", "request", "trace", "etag", "build", "digest")
    quote = pick("quote", '"', "'", "")
    form = F.pmod(F.xxhash64(F.lit(seed), F.lit("form"), "id"), F.lit(16))
    s = lambda cand, lead, b, b2, label, path=None: F.struct(cand.alias("candidate"), F.concat(lead, cand, pick("tail", "", '"', ",", ".", '"', "")).alias("word"), b.alias("before"), b2.alias("before2"), plain2.alias("after"), (path if path is not None else pick("path", "src/app.py", "config/prod.env", "deploy/values.yml")).alias("path"), F.lit(label).alias("label"))
    test_path = pick("tp", "tests/test_app.py", "docs/guide.md", "examples/demo.py", "fixtures/data.json")
    L = F.lit
    kinds = [
        s(F.concat(L("AKIA"), F.substring(upper, 1, 16)), L(""), plain, plain2, 1),
        s(F.substring(hexa("d"), 1, 40), quote, L("="), secret_word, 1),
        s(F.substring(hexa("e"), 1, 16), F.concat(secret_word, L("="), quote), plain, plain2, 1),
        s(F.substring(alnum, 1, 24), F.concat(secret_word, L(":"), quote), plain, plain2, 1),
        s(F.substring(base, 1, 40), quote, L(":"), secret_word, 1),
        s(F.concat(L("ghp_"), F.substring(alnum, 1, 36)), L(""), pick("gb", "bearer", "the", "token", "use"), plain2, 1),
        s(F.concat(L("sk_live_"), F.substring(alnum, 1, 24)), quote, L("="), secret_word, 1),
        s(F.substring(alnum, 1, 32), F.concat(secret_word, L("="), quote), plain, plain2, 1),
        s(F.substring(hexa("f"), 1, 40), L(""), benign, plain2, 0),
        s(F.substring(hexa("g"), 1, 32), F.concat(benign, L(":")), plain, plain2, 0),
        s(F.regexp_replace(F.substring(hexa("h"), 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), L(""), benign, plain2, 0),
        s(F.lpad(number("i", 16), 16, "7"), pick("nl", "", "", "no."), plain, plain2, 0),
        s(F.concat(L("20"), number("j", 2), L("-0"), number("k", 1), L("-1"), number("l", 1), L("T1"), number("m", 1)), L(""), plain, plain2, 0),
        s(F.concat(word("n"), L("_"), word("o"), L("_"), number("p", 3)), pick("pl", "/", "", "img/"), plain, plain2, 0),
        s(F.concat(word("q"), word("r"), number("s", 2)), L(""), plain, plain2, 0),
        s(F.concat(pick("ph", "EXAMPLE", "YOUR-KEY-", "xxxxxxxx", "0000000000", "changeme"), L("1234567890")), F.concat(secret_word, L("=")), plain, plain2, 0, test_path),
    ]
    return spark.range(0, n, 1, 1).withColumn("f", F.element_at(F.array(*kinds), (form + 1).cast("int"))).select("f.*")


def _assembled(rows: DataFrame) -> DataFrame:
    c = features(*[F.coalesce(F.col(x), F.lit("")) for x in ("candidate", "word", "before", "before2", "after")], F.col("path"))
    return VectorAssembler(inputCols=[f"__f_{k}" for k in FEATURES], outputCol="__features").transform(rows.select("*", *[c[k].cast("double").alias(f"__f_{k}") for k in FEATURES]))


def train(findings: DataFrame, *, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A forest from labelled findings; ``path`` is dropped for every other one so that the forest can do without.

    Findings are a labelled set of bounded size; they are brought to one partition so that
    the fit does not depend on the cluster.
    """
    # staged, so that the plans of the fit do not carry how the findings were made
    rows = stage(findings, "findings").withColumn("path", F.when(F.pmod(F.xxhash64(F.lit(seed), "candidate"), F.lit(2)) == 0, F.col("path"))).where("label in (0, 1)")
    rows = _assembled(rows).select("__features", F.col("label").cast("double").alias("label")).repartition(1)
    return RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, featureSubsetStrategy="sqrt").fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: doc_id, word_pos, nth, candidate, score, is_secret.

    Null and empty texts have no candidates; a very long word is read once; repeated rows give repeated findings; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = _assembled(candidates(docs, id_col, text_col, path_col))
    scored = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), 1))
    return scored.select("doc_id", "word_pos", F.col("nth").cast("long").alias("nth"), "candidate", F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))
