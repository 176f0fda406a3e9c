import math
import re
from collections import Counter

from siftline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    found = [(i, Counter(split(t))) for i, t in docs]
    n = sum(1 for _, c in found if c)
    total = sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    out = []
    for item, text in sorted({(i, t or "") for i, t in items if i is not None}):
        ranked = []
        for i, c in found:
            score = 0
            for w in split(text):
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    m = 100 - 75 + (75 * sum(c.values()) * n) // total
                    score += weight * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                ranked.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as term", "'x' as window", "2 as item_id", "3L as score")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as doc_id", "7 as rank")
    got = lexical.search(d.repartition(3), q, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


ODD = "Straße ÉTÉ été x\x7fy [a]`b`{c}~d 10-20 ½ z z  k K İ"
DOCS = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 3 + i % 23))) for i in range(300)] + [
    (5000, ODD), (9000, None), (9001, ""), (9002, " .,; "), (-7, "w1 W1 w1"), (5000, "w1 w2 w3"), (5000, "w1 w2 w3"), (None, "w1 w2 w3"), (None, ODD), (1 << 40, "rare w3 " * 5000), (4095, "tie word"), (4096, "tie word"), (8, "tie word")]
ITEMS = [(1, "w1 w2 w2 W3, w16"), (2, ODD), (3, "nothing-of-this"), (4, None), (5, "rare"), (6, "tie word"), (None, "w1"), (1, "w1 w2 w2 W3, w16"), (8, "w5 " * 3000)]


def test_equals_brute_force(spark):
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_small_windows_blocks_and_heaps(spark):
    for kw in ({"window": 3}, {"window": 1, "k": 2}, {"block_bytes": 12}):
        assert run(spark, DOCS, ITEMS, **kw) == brute(DOCS, ITEMS, kw.get("k", 10))


def test_one_id_for_most_rows(spark):
    docs = [(7, f"a b{i % 5} c") for i in range(400)] + [(None, "a c")] * 50 + [(i, "a") for i in range(20, 30)]
    assert run(spark, docs, [(1, "a b1"), (2, "c")], window=16, k=60) == brute(docs, [(1, "a b1"), (2, "c")], 60)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == [] and run(spark, DOCS, []) == [] and run(spark, [(1, None)], ITEMS) == []
