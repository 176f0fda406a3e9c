"""Very long texts through the operators that read texts whole."""

import hashlib

from siftline.llm import exact_dedup, lexical, mixing, simhash
from tests.llm.brute import ascii_lower, simhash_fingerprint, words

LONG = "Word ß " * 150_000  # some 1.2 MB
ROWS = [(1, LONG, "a"), (2, LONG.upper().replace("SS", "ß"), "a"), (3, LONG + "end", "b"), (4, "x" * 1_000_000, "b"), (5, "short text", "b"), (6, None, None), (7, "", "a")]


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


def test_exact_groups(spark):
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(frame(spark), digest_all=True).collect()}
    same = {}
    for i, t, _ in ROWS:
        same.setdefault(ascii_lower(t or ""), []).append(i)
    assert got == {i: (max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in same.items() for i in ids}
    assert got[1][0] == 2 and got[3][1] == 1


def test_mixing(spark):
    _, documents = mixing.mix(frame(spark))
    rows = {r.doc_id if "doc_id" in r.asDict() else r.id: r for r in documents.collect()}
    assert {i: r.size for i, r in rows.items()} == {i: len(words(t or "")) for i, t, _ in ROWS}
    assert all(0 <= r.taken <= 3 * r.size for r in rows.values())


def test_simhash(spark):
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(frame(spark)).collect()}
    assert {i: fp for i, (fp, _) in got.items()} == {i: simhash_fingerprint(t or "", 3) for i, t, _ in ROWS}
    assert got[1][1] == got[2][1] == 1


def test_lexical(spark):
    got = lexical.search(frame(spark).select("doc_id", "text"), spark.createDataFrame([(1, "end"), (2, LONG)], "item_id long, text string")).collect()
    assert sorted((r.item_id, r.doc_id) for r in got if r["rank"] == 1)[0] == (1, 3) and {r.doc_id for r in got if r.item_id == 2} <= {1, 2, 3}
