import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from siftline.llm import turns
from tests.llm.brute import words


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + mine[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own_tokens = (len(members[p]) - 1) * len(words(p[-1][1])) if p else 0
        saved[p] = own_tokens + sum(saved[x] for x in children[p])
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items()), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "'x' as n", "2 as piece", "3 as part", "4 as ends")
    got = turns.prefix_trie(df.repartition(5))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations(seed, n, longest, kinds):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 2), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(("user", "assistant")), f"t{rng.randrange(kinds)} some words"))
    return rows


@pytest.mark.parametrize(("seed", "n", "longest", "kinds"), [(1, 200, 7, 2), (2, 60, 40, 1), (3, 120, 5, 50)])
def test_equals_brute_force(spark, seed, n, longest, kinds):
    rows = conversations(seed, n, longest, kinds)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = conversations(4, 60, 5, 3) + [
        (7, None, None, None), (7, 3, "user", None), (7, -5, None, "a  b\tc"), (None, 1, "user", "x"), (400, 1, "u", ""), (401, 1 << 40, "u", "z"), (401, 1, "u", "y"), (402, None, "user", "no turn"),
        (403, 2, "user", "same")] + [(403, 2, "user", "same")] * 6 + [(440, 1, "user", "w " * 50_000), (441, 1, "user", "w " * 50_000), (10**12, 0, "u", "far")]
    assert run(spark, rows) == brute(rows)


def test_one_conversation_and_one_start_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(turns, "PIECE", 16)
    monkeypatch.setattr(turns, "END_BLOCK", 8)
    monkeypatch.setattr(turns, "HELD_ROWS", 64)
    monkeypatch.setattr(turns, "FAN", 2)
    rows = [(3, t, "user", f"long {t % 3}") for t in range(300)] + [(c, t, "user", f"start {t}") for c in range(20, 160) for t in range(4)] + conversations(5, 40, 6, 2)
    rows = [r for r in rows if r[0] != 3 or r[3].startswith("long")]
    assert run(spark, rows) == brute(rows)


def test_deep_common_path(spark):
    rows = [(c, t, "user", f"deep {t}") for c in (20, 21, 22, 23, 24) for t in range(70 + c)]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_single_conversation(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, 0, "u", "a b")]) == brute([(5, 0, "u", "a b")])
