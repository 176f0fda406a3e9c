import itertools
import random

import numpy as np

from siftline.llm import simhash
from tests.llm.brute import components, simhash_fingerprint


def shingles(text, size=5):
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain(docs, least=0.8):
    """Groups of two or more by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    comp = components(list(sets), links)
    many = {c for i, c in comp.items() if c != i}
    return {i: c for i, c in comp.items() if c in many}


def found(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.id: r.component_id for r in simhash.near_copies(df).collect()}


def test_crowd_links_join_what_all_pairs_join():
    rng = np.random.default_rng(3)
    for _ in range(20):
        template = rng.choice(4000, 150, replace=False)
        sets = []
        for _ in range(20):
            base = np.concatenate([template, rng.choice(np.arange(4000, 9000), 150, replace=False)])
            sets += [np.unique(np.concatenate([base[rng.permutation(300)[:n]], rng.choice(np.arange(9000, 20000), 300 - n)])).astype(np.uint32) for n in (300, 278, 278, 270)]
        links = [(a, b) for a, b in itertools.combinations(range(80), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
        part = np.arange(80) // 3 * 3 if _ % 2 else np.arange(80)
        a, b = simhash.crowd_links(part, sets, 0.8)
        joined = list(zip(a.tolist(), b.tolist(), strict=True))
        assert all(tuple(sorted(x)) in links for x in joined)
        same = [(i, int(p)) for i, p in enumerate(part)]
        assert components(list(range(80)), joined + same) == components(list(range(80)), links + same)


def test_crowded_template(spark, monkeypatch):
    rng = random.Random(7)
    template = ["t%d" % i for i in range(160)]
    docs = []
    for _ in range(300):
        own = ["w%d" % rng.randrange(10**6) for _ in range(40)]
        for _ in range(2):
            copy = list(own)
            copy[rng.randrange(40)] = "edit%d" % len(docs)
            docs.append((len(docs), " ".join(template + copy)))
    rng.shuffle(docs)
    want = plain(docs)
    assert sum(i != c for i, c in want.items()) >= 300
    assert found(spark, docs) == want
    monkeypatch.setattr(simhash, "CROWD_BLOCK", 100)
    assert found(spark, docs) == want


def test_equal_fingerprints_are_verified(spark):
    rng = random.Random(1)
    line = " ".join("r%d" % i for i in range(11))
    docs = [(i, " ".join([line] * 200 + ["w%d" % rng.randrange(10**6) for _ in range(100)])) for i in range(12)]
    docs += [(12, docs[3][1].upper()), (13, docs[5][1] + " " + line), (14, None), (15, " ")]
    assert len({simhash.fingerprint(t.encode()) for _, t in docs[:12]}) < 12
    assert found(spark, docs) == plain([(i, t or "") for i, t in docs[:14]]) | {14: 14, 15: 14}


def test_pairs_at_the_threshold(spark):
    rng = random.Random(4)
    docs, planted = [], 0
    for _ in range(300):
        n = rng.choice((100, 300, 1000))
        base = ["w%d" % rng.randrange(10**6) for _ in range(n)]
        copy = list(base)
        while True:
            more = list(copy)
            more[rng.randrange(n)] = "e%d" % rng.randrange(10**6)
            a, b = shingles(" ".join(base)), shingles(" ".join(more))
            s = len(a & b) / len(a | b)
            if s < 0.8:
                break
            copy = more
        a, b = shingles(" ".join(base)), shingles(" ".join(copy))
        planted += 0.8 <= len(a & b) / len(a | b) < 0.9
        docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(copy))]
    assert planted >= 280
    assert found(spark, docs) == {i: i - i % 2 for i, _ in docs}


def test_fingerprints_are_candidates_by_the_distance_table(spark, monkeypatch):
    rng = random.Random(9)
    docs = []
    for edits in (0, 1, 1, 2, 2, 4, 8, 40) * 5:
        base = ["w%d" % rng.randrange(10**6) for _ in range(400)]
        copy = list(base)
        for at in rng.sample(range(400), edits):
            copy[at] = "e%d" % rng.randrange(10**6)
        docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join([*copy, "end"]))]
    docs += [(len(docs), docs[0][1].upper())]
    fps = [simhash_fingerprint(t, 3) for _, t in docs]
    within = {i for i in range(0, len(docs) - 1, 2) if bin(fps[i] ^ fps[i + 1]).count("1") <= 5}
    whole = plain(docs)
    assert 5 <= len(within) < sum(i != c for i, c in whole.items()) - 1
    assert found(spark, docs) == whole
    # without least-shingle keys, what the distance table of SimHash finds is left
    monkeypatch.setattr(simhash, "_spread_keys", lambda batches: iter(()))
    sure = {i: c for i, c in whole.items() if i - i % 2 in within} | {0: 0, len(docs) - 1: 0}
    assert sure.items() <= found(spark, docs).items() <= whole.items()
