import itertools

import numpy as np
import pytest

from siftline.llm import simhash
from tests.llm.brute import components, simhash_fingerprint


def test_neighbour_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set(base.tolist())
    for _ in range(400):
        x = int(rng.choice(sorted(fps)))
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            x ^= 1 << int(b)
        fps.add(x)
    arr = np.array(sorted(fps), np.uint64)
    a, b = simhash._links_by_neighbours(arr)
    assert (np.bitwise_count(arr[a] ^ arr[b]) <= 2).all()
    pairs = [(i, j) for i, j in itertools.combinations(range(len(arr)), 2) if bin(int(arr[i]) ^ int(arr[j])).count("1") <= 2]
    assert components(range(len(arr)), pairs) == components(range(len(arr)), zip(a.tolist(), b.tolist()))


def test_every_pair_within_two_bits_shares_a_key():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(300):
        for b in rng.choice(64, 2, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    same = simhash.table_keys(x, 5, 3) == simhash.table_keys(y, 5, 3)
    assert same.any(1).all()
    assert simhash.table_keys(x, 5, 3).shape == (300, 10)


@pytest.mark.parametrize("text", ["", "  \t ", "One", "one two", "A b C d é A b C", "x " * 50])
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == simhash_fingerprint(text, 3)


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 4)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(50)]
    docs = []
    for g in range(8):
        words = rng.choice(vocabulary, 120).tolist()
        for c in range(int(rng.integers(1, 12))):
            w = list(words)
            for p in rng.integers(0, len(w), c % 4):
                w[int(p)] = "edit%d" % p
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "two words"), (None, "alone and without id"), (5, docs[5][1])]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, fp string, component_id int")
    got = {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(df).collect()}
    fps = {i: simhash_fingerprint(t or "", 3) for i, t in docs}
    ids = [i for i in fps if i is not None]
    pairs = [(a, b) for a, b in itertools.combinations(ids, 2) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    comp = components(ids, pairs)
    want = {(i, fps[i], comp[i]) for i in ids} | {(None, fps[None], None)}
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(df).count() == 0
