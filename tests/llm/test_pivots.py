import itertools

import numpy as np
import pytest

from siftline.llm import pivots
from tests.llm.brute import components


def brute(rows, threshold=0.93):
    ok = {}
    for n, (i, v, lab) in enumerate(rows):
        if i is None or lab is None or not v or any(e is None or not np.isfinite(e) for e in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(np.float64)
        ok[n] = (lab, x / np.linalg.norm(x))
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= threshold]
    return links


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for lab in (0, 1, None):
        for g in range(40):
            base = rng.normal(size=16)
            for c in range(60 if g == 0 else int(rng.integers(1, 5))):
                rows.append((len(rows), (base + rng.normal(size=16) * 0.03).tolist(), lab))
        rows += [(len(rows) + k, rows[-1][1], lab) for k in range(5)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, [float("nan")] + [1.0] * 15, 1), (n + 5, [float("inf")] + [1.0] * 15, 1), (n + 6, [1.0, 2.0], 1), (n + 7, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as component_id", "'x' as mult")
    got = pivots.near_vectors(df).collect()
    assert len(got) == len(rows)
    links = brute(rows)
    degree = dict.fromkeys(range(len(rows)), 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    by_id = {r.vec_id: r for r in got if r.vec_id is not None}
    found = sum(r.n_links for r in got)
    assert found >= 0.97 * 2 * len(links)
    assert all(by_id[rows[i][0]].n_links <= d for i, d in degree.items() if rows[i][0] is not None)
    comp = components(range(len(rows)), links)
    same = [by_id[i].component_id == comp[i] for i in by_id]
    assert sum(same) >= 0.97 * len(same)
    for i in range(n, n + 6):
        assert (by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert by_id[n + 6].n_links == 1 and by_id[n + 7].component_id == n + 6
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]


def test_empty_table(spark):
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_recall_does_not_depend_on_the_number_of_pivots():
    rng, unit = np.random.default_rng(1), lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(2000, 64)))
    z = rng.normal(size=x.shape)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * unit(z - (z * x).sum(1, keepdims=True) * x)
    for count in (96, 200, 400, 800, 2480, 4096):
        spread, nearest = pivots.spread_pivots(np.empty((0, 64)), count, 64), pivots.prefix_length(count)
        a, b = (pivots.prefixes(v, spread, nearest) for v in (x, y))
        recall = ((a[:, :, None] == b[:, None, :]).any(2).sum(1) >= pivots.SHARED).mean()
        print(count, nearest, recall)
        assert recall >= 0.995


def test_labels_of_any_type_and_extreme_components(spark):
    rows = [(1, [1e200, 2e200], "a"), (2, [1.0, 2.0], "a"), (3, [1e-200, 2e-200], "a"), (4, [1.0, 2.0], "b"), (5, [1.0, 2.0], None), (6, [float("inf"), 1.0], "a"), (7, [0.0, 0.0], "a"), (8, [-1.0, -2.0], "a")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False)} | {i: (0, i, True) for i in (4, 5, 6, 7, 8)}


@pytest.mark.parametrize("pairs", [500, 4000])
def test_recall_of_whole_runs_near_the_threshold(spark, pairs):
    """Pairs planted at cosines of 0.93 to 0.95, beside a dense group, in one label."""
    rng, unit = np.random.default_rng(pairs), lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(pairs, 64)))
    z = rng.normal(size=x.shape)
    c = rng.uniform(0.9305, 0.95, size=(pairs, 1))
    y = c * x + np.sqrt(1 - c**2) * unit(z - (z * x).sum(1, keepdims=True) * x)
    group = unit(x[:1] + 0.02 * rng.normal(size=(300, 64)))
    v = np.concatenate([x, y, group]).astype(np.float32)
    got = pivots.near_vectors(spark.createDataFrame([(i, e, 0) for i, e in enumerate(v.tolist())], "vec_id long, embedding array<float>, label int")).collect()
    u = unit(v.astype(np.float64))
    near = u @ u.T >= 0.93
    links = int(near.sum()) - len(u)
    planted = sum(1 for r in got if r.vec_id < 2 * pairs and r.n_links)
    print("links", sum(r.n_links for r in got) / links, "planted", planted / (2 * pairs))
    assert sum(r.n_links for r in got) >= 0.98 * links and planted >= 0.98 * 2 * pairs
