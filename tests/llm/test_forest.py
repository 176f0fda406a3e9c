import numpy as np
import pytest

from siftline.llm import forest


def brute(rows, is_query, k=5):
    ok = []
    for i, v in rows:
        if i is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v):
            ok.append((i, np.array(v, np.float32).astype(np.float64)))
    out = {}
    for q in sorted({i for i, _ in ok if is_query(i)}):
        best = {}
        for own in [v for i, v in ok if i == q]:
            for i, v in ok:
                if i != q and len(v) == len(own):
                    best[i] = max(best.get(i, -2), float(v @ own) / float(np.sqrt(v @ v) * np.sqrt(own @ own)))
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def run(spark, rows, condition="id % 50 = 0", **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "'x' as block", "2 as query_id", "3 as dim")
    got = forest.nearest(df.repartition(3), condition, **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        mine = out.setdefault(r.query_id, [])
        assert r["rank"] == len(mine) + 1
        mine.append((r.vec_id, r.score))
    return out


def same(got, want):
    assert got.keys() == {q for q, x in want.items() if x}
    for q, x in got.items():
        assert [i for i, _ in x] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in x], [s for _, s in want[q]], atol=1e-12)


def test_small_tables_are_exact_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(260)]
    rows += [(300 + i, rows[100][1]) for i in range(30)] + [(50, rows[50][1]), (50, rows[51][1]), (400, [2 * e for e in rows[100][1]])]
    rows += [(None, rows[0][1]), (450, None), (500, []), (550, [0.0] * 16), (600, [None] + [1.0] * 15), (650, [float("nan")] * 16), (700, [float("inf")] + [1.0] * 15), (750, [1.0, 2.0]), (751, [2.0, 1.0]), (800, [1.0]), (10**15, rows[7][1]), (-50, [-e for e in rows[7][1]])]
    same(run(spark, rows), brute(rows, lambda i: i % 50 == 0))


def test_copies_are_one_entry(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 else rng.normal(size=8).tolist()) for i in range(300)] + [(51, hot)] * 40
    same(run(spark, rows), brute(rows, lambda i: i % 50 == 0))


@pytest.mark.parametrize("n", [6_000, 24_000])
def test_recall_on_independent_vectors(spark, n):
    """The hardest case: neighbours hardly nearer than the rest."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    got = run(spark, [(i, v) for i, v in enumerate(x.tolist())], "id % 200 = 0")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -2
        hits += len({i for i, _ in found} & set(np.argsort(-s)[:5].tolist()))
    recall = hits / (5 * len(got))
    print("recall", n, recall)
    assert recall >= 0.93


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 64))
    x = (centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 64)) * 0.2).astype(np.float32)
    x[:3000] = x[0] + rng.normal(size=(3000, 64)).astype(np.float32) * 0.01  # a dense group
    got = run(spark, [(i, v) for i, v in enumerate(x.tolist())], "id % 100 = 0")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -2
        hits += len({i for i, _ in found} & set(np.argsort(-s)[:5].tolist()))
    print("recall", hits / (5 * len(got)))
    assert hits / (5 * len(got)) >= 0.93


def test_empty_table(spark):
    assert run(spark, []) == {}
