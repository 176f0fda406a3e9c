import random

import pytest

from siftline.llm import lines


def test_patience_aligns_equal_lines_in_order():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 25))] for _ in range(2))
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x < y and v < w for (x, v), (y, w) in zip(got, got[1:]))
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert lines.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def brute(docs, rare):
    """Pair by pair: copies with their first, others with all earlier documents that share a rare line and the first holders of frequent ones."""
    split = lambda t: tuple(x.strip(" ") if x.strip(" \t\r") else "" for x in (t or "").split("\n"))
    least = {}
    for i, t in docs:
        if i is not None:
            least[split(t)] = min(i, least.get(split(t), i))
    alone = {(i, t or "") for i, t in docs if i is not None and (least[split(t)] == i or not any(split(t)))}
    holders = {}
    for i, t in alone:
        ls = split(t)
        for s in {(x,) for x in ls if x} | {(x, y) for x, y in zip(ls, ls[1:]) if x and y}:
            holders.setdefault(s, []).append((i, t))
    out = []
    for i, t in docs:
        ls, gone, partners, losing = split(t), set(), set(), 0
        if i is not None and (i, t or "") not in alone:
            losing, gone = 1, set(range(len(ls)))
        elif i is not None:
            for s, h in holders.items():
                if (i, t or "") in h and (len(s) == 1 or len(h) > rare):
                    partners |= {x for x in h if x[0] < i and (len(h) <= rare or x[0] == min(h)[0])}
            for other in map(split, (x[1] for x in partners)):
                key = {x: n + 1 for n, x in enumerate(sorted({*ls, *other} - {""}))} | {"": 0}
                lost = lines.common_lines([key[x] for x in ls], [key[x] for x in other])
                gone.update(lost)
                losing += bool(lost)
        kept = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone)
        out.append((i, len(ls), len(gone), losing, kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rare", [1, 6, 1000])
def test_against_brute_force(spark, rare):
    rng = random.Random(9)
    pool = [f"line number {i} of many" for i in range(80)]
    docs = []
    for i in range(60):
        body = rng.choices(pool, k=rng.randint(0, 5)) + [f"own {i} {k}" for k in range(rng.randint(0, 6))] + ["", "common footer"]
        rng.shuffle(body)
        docs.append((i, "\n".join(body)))
    docs += [(100 + i, docs[i % 7][1] + ("" if i % 2 else f"\nadded {i}")) for i in range(20)]
    docs += [(200, None), (201, ""), (202, "\n\n"), (None, docs[0][1]), (100, "\n".join(pool[:5]) + "\r"), (203, "  " + pool[3] + " \n" + pool[4])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, lines string")
    got = sorted((tuple(r) for r in lines.dedup_lines(df, rare=rare).collect()), key=repr)
    assert got == brute(docs, rare)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_many_documents_go(spark):
    docs = [(i, f"own {i}\n\ncommon line\n\nanother own {i}") for i in range(70)]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if "common line" in r.kept} == {0}
    assert all(f"own {r.doc_id}\n" in r.kept and f"another own {r.doc_id}" in r.kept for r in got)


def test_any_earlier_document_counts_not_only_the_first(spark):
    docs = [(1, "b\nz\na"), (2, "a\nm\nb"), (3, "a\nn\nb")]
    got = {r.doc_id: r.kept for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[3] == "n"


def test_very_long_text_and_many_partners(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    docs = [(0, long), (1, "x" * 1_000_000)] + [(2 + i, f"own {i}\nline {i}\nline {i + 1}\nown too {i}") for i in range(600)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got[0].n_removed == got[1].n_removed == 0
    assert all(got[2 + i].kept == f"own {i}\nown too {i}" for i in range(600))
