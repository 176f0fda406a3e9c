import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import substrings


def brute(docs, length):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        if i is None:
            continue
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for s in range(len(b) - length + 1):
                if first[b[s : s + length]] < i:
                    gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, kept))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "über", "naïve", "x\ty", "word", "and\n"] + ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passages = [text(rng.randint(5, 40)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(0, 8))]
        docs.append((rng.randrange(10_000), " ".join(parts)))
    docs += [(d[0] + 1, d[1]) for d in docs[:6]]
    docs += [(d[0] + 2, d[1].replace(" ", "_", 3)) for d in docs[6:12]]
    docs += [(docs[0][0], passages[0] + text(4)), (docs[0][0], docs[0][1]), (None, passages[1]), (77, None), (78, ""), (79, "short"), (80, "z" * 400), (81, "y" + "z" * 200), (5, passages[2])]
    return docs


@pytest.mark.parametrize(("seed", "crowd", "chunk"), [(1, 4096, 1 << 17), (2, 1, 300), (3, 3, 1 << 10)])
def test_against_brute_force(spark, monkeypatch, seed, crowd, chunk):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_bytes int").repartition(3)
    got = [tuple(r) for r in substrings.remove_repeats(df, bits=1 << 15).collect()]
    got = sorted(((i, n, g, s, bytes(k)) for i, n, g, s, k in got), key=repr)
    assert got == brute(docs, 50)


def test_long_periodic_texts(spark):
    rng = random.Random(7)
    period = "".join(rng.choices("abc ", k=37))
    own = "".join(rng.choices("abcdefghijklmnop ", k=400_000))
    docs = [(1, period * 9000), (2, own), (3, "x" + period * 800 + "y" + own[1000:300_000]), (4, " " * 1_000_000), (5, "q" + " " * 70 + "q"), (6, own[::-1][:2000] + period * 2)]
    got = sorted(tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    assert [(i, n, g, s, bytes(k)) for i, n, g, s, k in got] == brute(docs, 50)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fold_holds_little_beside_the_batch():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 123, 4000).astype(np.uint8).tobytes() for _ in range(5000)]
    texts[7::10] = texts[:500]
    batch = pa.record_batch([pa.array(np.arange(5000)), pa.array(texts, pa.binary())], names=["doc", "t"])
    a, c, row = (np.concatenate(x) for x in list(zip(*substrings.anchors(texts), strict=True))[:3])
    want = {}
    for x, y, i in zip(a.tolist(), c.tolist(), row.tolist(), strict=True):
        low, high = want.get((x, y), (i, i))
        want[x, y] = min(low, i), max(high, i)
    tracemalloc.start()
    try:
        got = list(substrings._fold(50, 20)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 80 << 20  # 19 MiB of texts; sorting all of the batch's anchors at once took 162 MiB
    rows = [r for out in got for r in zip(*(x.to_pylist() for x in out.columns), strict=True)]
    assert {(x, y): (i, several) for x, y, i, several in rows} == {k: (low, high > low) for k, (low, high) in want.items()}
    assert len(rows) == len(want)


def test_bitmaps_grow_with_what_they_hold(spark):
    assert substrings._size_of(1000, 1 << 27, 1 << 29) == (1 << 27, 3)
    assert substrings._size_of(72_000_000, 1 << 27, 1 << 29)[0] == 1 << 29  # contexts shared in 6 GB by the share of 0.5 GB
    assert substrings._size_of(10**9, 1 << 27, 1 << 29) == (1 << 29, 1)
    keys = np.random.default_rng(3).integers(-(1 << 63), 1 << 63 - 1, (60_000, 2))
    held = spark.createDataFrame(keys[:30_000].tolist(), "anchor long, context long").repartition(5)
    bits, marks = substrings._size_of(held.count(), 1 << 15, 1 << 20)
    table = substrings._bitmap(held, bits, marks)
    hit = substrings._may_have(table, substrings._key_of(*(x.copy() for x in keys.T)), bits, marks)
    assert len(table) == bits // 8 and hit[:30_000].all() and hit[30_000:].mean() < 0.07


def test_spans_of_a_batch():
    rng = np.random.default_rng(5)
    n = 300
    doc, first, width = rng.integers(0, 9, n), rng.integers(0, 1000, n), rng.integers(0, 30, n)
    least, start, ids = rng.integers(0, 9, n), [], []
    for w in width.tolist():
        s = int(rng.integers(0, w + 1))
        start.append(s)
        ids.append(rng.integers(0, 9, w + 1 - s).tobytes() if rng.random() < 0.6 else None)
    batch = pa.record_batch([pa.array(doc), pa.array(np.arange(n), pa.int32()), pa.array(first, pa.int32()), pa.array(width, pa.int16()), pa.array(least), pa.array(start, pa.int32()), pa.array(ids, pa.binary())], names=list("dtfwlsi"))
    want = set()
    for i in range(n):
        told = range(first[i], first[i] + width[i] + 1) if ids[i] is None and least[i] < doc[i] else [] if ids[i] is None else [first[i] + start[i] + k for k, x in enumerate(np.frombuffer(ids[i], np.int64)) if x < doc[i]]
        want |= {(i, p + k) for p in told for k in range(50)}
    for some in (batch, batch.slice(7, 1), batch.slice(0, 0)):
        (out,) = substrings._spans(50)(iter([some]))
        tags = set(some.column(1).to_pylist())
        rows = list(zip(*(x.to_pylist() for x in out.columns), strict=True))
        assert {(t, p) for _, t, s, e in rows for p in range(s, e)} == {x for x in want if x[0] in tags}
        assert all(d == doc[t] for d, t, _, _ in rows)
