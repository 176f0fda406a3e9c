import random
import tracemalloc
import zlib

import numpy as np
import pytest

import corpus_pipeline
from siftline.llm import simhash, toxicity


def corpus(seed=0, n=600):
    """Label 1 needs an insult and a group together; either alone is harmless."""
    rng = random.Random(seed)
    plain = ["w%d" % i for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 60))
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["nasty"] * insult + ["people"] * group
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return docs, labels


def test_pairs_of_terms_are_learned():
    docs, labels = corpus()
    cache = toxicity._Terms()
    terms = [np.array(sorted(toxicity._text_terms(t, cache)), np.int32) for _, t in docs]
    machine = toxicity.fit(terms[:400], np.array([y for _, y in labels[:400]]))
    known = toxicity._Terms({int(t): i for i, t in enumerate(machine.terms)})
    scores = np.array([machine.decision(sorted(toxicity._text_terms(t, known))) for _, t in docs[400:]])
    y = np.array([y for _, y in labels[400:]])
    assert ((scores > 0) == y).mean() >= 0.95
    linear = toxicity.Machine(machine.terms, machine.bias, machine.weights, machine.factors * 0)
    plain = np.array([linear.decision(sorted(toxicity._text_terms(t, known))) for _, t in docs[400:]])
    assert ((plain > 0) == y).mean() < ((scores > 0) == y).mean()


def test_scores(spark):
    docs, labels = corpus(1)
    docs += [(1000, None), (1001, ""), (None, "nasty people"), (5, docs[5][1]), (1002, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    lab = spark.createDataFrame([(i, y, 1) for i, y in labels] + [(None, 1, 1), (3, None, 1), (4, 7, 1)], "doc_id long, toxic int, quality int")
    machine = toxicity.train(df, lab)
    got = toxicity.score(df, machine).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    y = dict(labels)
    held = [(r.score >= 0.5) == y[r.doc_id] for r in got if r.held_out and r.doc_id in y]
    assert np.mean(held) >= 0.9
    same = toxicity.train(df.repartition(5), lab)
    assert (same.weights == machine.weights).all()
    kept = toxicity.drop_toxic(df, machine)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in got)
    nothing = toxicity.train(df, lab.limit(0))
    assert {r.score for r in toxicity.score(df, nothing).collect()} == {0.5}
    assert toxicity.score(df.limit(0), machine).count() == 0


def test_near_copies(spark):
    rng = random.Random(2)
    vocabulary = ["v%d" % i for i in range(3000)]
    docs, close = [], set()
    for g in range(30):
        base = rng.choices(vocabulary, k=300)
        docs.append((len(docs), " ".join(base)))
        for edits in (1, 3):
            copy = list(base)
            for p in rng.sample(range(300), edits):
                copy[p] = "edit"
            close.add((g * 4, len(docs)))
            docs.append((len(docs), " ".join(copy)))
        far = list(base)
        for p in rng.sample(range(300), 60):
            far[p] = rng.choice(vocabulary)
        docs.append((len(docs), " ".join(far)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.near_copies(df).collect()}
    found = sum(got.get(b) == a for a, b in close)
    assert found >= 0.9 * len(close)
    assert all((c, i) in close for i, c in got.items() if i != c)
    left = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    assert left == {i for i, _ in docs} - {i for i, c in got.items() if i != c}


def test_pipeline(spark, tmp_path):
    docs, labels = corpus(4, 300)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs] + [(500 + i, docs[i][1].upper(), "en", None, 1) for i in range(20)] + [(900, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = frame.columns
    from siftline.llm.scratch import stage

    for name, function in corpus_pipeline.STAGES:
        frame = stage(function(spark, frame, str(tmp_path)), f"test-{name}")
        seen.append(frame.count())
        if name != "packing":
            assert frame.columns == columns
    assert seen[0] < len(rows) and seen[1] <= seen[0] - 10 and seen[2] <= seen[1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1]


@pytest.mark.parametrize("text", ["Nasty, people!", "", "!!!", "ß"])
def test_terms_ignore_punctuation_at_ends(text):
    for token in text.lower().split():
        assert toxicity.word_terms(token) == toxicity.word_terms(token.strip("!,"))


def test_machine_against_plain_formulas():
    rng = np.random.default_rng(3)
    n, factors = 9, rng.normal(size=(9, 4))
    machine = toxicity.Machine(np.arange(n), 0.3, rng.normal(size=n), factors)
    found = [0, 3, 4, 8]
    pairs = sum(float(factors[a] @ factors[b]) for i, a in enumerate(found) for b in found[i + 1 :])
    assert machine.decision(found) == pytest.approx(0.3 + sum(machine.weights[found]) + pairs)
    assert machine.decision([]) == 0.3


def test_pairs_that_only_matter_together_are_learned():
    rng = np.random.default_rng(5)
    insult, group, filler = 7, 11, list(range(100, 160))
    texts, labels = [], []
    for _ in range(3000):
        has = rng.random(2) < 0.4
        # an insult is somewhat more frequent in toxic texts; a group alone is as frequent in both
        toxic = bool(has.all())
        terms = {*rng.choice(filler, 8).tolist(), *([insult] if has[0] else []), *([group] if has[1] or (not has[0] and rng.random() < 0.66) else [])}
        texts.append(np.array(sorted(terms), np.int32))
        labels.append(int(toxic))
    machine = toxicity.fit(texts, np.array(labels))
    at = {int(t): i for i, t in enumerate(machine.terms)}
    assert insult in at and group in at
    score = lambda *terms: toxicity._sigmoid(np.array([machine.decision([at[t] for t in terms])]))[0]
    assert score(insult, group) > 0.7 > 0.3 > max(score(insult), score(group))


def test_fit_holds_little_beside_the_texts():
    rng = np.random.default_rng(5)
    texts = [np.unique(rng.integers(0, 1 << 20, 3000)).astype(np.int32) for _ in range(3000)]
    labels = rng.integers(0, 2, 3000)
    tracemalloc.start()
    try:
        toxicity.fit(texts, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 120 << 20  # 34 MiB of texts; arrays of all their terms took 351 MiB


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, f"word{i} and other words " * 3) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels, sample_bytes=1).bias == toxicity.fit([], np.array([])).bias
    assert toxicity.train(docs, labels).bias == pytest.approx(0.0, abs=0.5)


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars int, __pos int, __bucket int, __id string, __key string, __maybe string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(f"w{i}" for i in range(60_000))
    tables = [[], [(i, None, None, None, None) for i in range(4)], [(1, "", "en", "a", 0), (2, long, "en", "a", 1), (3, long + " end", "en", None, 1), (4, "Same text", "en", "a", 9), (5, "same text", None, "b", 9), (None, "same text", "x", "b", 9), (7, "x" * 1_000_000, "en", "a", 1)]]
    for rows in tables:
        docs = spark.createDataFrame([(*r, 1, 2, "x", "y", "z") for r in rows], schema)
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns, name
                docs = spark.createDataFrame(out.collect(), schema)
            else:
                out.collect()
        if len(rows) == 7:
            assert {r.doc_id for r in docs.collect()} <= {2, 5, 7}
