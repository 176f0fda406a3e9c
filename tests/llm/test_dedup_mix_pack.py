import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import exact_dedup, mixing, packing
from tests.llm.brute import ascii_lower, words

TEXTS = [None, "", "A b", "a B", "É a", "é a", "x" * 5000, "x" * 4999 + "y", "a\tb", "a b"]


def rows(seed=0, n=120):
    rng = random.Random(seed)
    out = [(rng.choice([*range(40), None]), rng.choice(TEXTS + ["w%d" % rng.randrange(30)])) for _ in range(n)]
    return [*out, *out[:5]]


@pytest.mark.parametrize("bits", [32768, 1 << 20])
def test_exact_groups(spark, bits):
    docs = rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, kept int, keep_id string").repartition(3)
    got = exact_dedup.exact_groups(df, digest_all=True, length_classes=7, filter_bits=bits, prefix_chars=4).collect()
    groups = defaultdict(list)
    for i, t in docs:
        groups[ascii_lower(t or "")].append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, max(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_drop_exact_copies(spark):
    docs = rows(1)
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, __extra string")
    got = exact_dedup.drop_exact_copies(df).collect()
    best = {}
    for i, t in docs:
        k = ascii_lower(t or "")
        best[k] = max((i if i is not None else -1), best.get(k, -1))
    assert sorted((ascii_lower(r.text or ""), -1 if r.doc_id is None else r.doc_id) for r in got) == sorted(best.items())
    assert exact_dedup.drop_exact_copies(df.limit(0)).count() == 0 and exact_dedup.exact_groups(df.limit(0)).count() == 0


def fill(sizes, weights, epochs=3.0):
    """Clamp the sources above their cap and share the rest, one by one."""
    total, free, target = float(sum(sizes.values())), set(sizes), {}
    while free:
        left = total - sum(target.values())
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > epochs * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
        free -= over
    return target


@pytest.mark.parametrize("buckets", [2, 512])
def test_mix(spark, buckets):
    rng = random.Random(3)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])) if rng.random() > 0.05 else None, rng.choice(["a", "b", "B", "c", None, "é"] + ["hot"] * 8)) for i in range(400)]
    docs += [(1000, "only one word here", "tiny"), (1000, "only one word here", "tiny"), (None, "no id at all", "a"), (1001, "", "empty")]
    df = spark.createDataFrame([(i, t, s, 5) for i, t, s in docs], "doc_id long, text string, source string, size int").repartition(3)
    got = mixing.mix(df, buckets=buckets)[1].collect()
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(words(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    target = fill(sizes, {s: (5.0, 2.0, 1.0)[n % 3] for n, s in enumerate(order)})
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(docs)
    assert all(abs(taken[s] - target[s]) <= 2 for s in sizes)
    again = mixing.mix(df.repartition(5), buckets=buckets)[1].collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = mixing.mixed(df, buckets=buckets)
    assert out.columns == df.columns
    mixed = Counter()
    for r in out.collect():
        mixed[r.source] += len(words(r.text))
    assert mixed == Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix(df.limit(0))[1].count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_cut_covers_every_length():
    for n in [*range(1, 5000), 10**6 + 7]:
        pieces = packing.cut(n)
        assert sum(length for length, _ in pieces) == n
        assert all(length * k <= 2048 for length, k in pieces)
        assert len(pieces) <= n // 2048 + 8


def test_pack(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(5)
    vocabulary = ["the", "don't", "naïve", "漢字", "\n", "  ", "a b", "<|endoftext|>", "x" * 70, "12345", "Zu.", "\x1c", "😀"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 80, 900, 4000])))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " "), (3, docs[3][1]), (None, "no id"), (103, "q" + " " * 2_000_000 + "<|endoftext|>")]
    df = spark.createDataFrame([(i, x, 1) for i, x in docs], "doc_id long, text string, length int").repartition(4)
    got = packing.pack(df, path("byte_bpe_50k.json"), with_ids=True).collect()
    want = Counter()
    for i, x in docs:
        ids = b"".join(k.to_bytes(4, "little") for k in [*t.encode(x or "", add_special_tokens=False).ids, 1])
        want[i, ids] += 1
    pieces = defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
    # pieces of repeated ids cannot be told apart; the others join to their documents
    for (i, ids), times in want.items():
        if times == 1 and sum(n for (j, _), n in want.items() if j == i) == 1:
            assert b"".join(bytes(r.ids) for r in sorted(pieces[i], key=lambda r: r.start)) == ids
            assert all(r.doc_tokens == len(ids) // 4 for r in pieces[i])
    assert sum(r.length for r in got) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = sum(r.length for r in got)
    assert len(sequences) * 2048 - used <= 0.03 * used + 4096
    assert packing.pack(df.limit(0), path("byte_bpe_50k.json")).count() == 0


def test_encoder_equals_tokenizer():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["a  b", "a\n b", "a \nb\n\n  c", " x", "  x\t y", "", " ", "é à\xa0 z　 q", "don't  's", "a  b  \xa0c", "\x1c \x1d x", "tail  ", "日本 語 ", "a" * 300 + " " + "b" * 300]
    texts += ["<|endoftext|>", "a <|endoftext|> b c", "x<|endoftext|><|endoftext|>\n y", "<|endof text|>"]
    texts += [" " * 1_000_000, "a" + "\n" * 2_000_000 + "b c", "a \u2003" * 1000, "ab" * 200_000 + " c"]
    rng = random.Random(8)
    odd = [chr(c) for c in (*range(1, 0x250), 0x85, 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x0660, 0x2160, 0x0301, 0x4E00, 0x1F600)]
    texts += ["".join(rng.choices([" ", " ", "\n", "a", "'s", "1", *rng.choices(odd, k=12)], k=60)) for _ in range(3000)]
    e = packing.encoder(path("byte_bpe_50k.json"))
    for x in texts:
        ids = e(x)
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x[:50]


def test_word_count(spark):
    texts = [None, "", " ", "a", " a b ", "a\t\n\x0b\x0c\rb", "a\xa0b", "é ß"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from siftline.llm.textops import word_count

    assert [r.n for r in df.select(word_count(F.col("t")).alias("n")).collect()] == [len(words(t or "")) for t in texts]
