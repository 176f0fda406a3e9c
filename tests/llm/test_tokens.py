import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import tokens

SCORES = tokens.zipf_scores(["▁", "a", "b", "ab", "▁a", "ba", "aba", "c", "▁ab", "bab"])


def best(word, scores, unknown):
    """Over all ways to cut the word."""
    found = []
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        score, count = 0.0, 0
        for a, b in itertools.pairwise(at):
            piece = word[a:b]
            if piece in scores:
                score, count = score + scores[piece], count + 1
            elif len(piece) == 1:
                score, count = score + unknown, count + len(piece.encode())
            else:
                break
        else:
            found.append((round(score, 9), -count))
    return -max(found)[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcxé", min_size=1, max_size=7), min_size=1, max_size=8))
def test_trie_counts_are_those_of_the_best_segmentation(words):
    trie = tokens.Trie(SCORES)
    for w in words:
        assert trie.tokens[trie.insert("▁" + w)] == best("▁" + w, SCORES, trie.unknown)


def test_prefixes_are_shared():
    trie = tokens.Trie(SCORES)
    trie.insert("▁abab")
    n = len(trie.score)
    trie.insert("▁aba")
    assert len(trie.score) == n


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_NODES", 30)
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = [(1, "the  cat\tsat"), (2, None), (3, ""), (4, " \n"), (1, "the  cat\tsat"), (None, "x" * 5000), (5, "naïve 漢字 \x1c")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_pretokens, r.n_tokens) for r in tokens.token_counts(df, path).collect()), key=repr)
    trie = tokens.Trie(tokens.vocabulary(path))
    import re

    want = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want.append((i, len(w), sum(trie.tokens[trie.insert("▁" + x)] for x in w)))
    assert got == sorted(want, key=repr)
    assert tokens.token_counts(df.limit(0), path).count() == 0


def test_terminals_store_how_often_a_word_came():
    counts = tokens.Counts(tokens.Trie(SCORES))
    assert counts.of([["ab", "abc", "ab"], [], ["ab"]]) == [sum(counts.trie.tokens[counts.nodes[w]] for w in ("ab", "abc", "ab")), 0, counts.trie.tokens[counts.nodes["ab"]]]
    assert counts.trie.occurred[counts.nodes["ab"]] == 3 and counts.trie.occurred[counts.nodes["abc"]] == 1


def test_long_words_are_scored_without_nodes():
    word = "ababc" * 60_000
    counts = tokens.Counts(tokens.Trie(SCORES))
    got = counts.of([[word, "ab"]])[0]
    assert len(counts.trie.score) == 4
    whole = tokens.Trie(SCORES)
    assert got == whole.tokens[whole.insert("▁" + word)] + whole.tokens[whole.insert("▁ab")]


def test_pieces_of_score_zero_count():
    trie = tokens.Trie({"▁": -1.0, "a": 0.0, "aa": -5.0})
    assert trie.tokens[trie.insert("▁aa")] == 3
