"""Token counts under a unigram model, by dynamic programming over a trie.

Distinct pre-tokens (words with the marker of a leading space) are inserted into a trie.
The best score of a prefix depends on the prefix alone, so it is computed once, when its
node is made, from the scores of the nodes above it; words that share a prefix share the
work.  A node at which a pre-token ends stores its token count and how often it occurred.

The trie lives in a worker, grows over the batches it sees and is begun anew when it reaches
``MAX_NODES``; a word adds at most ``LONGEST_KEPT`` + 1 nodes, and longer ones none.  Documents
are counted where they lie; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marker that the vocabulary writes for a leading space.
SPACE = "▁"
MAX_NODES = 600_000
#: Words longer than this are scored without nodes.
LONGEST_KEPT = 256
#: Texts whose distinct words are inserted together.
TEXTS = 256
_WHITE = str.maketrans(dict.fromkeys("\t\n\v\f\r", " "))
_models: dict[str, dict[str, float]] = {}


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities of pieces in order of rank, p ~ 1 / (rank + 2.7) (Zipf-Mandelbrot)."""
    total = sum(1 / (r + 2.7) for r in range(len(pieces)))
    return {p: -math.log((r + 2.7) * total) for r, p in enumerate(pieces)}


def vocabulary(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a sentencepiece model, ranked by their order in the file."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        _models[path] = zipf_scores([sp.id_to_piece(i) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))])
    return _models[path]


_ABSENT = object()


class Trie:
    """score and tokens are those of the best segmentation of a node's prefix.

    Of equally good ones the fewest tokens count.  A character without a piece costs one
    token for each of its UTF-8 bytes, at a score below any piece.  ``occurred`` counts, for a
    node at which a word ends, how often that word came.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        # what pieces may end with: the score of a piece, None for other endings, absent where no longer piece can follow
        self.endings: dict[str, float | None] = dict.fromkeys(p[i:] for p in scores for i in range(len(p))) | scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}  # by node and character, as one number
        self.score, self.tokens, self.occurred = [0.0], [0], [0]

    def _best(self, word: str, end: int, scores: Sequence[float], tokens: Sequence[int], above: Sequence[int]) -> tuple[float, int]:
        """Score and tokens of ``word[:end]``; ``above[-k]`` leads to those of ``word[: end - k]``."""
        ending, ch = self.endings.get, word[end - 1]
        at = above[-1]
        best, fewest = scores[at] + self.unknown, tokens[at] + len(ch.encode("utf-8", "surrogatepass"))
        for back in range(1, min(end, len(above)) + 1):
            piece = ending(word[end - back : end], _ABSENT)
            if piece is None:
                continue
            if piece is _ABSENT:
                break
            at = above[-back]
            s = scores[at] + piece
            if s >= best:
                t = tokens[at] + 1
                if s > best or t < fewest:
                    best, fewest = s, t
        return best, fewest

    def insert(self, word: str) -> int:
        """The node of ``word``; its prefixes are scored where they are new."""
        # the loop of _best, written out: this is where the time goes
        node, path, children, score, tokens, ending, absent = 0, [0], self.children, self.score, self.tokens, self.endings.get, _ABSENT
        for end, ch in enumerate(word, 1):
            key = node * 0x110000 + ord(ch)
            child = children.get(key)
            if child is None:
                child = children[key] = len(score)
                best, fewest = score[node] + self.unknown, tokens[node] + len(ch.encode("utf-8", "surrogatepass"))
                for start in range(end - 1, -1, -1):
                    piece = ending(word[start:end], absent)
                    if piece is None:
                        continue
                    if piece is absent:
                        break
                    above = path[start]
                    s = score[above] + piece
                    if s >= best:
                        t = tokens[above] + 1
                        if s > best or t < fewest:
                            best, fewest = s, t
                score.append(best)
                tokens.append(fewest)
                self.occurred.append(0)
            path.append(child)
            node = child
        return node

    def count_only(self, word: str) -> int:
        """Tokens of ``word`` by the same rule without a node, in memory of the longest piece."""
        scores, tokens, above = [0.0], [0], [0]
        for end in range(1, len(word) + 1):
            best, fewest = self._best(word, end, scores, tokens, above)
            scores.append(best)
            tokens.append(fewest)
            above.append(len(scores) - 1)
            if len(scores) > 4096:
                keep = self.longest + 1
                scores, tokens, above = scores[-keep:], tokens[-keep:], list(range(min(keep, len(scores))))
        return tokens[-1]


class Counts:
    """Token counts of words through the trie; ``nodes`` holds the words that the trie knows."""

    def __init__(self, trie: Trie) -> None:
        self.trie, self.nodes = trie, {}

    def of(self, texts: list[list[str]]) -> list[int]:
        """Tokens of each list of words; every distinct word is inserted once, with how often it came."""
        trie, nodes, told = self.trie, self.nodes, {}
        for word, times in Counter(chain.from_iterable(texts)).items():
            if len(word) > LONGEST_KEPT:
                told[word] = trie.count_only(SPACE + word)
                continue
            node = nodes.get(word)
            if node is None:
                if len(trie.score) > MAX_NODES:
                    trie.clear()
                    nodes.clear()
                node = nodes[word] = trie.insert(SPACE + word)
            trie.occurred[node] += times
            told[word] = trie.tokens[node]
        return [sum(map(told.__getitem__, words)) for words in texts]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(Trie(vocabulary(path)))
        for batch in batches:
            words, tokens = [], []
            for at in range(0, batch.num_rows, TEXTS):
                found = [[w for w in (t.as_py() or "").translate(_WHITE).split(" ") if w] for t in batch.column(1).slice(at, TEXTS)]
                words += map(len, found)
                tokens += counts.of(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row.

    Pre-tokens are runs of characters other than space and U+0009..U+000D.  Null and empty
    texts have 0 of both.  A very long word is scored whole, in bounded memory.  Repeated rows are counted each; other columns are ignored; an
    empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_count(vocabulary_path), "doc_id long, n_pretokens long, n_tokens long")
