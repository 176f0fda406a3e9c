"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: lower-cased words without punctuation at their ends
and word prefixes of 4, 5 and 6 characters.  The score is
sigmoid(b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)); the second-order part weighs
pairs of terms, such as an insult beside a group, which a linear model cannot.

The machine is fitted by numpy on the driver, on at most about SAMPLE labelled texts chosen
by a hash of their id (the bound on what is gathered); scoring reads every whole text where
it lies, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.scratch import discard, stage

#: Labelled texts gathered for training.
SAMPLE = 10_000
#: Bytes of hashed terms gathered for training.
SAMPLE_BYTES = 128 << 20
HASH_BITS, FACTORS, EPOCHS, BATCH, RATE, L2, SEED = 20, 4, 20, 64, 0.1, 1e-4, 42
PREFIXES = (4, 5, 6)
#: A term is used if its share among toxic texts differs from that among others by this many
#: standard errors, among all texts or among those that hold a term of the toxic ones.
LEAST_Z, LEAST_TEXTS = 3.0, 3
THRESHOLD = 0.7
_PUNCTUATION = ".,;:!?\"'`()[]{}<>*_-/\\|~#@&%+=«»“”‘’…¡¿"


def word_terms(token: str) -> tuple[int, ...]:
    """Hashed terms of one lower-cased token."""
    word = token.strip(_PUNCTUATION)
    if not word:
        return ()
    mask = (1 << HASH_BITS) - 1
    return (zlib.crc32(word.encode()) & mask, *(zlib.crc32(f"{n}:{word[:n]}".encode()) & mask for n in PREFIXES if len(word) >= n))


class _Terms(dict):
    """token -> terms, bounded."""

    def __init__(self, known: dict[int, int] | None = None) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, token: str) -> tuple[int, ...]:
        terms = word_terms(token)
        if self.known is not None:
            terms = tuple(self.known[t] for t in terms if t in self.known)
        if len(self) >= 300_000:
            self.clear()
        if len(token) <= 64:
            self[token] = terms
        return terms


def _text_terms(text: str | None, cache: _Terms) -> set[int]:
    found: set[int] = set()
    for token in set((text or "").lower().split()):
        if terms := cache[token]:
            found.update(terms)
    return found


@dataclass
class Machine:
    """terms: sorted hashed terms; their weights and factors; the bias."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def decision(self, found: list[int]) -> float:
        if not found:
            return self.bias
        v = self.factors[found]
        s = v.sum(0)
        return self.bias + float(self.weights[found].sum()) + 0.5 * float((s * s - (v * v).sum(0)).sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _separation(texts: list[np.ndarray], y: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(z, texts) of every term among some texts: by how many standard errors its share differs between the labels.

    Terms are counted text by text, each distinct in it, so that nothing as long as all texts is built.
    """
    n, positive = int(among.sum()), float(y[among].sum())
    df, toxic = np.zeros(1 << HASH_BITS, np.int64), np.zeros(1 << HASH_BITS)
    for i in np.flatnonzero(among).tolist():
        df[texts[i]] += 1
        if y[i]:
            toxic[texts[i]] += 1
    if not positive or positive == n:
        return np.zeros(1 << HASH_BITS), df
    share = df / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / positive + 1 / (n - positive)))
    return (toxic / positive - (df - toxic) / (n - positive)) / error, df


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> Machine:
    """Fit on arrays of hashed terms (distinct in each) and 0/1 labels, by AdaGrad on the log loss.

    Without texts of both labels the machine has no terms and its score is the share of
    label 1, smoothed.
    """
    y = np.asarray(labels, np.float64)
    n, positive = len(y), float(y.sum())
    rate = (positive + 0.5) / (n + 1.0)
    nothing = Machine(np.empty(0, np.int64), float(np.log(rate / (1 - rate))), np.empty(0), np.empty((0, FACTORS)))
    if not positive or positive == n:
        return nothing
    z, df = _separation(texts, y, np.ones(n, bool))
    chosen = (df >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z)
    # terms that tell nothing alone may tell the label of texts that hold a strong term
    strong = (df >= LEAST_TEXTS) & (z >= LEAST_Z)
    beside = np.array([strong[t].any() for t in texts])
    z, df = _separation(texts, y, beside)
    terms = np.flatnonzero(chosen | ((df >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z)))
    if not len(terms):
        return nothing
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    # the places of a text's terms, those without one left out; the texts follow one another
    places = [x[x >= 0] for x in (place[t] for t in texts)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in places])])
    idx = np.concatenate(places)
    del z, df, chosen, strong, place, places

    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS)), nothing.bias
    gw2, gv2, gb2 = np.full(len(terms), 1e-8), np.full((len(terms), FACTORS), 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            docs = order[at : at + BATCH]
            sizes = starts[docs + 1] - starts[docs]
            seg = np.repeat(np.arange(len(docs)), sizes)
            f = np.concatenate([idx[starts[d] : starts[d + 1]] for d in docs])
            vf = v[f]
            sums = np.zeros((len(docs), FACTORS))
            np.add.at(sums, seg, vf)
            squares = np.bincount(seg, weights=(vf * vf).sum(1), minlength=len(docs))
            s = b + np.bincount(seg, weights=w[f], minlength=len(docs)) + 0.5 * ((sums * sums).sum(1) - squares)
            g = (_sigmoid(s) - y[docs]) / len(docs)
            used, inv = np.unique(f, return_inverse=True)
            ge = g[seg]
            gw = np.bincount(inv, weights=ge, minlength=len(used)) + L2 * w[used]
            pair = ge[:, None] * (sums[seg] - vf)
            gv = np.column_stack([np.bincount(inv, weights=pair[:, k], minlength=len(used)) for k in range(FACTORS)]) if len(used) else np.empty((0, FACTORS))
            gv += L2 * v[used]
            gw2[used] += gw * gw
            gv2[used] += gv * gv
            gb2 += g.sum() ** 2
            w[used] -= RATE * gw / np.sqrt(gw2[used])
            v[used] -= RATE * gv / np.sqrt(gv2[used])
            b -= RATE * g.sum() / np.sqrt(gb2)
    return Machine(terms, float(b), w, v)


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Terms()
    for batch in batches:
        terms = [np.fromiter(sorted(_text_terms(t.as_py(), cache)), np.int32).tobytes() for t in batch.column(1)]
        order = [zlib.crc32(str(i).encode()) for i in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary()), pa.array(order, pa.int64())], names=["label", "terms", "h"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, seed: int = SEED) -> Machine:
    """Fit on the labelled rows of ``docs`` whose crc32(id as text) mod 3 is not 1.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the
    larger counts; of several texts each counts.  About ``sample`` texts are gathered, in the
    order of a hash of the id and up to ``sample_bytes`` bytes of terms; each counts whole.
    """
    label = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1) and crc32(cast(id as string)) % 3 <> 1")
    label = label.groupBy("id").agg(F.max("label").alias("label"))
    n = label.count()
    share = min(1.0, sample / max(n, 1))
    if share < 1:
        label = label.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most about ``sample`` rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(label), "id")
    found = stage(texts.select("label", "text", "id").mapInArrow(_terms_of, "label int, terms binary, h long"), "toxic-terms")
    sizes = sorted((r.h, r.n) for r in found.groupBy("h").agg(F.sum(F.length("terms")).alias("n")).collect())
    last, held = None, 0
    for h, n in sizes:
        held += n
        if held > sample_bytes:
            break
        last = h
    rows = found.where(F.col("h") <= last).select("label", "terms").collect() if last is not None else []
    discard(found)
    rows.sort(key=lambda r: (r.label, bytes(r.terms)))  # so that a rerun fits the same machine
    return fit([np.frombuffer(r.terms, np.int32) for r in rows], np.array([r.label for r in rows]), seed)


def _scorer(machine: Machine):
    cache = _Terms({int(t): i for i, t in enumerate(machine.terms)})

    def score(texts: pa.Array) -> np.ndarray:
        return _sigmoid(np.array([machine.decision(sorted(_text_terms(t.as_py(), cache))) for t in texts], np.float64))

    return score


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts get the machine's bias.

    held_out is crc32(id as text) mod 3 = 1, false for a null id.  A text of any length is
    scored whole; its distinct terms are held by the task that reads it.  Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return texts.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    shared, at = docs.sparkSession.sparkContext.broadcast(machine), [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(of(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
