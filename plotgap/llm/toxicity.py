"""Toxicity by a linear-chain conditional random field.

Each word is tagged toxic or not. Only documents are labelled, so labelled tokens are drawn from them first: word parts
(the word, its prefixes) that occur in many documents labelled toxic and next to none labelled clean mark the words of
toxic documents; all other words are clean tokens. Near copies are left out of the sample first, lest one text's words
look like evidence. A chain is a sentence, or 256 words of one; potentials are sums of word-part weights and a
two-by-two transition matrix, fitted by gradient ascent on the penalised likelihood with forward-backward expectations.

A document's score comes from its marginals: their highest log-odds and the expected number of toxic words enter a
logistic function fitted on the same sample. Words whose marginal is one half or more give the offending offsets.

The fit reads a bounded sample: ``per_class`` documents of each label, those with the lowest hash of doc_id. Scoring reads
whole texts and keeps one weight vector, of fixed size, per task.

Defined results: null text scores as empty text; empty texts get the score of a document without any suspicious word;
equal texts get equal scores; rows of labels without a label or with two different ones are used as toxic if any says
so; without both labels in the sample every score is 0; an empty table gives an empty result; other columns are
kept by ``reject`` and ignored by ``score``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
CHAIN = 256
ENDS = (b".", b"!", b"?")
TRIM = " \t.,;:!?|()[]{}\"'`*#$%&<>_-"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def parts(word: bytes) -> list[str]:
    """Word parts that carry weights: the word, its prefixes of 3 to 5 letters and its last 3."""
    w = word.decode("utf-8", "replace").lower().strip(TRIM)
    return [f"w{w}", *(f"{n}{w[:n]}" for n in (3, 4, 5) if len(w) > n), f"s{w[-3:]}"]


def slot(part: str) -> int:
    return xxhash.xxh3_64_intdigest(part.encode()) & ((1 << BITS) - 1)


@dataclass
class Model:
    """Weights by word part, start and transition log-potentials (from, to), document function, or nothing learned."""
    weights: np.ndarray
    start: float
    step: np.ndarray
    document: np.ndarray
    learned: bool = True


def chains(lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First word of every chain, for documents of these lengths laid end to end; ``ends`` marks the last word of a sentence."""
    n = int(lengths.sum())
    first = np.zeros(n, bool)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    first[offsets[:-1][lengths > 0]] = True
    first[1:] |= ends[:-1]
    starts = np.nonzero(first)[0]
    size = np.diff(np.append(starts, n))
    long = size > CHAIN
    if long.any():
        more = [np.arange(s, s + k, CHAIN)[1:] for s, k in zip(starts[long], size[long])]
        starts = np.sort(np.concatenate([starts, *more]))
    return starts


def forward_backward(emit: np.ndarray, starts: np.ndarray, start: float, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of the toxic tag at every word; their sum is the marginal's log-odds."""
    size = np.diff(np.append(starts, len(emit)))
    order = np.argsort(-size, kind="stable")
    at, size = starts[order], size[order]
    e = np.exp(step)  # e[from, to], 0 clean, 1 toxic
    ahead, back = np.zeros(len(emit)), np.zeros(len(emit))
    if not len(at):
        return ahead, back
    ahead[at] = emit[at] + start
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # chains longer than t
    for t in range(1, size[0]):
        i = at[:live[t]] + t
        odds = np.exp(ahead[i - 1])
        ahead[i] = emit[i] + np.log((e[0, 1] + odds * e[1, 1]) / (e[0, 0] + odds * e[1, 0]))
    for t in range(size[0] - 2, -1, -1):
        i = at[:live[t + 1]] + t
        odds = np.exp(emit[i + 1] + back[i + 1])
        back[i] = np.log((e[1, 0] + odds * e[1, 1]) / (e[0, 0] + odds * e[0, 1]))
    return ahead, back


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def distinct_texts(texts: list[list[bytes]]) -> list[int]:
    """Indices of texts that share none of four minimal five-word hashes with an earlier one."""
    seen, out = set(), []
    for i, words in enumerate(texts):
        grams = {xxhash.xxh3_64_intdigest(b" ".join(words[k:k + 5])) for k in range(max(1, len(words) - 4))}
        marks = {(s, min(xxhash.xxh3_64_intdigest(g.to_bytes(8, "little"), s) for g in grams)) for s in range(4)}
        if not marks & seen:
            out.append(i)
        seen |= marks
    return out


def suspicious_parts(texts: list[list[bytes]], toxic: np.ndarray, least: float = 16.0) -> set[str]:
    """Parts whose documents are toxic far more often than by chance (log-likelihood ratio) and almost never clean."""
    seen = {0: Counter(), 1: Counter()}
    for words, y in zip(texts, toxic):
        seen[int(y)].update({p for w in set(words) for p in parts(w) if not p.startswith("s") and len(p) > 3})
    n1, n = float(toxic.sum()), float(len(toxic))
    found = set()
    for p, a in seen[1].items():
        b = seen[0][p]
        if a >= 4 and a * (n - n1) >= 20 * b * n1:
            k, rate, mean = a + b, a / (a + b), n1 / n
            ratio = 2 * (a * np.log(rate / mean) + (b * np.log((1 - rate) / (1 - mean)) if b else 0.0))
            if ratio >= least:
                found.add(p)
    return found


def fit(texts: list[list[bytes]], toxic: np.ndarray, rounds: int = 60, penalty: float = 1e-4) -> Model:
    """Fit on the words of labelled documents."""
    kept = distinct_texts(texts) if texts else []
    texts, toxic = [texts[i] for i in kept], toxic[kept] if len(kept) else toxic[:0]
    none = Model(np.zeros(1 << BITS), 0.0, np.zeros((2, 2)), np.zeros(3), False)
    if not len(toxic) or toxic.min() == toxic.max():
        return none
    marks = suspicious_parts(texts, toxic)
    ids: dict[bytes, int] = {}
    rows: list[list[int]] = []
    marked: list[bool] = []
    words = np.zeros(sum(map(len, texts)), np.int64)
    n = 0
    for text in texts:
        for w in text:
            k = ids.get(w)
            if k is None:
                k = ids[w] = len(rows)
                p = parts(w)
                rows.append([slot(x) for x in p])
                marked.append(any(x in marks for x in p))
            words[n] = k
            n += 1
    lengths = np.array([len(t) for t in texts])
    end_of = np.zeros(len(rows), bool)
    end_of[[k for w, k in ids.items() if w.endswith(ENDS)]] = True
    y = np.array(marked, bool)[words] & np.repeat(toxic == 1, lengths)
    starts = chains(lengths, end_of[words])
    first = np.zeros(n, bool)
    first[starts] = True
    flat = np.array([s for r in rows for s in r])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights, extra = np.zeros(1 << BITS), np.zeros(5)  # start, then the transition matrix
    extra[0], extra[2] = -4.0, -4.0
    moments = [np.zeros((2, 1 << BITS)), np.zeros((2, 5))]
    inside = ~first
    before, after = np.nonzero(inside)[0] - 1, np.nonzero(inside)[0]
    for r in range(1, rounds + 1):
        by_word = np.bincount(owner, weights[flat], len(rows))
        emit = by_word[words]
        ahead, back = forward_backward(emit, starts, extra[0], extra[1:].reshape(2, 2))
        p = sigmoid(ahead + back)
        # expected transitions from the odds on either side of each step
        left, right = ahead[before], emit[after] + back[after]
        joint = np.exp(np.stack([np.zeros_like(left), right, left, left + right]) + extra[1:, None] - np.maximum(left, 0) - np.maximum(right, 0))
        joint /= joint.sum(axis=0)
        is_toxic = y.astype(float)
        seen = np.array([((1 - is_toxic[before]) * (1 - is_toxic[after])).sum(), ((1 - is_toxic[before]) * is_toxic[after]).sum(),
                         (is_toxic[before] * (1 - is_toxic[after])).sum(), (is_toxic[before] * is_toxic[after]).sum()])
        slope = [np.bincount(flat, np.bincount(words, is_toxic - p, len(rows))[owner], 1 << BITS) - penalty * n * 1e-3 * weights,
                 np.concatenate([[(is_toxic - p)[starts].sum()], seen - joint.sum(axis=1)])]
        for value, g, m, rate in ((weights, slope[0], moments[0], 0.3), (extra, slope[1], moments[1], 0.1)):
            m[0] = 0.8 * m[0] + 0.2 * g
            m[1] = 0.95 * m[1] + 0.05 * g * g
            value += rate * (m[0] / (1 - 0.8 ** r)) / (np.sqrt(m[1] / (1 - 0.95 ** r)) + 1e-3)
    model = Model(weights, float(extra[0]), extra[1:].reshape(2, 2).copy(), np.zeros(3))
    emit = np.bincount(owner, weights[flat], len(rows))[words]
    ahead, back = forward_backward(emit, starts, model.start, model.step)
    model.document = fit_document(features(ahead + back, lengths), toxic)
    return model


def features(odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: one, highest log-odds (limited), and the logarithm of one plus the expected number of toxic words."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    top = np.full(len(lengths), -12.0)
    np.maximum.at(top, owner, odds)
    many = np.bincount(owner, sigmoid(odds) if len(odds) else None, len(lengths)) if len(owner) else np.zeros(len(lengths))
    return np.stack([np.ones(len(lengths)), np.clip(top, -12, 12) / 4, np.log1p(many)], axis=1)


def fit_document(x: np.ndarray, toxic: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (toxic - p) - penalty * w)
    return w


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``per_class`` documents of each label, by lowest hash of doc_id."""
    one = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    mark = F.xxhash64("doc_id")
    chosen = [one.where(F.col("toxic") == y).orderBy(mark, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = chosen[0].union(chosen[1])  # at most 2 * per_class rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model:
    """The model, fitted in one task on the bounded sample; only its weights come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(3)))]
        rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[1] or ""))
        m = fit([(r[1] or "").encode("utf-8", "replace").split() for r in rows], np.array([r[2] for r in rows]))
        packed = np.concatenate([[float(m.learned), m.start], m.step.ravel(), m.document, m.weights])
        yield pa.RecordBatch.from_arrays([pa.array([packed.tobytes()], pa.binary())], names=["model"])

    row = sample(docs, labels, per_class).repartition(1).mapInArrow(run, "model binary").first()
    if row is None:  # no row, no task
        return fit([], np.zeros(0))
    v = np.frombuffer(row[0])
    return Model(v[9:], float(v[1]), v[2:6].reshape(2, 2), v[6:9], bool(v[0]))


class Emissions(dict):
    """A word's summed weight, remembered; forgets once ``most`` words are held."""

    def __init__(self, weights: np.ndarray, most: int = 400_000):
        super().__init__()
        self.weights, self.most = weights.tolist(), most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = sum(self.weights[slot(p)] for p in parts(word))
        return out


class Scorer:
    """Scores a few texts at once."""

    def __init__(self, model: Model):
        self.model, self.emissions = model, Emissions(model.weights)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[list]]:
        """Scores, and the spans of the words tagged toxic."""
        model = self.model
        words = [t.encode("utf-8", "replace").split() for t in texts]
        if not model.learned:
            return np.zeros(len(texts)), [[] for _ in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        flat = [w for ws in words for w in ws]
        emit = np.fromiter(map(self.emissions.__getitem__, flat), float, len(flat))
        ends = np.fromiter((w.endswith(ENDS) for w in flat), bool, len(flat))
        ahead, back = forward_backward(emit, chains(lengths, ends), model.start, model.step)
        odds = ahead + back
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        spans: list[list] = [[] for _ in texts]
        bad = np.nonzero(odds >= 0)[0]
        for d in np.unique(np.searchsorted(offsets, bad, "right") - 1):
            wanted = set((bad[(bad >= offsets[d]) & (bad < offsets[d + 1])] - offsets[d]).tolist())
            spans[d] = [{"start": m.start(), "end": m.end()} for k, m in enumerate(WORD.finditer(texts[d])) if k in wanted]
        return sigmoid(features(odds, lengths) @ model.document), spans

    def batches(self, column: pa.Array, characters: int = 3_000_000) -> Iterator[tuple[int, np.ndarray, list[list]]]:
        """(first row, scores, spans) of slices of a text column, a few million characters each."""
        texts, first, held = [], 0, 0
        for row, text in enumerate(column):
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held > characters or row + 1 == len(column):
                yield first, *self(texts)
                texts, first, held = [], row + 1, 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans): spans are [start, end) code points of the words tagged toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for first, result, spans in scorer.batches(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(result)), pa.array(result, pa.float64()), pa.array(spans, kind)],
                                                 names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or higher; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for first, result, _ in scorer.batches(batch.column(text)):
                yield batch.slice(first, len(result)).filter(pa.array(result < 0.5))

    return docs.mapInArrow(run, docs.schema)
