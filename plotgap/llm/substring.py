"""Removal of repeated passages by level-wise doubling.

A passage repeats where a window of ``min_words`` words has a word sequence that starts anywhere else too, in another
document or the same. Windows are found by levels of doubling length, and only what repeats at one level goes to the next:

1. Level of half the length (18 for 35). Every long window has one anchor, the smallest hash among the half-length windows
   inside it, so equal windows have equal anchors. Anchors, about a tenth of all windows, are counted over the corpus;
   those found once are dropped for good.
2. Twice that length, cut to ``min_words``: only windows whose anchor repeats are hashed and counted.

No candidate longer than ``min_words`` needs a level: all its windows of that length repeat already, so going on could not
change which words are removed. Words under a repeated window are removed; windows are judged on the input.

Counts come from partial aggregation, so a passage in a third of all documents is one row a task. Hashes go back to their
documents by joins whose hot keys Spark can split; a document's own hashes are the only group that is gathered. Hashes
have 64 bits: with n candidate windows, about n^2 / 2^65 pairs are mistaken.

Defined results: null and word-free texts have no words and keep none; texts shorter than a window lose nothing; equal
rows are repeats of each other, also under one doc_id; rows without doc_id take part; an empty table gives an empty
result; other columns are ignored by ``kept_words`` .
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgap.llm.base import Hashed, cut, discard, release, sliding_min, stored, window_hashes


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _hashes(words: list[bytes], hashed: Hashed) -> np.ndarray:
    return np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))


def _distinct(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``values``, and how often (1 or 2) each stands in ``among``."""
    found, n = np.unique(among, return_counts=True)
    values = np.unique(values)
    return values, np.minimum(n[np.searchsorted(found, values)], 2)


class _Rows:
    """Collects (hash, key, times) into record batches."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, hashes: np.ndarray, times: np.ndarray, key: int) -> None:
        self.parts.append((hashes, np.full(len(hashes), key, np.int64), times))
        self.n += len(hashes)

    def batch(self) -> pa.RecordBatch:
        h, k, t = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, int))
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k), pa.array(t, pa.int32())], names=["hash", "key", "times"])


ROWS = "hash long, key long, times int"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.xxhash64("text")).alias("key"))


def anchors(docs: DataFrame, min_words: int) -> DataFrame:
    """(hash, key, times): the half-length anchors of each document's windows; times is 2 if it is there more than once."""
    half = -(-min_words // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, rows = Hashed(), _Rows()
        for batch in batches:
            for text, key in zip(batch.column(0), batch.column(1)):
                words = _words(text.as_py())
                if len(words) >= min_words:
                    windows = window_hashes(_hashes(words, hashed), half)
                    rows.add(*_distinct(sliding_min(windows, min_words - half + 1), windows), key.as_py())
                if rows.n > 200_000:
                    yield rows.batch()
        yield rows.batch()
    return docs.select("text", "key").mapInArrow(run, ROWS)


def candidates(docs: DataFrame, marks: DataFrame, min_words: int) -> DataFrame:
    """(hash, key, times) of the full-length windows whose anchor is among the document's ``marks``."""
    half = -(-min_words // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, rows = Hashed(), _Rows()
        for batch in batches:
            for text, key, marked in zip(batch.column(0), batch.column(1), batch.column(2)):
                w = _hashes(_words(text.as_py()), hashed)
                if len(w) >= min_words:
                    whole = window_hashes(w, min_words)
                    own = marked.values.to_numpy(zero_copy_only=False).view(np.uint64)
                    live = np.isin(sliding_min(window_hashes(w, half), min_words - half + 1), own)
                    rows.add(*_distinct(whole[live], whole), key.as_py())
                if rows.n > 200_000:
                    yield rows.batch()
        yield rows.batch()
    return docs.select("text", "key").join(marks, "key").select("text", "key", "marks").mapInArrow(run, ROWS)


def repeated(rows: DataFrame) -> DataFrame:
    """(key, marks): for each document, those of its hashes that stand in two places or more."""
    often = stored(rows.groupBy("hash").agg(F.sum("times").alias("n")).where("n >= 2").select("hash"))
    return rows.join(often, "hash").groupBy("key").agg(F.collect_set("hash").alias("marks"))


def strip(docs: DataFrame, marks: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, n_words, n_removed, longest, kept): longest is the longest removed stretch in words, kept the words left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, removed, longest, kept = [], [], [], []
                for text, marked in zip(part.column(1), part.column(2)):
                    words = _words(text.as_py())
                    gone = np.zeros(len(words), bool)
                    if marked.is_valid and len(words) >= min_words:
                        own = marked.values.to_numpy(zero_copy_only=False).view(np.uint64)
                        hit = np.isin(window_hashes(_hashes(words, hashed), min_words), own).astype(np.int64)
                        edge = np.zeros(len(words) + 1, np.int64)
                        edge[:len(hit)] += hit
                        edge[min_words:min_words + len(hit)] -= hit
                        gone = np.cumsum(edge)[:-1] > 0
                    runs = np.diff(np.nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))[0])[::2]
                    n.append(len(words))
                    removed.append(int(gone.sum()))
                    longest.append(int(runs.max(initial=0)))
                    kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode() if removed[-1] else b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in (n, removed, longest)), pa.array(kept, pa.string())],
                                                 names=["doc_id", "n_words", "n_removed", "longest", "kept"])
    return (docs.join(marks, "key", "left").select("doc_id", "text", "marks")
            .mapInArrow(run, "doc_id long, n_words long, n_removed long, longest long, kept string"))


def kept_words(docs: DataFrame, min_words: int = 35) -> DataFrame:
    """Every document without its repeated passages; see ``strip`` for the columns."""
    if min_words < 2:
        raise ValueError("a window has two words at least")
    docs = keyed(docs)
    marked = stored(anchors(docs, min_words))
    half = cut(repeated(marked))
    discard(marked)
    release(docs.sparkSession)
    whole = stored(candidates(docs, half, min_words))
    del half
    release(docs.sparkSession)
    marks = stored(repeated(whole))
    discard(whole)
    release(docs.sparkSession)
    return strip(docs, marks, min_words)
