"""Exact top-k inner products by columnar branch and bound.

Vectors are packed into blocks held dimension by dimension. A query runs over a block's dimensions a few at a time: partial
products accumulate, and what the remaining dimensions can still add is at most the product of both remaining norms
(Cauchy-Schwarz). Candidates whose bound is below the k-th best score so far are dropped and the survivors compacted
before the next dimensions are read. Bounds are inclusive, so ties survive.

The stated queries run against all rows in blocks: query blocks are dealt to groups, candidate blocks to slots, and each
(group, slot) is a task of its own. Each task keeps k rows per query; the last step ranks those.

Defined results: vectors that are null or hold a null or non-finite component take no part, neither do rows without an
id; only vectors of one length are compared; empty vectors score 0; equal vectors are separate candidates; ties go to the
smaller id; an empty table gives an empty result; other columns are ignored. A score beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP = 16


def _blocks(vectors: DataFrame, prefix: str, most: int) -> DataFrame:
    """(width, block, ids, columns): up to ``most`` vectors of one width, components as floor(256 x), dimension-major."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            ok = ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy()
            values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes nan
            width = np.diff(ends)
            for w in np.unique(width[ok]):
                rows = np.nonzero(ok & (width == w))[0]
                matrix = values[ends[:-1][rows][:, None] + np.arange(w)]
                sound = np.isfinite(matrix).all(axis=1)
                rows, matrix = rows[sound], np.floor(256.0 * matrix[sound])
                for at in range(0, len(rows), most):
                    part = np.ascontiguousarray(matrix[at:at + most].T)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(w)], pa.int32()), pa.array([int(ids[rows[at]])], pa.int64()),
                         pa.array([ids[rows[at:at + most]].astype("<i8").tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary())],
                        names=["width", f"{prefix}block", f"{prefix}ids", f"{prefix}columns"])
    return vectors.mapInArrow(run, f"width int, {prefix}block long, {prefix}ids binary, {prefix}columns binary")


def _rest(columns: np.ndarray) -> np.ndarray:
    """Norm of what is left from each multiple of STEP on, never too low."""
    squares = np.zeros((len(columns) // STEP + 2, columns.shape[1]))
    for k in reversed(range(-(-len(columns) // STEP))):
        squares[k] = squares[k + 1] + (columns[k * STEP:(k + 1) * STEP] ** 2).sum(axis=0)
    return np.sqrt(squares) * (1 + 1e-9)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > k:
        keep = scores >= np.partition(scores, -k)[-k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_block(query: np.ndarray, own: int, query_rest: np.ndarray, ids: np.ndarray, columns: np.ndarray, rest: np.ndarray,
                 best: tuple[np.ndarray, np.ndarray], k: int, seed: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """``best`` (scores, ids) after a block: branch and bound over its columns."""
    alive = np.nonzero(ids != own)[0]
    if len(best[0]) < k:  # no bound yet: the first few are scored in full
        head, alive = alive[:seed], alive[seed:]
        best = _best(np.concatenate([best[0], query @ columns[:, head]]), np.concatenate([best[1], ids[head]]), k)
    partial = np.zeros(len(alive))
    for n, at in enumerate(range(0, len(query), STEP)):
        if not len(alive):
            return best
        partial = partial + query[at:at + STEP] @ columns[at:at + STEP, alive]
        if len(best[0]) == k:
            stay = partial + query_rest[n + 1] * rest[n + 1][alive] + 0.5 >= best[0][-1]
            alive, partial = alive[stay], partial[stay]
    return _best(np.concatenate([best[0], partial]), np.concatenate([best[1], ids[alive]]), k)


def _exact(query: np.ndarray, ids: np.ndarray, own: int, columns: np.ndarray, best: tuple, k: int) -> tuple:
    """Numbers too large for doubles: whole products of Python integers."""
    whole = [[int(v) for v in c] for c in columns.T]
    found = [(-int(s), int(i)) for s, i in zip(*best)]
    found += [(-sum(int(a) * b for a, b in zip(query, c)), int(i)) for c, i in zip(whole, ids) if i != own]
    found = sorted(found)[:k]
    return np.array([-s for s, _ in found], object), np.array([i for _, i in found], np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, groups: int = 8, slots: int = 16, query_block: int = 512,
          block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` highest integer inner products.

    Both frames have vec_id and embedding. ``groups`` and ``slots`` set how far the work is spread: candidate blocks are
    read by every group, query blocks by every slot.
    """
    asked = (_blocks(queries.select("vec_id", "embedding"), "q", query_block)
             .withColumn("_group", F.pmod(F.xxhash64("qblock"), F.lit(groups)))
             .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<bigint>"))))
    held = (_blocks(vectors.select("vec_id", "embedding"), "c", block)
            .withColumn("_slot", F.pmod(F.xxhash64("cblock"), F.lit(slots)))
            .withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None

        def result():
            own, _, _, best = state
            n = [len(b[0]) for b in best]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, n), pa.int64()), pa.array(np.concatenate([b[1] for b in best]).astype(np.int64), pa.int64()),
                 pa.array([int(s) for b in best for s in b[0]], pa.int64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                w, q_ids, q_bytes, c_ids, c_bytes = (batch.column(c)[row].as_py() for c in ("width", "qids", "qcolumns", "cids", "ccolumns"))
                if now != (w, q_ids):
                    if state:
                        yield result()
                    own = np.frombuffer(q_ids, "<i8")
                    q = np.frombuffer(q_bytes, float).reshape(w, len(own))
                    now, state = (w, q_ids), (own, q, _rest(q), [(np.zeros(0), np.zeros(0, np.int64))] * len(own))
                own, q, q_rest, best = state
                ids = np.frombuffer(c_ids, "<i8")
                columns = np.frombuffer(c_bytes, float).reshape(w, len(ids))
                small = np.abs(q).max(initial=0) * np.abs(columns).max(initial=0) * w < 2 ** 52
                rest = _rest(columns)
                for i in range(len(own)):
                    if small and best[i][0].dtype != object:
                        best[i] = search_block(q[:, i], own[i], q_rest[:, i], ids, columns, rest, best[i], k)
                    else:
                        best[i] = _exact(q[:, i], ids, own[i], columns, best[i], k)
        if state:
            yield result()

    pairs = (asked.join(held, ["width", "_group", "_slot"]).select("width", "qblock", "qids", "qcolumns", "cids", "ccolumns")
             .sortWithinPartitions("width", "qblock"))
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
