"""Centroid clustering over zone maps along a space-filling curve.

Vectors are turned into integers, floor(scale * x), and clustered by a fixed number of rounds of nearest-centroid assignment
and exact integer means.

1. Vectors are put in Hilbert order, on the components' places between the smallest and the largest of all, and dealt to
   tasks by ranges of it (vec_id and arrival settle ties, so equal vectors do not share a task). Neighbours form blocks of
   ``BLOCK`` vectors, kept in a table as packed integers with the smallest and largest value of each component.
2. In each round a task has the centroids, k times the width. The distance of a centroid to a block's box is a lower bound
   for all its vectors, that to the box's far corner an upper bound; centroids whose lower bound is above the least upper
   bound cannot be nearest to any vector of the block. The others are compared exactly, all vectors at once.
3. Tasks give for each centroid their count and sums by component, cut into 32-bit limbs, so sums of any size stay exact.
   The driver sees k sums, however many vectors there are.

Ties go to the smaller centroid number; an empty centroid stays where it is. Values of any finite size are exact; a distance
or inertia beyond a long is given as the largest long.

Defined results: vectors that are null, of another width, or hold a null or non-finite component take no part; rows without
vec_id take part, but become first centroids only if too few others are there; among rows of one hash the lower vector comes
first; fewer vectors than k give as many centroids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.llm.base import stored

BLOCK = 256
BITS = 4
LIMB = 32
SAFE = 1 << 24
LONGEST = (1 << 63) - 1


def usable(column: str, width: int) -> Column:
    """The vector has ``width`` components, all finite."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) == width) & ~bad, F.lit(False))


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python integers where those are too short."""
    with np.errstate(over="ignore"):
        x = np.floor(values.astype(np.float64) * scale)
    if not np.isfinite(x).all():  # the product left the range of doubles: scale a power of two exactly instead
        return np.array([int(v) * scale if abs(v) > 2.0 ** 60 else int(np.floor(v * scale)) for v in values.ravel()], object).reshape(values.shape)
    if np.abs(x).max(initial=0) < SAFE:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def hilbert_keys(places: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ``places`` (whole numbers below 2^bits) as bytes that sort like it."""
    x = places.T.astype(np.uint32).copy()
    n = len(x)
    q = np.uint32(1 << (bits - 1))
    while q > 1:  # undo the turns and mirrorings of the curve, from the coarsest cube down
        low = np.uint32(q - 1)
        for i in range(n):
            inside = (x[i] & q) != 0
            swap = np.where(inside, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= flip
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]  # one bit of every component, the top one first
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def packed(vectors: DataFrame, scale: int, width: int, column: str = "embedding") -> DataFrame:
    """(ids, known, wide, codes): blocks of ``BLOCK`` neighbours in Hilbert order with their boxes (low, high)."""
    low, high = vectors.agg(F.min(F.array_min(column)).cast("double"), F.max(F.array_max(column)).cast("double")).first()
    low, high = (0.0, 0.0) if low is None else (float(low), float(high))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), width).astype(np.float64)
            place = np.zeros(v.shape)
            if high > low:
                place = np.minimum(np.floor((v / 2 - low / 2) / (high / 2 - low / 2) * (1 << BITS)), (1 << BITS) - 1)
            key = hilbert_keys(place, BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k.tobytes() for k in key], pa.binary())], names=["vec_id", "v", "key"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            part = table.combine_chunks()
            ids = part.column(0).combine_chunks() if part.num_rows else pa.array([], pa.int64())
            v = scaled(_matrix(part.column(1).combine_chunks(), width), scale)
            wide = v.dtype == object
            text = ",".join(map(str, v.ravel())).encode() if wide else v.astype(np.int32).tobytes()
            lo, hi = ([[str(x) for x in f(axis=0)]] for f in (v.min, v.max))
            return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([wide]), pa.array([text], pa.binary()),
                                               pa.array(lo, pa.list_(pa.string())), pa.array(hi, pa.list_(pa.string()))], names=["ids", "wide", "codes", "low", "high"])

        for batch in batches:
            held.append(batch.select(["vec_id", "v"]))
            rows += batch.num_rows
            while rows >= BLOCK:
                whole = pa.Table.from_batches(held)
                for at in range(0, rows - BLOCK + 1, BLOCK):
                    yield block(whole.slice(at, BLOCK))
                done = rows // BLOCK * BLOCK
                held, rows = whole.slice(done).to_batches(), rows - done
        if rows:
            yield block(pa.Table.from_batches(held))

    kind = vectors.schema[column].dataType.simpleString()
    placed = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"))
                    .mapInArrow(keyed, f"vec_id long, v {kind}, key binary").withColumn("arrival", F.monotonically_increasing_id()))
    return (placed.orderBy("key", "vec_id", "arrival").select("vec_id", "v")
            .mapInArrow(blocks, "ids array<long>, wide boolean, codes binary, low array<string>, high array<string>"))


def nearest(v: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of every vector of a block, and how many centroids were compared."""
    kind = object if object in (v.dtype, centroids.dtype) else np.int64
    v, low, high, c = (a.astype(kind) for a in (v, low, high, centroids))
    outside = np.maximum(np.maximum(low - c, c - high), 0)
    corner = np.maximum(abs(c - low), abs(high - c))
    least, most = (outside * outside).sum(axis=1), (corner * corner).sum(axis=1)
    chosen = np.nonzero(least <= most.min())[0]
    best = number = None
    for k in chosen.tolist():
        d = ((v - c[k]) ** 2).sum(axis=1)
        if best is None:
            best, number = d, np.full(len(v), k)
        else:
            nearer = (d < best).astype(bool)
            best, number = np.where(nearer, d, best), np.where(nearer, k, number)
    return number, best, len(chosen)


def unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, low, high) of each block."""
    for ids, wide, codes, low, high in zip(*(batch.column(c) for c in ("ids", "wide", "codes", "low", "high"))):
        if wide.as_py():
            v = np.array([int(x) for x in codes.as_py().split(b",")], object).reshape(-1, width)
        else:
            v = np.frombuffer(codes.as_py(), np.int32).reshape(-1, width).astype(np.int64)
        yield ids.as_py(), v, *(np.array([int(x) for x in e.as_py()], v.dtype) for e in (low, high))


def integers(rows: list[list[int]]) -> np.ndarray:
    """Centroids as 64-bit integers where squared distances to ``SAFE`` values stay exact, else as Python integers."""
    return np.array(rows, np.int64 if max((abs(x) for r in rows for x in r), default=0) < SAFE else object)


def sums(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, component, limb, value): sums of the vectors of each cluster; component -1 holds their number."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), object), np.zeros(k, object)
        for batch in batches:
            for _, v, low, high in unpacked(batch, width):
                number, _, _ = nearest(v, low, high, centroids)
                for c in np.unique(number).tolist():
                    mine = v[number == c]
                    total[c] += mine.sum(axis=0).astype(object)
                    count[c] += len(mine)
        out = [(c, -1, 0, int(count[c])) for c in range(k) if count[c]]
        for c in range(k):
            for d in range(width):
                rest, limb = int(total[c, d]), 0
                while rest not in (0, -1):
                    out.append((c, d, limb, rest & ((1 << LIMB) - 1)))
                    rest >>= LIMB
                    limb += 1
                if rest:
                    out.append((c, d, limb, rest))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["cluster", "component", "limb", "value"])
    partial = blocks.mapInArrow(run, "cluster int, component int, limb int, value long")
    return partial.groupBy("cluster", "component", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    total: dict[tuple[int, int], int] = {}
    for r in sums(blocks, centroids).collect():
        total[r.cluster, r.component] = total.get((r.cluster, r.component), 0) + (int(r.value) << (LIMB * r.limb))
    rows = centroids.tolist()
    for c in range(len(rows)):
        n = total.get((c, -1), 0)
        if n:
            rows[c] = [total.get((c, d), 0) // n for d in range(len(rows[c]))]
    return integers(rows)


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: str = "1", column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    kept = vectors.where(usable(column, width)).select("vec_id", column)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select(order.alias("_order"), F.col(column).alias("_v")).orderBy(F.asc_nulls_last("_order"), "_v").limit(k).collect()
    centroids = integers([scaled(np.array(r["_v"], np.float64), scale).tolist() for r in first]).reshape(len(first), width)
    if not first:
        return kept.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = stored(packed(kept, scale, width, column))
    for _ in range(rounds):
        centroids = moved(blocks, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v, low, high in unpacked(batch, width):
                number, best, _ = nearest(v, low, high, centroids)
                far = [min(int(d), LONGEST) for d in best]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])
    placed = stored(blocks.mapInArrow(run, "vec_id long, cluster int, distance long"))
    by = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows at most
    every = sum(int(r.s) for r in by)
    names = kept.sparkSession.createDataFrame([(r.cluster, min(int(r.s), LONGEST), min(every, LONGEST), digest(centroids[r.cluster].tolist())) for r in by],
                                              "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
