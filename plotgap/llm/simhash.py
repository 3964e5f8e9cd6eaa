"""SimHash near duplicates: a hierarchical index over fingerprints in Gray order.

A fingerprint has 64 bits, each the majority of that bit among the XXH64 hashes (seed 42) of a document's three-word
shingles, repeats included. Two fingerprints link when ``most`` (3) bits differ or fewer.

1. Equal fingerprints are one node, so a group of exact copies costs one row a task.
2. The bits are cut into b blocks. Two linked fingerprints agree in b - 3 of them at least, so every node is dealt to one
   bucket for each choice of b - 3 blocks; b grows with the number of nodes (``blocks_for``).
3. All buckets are sorted by (choice, agreed bits, Gray rank of the other bits). Each task walks its stretch of that order.
   Runs of ``FAN`` neighbours become one upper node that keeps only the bits its members share; runs of upper nodes become
   nodes of the next level. Pairs of nodes are compared top down: the shared bits in which two nodes differ are a lower
   bound of all differences below them, so whole groups drop out once more than ``most`` have come up, and whole groups
   link at once when even their open bits cannot bring up more.
4. A bucket that is larger than a block of ``BLOCK`` nodes, or that a task border cuts, leaves its blocks in a table; pairs
   of such blocks go through the same comparison, spread over all tasks, unless their shared bits already differ too much.
5. Tasks give a spanning forest of what they found linked, never all pairs, and connected components are contracted from it.

Defined results: null, empty and word-free texts have fingerprint zero and link like any other; one or two words are one
shingle; repeated rows share a node; rows without doc_id take part and get the smallest doc_id they reach, or null if no
row of the class has one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.llm.base import stored
from plotgap.plans.components import connected_components

N = 3
SEED = 42
FAN = 8
BLOCK = 65_536
PAIRS = 2_000_000
HOT = 1000


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= N:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size).tolist()
    end = end.tolist()
    ones, n = np.zeros(64, np.int64), len(words) - N + 1
    for at in range(0, n, 65_536):
        upto = min(at + 65_536, n)
        h = np.fromiter((digest(joined[b:e], SEED) for b, e in zip(begin[at:upto], end[at + N - 1:upto + N - 1])), np.uint64, upto - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document, as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def blocks_for(nodes: int, most: int = 3) -> int:
    """Number of blocks with the least copies and expected comparisons."""
    def cost(b: int) -> float:
        return math.comb(b, most) * (1 + 0.1 * nodes / 2.0 ** (64 * (b - most) / b))
    return min(range(most + 1, most + 6), key=cost)


def masks(blocks: int, most: int = 3) -> list[int]:
    """For every choice of ``blocks - most`` blocks the mask of their bits."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    part = [(1 << edge[k + 1]) - (1 << edge[k]) for k in range(blocks)]
    return [sum(part[k] for k in chosen) for chosen in combinations(range(blocks), blocks - most)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(code: Column) -> Column:
    """Place of a code in Gray order: every bit is the parity of itself and the bits above."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def dealt(nodes: DataFrame, blocks: int, most: int) -> DataFrame:
    """(choice, agreed, fp) in the order of (choice, agreed, Gray rank of the other bits)."""
    each = [F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("agreed"),
                     gray_rank(F.col("fp").bitwiseAND(F.lit(_signed(~m & (1 << 64) - 1)))).alias("rank")) for k, m in enumerate(masks(blocks, most))]
    return nodes.select("fp", F.inline(F.array(*each))).orderBy("choice", "agreed", "rank").select("choice", "agreed", "fp")


class Index:
    """Upper nodes over sorted codes. ``starts`` are the first places of the buckets, whose nodes are never mixed."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        both, either, n = codes, codes, len(codes)
        bound = np.append(starts, n)
        self.levels = [(both, either, np.arange(n), np.ones(n, np.int64), np.arange(n), np.arange(1, n + 1))]
        while (np.diff(bound) > 1).any():
            runs = -(-np.diff(bound) // FAN)
            upper = np.append(0, np.cumsum(runs))
            first = np.repeat(bound[:-1], runs) + FAN * (np.arange(upper[-1]) - np.repeat(upper[:-1], runs))
            both, either = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(either, first)
            below = self.levels[-1]
            count = np.diff(np.append(first, len(below[0])))
            self.levels.append((both, either, first, count, below[4][first], below[5][first + count - 1]))
            bound = upper
        self.label = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the classes of places a[i] and b[i]."""
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                deeper = self.label[self.label]
                if (deeper == self.label).all():
                    break
                self.label = deeper

    def search(self, left: np.ndarray, right: np.ndarray, most: int) -> None:
        """Unite what is linked below the pairs (left[i], right[i]) of top nodes; a node stands against itself too."""
        todo = [(len(self.levels) - 1, left, right)]
        while todo:
            level, p, q = todo.pop()
            both, either, first, count, low, high = self.levels[level]
            if len(p) > 1 and int((count[p] * count[q]).sum()) > PAIRS:
                half = len(p) // 2
                todo += [(level, p[half:], q[half:]), (level, p[:half], q[:half])]
                continue
            fixed = (both[p] & ~either[q]) | (both[q] & ~either[p])
            near = np.bitwise_count(fixed) <= most
            p, q, fixed = p[near], q[near], fixed[near]
            whole = np.bitwise_count(fixed | (both[p] ^ either[p]) | (both[q] ^ either[q])) <= most
            if whole.any():
                a, b = p[whole], q[whole]
                self.unite(low[a], low[b])
                if level:
                    node = np.unique(np.concatenate([a, b]))
                    size = high[node] - low[node]
                    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[node], size)
                    self.unite(inside, np.repeat(low[node], size))
            if level == 0 or whole.all():
                continue
            p, q = p[~whole], q[~whole]
            size = count[p] * count[q]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            across = np.repeat(count[q], size)
            i, j = np.repeat(first[p], size) + at // across, np.repeat(first[q], size) + at % across
            keep = (np.repeat(p != q, size)) | (i <= j)
            todo.append((level - 1, i[keep], j[keep]))

    def forest(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = np.nonzero(self.label != np.arange(len(codes)))[0]
        return codes[moved], codes[self.label[moved]]


FOUND = "choice int, agreed long, a long, b long, codes binary, both long, either long, n int"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
_NAMES = ["choice", "agreed", "a", "b", "codes", "both", "either", "n"]


def _rows(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _links(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(a), 100_000):
        x, y = a[at:at + 100_000].view(np.int64), b[at:at + 100_000].view(np.int64)
        none = [None] * len(x)
        yield _rows([none, none, x, y, none, none, none, none])


def _block(choice: int, agreed: int, codes: np.ndarray) -> pa.RecordBatch:
    both, either = np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes)
    first = int(codes[:1].view(np.int64)[0])
    return _rows([[choice], [agreed], [first], [None], [codes.tobytes()], [int(both.view(np.int64))], [int(either.view(np.int64))], [len(codes)]])


def walked(order: DataFrame, most: int, size: int) -> DataFrame:
    """Links (a, b) inside blocks, and a row for each block (its first code in ``a``) of a bucket that may go on elsewhere."""
    def solve(choice: np.ndarray, agreed: np.ndarray, codes: np.ndarray, begun: bool, goes_on: bool) -> Iterator[pa.RecordBatch]:
        start = np.append(0, np.nonzero((np.diff(choice) != 0) | (np.diff(agreed) != 0))[0] + 1)
        index = Index(codes, start)
        each = np.diff(np.append(start, len(codes)))
        top = np.nonzero(each > 1)[0]
        index.search(top, top, most)
        yield from _links(*index.forest(codes))
        for k in {*([0] if begun else []), *([len(start) - 1] if goes_on else [])}:
            yield _block(int(choice[start[k]]), int(agreed[start[k]]), codes[start[k]:start[k] + each[k]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, begun = [], 0, True  # the first bucket may have begun in the task before

        def taken():
            return [np.concatenate([h[k] for h in held]) for k in range(3)]

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)))
            rows += batch.num_rows
            while rows > size:
                c, k, f = taken()
                last = int(np.nonzero((c != c[-1]) | (k != k[-1]))[0].max(initial=-1)) + 1  # where the bucket still open begins
                end = last or size
                yield from solve(c[:end], k[:end], f[:end], begun, not last)
                held, rows, begun = [(c[end:], k[end:], f[end:])], rows - end, not last
        if rows:
            yield from solve(*taken(), begun, True)  # the last bucket may go on in the next task
    return order.mapInArrow(run, FOUND)


def across(blocks: DataFrame, most: int) -> DataFrame:
    """(a, b): links between the blocks of one bucket. Places are paired without their codes, which follow by two joins."""
    small = blocks.select("choice", "agreed", "a", "both", "either")
    other = small.toDF("choice", "agreed", "b", "_both", "_either")
    fixed = F.col("both").bitwiseAND(F.bitwise_not("_either")).bitwiseOR(F.col("_both").bitwiseAND(F.bitwise_not("either")))
    pairs = small.join(other, ["choice", "agreed"]).where((F.col("a") < F.col("b")) & (F.bit_count(fixed) <= most)).select("choice", "a", "b")
    codes = blocks.select("choice", "a", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                index = Index(np.concatenate([x, y]), np.array([0, len(x)]))
                index.search(np.array([0]), np.array([1]), most)
                a, b = index.forest(np.concatenate([x, y]))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
    return (pairs.join(codes, ["choice", "a"]).join(codes.toDF("choice", "b", "_codes"), ["choice", "b"])
            .select("codes", "_codes").mapInArrow(run, "a long, b long"))


def classes(docs: DataFrame, most: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    if not 0 <= most <= 8:
        raise ValueError("most is between 0 and 8")
    each = stored(fingerprints(docs))
    nodes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    n_nodes, n_rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = stored(walked(dealt(nodes.select("fp"), blocks_for(n_nodes, most), most), most, block))
    links = stored(found.where("b IS NOT NULL").select("a", "b").union(across(found.where("b IS NULL"), most)))
    component = stored(connected_components(links))
    placed = nodes.join(component.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    named = stored(placed.join(lowest, "component").select("fp", "n", "component_id"))
    hot = F.col("n") * HOT >= n_rows  # at most HOT fingerprints can have that share of all rows
    marked = each.join(F.broadcast(named.where(hot).select("fp", "component_id", F.lit(True).alias("_hot"))), "fp", "left")
    rest = marked.where("_hot IS NULL").select("doc_id", "fp").join(named.where(~hot).select("fp", "component_id"), "fp")
    return marked.where("_hot").select("doc_id", "fp", "component_id").union(rest.select("doc_id", "fp", "component_id"))
