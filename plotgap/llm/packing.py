"""Best-fit packing by a configuration linear program.

Documents become token ids; only those longer than a sequence are cut. All that the packing needs to know is how many
pieces there are of each length, a table of at most ``capacity`` rows. On it the configuration program (fewest
sequences, each filled by a pattern of length classes) is solved by multiplicative weights: every round prices the
classes by how badly they are covered so far, a knapsack dynamic program finds the dearest pattern, and the round puts
an equal share of the sequences on it. The rounded-down program is filled with exact lengths, longest first; what is
left goes best-fit into the gaps and then into new sequences. Plain best-fit decreasing runs too, and the better of both
is used. Neither depends on the number of documents: ranges of equal sequences are handled as one.

Pieces find their place by their rank among pieces of the same length, so no table of pieces meets in one task.

Defined results: null text is an empty document (one piece of one end id); equal documents are packed separately; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotgap.llm.base import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Fixed pattern of the vocabulary's own word splitting, for words of these characters; others take the whole tokenizer.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
BLOCKS = 64


class WordIds(dict):
    """Ids of a word as little-endian unsigned 32-bit bytes; forgets once ``most`` words are held."""

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer, pre_tokenizers
        super().__init__()
        self.whole, self.most, self.parts = Tokenizer.from_file(path), most, {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {ch: level.pre_tokenize_str(ch)[0][0] for ch in map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x100)])}
        self.shown = str.maketrans(shown)
        self.model = self.whole.model

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and "<|" not in text:
            out = b"".join(self.part(p) for p in PARTS.findall(text.lower()))
        else:
            out = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.most:
            self.clear()
        self[word] = out
        return out

    def part(self, text: str) -> bytes:
        got = self.parts.get(text)
        if got is None:
            if len(self.parts) >= self.most:
                self.parts.clear()
            got = self.parts[text] = np.array([t.id for t in self.model.tokenize(text.translate(self.shown))], "<u4").tobytes()
        return got


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces of at most ``capacity`` ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(tokenizer)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1)):
                body = b"".join(map(ids.__getitem__, (text.as_py() or "").encode("utf-8", "replace").split())) + end
                doc = doc.as_py()
                for k, at in enumerate(range(0, len(body), step)):
                    part = body[at:at + step]
                    for column, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def dearest_pattern(prices: np.ndarray, most: np.ndarray, room: int) -> np.ndarray:
    """Knapsack by dynamic programming: how many of each class (of size 1, 2, ...) fill ``room`` at the highest price."""
    best, steps = np.zeros(room + 1), []
    for size in range(len(prices), 0, -1):
        left, part = int(min(most[size - 1], room // size)), 1
        while left > 0 and prices[size - 1] > 0:
            take = min(part, left)
            left, part = left - take, 2 * part
            width = take * size
            tried = best[:-width] + take * prices[size - 1]
            better = np.zeros(room + 1, bool)
            better[width:] = tried > best[width:]
            best[width:] = np.maximum(tried, best[width:])
            steps.append((size, take, better))
    at, chosen = int(np.argmax(best)), np.zeros(len(prices), np.int64)
    for size, take, better in reversed(steps):
        if better[at]:
            chosen[size - 1] += take
            at -= take * size
    return chosen


def fractional_patterns(demand: np.ndarray, room: int, rounds: int, rate: float) -> list[tuple[np.ndarray, float]]:
    """(pattern, sequences) of the configuration program over size classes, by multiplicative weights."""
    want = demand.astype(float)
    sizes = np.arange(1, len(demand) + 1)
    total = max(1.0, float((want * sizes).sum()) / room)
    share, covered = total / rounds, np.zeros(len(demand))
    found: dict[bytes, float] = defaultdict(float)
    has = want > 0
    for _ in range(rounds):
        weight = np.where(has, np.exp(-rate * (covered - covered[has].min())), 0.0)
        price = np.divide(weight, want, out=np.zeros_like(want), where=has)
        # no round covers a class by more than what is left of it, or an equal share
        most = np.ceil(np.maximum(want * (1 - covered), want / rounds) / share)
        pattern = dearest_pattern(price, np.where(has, most, 0), room)
        if not pattern.any():
            break
        found[pattern.tobytes()] += share
        covered += np.divide(pattern * share, want, out=np.zeros_like(want), where=has)
    return [(np.frombuffer(p, np.int64), n) for p, n in found.items()]


class Filling:
    """Ranges of sequences with equal gaps, and the slots put into them: (length, rank, count, first sequence)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.used, self.capacity = dict(counts), defaultdict(int), capacity
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.slots: list[tuple[int, int, int, int]] = []
        self.opened = 0

    def put(self, length: int, n: int, first: int) -> None:
        self.slots.append((length, self.used[length], n, first))
        self.used[length] += n
        self.left[length] -= n

    def keep(self, gap: int, first: int, n: int) -> None:
        self.gaps[gap].append((first, n))

    def patterns(self, plan: list[tuple[np.ndarray, float]], unit: int) -> None:
        by_class = defaultdict(list)
        for length in sorted(self.left):
            by_class[-(-length // unit)].append(length)
        for pattern, amount in sorted(plan, key=lambda p: -p[1]):
            n = round(amount)
            for size in np.nonzero(pattern)[0] + 1:
                have = sum(self.left[x] for x in by_class[size])
                n = min(n, have // int(pattern[size - 1]))
            if n < 1:
                continue
            ranges = [(self.opened, n, self.capacity)]
            self.opened += n
            for size in np.nonzero(pattern)[0] + 1:
                for _ in range(int(pattern[size - 1])):
                    following = []
                    for first, m, gap in ranges:
                        while m:
                            while not self.left[by_class[size][-1]]:
                                by_class[size].pop()
                            length = by_class[size][-1]
                            k = min(m, self.left[length])
                            self.put(length, k, first)
                            following.append((first, k, gap - length))
                            first, m = first + k, m - k
                    ranges = following
            for first, m, gap in ranges:
                self.keep(gap, first, m)

    def best_fit(self) -> None:
        """What is left, longest first, into the smallest gap that holds it."""
        room = np.zeros(self.capacity + 2, bool)
        for gap, ranges in self.gaps.items():
            room[gap] = bool(ranges)
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                ahead = np.nonzero(room[length:self.capacity + 1])[0]
                if len(ahead):
                    gap = length + int(ahead[0])
                    first, n = self.gaps[gap].pop()
                    room[gap] = bool(self.gaps[gap])
                else:
                    each = self.capacity // length
                    gap, n = self.capacity, -(-self.left[length] // each)
                    first = self.opened
                    self.opened += n
                # equal gaps take as many of this length as fit, whole ranges at a time
                while n and self.left[length] and gap >= length:
                    k = min(n, self.left[length])
                    self.put(length, k, first)
                    if k < n:
                        self.keep(gap, first + k, n - k)
                        room[gap] = True
                    n, gap = k, gap - length
                if n:
                    self.keep(gap, first, n)
                    room[gap] = True


def solve(counts: dict[int, int], capacity: int, classes: int = 1024, rounds: int = 300, rate: float = 8.0, small: int = 20) -> Filling:
    """Slots for ``counts`` pieces of each length. Pieces up to capacity / ``small`` are left to fill the patterns' gaps;
    lengths are rounded up to units so that about ``classes`` of them stay distinct."""
    unit = -(-len(counts) // classes) or 1
    demand = np.zeros(-(-capacity // unit), np.int64)
    for length, n in counts.items():
        if length > capacity // small:
            demand[-(-length // unit) - 1] += n
    out = Filling(counts, capacity)
    if demand.any():
        out.patterns(fractional_patterns(demand, capacity // unit, rounds, rate), unit)
    out.best_fit()
    plain = Filling(counts, capacity)
    plain.best_fit()
    return min(out, plain, key=lambda f: f.opened)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` has doc_id, piece and length <= capacity among its columns."""
    spark = pieces.sparkSession
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BLOCKS)).cast("int"))
    counted = dealt.groupBy("length", "_block").count().collect()  # at most capacity * BLOCKS rows
    counts, before = defaultdict(int), np.zeros((capacity + 1, BLOCKS), np.int64)
    for length, block, n in sorted(map(tuple, counted)):
        before[length, block] = counts[length]
        counts[length] += n
    slots = np.array(sorted(solve(dict(counts), capacity).slots), np.int64).reshape(-1, 4)
    keys = slots[:, 0] << 44 | slots[:, 1]
    shared = spark.sparkContext.broadcast((before, keys, slots))
    within = Window.partitionBy("length", "_block").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
    names = [*pieces.columns, "sequence_id"]
    schema = pieces.schema.add("sequence_id", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, keys, slots = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False) + before[length, batch.column("_block").to_numpy(zero_copy_only=False)]
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            sequence = slots[at, 3] + rank - slots[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(sequence, pa.int64())], names=names)

    placed = ranked.mapInArrow(place, schema)
    along = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(cut_pieces(docs, tokenizer, capacity)), capacity)
