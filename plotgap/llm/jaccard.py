"""N-gram Jaccard join by size-aware heavy and light sets, down to classes of near duplicates.

A document's set is its distinct five-word shingles (64-bit hashes). Equal sets are one class from the start. Two classes
link when their Jaccard similarity is ``threshold`` or more, so sizes n and m share at least c(n, m) = t / (1 + t) * (n + m)
shingles.

* Light sets (size up to a boundary) are enumerated: every subset of the fixed size c(n, m) becomes a key, for each
  size m they may meet; two light sets link exactly when they share a key.
* Heavy sets scan inverted lists. A list is read only for a set's first floor((1 - t) n) + 1 shingles in a global order,
  rare ones first, because two linked sets always share one of those. List lengths are exact: a third of the hash range
  is counted for every set, the rest of it only for sets too small to be covered by that third; shingles of one
  list entry drop out right after counting.
* The boundary is where subset keys plus list entries are fewest, from counts by size.

Only classes are wanted, so lists are not expanded into all pairs. Every member of a list is compared with two
representatives of it (the one with fewest rare shingles, and any other); what is found linked is contracted; only
members of lists that still stand in different components are compared pair by pair. These lists are pooled by their member of
smallest hash, a pool's sets are dealt into blocks, and two blocks meet in one place, where sizes and the parities of shingle
buckets (packed bits, a lower bound of the difference) decide which pairs become rows; those rows are settled by intersecting
whole sets. An entry is left out where too little of the set comes after it for any partner in the list.

Defined results: null, empty and word-free text has an empty set, which links with nothing; fewer than five words
are one shingle; repeated rows and equal sets are one class; rows without doc_id take part and get the smallest doc_id they
reach, or null if no row of the class has one; rows of one doc_id with different texts are judged by their texts; an empty table
gives an empty result; columns other than doc_id and text are ignored by ``classes`` and kept by ``one_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotgap.llm.base import Hashed, cut, discard, release, stored
from plotgap.plans.components import connected_components

N = 5
MOST_LIGHT = 12
ALL_BELOW = 96
THIRD = (1 << 64) // 3
BITS = 512
BLOCK = 4096
#: What a row is looked up by, and what tells the texts of one doc_id apart.
SAME = "xxhash64(coalesce(text, ''))"
KEY = f"coalesce(doc_id, {SAME})"


def shingle_set(text: str, hashed: Hashed) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of ``text`` with A-Z lowered."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) < N:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64) if words else np.zeros(0, np.uint64)
    w = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    h = w[:len(w) - N + 1].copy()
    for k in range(1, N):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k:len(w) - N + 1 + k]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def overlap_needed(n: int, m: int, threshold: float) -> int:
    """Least intersection of sets of n and m with that similarity."""
    return math.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)


def sized_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, key, same, n, set, set2, small, parity): set size, 128 hash bits of the set, the shingles themselves if there are few,
    and for each of ``BITS`` buckets of shingles whether their number is odd."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for batch in batches:
            n, a, b, small, parity = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py() or "", hashed)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                a.append(int.from_bytes(d[:8], "little", signed=True))
                b.append(int.from_bytes(d[8:], "little", signed=True))
                small.append(s.view(np.int64).tolist() if 0 < len(s) <= MOST_LIGHT else None)
                odd = np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                              pa.array(small, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))],
                                             names=["doc_id", "key", "same", "n", "set", "set2", "small", "parity"])
    return (docs.select("doc_id", "text", F.expr(KEY).alias("key"), F.expr(SAME).alias("same"))
            .mapInArrow(run, "doc_id long, key long, same long, n int, set long, set2 long, small array<long>, parity array<long>"))


def counted_shingles(docs: DataFrame, slack: float) -> DataFrame:
    """(token, set, n, n_first, n_other): the shingles whose list lengths are counted, once for a set and task.

    ``slack`` is the part of a set that its prefix takes. A set gives its shingles of the first third of the hash range;
    if they are fewer than its prefix, or the set is small, all of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, seen = Hashed(), set()
        kind = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        names = ["token", "set", "n", "n_first", "n_other"]

        def batch_of(held):
            size = [len(t) for t, *_ in held]
            columns = [np.concatenate([t for t, *_ in held]).view(np.int64), *(np.repeat([h[k] for h in held], size) for k in range(1, 5))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind)], names=names)

        for batch in batches:
            held, rows = [], 0
            for text in batch.column(0):
                s = shingle_set(text.as_py() or "", hashed)
                if not len(s):
                    continue
                mark = int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True)
                if mark in seen:
                    continue
                seen.add(mark)
                first = int(np.searchsorted(s, np.uint64(THIRD), "right"))
                everything = len(s) <= ALL_BELOW or first < int(slack * len(s) + 1e-9) + 1
                held.append((s if everything else s[:first], mark, len(s), first, len(s) - first if everything else 0))
                rows += len(held[-1][0])
                if rows > 500_000:
                    yield batch_of(held)
                    held, rows = [], 0
            if held:
                yield batch_of(held)
    return docs.select("text").mapInArrow(run, "token long, set long, n int, n_first int, n_other int")


def prefix_entries(tokens: DataFrame, slack: float) -> DataFrame:
    """(key, set, n, df, at): list entries of every set's prefix, without lists of one entry; at is the place in the order."""
    shared = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df >= 2"))
    release(tokens.sparkSession)
    back = tokens.join(shared, "token")
    other = ~F.col("token").between(0, THIRD)  # hashes over a half of the range are negative here
    part = Window.partitionBy("set", "_other")
    rank = F.row_number().over(part.orderBy("df", "token"))
    returned = F.count(F.lit(1)).over(part)
    rows = (back.repartition("set").dropDuplicates(["set", "token"]).withColumn("_other", other)
            .withColumn("_at", F.when(F.col("_other"), F.col("n_first") + F.col("n_other") - returned + rank).otherwise(F.col("n_first") - returned + rank)))
    return (rows.where(F.col("_at") <= F.floor(F.lit(slack) * F.col("n") + F.lit(1e-9)) + 1)
            .select(F.col("token").alias("key"), "set", "n", "df", (F.col("_at") - 1).cast("int").alias("at")))


def light_boundary(sizes: dict[int, int], scans: dict[int, tuple[int, int]], threshold: float) -> int:
    """Size up to which sets are enumerated. ``sizes``: sets by size; ``scans``: (list entries read, entries held) by size."""
    def meets(n: int, top: int) -> range:
        return range(math.ceil(threshold * n), min(top, math.floor(n / threshold)) + 1)

    def cost(top: int) -> int:
        keys = sum(sizes.get(n, 0) * math.comb(n, overlap_needed(n, m, threshold)) for n in range(1, top + 1) for m in meets(n, top))
        read = sum(r for n, (r, _) in scans.items() if n > top)
        held = sum(h for n, (_, h) in scans.items() if n <= top and n >= threshold * (top + 1))
        return keys + read + held
    return min(range(MOST_LIGHT + 1), key=lambda top: (cost(top), top))


def subset_keys(light: DataFrame, top: int, threshold: float) -> DataFrame:
    """(key, set, n): one key for each subset of the size that a pair of sizes has to share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets, sizes = [], [], []
            for mark, n, small in zip(*(batch.column(c).to_pylist() for c in ("set", "n", "small"))):
                for m in range(math.ceil(threshold * n), min(top, math.floor(n / threshold)) + 1):
                    pair = np.array([min(n, m), max(n, m)], np.int64).tobytes()
                    for chosen in combinations(small, overlap_needed(n, m, threshold)):
                        keys.append(xxhash.xxh3_64_intdigest(pair + np.array(chosen, np.int64).tobytes()) - (1 << 63))
                sets += [mark] * (len(keys) - len(sets))
                sizes += [n] * (len(keys) - len(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.int64()), pa.array(sizes, pa.int32())], names=["key", "set", "n"])
    return light.select("set", "n", "small").mapInArrow(run, "key long, set long, n int")


def confirmed(pairs: DataFrame, contents: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by whole intersections."""
    a = contents.select(F.col("set").alias("a"), F.col("tokens").alias("_ta"))
    b = contents.select(F.col("set").alias("b"), F.col("tokens").alias("_tb"))
    both = pairs.select("a", "b").join(b, "b").join(a, "a")
    common = F.size(F.array_intersect("_ta", "_tb"))
    return both.where(common >= F.lit(threshold) * (F.size("_ta") + F.size("_tb") - common) - F.lit(1e-9)).select("a", "b")


def contents_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, tokens) for (key, set) in ``wanted``; other texts of a key are passed over, and a set comes once from a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, seen = Hashed(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets, marks = [], []
                for mark, text in zip(part.column(0).to_pylist(), part.column(1)):
                    s = shingle_set(text.as_py() or "", hashed)
                    if mark not in seen and int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True) == mark:
                        seen.add(mark)
                        sets.append(s)
                        marks.append(mark)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), tokens], names=["set", "tokens"])
    return docs.select("text", F.expr(KEY).alias("key")).join(wanted, "key").select("set", "text").mapInArrow(run, "set long, tokens array<long>")


def close_pairs(near: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b: sets of one anchor in different components that may be similar enough, by sizes and parities.

    ``near`` is (anchor, set, n, component). The sets of an anchor are dealt into blocks by hash, and every two blocks meet in one
    place, so no place holds more than about two blocks; the comparisons are made there, on bits, and only survivors become rows.
    """
    size = near.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    own = F.pmod(F.xxhash64("set", F.lit("block")), F.col("_blocks")).cast("int")
    dealt = (near.join(size.drop("_c"), "anchor").join(sets.select("set", "parity"), "set").withColumn("own", own)
             .withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
             .select("anchor", F.least("own", "_with").alias("i"), F.greatest("own", "_with").alias("j"), "own", "set", "n", "component", "parity"))

    def compared(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own, mark, n, part = (rows.column(c).to_numpy() for c in ("own", "set", "n", "component"))
        bits = rows.column("parity").flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
        order = np.argsort(n, kind="stable")
        own, mark, n, part, bits = own[order], mark[order], n[order].astype(np.int64), part[order], bits[order]
        crossing = own.min() != own.max()
        left, right = [], []
        # a partner is no smaller and, with the threshold, no larger than n / threshold
        last = np.searchsorted(n, np.floor(n / threshold + 1e-9), "right")
        for k in range(len(n) - 1):
            to = slice(k + 1, last[k])
            able = part[to] != part[k]
            if crossing:
                able &= own[to] != own[k]
            at = np.flatnonzero(able) + k + 1
            differ = np.bitwise_count(bits[at] ^ bits[k]).sum(1, dtype=np.int64)
            hit = at[differ <= (1 - threshold) / (1 + threshold) * (n[at] + n[k]) + 1e-9]
            left.append(np.minimum(mark[hit], mark[k]))
            right.append(np.maximum(mark[hit], mark[k]))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def finished():
            a, b = compared(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            for at in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at:at + 100_000]), pa.array(b[at:at + 100_000])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("anchor", "i", "j")])
            starts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(starts[:-1], starts[1:]):
                key = tuple(place[:, lo].tolist())
                if now is not None and key != now:
                    yield from finished()
                    held = []
                now = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from finished()
    spread = dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return spread.mapInArrow(run, "a long, b long")


def linked_sets(docs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the sets that link with another; ``sets`` has one row per class (set, n, small, rep)."""
    slack = 1 - threshold
    tokens = stored(counted_shingles(docs, slack))
    entries = stored(prefix_entries(tokens, slack))
    discard(tokens)
    release(docs.sparkSession)
    scans = {r[0]: (r[1], r[2]) for r in entries.where(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.sum("df"), F.count(F.lit(1))).collect()}
    sizes = {r[0]: r[1] for r in sets.where(F.col("n").between(1, MOST_LIGHT)).groupBy("n").count().collect()}
    top = light_boundary(sizes, scans, threshold)
    heavy = entries.where(F.col("n") >= F.lit(threshold) * (top + 1)).select("key", "set", "n", "at", F.lit(True).alias("heavy"))
    light = (subset_keys(sets.where(F.col("n").between(1, top)), top, threshold)
             .select("key", "set", "n", F.lit(0).alias("at"), F.lit(False).alias("heavy")))
    rows = heavy.union(light)
    # an entry is of use if, with the smallest partner in its list, enough of the set comes after it
    shortest = cut(rows.groupBy("key", "heavy").agg(F.min("n").alias("_m"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c"))
    share = F.lit(threshold / (1 + threshold))

    def reachable(n: Column, m: Column, at: Column) -> Column:
        return ~F.col("heavy") | (at <= n - F.ceil(share * (n + m) - F.lit(1e-9)))

    useful = stored(rows.join(shortest, ["key", "heavy"])
                 .where(reachable(F.col("n"), F.greatest(F.col("_m"), F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9))), F.col("at"))).drop("_m"))
    # of the two representatives one has the fewest rare shingles, so it is close to most others; the other is any
    ends = useful.groupBy("key", "heavy").agg(F.min(F.struct(F.col("at"), F.col("set"), F.col("n"))).alias("_lo"),
                                              F.max(F.struct(F.col("set"), F.col("n"), F.col("at"))).alias("_hi"), F.count(F.lit(1)).alias("_c"))
    members = stored(useful.join(cut(ends.where("_c > 1").drop("_c")), ["key", "heavy"]))
    discard(entries, useful)

    def worth(n: Column, at: Column, m: Column, at_m: Column) -> Column:
        """Sizes and places leave room for a link; light sets meet in light lists alone."""
        return ((F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)) & (~F.col("heavy") | (F.greatest(n, m) > top))
                & reachable(n, m, at) & reachable(m, n, at_m))

    def against(end: str) -> DataFrame:
        far = F.col(end)
        return members.where((F.col("set") != far["set"]) & worth(F.col("n"), F.col("at"), far["n"], far["at"])).select(
            F.least("set", far["set"]).alias("a"), F.greatest("set", far["set"]).alias("b"))

    first = cut(against("_lo").union(against("_hi")).distinct())
    wanted = members.select("set").distinct().join(sets.select("set", F.col("rep").alias("key")), "set")
    contents = stored(contents_of(docs, wanted))
    release(docs.sparkSession)
    links = cut(confirmed(first, contents, threshold))
    component = connected_components(links)
    # lists whose members still stand apart; lists of one family mostly share the member of smallest hash
    placed = (members.select("key", "heavy", "set", "n").join(component.withColumnRenamed("node", "set"), "set", "left")
              .withColumn("component", F.coalesce("component", "set")))
    apart = (placed.groupBy("key", "heavy").agg(F.min("component").alias("_a"), F.max("component").alias("_b"),
                                                F.min_by("set", F.xxhash64("set")).alias("anchor")).where("_a <> _b").select("key", "heavy", "anchor"))
    near = stored(placed.join(apart, ["key", "heavy"]).select("anchor", "set", "n", "component").distinct())
    second = close_pairs(near, sets, threshold).distinct().join(first, ["a", "b"], "left_anti")
    more = cut(confirmed(second, contents, threshold))
    discard(members, contents, near)
    return connected_components(links.union(more))


def judged(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): the rows of ``sized_sets``, and (set, component, component_id) of every set that is not empty."""
    each = cut(sized_sets(docs))
    sets = cut(each.where("n > 0").groupBy("set", "set2").agg(F.min("key").alias("rep"), F.min("doc_id").alias("low"), F.first("n").alias("n"),
                                                              F.first("small").alias("small"), F.first("parity").alias("parity")))
    linked = linked_sets(docs, sets, threshold)
    placed = sets.join(linked.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    named = cut(placed.select("set", "component").join(lowest, "component").select("set", "component", "component_id"))
    release(docs.sparkSession)
    return each, named


def classes(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id reachable over links."""
    each, named = judged(docs, threshold)
    return (each.join(named, "set", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def one_each(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``docs`` with one document of each class: the one of the smallest doc_id, of several texts under it the one whose hash is
    smallest. Rows without doc_id all stay, and so does one row of every doc_id and text without words."""
    known = docs.where("doc_id IS NOT NULL")
    each, named = judged(known, threshold)
    first = each.join(named, "set").groupBy("component").agg(F.min(F.struct("doc_id", "same")).alias("_f")).select("_f.*")
    keep = cut(first.union(each.where("n = 0").select("doc_id", "same").distinct()))
    release(docs.sparkSession)
    told = known.withColumn("_same_text", F.expr(SAME)).join(keep.withColumnRenamed("same", "_same_text"), ["doc_id", "_same_text"], "left_semi")
    return told.dropDuplicates(["doc_id", "_same_text"]).select(docs.columns).union(docs.where("doc_id IS NULL"))
