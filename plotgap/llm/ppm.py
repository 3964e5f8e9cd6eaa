"""Language-model scores by prediction by partial matching over bytes.

The model is a byte-context trie of three levels, pretrained on the training documents: for every context of up to three
bytes, how often each byte followed. A byte seen in the longest known context is coded by its share there; otherwise
an escape is paid (distinct followers / (total + distinct followers)) and the next shorter context is asked, without the
symbols already ruled out. Below the empty context all bytes left are equally likely. Texts are read as their words, A-Z
lowered, joined by one space, with an end mark; code lengths add up to the text's log10 probability.

Training counts come from all training documents by partial aggregation, and all of them are kept as a table (shorter
contexts are sums over them). Code lengths of the ``frequent_grams`` most used four-byte strings are sent to every task; all
other places of a text, unseen ones too, meet the counts and escape figures of their contexts in joins.

Beside it stands a unigram score of words with add-one smoothing over the whole training vocabulary, which grows with the
corpus: counts of the ``frequent`` most used words are sent to every task, all other words meet their counts in a join.

Defined results: null, empty and word-free texts consist of the end mark alone; equal rows are scored each; rows without
doc_id take part by the crc32 of nothing, as held out; without training documents every byte is equally likely and no
word is known; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.llm.base import cut, release, stored

END = b"\n"
PAD = 3


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def signed(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def laid_out(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, symbol, texts' sizes): the three bytes before every byte to predict, as one number, and that byte."""
    bodies = [b" ".join(w) + END for w in texts]
    sizes = np.array([len(b) for b in bodies], np.int64)
    raw = np.frombuffer(END * PAD + (END * PAD).join(bodies), np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes + PAD)])[:-1] + PAD
    edge = np.zeros(len(raw) + 1, np.int8)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + sizes, -1)
    at = np.nonzero(np.cumsum(edge[:-1]))[0]
    wide = raw.astype(np.uint32)
    context = wide[at - 3] << 16 | wide[at - 2] << 8 | wide[at - 1]
    return context, raw[at], sizes


def grams(docs: DataFrame) -> DataFrame:
    """(gram, n): four-byte strings, context first, of the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held = [], 0
            for row, text in enumerate(batch.column(0)):
                texts.append(words_of(text.as_py()))
                held += len(text.as_py() or "")
                if held > 6_000_000 or row + 1 == batch.num_rows:
                    context, symbol, _ = laid_out(texts)
                    found, n = np.unique(context << np.uint32(8) | symbol, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])
                    texts, held = [], 0
    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Trie:
    """log10 probability of each byte after each known context, from four-byte counts that fit in memory."""

    def __init__(self, found: np.ndarray, n: np.ndarray):
        self.keys, self.n = found, n  # sorted by key, so by context

    def level(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(contexts of ``order`` bytes, row of each entry, its byte, its count)."""
        key = self.keys & ((1 << 8 * (order + 1)) - 1)
        contexts, row = np.unique(key >> 8, return_inverse=True)
        return contexts, row, key & 255, self.n

    @staticmethod
    def dense(rows: int, row: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> np.ndarray:
        counts = np.zeros((rows, 256))
        np.add.at(counts, (row, symbol), n)
        return counts

    @staticmethod
    def coded(counts: np.ndarray, above: np.ndarray | None, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probabilities, share of the unseen bytes once escaped) of contexts with these counts.

        ``above`` has the counts of the next shorter context, ``outside`` its second result.
        """
        seen = counts > 0
        total, kinds = counts.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        if above is not None:
            rest = np.where(seen, 0, above).sum(axis=1, keepdims=True)
            new = ((above > 0) & ~seen).sum(axis=1, keepdims=True)
            outside = np.where(above > 0, above / np.maximum(rest + new, 1), np.where(new > 0, new / np.maximum(rest + new, 1), 1.0) * outside)
        whole = np.maximum(total + kinds, 1)
        p = np.where(seen, counts / whole, np.where(total > 0, kinds / whole, 1.0) * outside)
        with np.errstate(divide="ignore"):
            return np.log10(p).astype(np.float32), outside

    def table(self, part: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(row of each three-byte context, log10 probabilities by row); contexts are worked off ``part`` at a time."""
        rows, tables, used = np.zeros(1 << 24, np.int32), [], 1
        base = self.dense(1, np.zeros(len(self.keys), np.int64), self.keys & 255, self.n)
        left = 256 - (base > 0).sum()
        logs, outside = self.coded(base, None, np.full((1, 256), 1 / left if left else 0.0))
        tables.append(logs)
        shorter, above = np.zeros(1, np.int64), base
        for order in (1, 2, 3):
            contexts, row, symbol, n = self.level(order)
            if not len(contexts):
                break
            entries = np.argsort(row, kind="stable")
            row, symbol, n = row[entries], symbol[entries], n[entries]
            parent = np.searchsorted(shorter, contexts & ((1 << 8 * (order - 1)) - 1))
            kept = []
            for at in range(0, len(contexts), part):
                lo, hi = np.searchsorted(row, [at, at + part])
                counts = self.dense(min(part, len(contexts) - at), row[lo:hi] - at, symbol[lo:hi], n[lo:hi])
                mine = parent[at:at + part]
                logs, beyond = self.coded(counts, above[mine], outside[mine])
                tables.append(logs)
                if order < 3:
                    kept.append((counts, beyond))
            fill = rows.reshape(1 << 8 * (3 - order), 1 << 8 * order)
            fill[:, contexts] = used + np.arange(len(contexts))
            used += len(contexts)
            if order < 3:
                shorter, above, outside = contexts, *(np.concatenate(c) for c in zip(*kept))
        return rows, np.concatenate(tables)


class Counts:
    """The whole model as tables: by order, (gram, n) of strings of a context and its next byte, and figures of the contexts."""

    def __init__(self, docs: DataFrame):
        longest = stored(grams(docs))
        middle = stored(self.shorter(longest, 2))
        small = self.shorter(middle, 1)
        self.entries = [self.shorter(small, 0), small, middle, longest]
        self.contexts = [self.figures(order) for order in (1, 2)]
        self.contexts.append(stored(self.figures(3)))

    @staticmethod
    def shorter(entries: DataFrame, order: int) -> DataFrame:
        return entries.groupBy(F.col("gram").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))

    def figures(self, order: int) -> DataFrame:
        """(context, total, kinds, shared): its bytes' count, how many there are, and their count after the next shorter context."""
        above = self.entries[order - 1].select(F.col("gram").alias("_tail"), F.col("n").alias("_above"))
        entries = self.entries[order].withColumn("_tail", F.col("gram").bitwiseAND((1 << 8 * order) - 1))
        return (entries.join(above, "_tail").groupBy(F.shiftright("gram", 8).alias("context"))
                .agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("_above").alias("shared")))

    def frequent(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(gram, log10 probability) of the most used strings."""
        known = self.entries[3].join(self.contexts[2].withColumnRenamed("context", "_context"), F.shiftright("gram", 8) == F.col("_context"))
        got = (known.select("gram", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).cast("float").alias("length"))
               .orderBy(F.col("n").desc(), "gram").limit(most).select("gram", "length").toArrow())
        return got.column("gram").to_numpy(), got.column("length").to_numpy()

    def lengths(self, wanted: DataFrame) -> DataFrame:
        """(gram, length): log10 probability of each of the different strings ``wanted``."""
        out = wanted.select("gram")
        for order in (3, 2, 1, 0):
            entries = self.entries[order].select(F.col("gram").alias("_g"), F.col("n").alias(f"n{order}"))
            out = out.join(entries if order > 1 else F.broadcast(entries), F.col("gram").bitwiseAND((1 << 8 * (order + 1)) - 1) == F.col("_g"), "left").drop("_g")
            if order:  # at most 65,536 contexts of two bytes
                figures = self.contexts[order - 1].select(F.col("context").alias("_c"), *[F.col(c).alias(f"{c}{order}") for c in ("total", "kinds", "shared")])
                out = out.join(figures if order > 2 else F.broadcast(figures), F.shiftright("gram", 8).bitwiseAND((1 << 8 * order) - 1) == F.col("_c"), "left").drop("_c")
        all_ = self.entries[0].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total0"), F.count(F.lit(1)).alias("kinds0"))
        return out.crossJoin(F.broadcast(all_)).select("gram", F.log10(self.probability()).cast("float").alias("length"))

    @staticmethod
    def probability() -> Column:
        """As ``Trie.coded``, over columns; what an unknown context lacks is null, and the next shorter one answers."""
        def of(name: str, order: int) -> Column:
            return F.col(f"{name}{order}")

        def told(order: int, outside: Column) -> Column:
            whole = of("total", order) + of("kinds", order)
            return F.when(of("n", order) > 0, of("n", order) / whole).when(of("total", order) > 0, of("kinds", order) / whole * outside)

        outside = F.lit(1.0) / F.greatest(256 - of("kinds", 0), F.lit(1))
        p = F.coalesce(told(0, outside), outside)
        for order in (1, 2, 3):
            rest, new, above = of("total", order - 1) - of("shared", order), of("kinds", order - 1) - of("kinds", order), of("n", order - 1)
            outside = F.when(above > 0, above / F.greatest(rest + new, F.lit(1))).when(new > 0, new / (rest + new) * outside).otherwise(outside)
            p = F.coalesce(told(order, outside), p)
        return p


def dense(found: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each three-byte context, lengths by row and byte): not a number where a string is not among ``found``."""
    contexts, row = np.unique(found >> 8, return_inverse=True)
    rows = np.zeros(1 << 24, np.int32)
    rows[contexts] = 1 + np.arange(len(contexts))
    table = np.full((len(contexts) + 1, 256), np.nan, np.float32)
    table[row + 1, found & 255] = lengths
    return rows, table.ravel()


def listed(gram: np.ndarray, text: np.ndarray, texts: int) -> tuple[pa.Array, pa.Array]:
    """Lists by text of its different strings and how often each is there."""
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    at = np.nonzero(first)[0]
    offsets = pa.array(np.searchsorted(text[at], np.arange(texts + 1)).astype(np.int32))
    times = np.diff(np.append(at, len(gram)))
    return pa.ListArray.from_arrays(offsets, pa.array(gram[at], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, c) of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([signed(w) for w in held], pa.int64()), pa.array(held.values(), pa.int64())], names=["hash", "c"])
    return docs.select("text").mapInArrow(run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


class Common(dict):
    """log10(c + 1) of a frequent word, None of another; forgets once ``most`` words are held."""

    def __init__(self, logs: dict[int, float], most: int = 300_000):
        super().__init__()
        self.logs, self.most = logs, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.logs.get(signed(word))
        return out


def score(docs: DataFrame, training: Column, frequent: int = 200_000, frequent_grams: int = 200_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); ``training`` tells the training rows."""
    spark = docs.sparkSession
    learn = docs.where(training)
    counts = stored(word_counts(learn))
    vocabulary, tokens, n_learn = (*counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first(), learn.select("doc_id").count())
    if n_learn:
        vocabulary, tokens = vocabulary + 1, tokens + n_learn
    top = counts.orderBy(F.col("c").desc(), "hash").limit(frequent).toArrow()
    logs = dict(zip(top.column("hash").to_pylist(), map(math.log10, (np.add(top.column("c").to_numpy(), 1)).tolist())))
    least = int(top.column("c").to_numpy().min()) if top.num_rows == frequent else None
    strings = Counts(learn)
    model = spark.sparkContext.broadcast((strings.frequent(frequent_grams), logs))
    del top, logs
    release(spark)
    marked = docs.select("doc_id", "text", F.coalesce(~training, F.lit(True)).alias("held_out"), F.xxhash64("doc_id", "text").alias("key"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Common(model.value[1])
        for batch in batches:
            h, k, n = [], [], []
            for text, key in zip(batch.column(0), batch.column(1).to_pylist()):
                held = Counter(w for w in words_of(text.as_py()) if common[w] is None)
                h += [signed(w) for w in held]
                n += held.values()
                k += [key] * len(held)
                if len(h) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.int64()), pa.array(n, pa.int32())], names=["hash", "key", "n"])
                    h, k, n = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.int64()), pa.array(n, pa.int32())], names=["hash", "key", "n"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, logs = model.value
        common = Common(logs)
        rows, table = dense(*head)
        for batch in batches:
            texts, held, first = [], 0, 0
            for row, text in enumerate(batch.column(1)):
                texts.append(words_of(text.as_py()))
                held += len(text.as_py() or "")
                if held > 3_000_000 or row + 1 == batch.num_rows:
                    context, symbol, sizes = laid_out(texts)
                    lengths = table[rows[context].astype(np.int64) * 256 + symbol]
                    other = np.nonzero(np.isnan(lengths))[0]
                    lengths[other] = 0
                    ends = np.cumsum(sizes)
                    total = np.add.reduceat(lengths.astype(np.float64), np.concatenate([[0], ends[:-1]]))
                    others = listed(context[other].astype(np.int64) << 8 | symbol[other], np.searchsorted(ends, other, side="right"), len(texts))
                    size, known, base = [], [], []
                    for w in texts:
                        got = [x for x in map(common.__getitem__, w) if x is not None]
                        size.append(len(w) + 1)
                        known.append(len(got))
                        base.append(math.fsum(got))
                    part = batch.slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(2), part.column(3), pa.array(size, pa.int64()), pa.array(known, pa.int64()),
                         pa.array(base, pa.float64()), pa.array(total, pa.float64()), *others],
                        names=["doc_id", "held_out", "key", "n_tokens", "known", "base", "score", "grams", "times"])
                    texts, held, first = [], 0, row + 1

    known = marked.select("text", "key").mapInArrow(rare, "hash long, key long, n int")
    if least is not None:  # nothing outside the frequent words is more frequent than the last of them
        counts = counts.where(F.col("c") <= least)
    # rows that are equal in doc_id and text share a key; their sums are shared out again
    sums = (known.join(counts, "hash").groupBy("key")
            .agg(F.sum("n").alias("_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("_base")))
    rows = cut(marked.mapInArrow(whole, "doc_id long, held_out boolean, key long, n_tokens long, known long, base double, score double, grams array<long>, times array<long>"))
    others = rows.select("key", F.explode(F.arrays_zip("grams", "times")).alias("_o")).select("key", F.col("_o.grams").alias("gram"), F.col("_o.times").alias("times"))
    lost = (others.join(strings.lengths(others.select("gram").distinct()), "gram").groupBy("key")
            .agg(F.sum(F.col("times") * F.col("length").cast("double")).alias("_score")))
    equal = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_equal")).where("_equal > 1")
    end = math.log10(n_learn + 1) if n_learn else 0.0
    norm = math.log10(tokens + vocabulary + 1)
    share = F.coalesce("_equal", F.lit(1))
    return (rows.join(sums, "key", "left").join(lost, "key", "left").join(equal, "key", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("known") + F.coalesce("_known", F.lit(0)) / share + F.lit(1 if n_learn else 0)).cast("long").alias("n_known"),
                    F.lit(tokens).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("_base", F.lit(0.0)) / share + F.lit(end) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
                    (F.col("score") + F.coalesce("_score", F.lit(0.0)) / share).alias("score")))
