"""Phrase collocations by level-wise counting over broadcast sorted codes.

Texts are lowered (A-Z), cut into pieces at punctuation and line ends, and pieces into words. Phrases of one word to
``longest`` words are counted level by level, and only what an Apriori-safe window shows is counted at all: a window of k
words can be frequent only if both windows of k - 1 words in it are.

The frequent words are numbered, and so are the frequent phrases of two words and more: a phrase is the place of its first
words among the frequent phrases of that length, and the number of its last word, in one code. The sorted codes of the levels
before are broadcast, eight bytes for each phrase; a task looks the windows of k - 1 words up in them, a whole stretch of text
at a time, and what is safe leaves it as codes of k words, packed in a few bytes, dealt in sorted blocks by a bijective mix and
counted by sorting one part at a time. Windows never become rows of their own.

With more than ``most`` frequent phrases of a length, windows are counted in words from there on, as rows. Then a double-array
trie of at most ``TRIE`` frequent phrases, and below them candidates that some task found often in one of its own stretches
(``LOCALLY`` times), keeps the commonest windows from becoming rows: states that accept a candidate are counted by bincount. A
word is two or three bytes of its number there, so every node has at most 256 children. Windows outside the trie count as safe.

The score of a phrase is floor(scale * a / (l + r)) at its lowest-scoring cut into two parts, a, l and r being the counts of
the phrase and of the parts; the first such cut counts. Arithmetic is in decimals of 38 digits. Phrases inside a longer
candidate that is nearly as frequent are dropped. Counts of the most frequent words are broadcast to the cuts (at most
``HOT`` words can hold a thousandth of all words each), other parts meet theirs in a join.

Defined results: null, empty and word-free texts count for nothing; texts without lang are those of ``und``; repeated rows count
as often as they stand there; ties are settled by the phrase in byte order; doc_id is not used; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotgap.llm.base import release, stored

UNIT = 750_000
LOCALLY = 8
HOLD = 100_000
HOT = 1000
BATCH = 2000
_GAP = b"\n"
_UPPER = bytes(range(65, 91))
#: Fixed bytes: what ends a piece.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + b"\t" + _ENDS, _UPPER.lower() + b" " + _GAP * len(_ENDS))
#: Windows that a task holds before it deals them out, and about as many as one part gets.
HELD = 1 << 20
PART = 1 << 18
TRIE = 300_000
_MIX = 0x9E3779B97F4A7C15
ROWS = "seed boolean, lang string, phrase string, n long"


class Words(dict):
    """Numbers words by first appearance. 0 is no word, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, _GAP: 1})
        self.names = [b"", _GAP]

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.names)
        self.names.append(word)
        return k


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words) of whole texts of one language, about ``UNIT`` bytes at a time; pieces are divided by ``_GAP``."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def taken(lang: str) -> tuple[str, list[bytes]]:
        size.pop(lang)
        return lang, _GAP.join(held.pop(lang)).replace(_GAP, b" \n ").split(b" ")
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang, data = lang.as_py(), (text.as_py() or "").encode("utf-8", "replace").translate(_TABLE)
            held.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data)
            if size[lang] > UNIT:
                yield taken(lang)
    for lang in list(held):
        yield taken(lang)


class Trie:
    """Double-array trie over bytes of word numbers. State 0 is dead; every language has its own root."""

    def __init__(self, known: list[tuple[str, str]], wanted: list[tuple[str, str]], k: int):
        words = Words()
        langs = sorted({lang for lang, _ in known})
        self.root = {lang: 256 + i for i, lang in enumerate(langs)}

        def numbered(rows, length):
            n = np.fromiter((words[w] for _, p in rows for w in p.encode().split(b" ")), np.int64, len(rows) * length)
            return n.reshape(len(rows), length) - 2
        rows, cand = numbered(known, k - 1), numbered(wanted, k)
        self.words = words.names[2:]
        self.digits = 1 + (len(self.words) > 256) + (len(self.words) > 65_536)
        self.known, self.known_lang = rows.astype(np.int32), [lang for lang, _ in known]
        self.cand, self.cand_lang = cand.astype(np.int32), [lang for lang, _ in wanted]
        self.free = np.ones(4096, bool)
        self.free[:256 + len(langs)] = False
        self.tail = self.cursor = 256 + len(langs)
        self.base, self.check = np.zeros(4096, np.int32), np.full(4096, -1, np.int32)
        at = [np.array([self.root[lang] for lang, _ in r], np.int64) for r in (known, wanted)]
        for step in range(k * self.digits):
            j, shift = divmod(step, self.digits)
            live = [i for i, m in enumerate((rows, cand)) if j < m.shape[1] and len(m)]
            if not live:
                break
            key = [at[i] << 8 | ((rows, cand)[i][:, j] >> (8 * shift)) & 255 for i in live]
            distinct, inverse = np.unique(np.concatenate(key), return_inverse=True)
            slots = self._place(distinct >> 8, distinct & 255)[inverse]
            for i, part in zip(live, np.split(slots, np.cumsum([len(x) for x in key])[:-1])):
                at[i] = part
        self._grow(self.tail + 257)
        self.base, self.check = self.base[:self.tail + 257], self.check[:self.tail + 257]
        self.accept = np.full(len(self.base), -1, np.int32)
        self.accept[at[1]] = np.arange(len(cand))
        self.place = np.full(len(self.base), -1, np.int32)  # states of the phrases of k - 1 words
        self.place[at[0]] = np.arange(len(rows))
        del self.free

    def _grow(self, size: int) -> None:
        if size > len(self.free):
            more = max(size, 2 * len(self.free)) - len(self.free)
            self.free = np.concatenate([self.free, np.ones(more, bool)])
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def _place(self, parent: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """Slots of the children (parent[i], digit[i]), which are sorted: the widest parents first, single children last."""
        first = np.nonzero(np.diff(parent, prepend=-1))[0]
        count = np.diff(np.append(first, len(parent)))
        slots = np.zeros(len(parent), np.int64)
        tries = np.arange(128)[:, None]
        for g in np.argsort(-count, kind="stable")[:int((count > 1).sum())].tolist():
            d = digit[first[g]:first[g] + count[g]]
            self._grow(self.tail + 1024)
            fits = self.free[np.minimum(self.cursor + tries + (d - d[0]), self.tail + 512)].all(axis=1)
            begin = self.cursor + int(fits.argmax()) if fits.any() and self.cursor + 128 < self.tail else self.tail
            if begin == self.tail:
                self.cursor = min(self.cursor + 128, self.tail)
            mine = begin + d - d[0]
            self.free[mine] = False
            self.tail = max(self.tail, int(mine[-1]) + 1)
            slots[first[g]:first[g] + count[g]] = mine
            self.base[parent[first[g]]] = begin - d[0]
        single = first[count == 1]
        if len(single):
            self._grow(self.tail + len(single) + 512)
            open_ = np.nonzero(self.free[:self.tail + len(single)])[0][:len(single)]
            self.free[open_] = False
            self.tail = max(self.tail, int(open_[-1]) + 1)
            slots[single] = open_
            self.base[parent[single]] = open_ - digit[single]
        self.check[slots] = parent
        return slots

    def states(self, lang: str, symbol: np.ndarray, k: int) -> np.ndarray:
        """State of the window of k - 1 words at every place where there is one."""
        state = np.full(max(len(symbol) - k + 2, 0), self.root.get(lang, 0), np.int64)
        for j in range(k - 1):
            state = self.advance(state, symbol[j:j + len(state)])
        return state

    def table(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def advance(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States after one more word; the dead state stays dead."""
        for shift in range(0, 8 * self.digits, 8):
            to = self.base[state] + (symbol >> shift & 255)
            state = np.where(self.check[to] == state, to, 0)
        return np.where(symbol >= 0, state, 0)


def windows(ids: np.ndarray, at: np.ndarray, k: int, names: list[bytes], least: int = 1) -> tuple[list[bytes], np.ndarray]:
    """Distinct windows of k words at the places ``at`` that stand there ``least`` times, and how often."""
    width = int(ids.max(initial=0)) + 1
    code, span = ids[at].astype(np.int64), width
    for j in range(1, k):
        if span * width >= 1 << 62:
            _, code = np.unique(code, return_inverse=True)
            span = len(at) + 1
        code, span = code * width + ids[at + j], span * width
    if least > 1:
        some = often(code, least)
        at, code = at[some], code[some]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    first, n = first[n >= least], n[n >= least]
    columns = [[names[w] for w in ids[at[first] + j].tolist()] for j in range(k)]
    return list(map(b" ".join, zip(*columns))), n


def _batch(seed: bool, lang: str, phrases: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    size = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, seed)), pa.array([lang] * size, pa.string()), pa.array(phrases, pa.string()), pa.array(n, pa.int64())],
                                      names=["seed", "lang", "phrase", "n"])


def inside(ids: np.ndarray, k: int) -> np.ndarray:
    """Whether the window of k words at each place lies within a piece."""
    n = max(len(ids) - k + 1, 0)
    ends = np.append(0, np.cumsum(ids == 1))
    return ends[k:k + n] == ends[:n]


def words_counted(texts: DataFrame) -> DataFrame:
    """Counts of words, and of all words of a language (as the empty phrase)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, Counter] = {}

        def flushed(lang: str) -> pa.RecordBatch:
            words = count.pop(lang)
            words.pop(b"", None), words.pop(_GAP, None)
            n = np.fromiter(words.values(), np.int64, len(words))
            return _batch(False, lang, [b"", *words], np.append(n.sum(), n))
        for lang, tokens in stretches(batches):
            count.setdefault(lang, Counter()).update(tokens)
            if len(count[lang]) > HOLD:
                yield flushed(lang)
        for lang in list(count):
            yield flushed(lang)
    return texts.mapInArrow(run, ROWS)


class Known(dict):
    """Symbols of the words of a trie. Other words and ends of pieces are -1, no word is -2."""

    def __init__(self, table: dict[bytes, int]):
        super().__init__(table)
        self[b""], self[_GAP] = -2, -1

    def __missing__(self, word: bytes) -> int:
        return -1

    def read(self, tokens: list[bytes]) -> np.ndarray:
        symbol = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return symbol[symbol > -2]


class Reader:
    """Word numbers and trie symbols of a task's stretches."""

    def __init__(self, trie: Trie):
        self.trie, self.table = trie, trie.table()
        self.words, self.symbols = Words(), np.array([-1, -1], np.int64)

    def read(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > HOLD:
            self.words, self.symbols = Words(), self.symbols[:2]
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens))
        ids = ids[ids != 0]
        if len(self.words) > len(self.symbols):
            self.symbols = np.append(self.symbols, [self.table.get(w, -1) for w in self.words.names[len(self.symbols):]]).astype(np.int64)
        return ids, self.symbols[ids]


def often(code: np.ndarray, least: int) -> np.ndarray:
    """Whether each code stands there ``least`` times."""
    s = np.sort(code)
    many = np.unique(s[least - 1:][s[least - 1:] == s[:max(len(s) - least + 1, 0)]])
    if not len(many):
        return np.zeros(len(code), bool)
    return many[np.minimum(np.searchsorted(many, code), len(many) - 1)] == code


class Index:
    """Numbers of the frequent words of every language, and sorted codes of the frequent phrases of two words and more."""

    def __init__(self, words: list[tuple[str, str]], longer: tuple[np.ndarray, ...] = ()):
        self.words, self.longer, self.width = words, longer, max(len(words), 1)
        self.known: dict[str, Known] = {}

    def read(self, lang: str, tokens: list[bytes]) -> np.ndarray:
        if not self.known:
            tables: dict[str, dict[bytes, int]] = {lang: {}}
            for i, (l, w) in enumerate(self.words):
                tables.setdefault(l, {})[w.encode()] = i
            self.known = {l: Known(t) for l, t in tables.items()}
        return self.known.setdefault(lang, Known({})).read(tokens)

    def states(self, symbol: np.ndarray) -> np.ndarray:
        """Number of the longest frequent phrase known that begins at each place; -1 is none."""
        state = symbol
        for j, codes in enumerate(self.longer, 1):
            first, word = state[:-1], symbol[j:]
            at = np.nonzero((first >= 0) & (word >= 0))[0]
            state = np.full(len(first), -1, np.int64)
            if len(codes):
                code = first[at] * self.width + word[at]
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                state[at] = np.where(codes[place] == code, place, -1)
        return state

    def spelled(self, code: np.ndarray) -> tuple[list[str], list[str]]:
        """Languages and phrases."""
        numbers, place = [code % self.width], code // self.width
        for codes in reversed(self.longer):
            numbers.append(codes[place] % self.width)
            place = codes[place] // self.width
        rows = np.stack([place, *reversed(numbers)], 1).tolist()
        return [self.words[r[0]][0] for r in rows], [" ".join([self.words[i][1] for i in r]) for r in rows]


class Mix:
    """Deals codes over ``parts`` equal ranges of a bijective mix."""

    def __init__(self, index: Index, parts: int):
        size = (len(index.longer[-1]) if index.longer else len(index.words)) * index.width
        self.bits, self.parts = max(16, size.bit_length()), parts
        self.mask, self.bytes = np.uint64((1 << self.bits) - 1), -(-self.bits // 8)
        self.back = np.uint64(pow(_MIX, -1, 1 << self.bits))
        self.edges = np.array([(p << self.bits) // parts for p in range(1, parts)], np.uint64)

    def dealt(self, codes: list[np.ndarray]) -> pa.RecordBatch:
        """One block for each part that gets codes."""
        mixed = np.sort(np.concatenate(codes).astype(np.uint64) * np.uint64(_MIX) & self.mask)
        cut = np.concatenate([[0], np.searchsorted(mixed, self.edges), [len(mixed)]])
        full = np.nonzero(np.diff(cut))[0]
        packed = np.ascontiguousarray(mixed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :self.bytes])
        ends = np.append(0, cut[full + 1] * self.bytes).astype(np.int32)
        blocks = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), blocks], names=["part", "block"])

    def counted(self, blocks: list[bytes], least: int) -> pa.RecordBatch:
        """Codes that all blocks of a part hold ``least`` times."""
        raw = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, self.bytes)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :self.bytes] = raw
        mixed = np.sort(wide.view("<u8").ravel())
        first = np.nonzero(np.append(True, mixed[1:] != mixed[:-1]))[0]
        n = np.diff(np.append(first, len(mixed)))
        code = (mixed[first[n >= least]] * self.back & self.mask).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n[n >= least], pa.int64())], names=["code", "n"])


def level_keyed(texts: DataFrame, index, k: int, least: int, parts: int) -> DataFrame:
    """Codes and counts of the phrases of k words found ``least`` times."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        mix, held, size = Mix(known, parts), [], 0
        for lang, tokens in stretches(batches):
            symbol = known.read(lang, tokens)
            state = known.states(symbol)
            at = np.nonzero((state[:-1] >= 0) & (state[1:] >= 0))[0]
            held.append(state[at] * known.width + symbol[at + k - 1])
            size += len(at)
            if size > HELD:
                yield mix.dealt(held)
                held, size = [], 0
        if size:
            yield mix.dealt(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, now, held = Mix(index.value, parts), -1, []
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now and held:
                    yield mix.counted(held, least)
                    held = []
                now = part
                held.append(block.as_py())
        if held:
            yield mix.counted(held, least)
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(deal, "part int, block binary").repartition(partitions, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(count, "code long, n long")


def spelled(numbered: DataFrame, index) -> DataFrame:
    """Codes in words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = index.value.spelled(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(langs), pa.bool_()), pa.array(langs, pa.string()), pa.array(phrases, pa.string()), batch.column(1)],
                                             names=["seed", "lang", "phrase", "n"])
    return numbered.mapInArrow(run, ROWS)


def level_worded(texts: DataFrame, trie, k: int, last: bool) -> DataFrame:
    """The same with rows in words, where the trie holds only some of the frequent phrases of k - 1 words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Trie = trie.value
        reader, count = Reader(t), np.zeros(len(t.cand), np.int64)
        for lang, tokens in stretches(batches):
            ids, symbol = reader.read(tokens)
            state = t.states(lang, symbol, k)
            if len(state) < 2:
                continue
            safe = inside(ids, k)
            accepted = t.accept[t.advance(state[:-1], symbol[k - 1:])]
            hit = accepted >= 0
            count += np.bincount(accepted[hit], minlength=len(count))
            yield _batch(False, lang, *windows(ids, np.nonzero(safe & ~hit)[0], k, reader.words.names))
            if not last:
                longer = safe[:-1] & safe[1:]
                yield _batch(True, lang, *windows(ids, np.nonzero(longer)[0], k + 1, reader.words.names, LOCALLY))
        by: dict[str, list[int]] = {}
        for c in np.nonzero(count)[0].tolist():
            by.setdefault(t.cand_lang[c], []).append(c)
        for lang, chosen in by.items():
            yield _batch(False, lang, [b" ".join([t.words[s] for s in t.cand[c]]) for c in chosen], count[chosen])
    return texts.mapInArrow(run, ROWS)


def _summed(rows: DataFrame, least: int) -> DataFrame:
    return stored(rows.groupBy("seed", "lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("seed") | (F.col("n") >= least)))


def _top(rows: DataFrame, most: int) -> list[tuple[str, str]]:
    """The ``most`` most frequent rows of a phrase table."""
    got = rows.orderBy(F.desc("n"), "lang", "phrase").limit(most).select("lang", "phrase").toArrow()
    return list(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))


def counted(docs: DataFrame, least: int = 30, longest: int = 4, most: int = 20_000_000) -> DataFrame:
    """(lang, phrase, size, n): all phrases of up to ``longest`` words found ``least`` times; size 0 holds all words of a language."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    level = _summed(words_counted(texts), least)
    parts = 1 + (level.where("phrase = ''").agg(F.sum("n")).first()[0] or 0) // PART
    out = level.where("NOT seed").select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(1).alias("size"), "n")
    share, numbered, index = docs.sparkSession.sparkContext.broadcast, level, None
    for k in range(2, longest + 1):
        known = level.where("NOT seed AND phrase <> ''")
        if numbered is not None and (known if k == 2 else numbered).count() <= most:
            if k == 2:
                got = known.select("lang", "phrase").toArrow()
                index = Index(list(zip(got.column(0).to_pylist(), got.column(1).to_pylist())))
            else:
                index = Index(index.words, (*index.longer, np.sort(numbered.select("code").toArrow().column(0).to_numpy())))
            held = share(index)
            numbered = stored(level_keyed(texts, held, k, least, parts))
            level = stored(spelled(numbered, held))
        else:
            top, numbered = _top(known, min(most, TRIE)), None
            frequent = set(top)
            seeds = [(lang, p) for lang, p in _top(level.where("seed"), min(most, TRIE))
                     if (lang, p.rsplit(" ", 1)[0]) in frequent and (lang, p.split(" ", 1)[1]) in frequent]
            held = share(Trie(top, seeds, k))
            level = _summed(level_worded(texts, held, k, k == longest), least)
        held.unpersist()
        release(docs.sparkSession)
        out = out.union(level.where("NOT seed").select("lang", "phrase", F.lit(k).alias("size"), "n"))
    return out


def scored(counts: DataFrame, longest: int = 4, scale: int = 2_000_000, share: int = 80) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer candidate nearly covers; ``counts`` as from ``counted``."""
    total = counts.where("size = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = counts.where(f"size BETWEEN 1 AND {longest - 1}").select("lang", F.col("phrase").alias("part"), F.col("n").alias("m"))
    common = (F.instr("part", " ") == 0) & (F.col("m") * HOT >= total)
    words = F.split("phrase", " ")
    cand = counts.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"))
    sides = [F.when(F.col("size") > c, F.struct(F.lit(f"{side}{c}").alias("place"), F.array_join(piece, " ").alias("part")))
             for c in range(1, longest) for side, piece in (("l", F.slice(words, 1, c)), ("r", F.slice(words, c + 1, longest)))]
    cuts = cand.select("lang", "phrase", "a", F.inline(F.filter(F.array(*sides), lambda s: s.isNotNull())))
    near = cuts.join(F.broadcast(parts.where(common).withColumnRenamed("m", "_m")), ["lang", "part"], "left")
    met = (near.where("_m IS NOT NULL").select("lang", "phrase", "a", "place", F.col("_m").alias("m"))
           .union(near.where("_m IS NULL").join(parts.where(~common), ["lang", "part"]).select("lang", "phrase", "a", "place", "m")))
    places = [f"{side}{c}" for c in range(1, longest) for side in "lr"]
    wide = met.groupBy("lang", "phrase", "a").agg(*[F.max(F.when(F.col("place") == p, F.col("m"))).alias(p) for p in places])

    def at(c: int):
        score = F.expr(f"cast((cast({scale} as decimal(18,0)) * cast(a as decimal(20,0))) div (cast(l{c} as decimal(20,0)) + cast(r{c} as decimal(20,0))) as long)")
        return F.when(F.col(f"l{c}").isNotNull(), F.struct(score.alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")))
    best = wide.withColumn("_best", F.array_min(F.filter(F.array(*[at(c) for c in range(1, longest)]), lambda s: s.isNotNull())))
    runs = [F.when(F.col("size") > k, F.array_join(F.slice(words, i + 1, k), " "))
            for k in range(2, longest) for i in range(longest - k + 1)]
    held = [F.when(F.col("size") >= i + k, r) for r, (k, i) in zip(runs, [(k, i) for k in range(2, longest) for i in range(longest - k + 1)])]
    within = (cand.select("lang", "a", F.explode(F.filter(F.array(*held), lambda s: s.isNotNull())).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("_over")))
    covered = F.col("_over").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share
    return (best.join(within, ["lang", "phrase"], "left").where(F.col("_over").isNull() | ~covered)
            .select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, longest: int = 4, scale: int = 2_000_000, share: int = 80, most: int = 20_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language."""
    if not 2 <= longest <= 6:
        raise ValueError("longest is between 2 and 6 words")
    conf, small = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(small)
    conf.set(small, str(BATCH))  # batches of texts stand in every task's memory several times
    try:
        counts = stored(counted(docs, least, longest, most))
    finally:
        conf.set(small, before)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(counts, longest, scale, share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", "n")
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
