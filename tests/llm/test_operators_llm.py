"""The training-data operators against brute force, on small and awkward tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plotgap.llm import jaccard, mixing, packing, pii, ppm, quality, queries, secret_scan, substring, topk, toxicity
from plotgap.llm.base import crc_remainder

CLASHING = "key set n marks hash token epoch block position start kept pii spans good stratum _row _t _key _s _w".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
WORDS = "ba be bi bo bu da de di".split()


def table(spark, rows):
    """Documents of (doc_id, text) with extra columns whose names clash with inner ones."""
    full = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", len(t or "")) + ("x",) * len(CLASHING) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def text(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def awkward():
    rng = random.Random(5)
    long = text(rng, 30_000)
    base = text(rng, 120, [f"w{i}" for i in range(400)])
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, base), (7, base), (7, base), (None, base), (8, base + " tail"), (None, None), (9, long),
            (10, "é ü 🙂   ǅ"), (11, "a b c d"), (12, "A B C D"), (13, base.replace("w", "v")), (14, "\r\n".join(["same line"] * 40))]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward())


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, awkward()).limit(0)


def brute_substring(rows, size):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[k:k + size]) for _, w in split for k in range(len(w) - size + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k:k + size])] > 1:
                gone[k:k + size] = [True] * size
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("size", [2, 7, 35])
def test_substring(spark, size):
    rng = random.Random(size)
    rows = awkward() + [(100 + k, text(rng, rng.randrange(90), [f"x{i}" for i in range(3 * size)])) for k in range(40)]
    got = substring.kept_words(table(spark, rows), size).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == sorted(brute_substring(rows, size), key=repr)


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_classes(rows):
    sets = sets_of(rows)
    lead = {i: i for i in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            lead[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(rng, n, copies, start, edits):
    """A text and copies with a few words changed."""
    base = [f"{rng.randrange(10 ** 6)}" for _ in range(n)]
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(n)] = f"e{rng.randrange(10 ** 6)}"
        out.append((start + k, " ".join(w)))
    return out


def test_jaccard_classes(spark):
    rng = random.Random(2)
    rows = [r for r in awkward() if r[0] is not None and r[0] != 9]
    rows += family(rng, 150, 60, 1000, 6) + family(rng, 40, 30, 2000, 3)
    for k in range(60):  # light sets of 1 to 12 shingles, many of them close
        rows += family(rng, 5 + k % 12, 3, 3000 + 10 * k, 1)
    shared = " ".join(f"p{i}" for i in range(60))
    rows += [(5000 + k, shared + " " + text(rng, 200, [f"q{k}_{i}" for i in range(300)])) for k in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(table(spark, rows)).collect()}
    assert got == brute_classes(rows)
    kept = jaccard.one_each(table(spark, rows + [(None, "no id")]))
    assert {r.doc_id for r in kept.collect()} == {c for _, c in got.values()} | {None}
    assert kept.columns == table(spark, rows).columns


def test_light_boundary_follows_cost():
    assert jaccard.light_boundary({}, {}, 0.75) == 0
    assert jaccard.light_boundary({5: 10}, {5: (10_000, 50)}, 0.75) == 6  # sets of 5 then meet no heavy one
    assert jaccard.light_boundary({12: 1000}, {12: (1000, 500)}, 0.75) == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    emit, step, start = rng.normal(size=6), rng.normal(size=(2, 2)), -0.4
    ahead, back = toxicity.forward_backward(emit, np.array([0]), start, step)
    mass = np.zeros((6, 2))
    for tags in itertools.product((0, 1), repeat=6):
        w = math.exp(start * tags[0] + sum(emit[i] * t for i, t in enumerate(tags)) + sum(step[a, b] for a, b in zip(tags, tags[1:])))
        for i, t in enumerate(tags):
            mass[i, t] += w
    assert np.allclose(ahead + back, np.log(mass[:, 1] / mass[:, 0]))
    two = toxicity.forward_backward(np.tile(emit, 2), np.array([0, 6]), start, step)
    assert np.allclose((two[0] + two[1])[6:], ahead + back)
    assert list(toxicity.chains(np.array([600, 0, 3]), np.zeros(603, bool))) == [0, 256, 512, 600]


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op4_toxicity_chain(spark, folder).where("held_out")
    both = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert len(both) > 500
    assert np.mean([r.predicted == r.toxic for r in both]) > 0.97
    assert np.mean([r.predicted for r in both if r.toxic]) > 0.8
    assert np.mean([r.predicted for r in both if not r.toxic]) < 0.02
    assert all(0 <= r.score <= 1 for r in both)


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, None, i % 2, "x") for i in range(1, 14)] + [(1, 1, None, "x"), (None, 1, 1, "x"), (6, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.train(docs, labels, per_class=4)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.train(docs, labels.limit(0))
    assert not nothing.learned and {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.reject(docs, nothing).collect() == docs.collect()
    assert toxicity.score(empty, nothing).count() == 0 and not toxicity.train(empty, labels).learned


def packed_right(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=512).collect()
    want = []
    for i, t in awkward():
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, a, len(ids[a:a + 512]), zlib.crc32(ids[a:a + 512].tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    used = packed_right(rows, 512)
    assert used <= -(-sum(r.length for r in rows) // 512) + 2
    assert packing.pack_documents(empty, path).count() == 0


def test_word_ids_equal_the_whole_tokenizer():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, ids = Tokenizer.from_file(path), packing.WordIds(path, most=3)
    for t in ["Don't stop: it's 42% <|endoftext|> naïve ÀÉÎ straße İstanbul µm éa x ΑΣ 'S we'LL l'été ''s x'd!'re 12ab3²", "“q” 中文 🙂🙂  a b", "a" * 3000]:
        assert b"".join(ids[w] for w in t.encode().split()) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("seed", range(4))
def test_configuration_program(seed):
    rng = random.Random(seed)
    counts = collections.Counter(min(1000, int(rng.lognormvariate(4.5, 1.2)) + 1) for _ in range(4000))
    filled = packing.solve(dict(counts), 1000)
    load = collections.Counter()
    for length, rank, n, first in filled.slots:
        for k in range(n):
            load[first + k] += length
    assert not any(filled.left.values()) and max(load.values()) <= 1000
    assert filled.opened <= math.ceil(sum(k * n for k, n in counts.items()) / 1000) * 1.01 + 1


@pytest.mark.parametrize("counts, capacity", [({43: 400, 31: 10, 65: 400}, 128), ({76: 100, 44: 400, 15: 400, 46: 10}, 128), ({}, 128)])
def test_never_worse_than_best_fit_decreasing(counts, capacity):
    plain = packing.Filling(counts, capacity)
    plain.best_fit()
    filled, load = packing.solve(dict(counts), capacity), collections.Counter()
    for length, _, n, first in filled.slots:
        for k in range(n):
            load[first + k] += length
    assert filled.opened <= plain.opened and not any(filled.left.values()) and max(load.values(), default=0) <= capacity


def test_dearest_pattern_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        prices, most = rng.random(5), rng.integers(0, 4, 5)
        got = packing.dearest_pattern(prices, most, 11)
        best = max(sum(p * c for p, c in zip(prices, cs)) for cs in itertools.product(*(range(m + 1) for m in most)) if sum((i + 1) * c for i, c in enumerate(cs)) <= 11)
        assert (got <= most).all() and got @ np.arange(1, 6) <= 11 and np.isclose(got @ prices, best)


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(20)], "x") for i in range(300)]
    rows += [(300, None, "x"), (301, [float("nan")] * 20, "x"), (302, [None] * 20, "x"), (303, [float("inf")] * 20, "x"), (304, [], "x"), (350, [], "x"), (None, [1.0] * 20, "x"),
             (400, [1e7] * 20, "x"), (401, [0.5] * 3, "x"), (450, rows[7][1], "x"), (451, rows[7][1], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5).collect())
    sound = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(sound):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert got == sorted(want)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_mixing(spark, docs, empty):
    uses = mixing.mix(docs, 0.999, 3.0, block_tokens=50).collect()
    copies = collections.Counter(r.doc_id for r in uses)
    assert set(copies) == {i for i, _ in awkward()}
    sized = {}
    for r in uses:
        sized.setdefault((r.source, r.epoch), []).append((r.start, r.n_tokens))
    for spans in sized.values():  # streams without holes
        spans = sorted(spans)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]) if n) or len(spans) == 1
    got = mixing.mixed(docs, 0.999, 3.0, block_tokens=50)
    rows = collections.Counter(i for i, _ in awkward())
    assert got.columns == docs.columns
    per_source = collections.Counter((r.doc_id, r.source) for r in uses)
    want = collections.Counter()
    for r in docs.collect():
        want[r.doc_id] += per_source[(r.doc_id, r.source)]
    assert collections.Counter(r.doc_id for r in got.collect()) == want and sum(want.values()) >= sum(rows.values())
    assert mixing.mix(empty, 0.9, 2.0).count() == 0 and mixing.mixed(empty, 0.9, 2.0).count() == 0


def test_exponent():
    tokens = [1000, 100, 10]
    assert mixing.fit_exponent(tokens, 0.1, 2.0) == 1.0
    a = mixing.fit_exponent(tokens, 0.8, 1e9)
    assert mixing.entropy(mixing.weights_at(tokens, a)) / math.log(3) == pytest.approx(0.8, abs=1e-6)
    b = mixing.fit_exponent(tokens, 0.99, 5.0)
    assert mixing.repeats(tokens, mixing.weights_at(tokens, b)) == pytest.approx(5.0, rel=1e-6)


SECRETS = [(1, None), (2, ""), (3, 'x password="abcd" token=secret: abcdefghijklmnop é🙂 api_key : \'Zx81kLpQ9sTy77vbNmQw22\''), (4, "🙂AKIA1234567890ABCD AKIAAKIA12 zz0123456789abcdef00"),
           (5, "q8Zr2LxT0vBn5KwP1sYd7 thisisaverylonglowercaseword some.dotted.name.with.words aaaaaaaaaaaaaaaaaaaaaaaa1"), (6, "PASSWD:" + "k" * 5000), (7, "token = deadbeefdeadbeef0"), (7, "token = deadbeefdeadbeef0")]
BASE = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def brute_secrets(t, window=20, bits=(2.9, 3.5, 3.7)):
    base = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t):
            if not (kind == "assign" and len(m.group(2)) < 12 or kind == "access" and len(m.group()) < 18 or kind == "hex" and len(m.group()) < 16):
                base.append((m.start(), rank, m.end(), kind))
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]{20,}", t):
        v = m.group()
        if any(re.fullmatch(p, v) for p in secret_scan.ALLOWED):
            continue
        need = bits[0] if re.fullmatch("[0-9a-fA-F]+", v) else bits[1] if re.fullmatch("[A-Za-z0-9]+", v) else bits[2]
        spans = []
        for i in range(len(v) - window + 1):
            c = collections.Counter(v[i:i + window])
            if -sum(n / window * math.log2(n / window) for n in c.values()) >= need:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + window
                else:
                    spans.append([i, i + window])
        more += [(m.start() + a, 3, m.start() + b, "entropy") for a, b in spans if not any(s < m.start() + b and m.start() + a < e for s, _, e, _ in base)]
    return sorted(base + more)


def test_secrets(spark, docs, empty):
    rng = random.Random(8)
    rows = SECRETS + [(100 + k, " ".join("".join(rng.choice(secret_scan.ALPHABET[:n]) for _ in range(rng.randrange(15, 60))) for n in (16, 40, 62, 68))) for k in range(60)]
    rows += [(200 + k, "".join(rng.choice(["0123456789abcdef", "g h"][rng.random() < 0.1]) for _ in range(200))) for k in range(20)]
    got = secret_scan.scan(table(spark, rows)).collect()
    assert sorted(((r.doc_id, [(s.start, s.end, s.kind) for s in r.spans]) for r in got), key=repr) == sorted(
        ((i, [(a, b, k) for a, _, b, k in brute_secrets(t or "")]) for i, t in rows), key=repr)
    clean = secret_scan.redacted(table(spark, rows))
    assert clean.columns == docs.columns
    for r in clean.where("doc_id < 100 and text is not null").collect():
        t, out, at = dict(rows)[r.doc_id], "", 0
        for a, _, b, _ in brute_secrets(t):
            out += t[at:max(a, at)] + ("[SECRET]" if a >= at else "")
            at = max(at, b)
        assert r.text == out + t[at:] and r.n_chars == len(r.text)
    assert secret_scan.redacted(empty).count() == 0 and secret_scan.scan(docs).count() == docs.count()


def test_secrets_beside_known_shapes_and_filler(spark):
    secret = "q8Zr2LxT0vBn5KwP1sYd7uFh"
    cases = [f"9f86d081884c7d65.{secret}", f"é AKIA1234567890ABCD/{secret}", f"{secret}/AKIA1234567890ABCD", f"api.example.com/v1/{secret}", f"{secret}.sample.9f86d081884c7d65/{secret[::-1]}"]
    rows = list(enumerate(cases)) + [(10, "www.example.com"), (11, f"example{secret}"), (12, "config.aws.api_key=Zx81kLpQ9sTy77vbNmQw22")]
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "entropy"] for r in secret_scan.scan(table(spark, rows)).collect()}
    clean = {r.doc_id: r.text for r in secret_scan.redacted(table(spark, rows)).collect()}
    for k, t in enumerate(cases):
        for s in (secret, secret[::-1]):
            at = t.find(s)
            assert at < 0 or any(a <= at and at + len(s) <= b for a, b in spans[k]), t
            assert s not in clean[k]
    assert not spans[10] and not spans[11] and not spans[12]


def luhn(d):
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pii(spark, docs, empty):
    rng = random.Random(9)

    def card():
        body = "".join(rng.choice("0123456789") for _ in range(15))
        return next(body + c for c in "0123456789" if luhn(body + c))
    cards = [card() for _ in range(300)]
    dates = [f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}" for _ in range(300)]
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(300)]
    phones = [f"+1 ({rng.randrange(1000):03d}) {rng.randrange(1000):03d}-{rng.randrange(10000):04d}" for _ in range(300)]
    mails = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) + f".{rng.randrange(100)}@mail.example.com" for _ in range(300)]
    rows = [(k, f"é {a} {b} {c} {d} {e}.") for k, (a, b, c, d, e) in enumerate(zip(cards, dates, ips, phones, mails))] + [(900, None), (901, ""), (902, "1234567890123456 2024-13-01 999.1.1.1 000-12-3456 12345")]
    out = pii.pseudonymised(table(spark, rows), "k").collect()
    assert next(r.text for r in out if r.doc_id == 902) == dict(rows)[902] and next(r.text for r in out if r.doc_id == 900) is None
    pairs = [(r.text.split(" ", 5), dict(rows)[r.doc_id].split(" ", 5)) for r in out if r.doc_id < 900]
    assert all(luhn(n[1]) and len(n[1]) == 16 and n[1][0] == o[1][0] for n, o in pairs)
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\d", n[2]) and all(int(x) < 256 for x in n[3].split(".")) for n, _ in pairs)
    found = {}
    for r in out:
        for s in r.pii or []:
            found.setdefault((s.kind, dict(rows)[r.doc_id][s.start:s.end]), set()).add(s.value)
    assert all(len(v) == 1 for v in found.values()) and len({(k[0], min(v)) for k, v in found.items()}) == len(found)
    assert sum(min(v) == k[1] for k, v in found.items()) <= 2
    again = {(s.kind, dict(rows)[r.doc_id][s.start:s.end], s.value) for r in pii.pseudonymised(table(spark, rows), "other").collect() for s in r.pii or []}
    assert len(again & {(k, o, min(v)) for (k, o), v in found.items()}) <= 5
    assert pii.pseudonymised(empty, "k").count() == 0 and pii.pseudonymised(docs, "k").drop("pii").count() == docs.count()


def test_numbers_beside_cards_hide_nothing(spark):
    card, spaced, address = "4111111111111111", "4111 1111 1111 1111", "190.137.223.204"
    cases = [(f"{card} {address}", [card, address]), (f"12 {spaced}", [spaced]), (f"{spaced} 25", [spaced]), (f"7 {spaced}-123 {address}", [spaced, address]), (f"é {card} 12.05.2020", [card, "12.05.2020"]),
             (f"{card} 555-123-4567", [card, "555-123-4567"]), (f"212-555-0199 {spaced} {card}", ["212-555-0199", spaced, card]), (f"{spaced} 12.bob@mail.org", [spaced, "12.bob@mail.org"]),
             (f"1  {spaced}", [spaced]), ("3782 822463 10005 4", ["3782 822463 10005"]), ("41111 11111 11111 1", ["41111 11111 11111 1"]), ("1234567890123456", []), ("9" * 5000, [])]
    for r in pii.pseudonymised(table(spark, [(k, t) for k, (t, _) in enumerate(cases)]), "k").collect():
        t, want = cases[r.doc_id]
        assert [t[s.start:s.end] for s in r.pii] == want, t
        assert not any(w in r.text for w in want)
        assert all(luhn(re.sub("[^0-9]", "", s.value)) for s in r.pii if s.kind == "card")


def test_feistel_is_a_permutation(spark):
    got = spark.range(17 * 23).select(pii.feistel(F.floor(F.col("id") / 23), F.col("id") % 23, F.lit(17), F.lit(23), "k", "t").alias("s")).collect()
    assert len({(r.s.a, r.s.b) for r in got}) == 17 * 23 and all(0 <= r.s.a < 17 and 0 <= r.s.b < 23 for r in got)


def naive_ppm(train):
    counts = [collections.defaultdict(collections.Counter) for _ in range(4)]

    def body(t):
        return b"\n\n\n" + b" ".join((t or "").encode().lower().split()) + b"\n"
    for t in train:
        b = body(t)
        for k in range(3, len(b)):
            for o in range(4):
                counts[o][b[k - o:k]][b[k]] += 1

    def score(t):
        b, total = body(t), 0.0
        for k in range(3, len(b)):
            p, out, done = 1.0, set(), False
            for o in (3, 2, 1, 0):
                c = {s: n for s, n in counts[o].get(b[k - o:k], {}).items() if s not in out}
                if c:
                    whole = sum(c.values()) + len(c)
                    if b[k] in c:
                        p, done = p * c[b[k]] / whole, True
                        break
                    p, out = p * len(c) / whole, out | set(c)
            total += math.log10(p if done else p / (256 - len(out)))
        return total
    return score


@pytest.mark.parametrize("frequent", [3, 1000])
def test_ppm(spark, empty, frequent):
    rng = random.Random(6)
    rows = [r for r in awkward() if r[0] != 9] + [(100 + k, text(rng, rng.randrange(40), ["abra", "kadabra", "Simsala", "bim", f"r{k}"])) for k in range(60)]
    learn = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for _, t in learn for w in [*(t or "").encode().lower().split(), None])
    tokens, norm, score = sum(counts.values()), None, naive_ppm([t for _, t in learn])
    norm = tokens + len(counts) + 1
    got = ppm.score(table(spark, rows), crc_remainder("doc_id", 7) != 2, frequent=frequent).collect()
    want = []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        want.append((str(i), len(w), sum(counts[x] > 0 for x in w), tokens, round(sum(math.log10((counts[x] + 1) / norm) for x in w), 6), round(score(t), 3)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in got) == sorted(want)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    assert ppm.score(empty, crc_remainder("doc_id", 7) != 2).count() == 0
    alone = ppm.score(table(spark, [(1, "ab")]), F.lit(False)).collect()[0]
    assert alone.n_known == 0 and alone.score == pytest.approx(3 * math.log10(1 / 256), rel=1e-6)


@pytest.mark.parametrize("frequent_grams", [1, 40, 200_000])
def test_every_gram_counts(spark, frequent_grams):
    rng = random.Random(16)
    rows = [(k, text(rng, rng.randrange(1, 30), [*WORDS, f"r{k}", "".join(rng.choice("0123456789abcdef") for _ in range(20))])) for k in range(80)] + [(80, "é 🙂"), (80, "é 🙂"), (81, None)]
    score = naive_ppm([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    got = ppm.score(table(spark, rows), crc_remainder("doc_id", 7) != 2, frequent_grams=frequent_grams).collect()
    assert sorted((r.doc_id, round(r.score, 3)) for r in got) == sorted((i, round(score(t), 3)) for i, t in rows)


def test_probabilities_sum_to_one():
    grams = np.unique(np.random.default_rng(0).integers(97, 105, (500, 4)) @ np.array([1 << 24, 1 << 16, 1 << 8, 1]))
    rows, table_ = ppm.Trie(grams, np.arange(1, len(grams) + 1)).table()
    for context in (grams[0] >> 8, 97 << 16 | 97 << 8 | 97, 0, 200):
        assert (10.0 ** table_[rows[context]].astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, None, "x") for i in range(1, 15)] + [(None, 1, 1, "x"), (6, None, 0, "x"), (6, 0, 0, "x")], "doc_id long, quality int, toxic int, lang string")
    got = quality.judge(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.kept is not None and (not r.kept or not r.base_failed) for r in got)
    assert {r.n_words for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert quality.judge(empty, labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == docs.count()


def test_binomial_tail():
    for n, rate in ((1, 0.3), (7, 0.01), (40, 0.5), (400, 0.02)):
        for k in range(n + 1):
            assert quality.binomial_tail(k, n, rate) == pytest.approx(sum(math.comb(n, i) * rate ** i * (1 - rate) ** (n - i) for i in range(k + 1)), rel=1e-9, abs=1e-12)


def test_thresholds_keep_their_promise():
    """Cutoffs chosen on random holdouts reject more clean documents than allowed in less than delta of the trials."""
    rng, bad = np.random.default_rng(1), 0
    for _ in range(200):
        clean, junk = np.sort(rng.exponential(0.1, 800)), rng.exponential(0.6, 200)
        tables = {("en", rule): {"clean": [int((clean > c).sum()) for c in grid], "bad": [int((junk > c).sum()) for c in grid], "n": 800} for rule, grid in quality.GRIDS.items()}
        for _, rule, cutoff in quality.choose(tables, 0.1, 0.1, 0.0):
            bad += math.exp(-cutoff / 0.1) > 0.1 / len(quality.GRIDS)
    assert bad <= 20


def test_five_word_repeats(spark):
    rng = random.Random(3)
    rows = [(k, text(rng, rng.randrange(60), WORDS[:3])) for k in range(80)]
    got = {r.doc_id: r.n for r in table(spark, rows).select("doc_id", quality.repeat_words(F.filter(F.split("text", " "), lambda w: w != "")).cast("int").alias("n")).collect()}
    for i, t in rows:
        w = t.split()
        seen = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        assert got[i] == len({k + j for k in range(len(w) - 4) if seen[tuple(w[k:k + 5])] > 1 for j in range(5)})


def test_digests_are_of_the_kept_words(spark):
    rows = {r.doc_id: r for r in queries.op1_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for i, n, removed, kept in brute_substring(docs, 35):
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())
