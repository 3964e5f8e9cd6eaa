"""SimHash classes, phrase collocations and centroid clustering against brute force, on small and awkward tables."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plotgap.llm import clustering, jaccard, phrases, simhash
from test_operators_llm import awkward, docs, empty, family, sets_of, table, text  # noqa: F401


def naive_fingerprint(t):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if x]
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_classes(codes, most=3):
    """Smallest place reachable, for each place of ``codes``."""
    lead = list(range(len(codes)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x
    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= most:
                p, q = find(i), find(j)
                lead[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(codes))]


def test_simhash_awkward(spark):
    rng = random.Random(4)
    rows = awkward() + family(rng, 300, 40, 100, 4) + family(rng, 60, 20, 300, 2) + [(None, "no id here at all"), (None, None)]
    got = simhash.classes(table(spark, rows)).collect()
    codes = [naive_fingerprint(t) for _, t in rows]
    least = collections.defaultdict(list)
    for (i, _), c in zip(rows, naive_classes(codes)):
        if i is not None:
            least[c].append(i)
    want = [(i, f, min(least[c]) if least[c] else None) for (i, _), f, c in zip(rows, codes, naive_classes(codes))]
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == sorted(want, key=repr)


def test_simhash_empty(empty):
    assert simhash.classes(empty).collect() == []


@pytest.mark.parametrize("most", [0, 1, 3, 5])
def test_gray_index_equals_all_pairs(most):
    rng = np.random.default_rng(most)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = [(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for c in centre for _ in range(60)]
    codes = np.unique(np.array(flips, np.uint64))
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    codes = codes[np.argsort(rank)]
    for starts in ([0], [0, 1, 9, 100, 350]):
        index = simhash.Index(codes, np.array(starts))
        top = np.arange(len(starts))
        index.search(top, top, most)
        for a, b in zip(starts, [*starts[1:], len(codes)]):
            assert (index.label[a:b] - a).tolist() == naive_classes([int(c) for c in codes[a:b]], most)


def test_simhash_blocks_of_one_hot_bucket(spark):
    """A dense cluster in one bucket, cut into many blocks that meet across."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    codes = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)})
    nodes = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    for size in (7, 64, 100_000):
        found = simhash.walked(simhash.dealt(nodes, 4, 3), 3, size).cache()
        links = found.where("b IS NOT NULL").select("a", "b").union(simhash.across(found.where("b IS NULL"), 3)).collect()
        lead = {c: c for c in codes}

        def find(x):
            while lead[x] != x:
                x = lead[x]
            return x
        for r in links:
            a, b = r.a & (1 << 64) - 1, r.b & (1 << 64) - 1
            p, q = find(a), find(b)  # an edge of a forest joins a class; its ends need not be close themselves
            lead[max(p, q)] = min(p, q)
        assert [find(c) for c in codes] == [codes[c] for c in naive_classes(codes)]
        assert len(links) < 4 * len(codes) * 60


def test_blocks_grow_with_the_corpus():
    assert [simhash.blocks_for(n) for n in (1_000, 15_000_000, 50_000_000_000)] == [4, 5, 7]
    assert all(m.bit_count() == 16 for m in simhash.masks(4))


def naive_collocations(rows, top, least, longest, scale, share):
    f, n = collections.Counter(), collections.Counter()
    for lang, t in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {c: a for c, a in f.items() if len(c[1]) >= 2 and a >= least}
    covered = set()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, w[i:i + k])
                if 100 * a >= share * cand[part]:
                    covered.add(part)
    out = []
    for lang in n:
        mine = []
        for (g, w), a in cand.items():
            if g == lang and (g, w) not in covered:
                score, _, l, r = min((scale * a // (f[g, w[:k]] + f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
                mine.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("most", [100_000, 40, 3])
def test_collocations(spark, most):
    """With ``most`` phrases in the trie or fewer than there are, so that windows outside it count too."""
    rng = random.Random(6)
    rows = awkward() + [(100 + k, text(rng, 400, [f"w{min(int(rng.expovariate(.05)), 400)}" for _ in range(60)])) for k in range(60)]
    rows += [(300 + k, rng.choice(["New York, New York! is Big", "the the the the the", "a.b.c d\te f\x0bg h", "é ü 🙂 é ü 🙂"])) for k in range(160)]
    frame = table(spark, rows)
    got = phrases.collocations(frame, top=50, least=8, longest=4, most=most)
    want = naive_collocations([(r.lang, r.text) for r in frame.collect()], 50, 8, 4, 2_000_000, 80)
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_collocations_empty(empty):
    assert phrases.collocations(empty).collect() == []


def test_collocations_exact_beyond_64_bits(spark):
    big = 9 * 10 ** 12
    rows = [("en", "", 0, 4 * big), ("en", "a", 1, 2 * big), ("en", "b", 1, big + 7), ("en", "a b", 2, big)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, n long")).collect()
    assert [(r.a, r.l, r.r, r.score) for r in got] == [(big, 2 * big, big + 7, 2_000_000 * big // (3 * big + 7))]


def test_trie_accepts_what_it_holds():
    rng = random.Random(3)
    words = [f"t{i}" for i in range(700)]
    known = sorted({("en" if rng.random() < .7 else "de", f"{rng.choice(words[:40])} {rng.choice(words)}") for _ in range(4000)})
    wanted = sorted({(lang, f"{p} {rng.choice(words)}") for lang, p in rng.sample(known, 900)})
    trie = phrases.Trie(known, wanted, 3)
    number = trie.table()
    held = {p: i for i, p in enumerate(wanted)}
    for lang in ("en", "de"):
        lines = [p.split() for _, p in wanted] + [[rng.choice(words) for _ in range(3)] for _ in range(3000)]
        m = np.array([[number.get(w.encode(), -1) for w in line] for line in lines])
        state = np.full(len(m), trie.root[lang], np.int64)
        for j in range(3):
            if j == 2:
                assert [bool(s) for s in state] == [(lang, " ".join(line[:2])) in set(known) for line in lines]
            state = trie.advance(state, m[:, j])
        assert trie.accept[state].tolist() == [held.get((lang, " ".join(line)), -1) for line in lines]


def naive_cluster(rows, k, rounds, scale, width):
    kept = [(i, [math.floor(scale * Fraction(x)) for x in v], v) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    c = [v for _, v, _ in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, z)), j) for j, z in enumerate(c))
    for _ in range(rounds):
        by = collections.defaultdict(list)
        for _, v, _ in kept:
            by[near(v)[1]].append(v)
        c = [[sum(x) // len(by[j]) for x in zip(*by[j])] if by[j] else c[j] for j in range(len(c))]
    found = [(i, *near(v)[::-1]) for i, v, _ in kept]
    each = collections.Counter()
    for _, j, d in found:
        each[j] += d
    top = (1 << 63) - 1
    return sorted(((i, j, min(d, top), min(each[j], top), min(sum(each.values()), top), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
                   for i, j, d in found), key=repr)


VECTORS = "vec_id long, embedding array<double>, cluster string, key string, arrival string, v string, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x", 1) for i, v in rows], VECTORS)


def clustered(df, **kw):
    return sorted((tuple(r) for r in clustering.cluster(df, **kw).collect()), key=repr)


def test_clustering(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 2]), .3) for _ in range(6)]) for i in range(900)]
    rows += [(None, [0.5] * 6), (5, rows[5][1]), (5, rows[5][1]), (7, [1.0] * 6), (1000, None), (1001, [1.0] * 5), (1002, [1.0] * 5 + [None]),
             (1003, [1.0] * 5 + [float("nan")]), (1004, [float("inf")] + [1.0] * 5), (1005, [])]
    rows += [(2000 + k, [0.25] * 6) for k in range(700)]  # one vector many times
    assert clustered(vectors(spark, rows), k=9, width=6) == naive_cluster(rows, 9, 3, 64, 6)


def test_clustering_of_huge_values(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-2, e) for _ in range(4)]) for e in (9, 300) for i in range(e, e + 60)] + [(999, [1.7e308, -1.7e308, 0.0, 1.0])]
    assert clustered(vectors(spark, rows), k=5, width=4) == naive_cluster(rows, 5, 3, 64, 4)


def test_clustering_of_few_vectors(spark):
    rows = [(3, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [-3.0, 0.1])]
    assert clustered(vectors(spark, rows), k=16, width=2) == naive_cluster(rows, 16, 3, 64, 2)
    assert clustered(vectors(spark, rows).limit(0), k=16, width=2) == []


def test_boxes_prune_and_hilbert_order_keeps_neighbours():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    keys = [k.tobytes() for k in clustering.hilbert_keys(grid, 4)]
    walk = grid[sorted(range(256), key=keys.__getitem__)]
    assert len(set(keys)) == 256 and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    v = np.array([[1, 1], [2, 2], [3, 1]])
    number, best, compared = clustering.nearest(v, v.min(0), v.max(0), np.array([[2, 1], [1000, 1000], [-500, 3], [2, 3]]))
    assert number.tolist() == [0, 0, 0] and best.tolist() == [1, 1, 1] and compared == 2


def test_jaccard_null_ids_and_families_below_the_threshold(spark):
    """Rows without doc_id link like others, a doc_id may have several texts, and a family of copies that hardly link is compared whole."""
    rng = random.Random(12)
    base = " ".join(f"b{i}" for i in range(60))
    rows = awkward() + [(None, base), (None, base + " x"), (903, base + " y"), (904, "another text of five words"), (904, base + " z"), (None, "alone without any id here")]
    rows += family(rng, 200, 120, 1000, 14) + family(rng, 400, 60, 3000, 26)
    sets = [next(iter(sets_of([(0, t)]).values())) for _, t in rows]
    lead = list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                lead[max(p, q)] = min(p, q)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    want = [(i, len(sets[k]), low.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]
    got = jaccard.classes(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({c for i, _, c in want if i is not None and 1000 <= i < 3000}) > 5
    kept = jaccard.one_each(table(spark, rows)).collect()
    alone = [k for k, (i, _) in enumerate(rows) if i is not None]
    assert len([r for r in kept if r.doc_id == 904]) == 1 and sum(r.doc_id is None for r in kept) == sum(i is None for i, _ in rows)
    lone = table(spark, [(1, base), (1, "quite another text of words"), (1, base), (2, base + " x")])
    assert sorted(r.text for r in jaccard.one_each(lone).collect()) == sorted([base, "quite another text of words"]) and alone


def test_jaccard_empty(empty):
    assert jaccard.classes(empty).collect() == [] and jaccard.one_each(empty).collect() == []


def test_jaccard_close_pairs_over_blocks(spark, monkeypatch):
    """A family over many blocks: every pair of different components that sizes and parities allow, each found, none twice in a place."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = np.random.default_rng(5)
    core = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    content = {}
    for k in range(90):
        kept = core[rng.random(60) < rng.choice([0.8, 0.95])]
        content[k + 1] = np.unique(np.concatenate([kept, rng.integers(1, 1 << 62, int(rng.integers(0, 12))).astype(np.uint64)]))

    def parity(s):
        odd = np.bincount((s % np.uint64(jaccard.BITS)).astype(np.int64), minlength=jaccard.BITS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
    near = spark.createDataFrame([(a, k, len(s), k % 7) for k, s in content.items() for a in (11, 12)], "anchor long, set long, n int, component long")
    sets = spark.createDataFrame([(k, parity(s)) for k, s in content.items()], "set long, parity array<long>")
    got = [(r.a, r.b) for r in jaccard.close_pairs(near, sets, 0.75).collect()]
    assert len(got) == 2 * len(set(got)) and all(a < b and a % 7 != b % 7 for a, b in got)
    linked = {(a, b) for a in content for b in content if a < b and a % 7 != b % 7
              and 100 * len(np.intersect1d(content[a], content[b])) >= 75 * len(np.union1d(content[a], content[b]))}
    assert linked and linked <= set(got)
    assert jaccard.close_pairs(near.limit(0), sets, 0.75).collect() == []
