import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom.llm import components, neighbours, ngramjoin


class Union(dict):
    def find(self, a):
        self.setdefault(a, a)
        while self[a] != a:
            a = self[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (5, 5)] + [(100 + i, 101 + i) for i in range(60)] + [(200, 300 + i) for i in range(50)]
    union = Union()
    for a, b in links:
        union.join(a, b)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: union.find(n) for n in union if n != 5}


@pytest.mark.parametrize("few", [0, 10_000])
def test_few_links_take_no_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few, raising=False)
    if few:
        monkeypatch.setattr(components, "ROUNDS", 0)
    links = [(7, 7), (90, 80)] + [(1 << 62, 100 + i) for i in range(40)] + [(-3, 140), (-3, 130)] + [(200 + i, 201 + i) for i in range(50)]
    union = Union()
    for a, b in links:
        union.join(a, b)
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {n: union.find(n) for n in union if n != 7}
    assert components.components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_jaccard_components_are_brute_forces(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 200))) for _ in range(60)]
    for base in texts[:12]:
        for edits in (0, 1, 2, 3, 6):
            words = base.split()
            for _ in range(edits):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(" ".join(words))
    core = " ".join(rnd.choice(vocabulary) for _ in range(120)).split()
    for i in range(60):  # a dense group of near copies
        words = list(core)
        words[i % 120] = f"x{i}"
        texts.append(" ".join(words))
    texts += [f"{passage} tail {i} " + " ".join(rnd.choice(vocabulary) for _ in range(40)) for i in range(40)]
    texts += ["", None, "   ", "one two", "ONE two", "one two", texts[0].upper(), "a b c d e", "a b c d e f"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0)], "doc_id long, text string, component_id int")
    sets, union = [_shingles(t) for t in texts], Union()
    for i in range(len(texts)):
        union.find(i)
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                union.join(i, j)
    out = ngramjoin.jaccard_components(docs).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), union.find(r.doc_id))
    assert ngramjoin.jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("turned", [False, True])
def test_rows_that_share_an_id_are_one_node(spark, turned):
    rnd = random.Random(8)
    a, b = (" ".join(f"{c}{rnd.randrange(300)}" for _ in range(120)) for c in "ab")
    rows = [(1, a), (1, b), (2, f"{b} word"), (5, a), (6, b), (6, None), (7, ""), (None, f"{a} other"), (None, "quite alone is this text here"), (9, "nothing like it at all")]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string")
    found = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(docs).collect()), key=str)
    n, m = len(_shingles(a)), len(_shingles(b))
    want = [(1, n, 1), (1, m, 1), (2, len(_shingles(f"{b} word")), 1), (5, n, 1), (6, m, 1), (6, 0, 6), (7, 0, 7), (0, len(_shingles(f"{a} other")), 1), (0, 2, None), (9, 1, 9)]
    assert found == sorted(want, key=str)


def test_a_pair_is_met_once(spark):
    """Documents that share all of a long prefix meet in the list of its first shingle only."""
    rows = [(token, k, 100, pos, k) for k in range(30) for pos, token in enumerate(range(500, 520))]
    rows += [(900 + k, k, 100, 20, k) for k in range(30)]
    lists = spark.createDataFrame(rows, "token long, k long, n long, pos long, component long")
    met = [(r.ks, r.kt) for r in ngramjoin._Listing(lists, 80).met().collect()]
    assert sorted(met) == [(a, b) for a in range(30) for b in range(a + 1, 30)]


def test_sketches_tell_who_cannot_link():
    """Where sketches differ, so do the sets, in as many shingles at least."""
    rng = np.random.default_rng(1)
    for n in (1, 5, 80, 700, 5000):
        s = rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64)
        for same in (0, n // 2, n - 1, n):
            a, b = s[:n], np.concatenate([s[:same], s[n : 2 * n - same]])
            assert np.unpackbits((ngramjoin._sketch(a) ^ ngramjoin._sketch(b)).view(np.uint8)).sum() <= 2 * (n - same)


def test_copies_too_far_apart_are_not_paired(spark):
    """Of a text's copies that all differ from each other in too many words, none is paired, though all share most shingles."""
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(160)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in rnd.sample(range(160), 6):
            words[at] = "other"
        texts.append(" ".join(words))
    rows, sketches = [], []
    for k, s in enumerate(s for _, _, words in ngramjoin.chunks(pa.array(texts), ngramjoin.SPACED) for s in ngramjoin._sets(words, 5)):
        rows += [(int(token), k, len(s), pos, k) for pos, token in enumerate(np.sort(s).view(np.int64)[:40])]
        sketches.append((k, ngramjoin._sketch(s).tolist()))
    listing = ngramjoin._Listing(spark.createDataFrame(rows, "token long, k long, n long, pos long, component long"), 80)
    kept = {frozenset((r.ks, r.kt)) for r in listing.met(spark.createDataFrame(sketches, "k long, sketch array<long>")).collect()}
    met = {frozenset((r.ks, r.kt)) for r in listing.met().collect()}
    shingled = [_shingles(t) for t in texts]
    links = {frozenset((a, b)) for a in range(60) for b in range(a) if 100 * len(shingled[a] & shingled[b]) >= 80 * len(shingled[a] | shingled[b])}
    assert met & links <= kept <= met
    assert len(kept) - len(kept & links) < 0.2 * (len(met) - len(met & links))


def test_prefix_bounds_hold():
    rng = np.random.default_rng(0)
    for n in range(1, 60):
        level = ngramjoin.multiplicity(rng.integers(1, 50, n).astype(float), n, 80)
        assert 1 <= level and n - ngramjoin.required(n, 80) + level <= n


def test_candidates_have_room_for_a_link():
    """The first shared shingle of two sets that link passes the bound on places, whatever the order."""
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randrange(1, 60)
        x = set(rnd.sample(range(1000), n))
        y = set(rnd.sample(sorted(x), rnd.randrange(max(1, n - 8), n + 1))) | set(rnd.sample(range(1000, 2000), rnd.randrange(0, 6)))
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        x, y = sorted((x, y), key=len)
        order = rnd.sample(range(2000), 2000)
        px, py = (sorted(s, key=order.__getitem__) for s in (x, y))
        first = min(x & y, key=order.__getitem__)
        both = max(-(-80 * (len(x) + len(y)) // 180), -(-80 * len(y) // 100))
        assert 100 * len(x) >= 80 * len(y) and min(len(x) - px.index(first), len(y) - py.index(first)) >= both


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    base = _unit(rng, 60)
    vectors = np.concatenate([base, *[base + rng.normal(size=base.shape) * s / 8 for s in (0.2, 0.3, 0.4, 0.45)]])
    labels = rng.integers(0, 2, len(vectors))
    docs = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    found = {r.vec_id: r.n_links for r in neighbours.near_vectors(docs.withColumn("cap", F.lit(1))).collect()}
    assert all(found[i] <= link[i].sum() for i in found) and sum(found.values()) >= 0.95 * link.sum() > 100


def _unit(rng, n):
    x = rng.normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_caps_find_links_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    x, y = _unit(rng, 300), _unit(rng, 300)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.931 * x + np.sqrt(1 - 0.931**2) * y
    below = 0.929 * x + np.sqrt(1 - 0.929**2) * y
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, v.tolist(), 1) for i, v in enumerate(z)] + [(2000 + i, v.tolist(), 2) for i, v in enumerate(below)]
    odd = [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] * 64, 1), (9003, [1.0] * 64, None), (9004, [None] * 64, 1), (9005, [], 1), (9006, [2.0] * 64, 3), (9007, [2.0] * 64, 3), (9007, [2.0] * 64, 3), (9008, [1.0] * 64, 3), (9009, [1.0, 1.0], 3)]
    found = neighbours.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()
    assert len(found) == len(rows) + len(odd)
    by = defaultdict(list)
    for r in found:
        by[r.vec_id].append(r)
    assert sum(by[i][0].n_links for i in range(300)) >= 0.9 * 300
    assert all(by[1000 + i][0].component_id in (i, 1000 + i) for i in range(300))
    assert all(by[2000 + i][0].n_links == 0 for i in range(300))
    assert all(by[i][0].n_links == 0 and by[i][0].kept for i in (*range(9000, 9006), 9009))
    assert [(r.n_links, r.component_id, r.kept) for r in by[9006] + by[9007] + by[9008]] == [(3, 9006, True), (3, 9006, False), (3, 9006, False), (3, 9006, False)]
    assert neighbours.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_few_dimensions_lose_no_link(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for dim in (1, 2, 3, 5):
        x = rng.normal(size=(60, dim))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = u @ u.T >= 0.93
        np.fill_diagonal(near, False)
        rows += [(100 * dim + i, v.tolist(), 1) for i, v in enumerate(x)]
        want |= {100 * dim + i: int(n) for i, n in enumerate(near.sum(axis=1))}
    rows += [(9, [5.0, 0.0], 2), (9, [0.0, 1.0], 2), (8, [0.0, 2.0], 2)]
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert found[:3] == [(8, 1, 8), (9, 0, 9), (9, 1, 8)]
    assert {i: n for i, n, _ in found[3:]} == want


@pytest.mark.parametrize("n", [20_000, 1_000_000, 10_000_000, 30_000_000])
def test_caps_find_links_among_any_number_of_vectors(n):
    rng, size = np.random.default_rng(n), neighbours.code_size(n)
    x, y = _unit(rng, 200), _unit(rng, 200)
    y -= (y * x).sum(1, keepdims=True) * x
    z = 0.931 * x + np.sqrt(1 - 0.931**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    codes = range(neighbours.codes_needed(64, size, 0.93))
    listed, met = np.zeros(200), np.zeros(200, dtype=bool)
    for (i, f), (_, g) in zip(neighbours.decoded(x, size, codes), neighbours.decoded(z, size, codes), strict=True):
        listed[i] += len(f)
        met[i] |= bool(np.isin(f, g).any())
    assert 0.8 < listed.mean() / len(codes) / neighbours.LISTED < 1.2 and listed.min() > 0
    assert met.mean() >= 0.95
