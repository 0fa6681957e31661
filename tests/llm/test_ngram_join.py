"""Operator 11 against all pairs."""

import random
import re

import numpy as np
import pytest

from kbspark.llm import ngram_join
from kbspark.llm.grams import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, cid string, n long, u long"


def gram_set(text, size=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def wanted(rows, num=90, den=100, size=3):
    sets = [gram_set(r[1], size) for r in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)):
                common = len(a & b)
                if den * common >= num * (len(a) + len(b) - common):
                    top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def rows():
    rng = random.Random(11)
    base = lambda n: [f"w{rng.randrange(3_000)}" for _ in range(n)]
    texts = []
    crowd = base(160)
    texts += [" ".join(changed(rng, crowd, k)) for k in [1] * 30 + [2] * 60 + [3] * 40 + [5] * 20]  # all but alike, some to no hub
    for _ in range(60):
        own = base(rng.randrange(3, 90))
        texts += [" ".join(own), " ".join(changed(rng, own, 1)), " ".join(own[:-1]), " ".join([*own, "more"])]
    other = base(120)
    texts += [" ".join(changed(rng, other[: 120 - rng.randrange(15)], rng.randrange(3))) for _ in range(60)]
    long = base(4_000)
    texts += [" ".join(changed(rng, long, k)) for k in (0, 10, 60, 66, 67, 80, 300)]
    few = ["a b c", "A b  c", "a b", "A\tB", "a", "a b c d", " ", "", None, None, "x\x85y z", "é É é", "É é é", "a b a b a b a b a b a b", "b a b a b a"]
    texts += few + texts[:5] + [t.upper() for t in texts[5:8]] + [" ".join(base(12)) for _ in range(40)]
    order = rng.sample(range(len(texts)), len(texts))
    out = [(i, texts[k], "c", 1, 1) for i, k in enumerate(order)]
    return [*out, out[3], (None, texts[0], None, None, None), (None, "all alone here", None, None, None)]


key = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("num,den,size", [(9, 10, 3), (4, 5, 5)])
def test_op11_equals_all_pairs(spark, num, den, size):
    got = ngram_join.groups(spark.createDataFrame(rows(), SCHEMA).repartition(4), size, ngram_join.Alike(num, den))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(wanted(rows(), num, den, size), key=key)


def test_op11_empty(spark):
    assert ngram_join.query(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = ngram_join.query(spark.createDataFrame([(4, None, "", 0, 0), (3, " ", "", 0, 0), (None, "", "", 0, 0)], SCHEMA)).collect()
    assert sorted(map(tuple, blank), key=key) == sorted([(4, 0, 4), (3, 0, 3), (None, 0, None)], key=key)


@pytest.mark.parametrize("num,den", [(9, 10), (4, 5), (1, 2)])
def test_op11_alike_sets_share_a_key(num, den):
    rng, alike = np.random.default_rng(num), ngram_join.Alike(num, den)
    for _ in range(1_500):
        n = int(rng.integers(1, 60)) if rng.random() < 0.7 else int(rng.integers(60, 3_000))
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1))
        m = int(rng.integers(max(1, -(-len(a) * num // den)), alike.partner(len(a)) + 1))
        apart = alike.apart(len(a) + m)
        lost = min(len(a) - 1, max(0, (apart + len(a) - m) // 2))
        b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 1 << 63, max(0, m - len(a) + lost), np.uint64)]))
        common = len(np.intersect1d(a, b))
        if den * common >= num * (len(a) + len(b) - common) and len(np.setxor1d(a, b)):
            assert np.isin(ngram_join.segment_keys(a, alike), ngram_join.segment_keys(b, alike)).any()


def test_op11_sizes_of_classes():
    for alike in (ngram_join.Alike(9, 10), ngram_join.Alike(4, 5)):
        for n in range(alike.least(), 500):
            number, first, last = ngram_join.level_of(n, alike)
            assert first <= n <= last and ngram_join.level_of(alike.partner(n), alike)[0] - number <= 1


def crowd(n, changes, seed=7):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    return [(i, " ".join(changed(rng, base, changes)), "", 0, 0) for i in range(n)]


@pytest.mark.parametrize("changes", [1, 3])
def test_op11_work_is_linear_in_a_crowd(spark, changes, monkeypatch):
    made = []
    for n in (150, 300):
        counts = {}
        inner = ngram_join.materialise
        monkeypatch.setattr(ngram_join, "materialise", lambda df, label, inner=inner, counts=counts: [t := inner(df, label), counts.__setitem__(label, t.count())][0])
        got = ngram_join.groups(spark.createDataFrame(crowd(n, changes), SCHEMA))
        n_groups = got.select("component_id").distinct().count()
        monkeypatch.setattr(ngram_join, "materialise", inner)
        assert n_groups == (1 if changes == 1 else len({c for _, _, c in wanted(crowd(n, changes))}))
        made.append(sum(counts.values()))
    assert made[1] < 2.3 * made[0]


def test_grams_are_folded_and_whole():
    assert np.array_equal(shingles(b"A b\tC", 3), shingles(b"a B c", 3)) and len(shingles(b"a b", 3)) == 1 and not len(shingles(b" \n", 3))


def test_keys_are_those_that_partners_need():
    """A set gives no more keys of a class of sizes than one and the spare ones beyond what it may differ in from its largest partner there."""
    alike, rng, fewer = ngram_join.Alike(), np.random.default_rng(5), 0
    for n in (9, 40, 200, 301, 700, 2_000):
        number, _, last = ngram_join.level_of(n, alike)
        sizes = [last, *([ngram_join.last_of(last + 1, alike)] if alike.partner(n) > last else [])]
        most = [alike.apart(n + min(m, alike.partner(n))) + 1 + ngram_join.fragments_of(alike.apart(2 * m))[1] for m in sizes]
        keys = ngram_join.segment_keys(np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)), alike)
        assert len(keys) <= sum(most) + len(most)  # and one for sets with many empty segments
        fewer += sum(ngram_join.fragments_of(alike.apart(2 * m))[0] for m in sizes) > sum(most)
    assert fewer >= 3


def test_keys_meet_at_all_sizes():
    """Sets that differ in as much as alike ones may have a key in common, at and over the edges of classes of sizes."""
    alike, rng = ngram_join.Alike(), np.random.default_rng(6)
    for a in (9, 10, 30, 99, 180, 250, 313, 390, 800):
        for b in {a, (a + alike.partner(a)) // 2, alike.partner(a)}:
            common = -(-alike.num * (a + b) // (alike.den + alike.num))
            for _ in range(20):
                h = rng.permutation(rng.integers(0, 1 << 63, a + b - common, np.uint64) * np.uint64(2))
                x, y = np.sort(h[:a]), np.sort(np.concatenate([h[:common], h[a:]]))
                assert len(x) == a and len(y) == b
                assert np.isin(ngram_join.segment_keys(x, alike), ngram_join.segment_keys(y, alike)).any(), (a, b)
