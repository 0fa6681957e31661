"""Names with a long common prefix, suggestions under hot prefixes, and sentence packs, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kbspark.operators import chunking, resolution, search


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("crowd", [3, 256])
def test_ambiguous_names_with_a_common_prefix(spark, crowd, monkeypatch):
    monkeypatch.setattr(resolution, "CROWD", crowd)
    rng = random.Random(2)
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz")
    right = ["the common prefix of " + "".join(letter() for _ in range(12)) for _ in range(60)] + ["the com" + letter() for _ in range(12)] + ["".join(letter() for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    left = []
    for name in right:
        w = list(name)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = [letter()] if rng.random() < 0.7 else []
        left.append("".join(w))
    a, b = (spark.createDataFrame([("t", x) for x in side] + [(None, "x"), ("t", None)], "type string, name string") for side in (left, right))
    for most in (3, 5):
        got = {(r.a_name, r.b_name): r.distance for r in resolution.fuzzy_join(a, b, most, 1).collect()}
        want = {(x, y): d for x in set(left) for y in set(right) if abs(len(x) - len(y)) <= most and 1 <= (d := edits(x, y)) <= most}
        assert got == want


def test_no_key_of_rare_pairs_is_crowded(spark):
    rng = random.Random(3)
    names = spark.createDataFrame([("t", "customer of the north " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14))) for _ in range(3_000)], "type string, name string")
    keys = resolution._rare_pairs(names, names, 11)[0].groupBy("gram", "nth").count()
    assert keys.agg(F.max("count")).first()[0] <= resolution.CROWD


def test_suggest_equals_brute_force(spark):
    rng = random.Random(4)
    names = [(rng.choice(["Person", "Topic"]), rng.choice(["An", "ann", "Bo", "É"]) + rng.choice(["", "a", "B", "ß"]) + str(rng.randrange(40))) for _ in range(500)] + [("Person", None), ("Topic", "")]
    asked = ["a", "AN", "ann", "É", "é", "", "bo1", "nobody", None, "a"]
    got = {}
    for r in search.suggest(spark.createDataFrame([(x,) for x in asked], "prefix string"), spark.createDataFrame(names, "label string, name string"), 5).collect():
        got.setdefault(r.prefix, {})[r["rank"]] = r.name
    want = {}
    for p in {x for x in asked if x is not None}:
        each = [sorted({n for label, n in names if label == kind and n is not None and n.lower().startswith(p.lower())}, key=str.encode)[:5] for kind in ("Person", "Topic")]
        if first := sorted({n for e in each for n in e}, key=str.encode)[:5]:
            want[p] = dict(enumerate(first, 1))
    assert got == want


def plain_sentences(text, size, overlap):
    out, pack = [], []
    for s in [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x]:
        w = s.split()
        for piece in [" ".join(w[i : i + size]) for i in range(0, len(w), size)] if len(w) > size else [s]:
            count = lambda: sum(len(x.split()) for x in pack)  # noqa: B023, E731
            if pack and count() + len(piece.split()) > size:
                out.append(" ".join(pack))
                while pack and (count() > overlap or count() + len(piece.split()) > size):
                    pack.pop(0)
            pack.append(piece)
    return [*out, " ".join(pack)] if pack else out


def test_sentence_packs():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bb", " ", " ", ". ", "! ", "?", "\n"]) for _ in range(rng.randrange(120)))
        for size, overlap in ((5, 2), (3, 0), (8, 7), (1, 0)):
            assert chunking.sentences(text, size, overlap) == plain_sentences(text, size, overlap)
    assert len(chunking.sentences("One. " * 200_000, 512, 50)) > 400
