"""Merging entities against union-find on hand-made graphs."""

import random

import pytest

from kbspark.operators import graph
from kbspark.operators.components import components

EDGE = "rel_type string, from_label string, from_id long, to_label string, to_id long"


def ends_of(pairs, known):
    """Union-find over pairs of known nodes; a group ends in its least node that is no source, or its least."""
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    good = [(s, t) for s, t in pairs if s in known and t in known and s != t]
    for s, t in good:
        top[find(s)] = find(t)
    groups = {}
    for x in list(top):
        groups.setdefault(find(x), set()).add(x)
    sources = {s for s, _ in good}
    return {x: min(g - sources, default=min(g)) for g in groups.values() for x in g}


CASES = {"self": [(1, 1)], "chain": [(1, 2), (2, 3)], "long chain": [(i, i + 1) for i in range(1, 30)], "two targets": [(1, 2), (1, 3)], "ring": [(1, 2), (2, 3), (3, 1)], "unknown": [(99, 1), (1, 98)],
         "star": [(i, 1) for i in range(2, 20)], "nothing": []}


@pytest.mark.parametrize("case", [*CASES, "random"])
def test_merge_equals_union_find(spark, case):
    rng = random.Random(5)
    pairs = CASES[case] if case != "random" else [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    known = set(range(50))
    nodes = spark.createDataFrame([("Person", i, f"p{i}") for i in known] + [("Topic", i, f"t{i}") for i in known], "label string, id long, name string")
    made = sorted({("ASSIGNED_TO", "Person", rng.randrange(50), "Person", rng.randrange(50)) for _ in range(80)} | {("TAGGED_WITH", "Person", i % 50, "Topic", i * 7 % 50) for i in range(60)})
    p = spark.createDataFrame([("Person", s, t) for s, t in pairs] * 2 + [("Person", None, 1), ("Person", 1, None)], "label string, source long, target long")
    left, moved = graph.merge_entities(nodes, spark.createDataFrame(made, EDGE), p)
    end = ends_of(pairs, known)
    to = lambda label, i: end.get(i, i) if label == "Person" else i
    got = [tuple(r) for r in moved.collect()]
    assert len(got) == len(set(got)) and set(got) == {(r, a, to(a, i), b, to(b, j)) for r, a, i, b, j in made}
    kept = {(r.label, r.id) for r in left.collect()}
    assert kept == {("Topic", i) for i in known} | {("Person", i) for i in known if end.get(i, i) == i}
    assert {("Person", i) for _, a, i, b, j in got if a == "Person"} <= kept
    out = {(r.source, r.target): (r.outcome, r.root) for r in graph.merge_outcomes(nodes, p).collect()}
    what = lambda s, t: "source_not_found" if s not in known else "target_not_found" if t not in known else "self" if s == t else "merged"
    assert out == {(s, t): (w := what(s, t), end[s] if w == "merged" else None) for s, t in {*pairs, (None, 1), (1, None)}}


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1_000 + i, 1_001 + i) for i in range(200)] + [(None, 3), (5, 5)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            top[hi] = lo
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "node long, other long")).collect()}
    assert got == {x: find(x) for x in top}
