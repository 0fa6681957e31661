"""The vector index and mentions of names against exhaustive search."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.operators import mentions, search, vector_index


def vectors(rng, n, centres, spread):
    middle = rng.normal(size=(centres, 8))
    rows = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, 8))
    return [(i, r.astype(np.float32).tolist()) for i, r in enumerate(rows)]


@pytest.mark.parametrize("spread,part", [(0.05, 8_192), (0.05, 30), (5.0, 8_192)])
def test_index_equals_exhaustive_search(spark, spread, part, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", part)
    rng = np.random.default_rng(3)
    rows = vectors(rng, 700, 12, spread) + [(1000 + i, [1.0] * 8) for i in range(80)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, 2.0])]
    c = spark.createDataFrame(rows, "chunk_id long, vector array<float>")
    asked = [*vectors(np.random.default_rng(3), 700, 12, spread)[::20], (5_000, [1.0] * 8), (5_001, []), (5_002, None), (5_003, [3.0, 1.0])]
    q = spark.createDataFrame(asked, "query_id long, vector array<float>")
    index = vector_index.build(c, 40)
    assert len(index.blocks.centres) > 10 and index.blocks.sizes.sum() == len(rows)
    got = sorted(map(tuple, vector_index.search(index, q, 7).collect()))
    assert got == sorted(map(tuple, search.cosine_topk_blocks(c, q, 7).collect()))
    told = vector_index.skipped(index, q, 7).agg(F.sum("blocks"), F.sum("searched")).first()
    assert told[1] <= told[0] and (spread > 1 or told[1] < 0.7 * told[0])


def test_index_of_few_or_no_vectors(spark):
    none = spark.createDataFrame([], "chunk_id long, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert vector_index.search(vector_index.build(none), q, 3).count() == 0
    few = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "chunk_id long, vector array<float>")
    assert [(r.chunk_id, r.rank) for r in vector_index.search(vector_index.build(few), q, 5).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    with pytest.raises(ValueError):
        vector_index.search(vector_index.build(few), q, 0)


def plain_mentions(docs, names):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    index = [(i, n, words(n)) for i, n in set(names) if i is not None and words(n)]
    for d, text in docs:
        if d is None or text is None:
            continue
        w = words(text)
        spans = {(at, len(g)) for _, _, g in index for at in range(len(w)) if w[at : at + len(g)] == g}
        for at, n in spans:
            if not any(a <= at and a + m >= at + n and m > n for a, m in spans):
                out += [(d, at, n, i, name) for i, name, g in index if g == w[at : at + n]]
    return sorted(out)


@pytest.mark.parametrize("slots", [1 << 18, 2])
def test_mentions_equal_brute_force(spark, slots, monkeypatch):
    monkeypatch.setattr(mentions, "SLOTS", slots)
    rng = random.Random(4)
    some = ["Ann", "Ann Lee", "ann lee", "Lee", "Bo", "Bo-Ann", "José Ño", "Ann Lee Bo Ann", "x9", "lee ann"]
    names = [(i, n) for i, n in enumerate(some)] + [(40, "Ann"), (None, "Bo"), (41, ""), (42, None), (0, "Annie")]
    words = ["Ann", "LEE", "bo", "ann,", "Lee.", "josé", "ñO", "and", "X9", "x9y", "Annie"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(120)] + [(500, None), (None, "Ann"), (501, ""), (502, "Ann " * 2_000)]
    got = mentions.mentions(spark.createDataFrame(docs, "id long, content string"), spark.createDataFrame(names, "id long, name string"))
    assert sorted(map(tuple, got.collect())) == plain_mentions(docs, names)
    none = spark.createDataFrame([], "id long, name string")
    assert mentions.mention_edges(spark.createDataFrame(docs, "id long, content string"), none).count() == 0


def test_hot_name_is_split(spark):
    docs = spark.range(3_000).select("id", F.lit("told by Ann").alias("content"))
    found = mentions.mentions(docs, spark.createDataFrame([(1, "Ann")], "id long, name string"))
    assert found.count() == 3_000
    salts = docs.groupBy(F.pmod(F.xxhash64("id"), F.lit(mentions.SALTS))).count().agg(F.max("count"), F.min("count")).first()
    assert salts[0] < 1.5 * 3_000 / mentions.SALTS and salts[1] > 0


def test_sieve_of_a_large_dictionary(spark):
    """Every value of a dictionary passes, and of others few, however many names it has."""
    names = spark.range(300_000).select(F.concat(F.lit("ann "), F.col("id").cast("string")).alias("value"))
    n = mentions.buckets_for(300_000)
    filled = mentions.sieve(names, n)
    assert filled.count() <= n and mentions.buckets_for(10**12) * 64 * mentions.LONGS == mentions.SLOTS
    passed = lambda rows: mentions.sieved(rows, F.col("value"), filled, n).count()
    assert passed(names) == 300_000
    assert passed(names.select(F.concat("value", F.lit("x")).alias("value"))) < 6_000


@pytest.mark.parametrize("hot", [1 << 16, 2])
def test_edges_of_common_names_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(mentions, "HOT", hot)
    rng = random.Random(6)
    names = [(i, f"Ann {i % 7}") for i in range(60)] + [(i, f"ann {i % 7} Lee") for i in range(30)] + [(3, "ANN 3"), (4, "Lee")]
    docs = [(i % 150, " ".join(rng.choice(["Ann", "3", "4", "lee", "Lee!", "x"]) for _ in range(12))) for i in range(151)]
    docs[150] = docs[0]  # a row that comes twice
    want = {}
    for d, at, _, i, name in plain_mentions(docs[:150], names):
        want.setdefault((i, d), []).append((name, at))
    want = sorted((i, d, min(x for x, _ in v), len({at for _, at in v})) for (i, d), v in want.items())
    got = mentions.mention_edges(spark.createDataFrame(docs, "id long, content string"), spark.createDataFrame(names, "id long, name string"))
    assert sorted((r.from_id, r.to_id, r.context, r.n) for r in got.collect()) == want and len(want) > 500
    assert dict(got.dtypes)["n"] == "bigint"
