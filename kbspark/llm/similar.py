"""Operator 6 on shingles of five words: groups of texts whose sets of shingles have a Jaccard similarity of 0.8 or more.

Such texts differ in about 10 of 64 fingerprint bits, and in up to 20. No buckets of a whole text's pivot table keep so wide
a distance without meeting nearly all pairs. So a set is also cut into small parts, which have fingerprints and pivot
tables of their own; distances to references index the parts and discard pairs, whole sets verify:

1. Rows with the same words (A-Z lower-cased) are one class. Each class has the fingerprint of its distinct shingles.
2. The shingles are put into an order by a hash and cut into ranges, as many for all sets of like sizes. BANDS parts (of
   one order, or of several if a set is small) have fingerprints. Alike sets have most of their shingles in common, so some
   of their parts are the same and so are these parts' rows of the pivot table; classes meet under such rows. Pairs at 0.8
   meet with a chance of 0.999 or more (a test); unlike texts seldom meet.
3. Each key has a hub: its member whose keys have the most members. A text that was copied with changes shares most keys
   with its copies, so it is their hub, and members are compared with hubs alone. Pivot tables and XOR of the whole
   fingerprints discard pairs that differ in more than BITS bits (not for sets under SHORT shingles, whose bits waver);
   the whole sets verify the others. Each class is compared with the hub that it shares most keys with first, then with
   those of keys that still hold several groups. The links found make groups.
4. Members of keys that hold several groups still are compared with the keys' hubs whole, and what each differs in from its
   hub is kept. Texts of different groups that are alike have some of that in common, so they meet under the first few of
   these shingles, rarest first; shingles of one group alone are counted as differences and match nothing (ngram_join.py).

A crowd of near-copies is thus never paired with itself, and texts just under the similarity, which differ from the hub in
ways of their own, are told apart without a comparison.

Nulls: null text is a text without words; all such rows are one class. Fewer words than a shingle: the whole sequence is
the shingle. doc_id may repeat or be null. Of equal classes the smallest doc_id stays, null last, then by text. An empty
table gives an empty result. Extra columns are kept and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise, short_batches, slices, texts
from .components import components
from .grams import shingles
from .ngram_join import Alike, across, added, cut, overlaps
from .simhash import PIVOTS, majority, near, references
from .words import mixed

BITS, SHORT = 24, 32
#: Parts of a set with fingerprints; one shingle to PART ranges of an order at most; the fewest of a part of a set that is not short.
BANDS, PART, FEWEST = 28, 6, 3
#: Classes that are compared with one copy of a hub.
SHARE = 256
ALIKE = Alike(4, 5)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PIVOTS = np.array(references(PIVOTS), np.int64).view(np.uint64)


def ranges_of(level: int) -> tuple[int, int]:
    """Of sets of 2 ** (level - 1) to 2 ** level - 1 shingles: ranges of an order, and the fewest shingles of a part. Short
    sets have more ranges than they may differ in."""
    last = (1 << level) - 1
    return (ALIKE.apart(2 * last) + 1, 1) if last < SHORT else (last // PART, FEWEST)


def part_prints(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and fingerprints of the parts of a set of shingle hashes."""
    ranges, fewest = ranges_of(level)
    numbers, prints = [], []
    for order in range(-(-BANDS // ranges)):
        own = cut(mixed(h ^ mixed(np.array([64 * level + order], np.uint64) * _STEP)), ranges) + order * ranges
        taken = np.flatnonzero(own < BANDS)
        taken = taken[np.argsort(own[taken], kind="stable")]
        if not len(taken):
            continue
        first = np.flatnonzero(np.diff(own[taken], prepend=-1))
        size = np.diff(first, append=len(taken))
        ones = np.add.reduceat(np.unpackbits(h[taken].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), first, axis=0, dtype=np.int64)
        large = size >= fewest
        numbers.append(own[taken][first][large])
        prints.append(np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0][large])
    return (np.concatenate(numbers), np.concatenate(prints)) if numbers else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def part_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a set of shingle hashes: its parts' rows of the pivot table, at its size and at the next if it can have partners
    there; none of a set so small that only equal ones are alike to it."""
    keys = [np.zeros(0, np.uint64)]
    if len(h) >= ALIKE.least():
        own = len(h).bit_length()
        for level in range(own, ALIKE.partner(len(h)).bit_length() + 1):
            numbers, prints = part_prints(h, level)
            distances = np.bitwise_count(prints[:, None] ^ _PIVOTS).astype(np.uint64)
            row = mixed(distances * _STEP + _PIVOTS).sum(axis=1)
            keys.append(mixed(row + mixed(numbers.astype(np.uint64) * _STEP + np.uint64(level))))
    return np.concatenate(keys).view(np.int64)


def same_words() -> Column:
    """16 bytes that are equal for texts with the same words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    spaced = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.unhex(F.md5(F.encode(F.translate(spaced, upper, upper.lower()), "UTF-8")))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        n, fp, keys = [], [], []
        for text in texts(b):
            h = shingles(text)
            n.append(len(h))
            fp.append(majority(h))
            keys.append(part_keys(h))
        columns = [pa.array(n, pa.int64()), pa.array(np.array(fp, np.uint64).astype(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("cid"), *columns], names=["doc_id", "cid", "n", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        own = [shingles(text).tobytes() for text in texts(b)]
        yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(own, pa.binary())], names=["cid", "hashes"])


def alike(common: np.ndarray | int, sizes: np.ndarray | int) -> np.ndarray | bool:
    """Jaccard of 0.8 or more, in whole numbers: common / all >= 4/5; sizes: of both sets together."""
    return 9 * common >= 4 * sizes


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted so that a hub's own (part 0) comes before the texts that meet it: the pairs that are alike."""
    hub = np.zeros(0, np.uint64)
    for b in slices(batches):
        passed = []
        for i, (part, text) in enumerate(zip(b.column("part").to_pylist(), texts(b), strict=True)):
            own = shingles(text)
            if part == 0:
                hub = own
            elif alike(int(np.isin(own, hub, assume_unique=True).sum()), len(own) + len(hub)):
                passed.append(i)
        yield b.select(["u", "v"]).take(pa.array(passed, pa.int64()))


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Links (u, v) of pairs (u, v) of texts and hubs: those whose sets are alike. Each SHARE texts have a copy of their hub."""
    met = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("met"))
    pairs = pairs.join(met, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.ceil(F.col("met") / SHARE)).alias("share"))
    own = pairs.join(known.withColumnRenamed("cid", "u"), "u").select("u", "v", "share", F.lit(1).alias("part"), "text")
    hubs = pairs.select("v", "share").distinct().join(known.withColumnRenamed("cid", "v"), "v").select(F.col("v").alias("u"), "v", "share", F.lit(0).alias("part"), "text")
    rows = own.unionByName(hubs).repartition("v", "share").sortWithinPartitions("v", "share", "part")
    return materialise(rows.mapInArrow(_verify, "u binary, v binary"), "verified")


def _several(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs (key, u, v) -> u, v: texts and the hubs of keys that hold, with their hub, texts of several groups."""
    root_of = lambda c: roots.select(F.col("u").alias(c), F.col("v").alias(f"root_{c}"))
    rooted = pairs.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left")
    keys = rooted.groupBy("key").agg(F.max(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).alias("out")).where("out").select("key")
    return pairs.join(keys, "key", "left_semi").select("u", "v").distinct()


def _outside(met: DataFrame, roots: DataFrame, every: DataFrame, known: DataFrame) -> DataFrame:
    """Links (u, v) between groups (roots) under keys that hold several, hubs apart, whose pairs are known."""
    rooted = met.join(roots.select(F.col("u").alias("cid"), F.col("v").alias("root")), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    groups = rooted.where(F.col("cid") != F.col("hub.cid")).groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    open_ = met.where(F.col("cid") != F.col("hub.cid")).join(groups.select("key"), "key", "left_semi")
    pairs = materialise(open_.select(F.col("cid").alias("u"), F.col("hub.cid").alias("v"), F.col("n").alias("n_u"), F.col("hub.n").alias("n_v"), (-F.col("hub.order")).alias("met")).distinct(), "open")
    wanted = pairs.select(F.col("u").alias("cid")).union(pairs.select("v")).distinct()
    sets = known.join(wanted, "cid", "left_semi").mapInArrow(_sets, "cid binary, hashes binary")
    counted = materialise(overlaps(pairs, sets), "counted")
    found = materialise(added(counted, pairs, ALIKE).unionByName(across(counted, pairs, every, roots, ALIKE)), "more")
    forget(pairs, counted)
    return found


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, least doc_id, ...) of each class, and (cid, root) of each class with a link to another."""
    short_batches(docs.sparkSession)
    texts_of = docs.select("doc_id", same_words().alias("cid"), "text")
    signed = texts_of.mapInArrow(_sign, "doc_id long, cid binary, n long, fp long, keys array<long>")
    every = signed.groupBy("cid").agg(F.min("doc_id").alias("least"), *[F.any_value(c).alias(c) for c in ("n", "fp", "keys")])
    every = materialise(every, "classes")
    # every class has about BANDS of these rows, and few of them meet another: nothing but the key and half of an id travels;
    # two classes with the same half may be taken along, which does no harm
    half = F.xxhash64("cid").alias("half")
    members = every.select(half, F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    keyed = materialise(members.join(sizes, "key"), "keyed")
    nodes = materialise(every.drop("keys").withColumn("half", half).join(keyed.groupBy("half").agg(F.sum("size").alias("centre")), "half"), "nodes")
    rows = keyed.select("key", "half").join(nodes.drop("least"), "half").drop("half")
    hubs = rows.groupBy("key").agg(F.min(F.struct((-F.col("centre")).alias("order"), "cid", "n", "fp")).alias("hub"))
    met = materialise(rows.drop("centre").join(hubs, "key"), "met")
    forget(keyed)

    wanted = nodes.select(F.col("cid").alias("_cid"), F.col("least").alias("_least"))
    mine = (F.col("cid") == F.col("_cid")) & F.col("doc_id").eqNullSafe(F.col("_least"))
    known = materialise(texts_of.join(wanted, mine, "left_semi").groupBy("cid").agg(F.any_value("text").alias("text")), "texts")

    pivoted = lambda prefix: [F.bit_count(F.col(f"{prefix}fp").bitwiseXOR(F.lit(r))).cast("tinyint").alias(f"p{i}") for i, r in enumerate(references(PIVOTS))]
    met_hub = met.where("cid <> hub.cid").select("key", F.struct("cid", "n", "fp", *pivoted("")).alias("a"), F.struct("hub.cid", "hub.n", "hub.fp", *pivoted("hub.")).alias("b"))
    sized = 5 * F.least("a.n", "b.n") >= 4 * F.greatest("a.n", "b.n")
    pairs = met_hub.where(sized & ((F.least("a.n", "b.n") < SHORT) | near("a", "b", BITS, PIVOTS)))
    pairs = materialise(pairs.select("key", F.col("a.cid").alias("u"), F.col("b.cid").alias("v")), "pairs")
    shared = pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"))
    first = materialise(shared.groupBy("u").agg(F.max_by("v", F.struct("shared", "v")).alias("v")), "first")
    roots = components(_verified(first, known), "groups")
    rest = materialise(_several(pairs, roots).join(first, ["u", "v"], "left_anti"), "rest")
    roots = components(roots.unionByName(_verified(rest, known)), "groups")
    more = _outside(met, roots, every, known)
    whole = components(roots.unionByName(more), "groups")
    forget(met, nodes, known, pairs, first, rest, roots, more)
    return every, whole.select(F.col("u").alias("cid"), F.col("v").alias("root"))


def _firsts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, least, root) of each class, and the class of each group with the smallest (doc_id, cid), null ids last."""
    every, linked = classes(docs)
    rooted = every.select("cid", "least").join(linked, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "cid")).alias("first")
    return rooted, rooted.groupBy("root").agg(first).select("root", "first.least", "first.cid")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its group; null if it has none) of each row."""
    rooted, firsts = _firsts(docs)
    ids = rooted.select("cid", "root").join(firsts.select("root", F.col("least").alias("component_id")), "root")
    return docs.select("doc_id", same_words().alias("cid")).join(ids.select("cid", "component_id"), "cid").select("doc_id", "component_id")


def dedupe(docs: DataFrame) -> DataFrame:
    """One row of each group, all columns: of the class with the smallest doc_id, that doc_id's first row by text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = materialise(_firsts(docs)[1].select(F.col("cid").alias("_kept"), F.col("least").alias("_least")), "kept")
    mine = (F.col("_cid") == F.col("_kept")) & F.col("_row.doc_id").eqNullSafe(F.col("_least"))
    rows = docs.select(row.alias("_row"), same_words().alias("_cid")).join(kept.hint("shuffle_hash"), mine, "left_semi")
    first = F.min_by("_row", F.struct("_row.text", F.xxhash64("_row")))
    return rows.groupBy("_cid", "_row.doc_id").agg(first.alias("_row")).select("_row.*")
