"""Operator 11: texts whose sets of word n-grams are alike (Jaccard), by vertical partitioning of the n-gram order.

The global order of n-grams is that of their 64-bit hashes; a fragment is a range of it, and a set's segment is what it has
in a fragment. Texts with equal sets are one class. With c = (1 - t) / (1 + t), sets of sizes a and b are alike just when
they differ in c * (a + b) elements or fewer. So:

1. Meeting. Sets of like sizes are cut into one fragment more than they may differ in, so alike sets have an equal segment;
   classes meet under their segments. A set gives the first of them alone, one more than it may differ in from its largest
   partner there: two sets differ in no more than that, so they have an equal one among those that both give. Spare fragments
   make up for empty segments; a set with more empty ones than these meets the others of its kind under a key of their own.
   No alike pair is lost, and unlike texts seldom meet.
2. Counting. Each class is compared with the hubs of its keys alone (a key's hub is its class with the most meetings). Both
   sets are cut into fragments of about FRAGMENT n-grams; the overlaps of each are counted in separate tasks and added up
   for each pair. What the segments differ in is kept: the class as seen from the hub, a small set if they are near.
3. Crowds. Alike to one hub means one group, so a crowd of near-copies is never paired with itself. What is left are pairs
   under one hub, of keys with several groups beside it. If x or y is not alike to the hub but x and y are, what they
   differ from it in has something in common (else their sizes would not fit), so they share one of the first few elements
   of these small sets, rarest under the hub first. Elements that only one group has match nothing and count as differences
   from the start. So copies that differ from a hub in ways of their own are told apart without a comparison.

Links are exact but for hash collisions. Groups are connected components of links.

Nulls: null text is a text without words, whose set is empty; it is linked with nothing. Fewer words than an n-gram: the
whole sequence is the n-gram. doc_id may repeat (each row is returned) or be null (a group of null ids alone has a null
component_id). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialise, short_batches, slices, texts
from .components import components
from .grams import shingles
from .words import mixed

SHINGLE = 3
#: n-grams of a fragment in which overlaps are counted; classes that are compared with one copy of a hub.
FRAGMENT, SHARE = 512, 256
#: Slots of the broadcast filter of texts that meet others (4 bytes each).
SLOTS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(32)


@dataclass(frozen=True)
class Alike:
    """Jaccard of num / den or more."""

    num: int = 9
    den: int = 10

    def partner(self, n: int | Column) -> int | Column:
        """The largest size of a set that can be alike to one of n."""
        return F.floor(n * self.den / self.num).cast("long") if isinstance(n, Column) else n * self.den // self.num

    def apart(self, sizes: int | Column) -> int | Column:
        """How many elements two alike sets of so many together may differ in."""
        both = self.den + self.num
        return F.floor(sizes * (self.den - self.num) / both).cast("long") if isinstance(sizes, Column) else sizes * (self.den - self.num) // both

    def least(self) -> int:
        """The smallest size of a set to which an unequal one can be alike."""
        return -(-self.num // (self.den - self.num))


def last_of(first: int, alike: Alike) -> int:
    """Where a class of sizes ends: a quarter beyond its first, or at that one's largest partner, so partners are at most a class apart."""
    return max(first * 5 // 4, alike.partner(first))


def level_of(n: int, alike: Alike) -> tuple[int, int, int]:
    """The class of sizes that n is in: its number, first and last size."""
    number, first = 0, alike.least()
    while (last := last_of(first, alike)) < n:
        number, first = number + 1, last + 1
    return number, first, last


def cut(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of each hash: equal ranges of the order."""
    return (((hashes >> _LOW) * np.uint64(fragments)) >> _LOW).astype(np.int64)


def fragments_of(apart: int) -> tuple[int, int]:
    """Number of fragments for sets that differ in so many elements, and how many of them are spare."""
    spare = 0 if apart < 7 else 1 + apart // 64
    return apart + 1 + spare, spare


def segment_keys(hashes: np.ndarray, alike: Alike) -> np.ndarray:
    """Keys of a set: its first non-empty segments at its class of sizes, and at the next if it can have partners there."""
    n = len(hashes)
    if n < alike.least():
        return np.zeros(0, np.int64)
    number, _, last = level_of(n, alike)
    keys = []
    for level, most in ((number, last), (number + 1, last_of(last + 1, alike))):
        if level > number and alike.partner(n) <= last:
            continue
        fragments, spare = fragments_of(alike.apart(2 * most))
        given = alike.apart(n + min(most, alike.partner(n))) + fragments - alike.apart(2 * most)
        own = cut(hashes, fragments)
        own = own[: np.searchsorted(own, given)]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        salt = mixed(np.array([2 * level + 1], np.uint64) * _STEP)
        if len(first):
            value = np.add.reduceat(mixed(hashes[: len(own)] ^ salt), first)
            keys.append(mixed(mixed(value + salt) + own[first].astype(np.uint64) * _STEP))
        if given - len(first) > spare:
            keys.append(mixed(salt + np.uint64(1)))
    return np.concatenate(keys).view(np.int64)


def set_id(hashes: np.ndarray) -> bytes:
    return hashlib.md5(hashes.tobytes()).digest()


def _sign(shingle: int, alike: Alike):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of equal sets of a task one has keys, so a group of copies is nearly one before anything is shuffled
        for b in slices(batches):
            sets = [shingles(text, shingle) for text in texts(b)]
            ids, keys = list(map(set_id, sets)), []
            for own, h in zip(ids, sets, strict=True):
                keys.append(None if own in seen else segment_keys(h, alike))
                seen.add(own)
            columns = [pa.array(ids, pa.binary()), pa.array([len(h) for h in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("at").cast(pa.int64()), *columns], names=["doc_id", "at", "cid", "n", "keys"])

    return run


def _known(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(text, shingle) for text in texts(b)]
            yield pa.RecordBatch.from_arrays([pa.array([f(h) for h in sets], pa.binary()) for f in (set_id, np.ndarray.tobytes)], names=["cid", "hashes"])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, share, part, parts, hashes) -> a row for each of the hub's fragments, empty segments too."""
    for b in slices(batches, 64):
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            hashes, parts = np.frombuffer(row.column("hashes")[0].as_py(), np.uint64), row.column("parts")[0].as_py()
            edges = np.searchsorted(cut(hashes, parts), np.arange(parts + 1))
            own = [hashes[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:], strict=False)]
            again = [pa.array(row.column(c).to_pylist() * parts, row.column(c).type) for c in ("u", "v", "share", "part")]
            yield pa.RecordBatch.from_arrays([*again, pa.array(range(parts), pa.int32()), pa.array(own, pa.binary())], names=["u", "v", "share", "part", "fragment", "hashes"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted so that a hub's own (part 0) comes before those that it is compared with: overlap and difference."""
    hub = np.zeros(0, np.uint64)
    for b in slices(batches):
        u, v, common, apart = [], [], [], []
        for one, other, part, raw in zip(*(b.column(c).to_pylist() for c in ("u", "v", "part", "hashes")), strict=True):
            own = np.frombuffer(raw, np.uint64)
            if part == 0:
                hub = own
                continue
            different = np.setxor1d(own, hub, assume_unique=True)
            u.append(one)
            v.append(other)
            common.append((len(own) + len(hub) - len(different)) // 2)
            apart.append(different.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(common, pa.int64()), pa.array(apart, pa.list_(pa.int64()))], names=["u", "v", "common", "apart"])


def overlaps(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs (u, v, n_v, met) of classes and hubs, known (cid, hashes) -> for each pair and fragment u, v, common (n-grams of
    both) and apart (n-grams of one). met: at how many classes at least the hub is met, which sets its number of copies."""
    parts = F.ceil(F.col("n_v") / FRAGMENT).cast("int").alias("parts")
    shared = pairs.select("u", "v", F.pmod(F.xxhash64("u"), F.ceil(F.col("met") / SHARE)).alias("share"), parts)
    own = shared.join(known.withColumnRenamed("cid", "u"), "u").select("u", "v", "share", F.lit(1).alias("part"), "parts", "hashes")
    hubs = shared.select("v", "share", "parts").distinct().join(known.withColumnRenamed("cid", "v"), "v")
    rows = own.unionByName(hubs.select(F.col("v").alias("u"), "v", "share", F.lit(0).alias("part"), "parts", "hashes"))
    cuts = rows.mapInArrow(_segments, "u binary, v binary, share long, part int, fragment int, hashes binary")
    ordered = cuts.repartition("v", "share", "fragment").sortWithinPartitions("v", "share", "fragment", "part")
    return ordered.mapInArrow(_count, "u binary, v binary, common long, apart array<long>")


def added(counted: DataFrame, pairs: DataFrame, alike: Alike) -> DataFrame:
    """Overlaps of fragments added up for each pair: pairs (u, v, n_u, n_v) that are alike."""
    common = counted.groupBy("u", "v").agg(F.sum("common").alias("common"))
    near = alike.den * F.col("common") >= alike.num * (F.col("n_u") + F.col("n_v") - F.col("common"))
    return common.join(pairs.select("u", "v", "n_u", "n_v"), ["u", "v"]).where(near).select("u", "v")


def across(counted: DataFrame, open_: DataFrame, sizes: DataFrame, roots: DataFrame, alike: Alike) -> DataFrame:
    """Links (u, v) between groups (roots: u, v) among classes that met one hub, of pairs open_ (u, v). sizes: cid and n of the classes."""
    root_of = lambda c: roots.select(F.col("u").alias(c), F.col("v").alias(f"root_{c}"))
    # numbers of elements travel without the elements
    open_ = open_.select("u", "v")
    whole = counted.select("u", "v", F.size("apart").alias("d")).groupBy("u", "v").agg(F.sum("d").alias("d")).join(open_, ["u", "v"], "left_semi")
    rooted = whole.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left").join(sizes.select(F.col("cid").alias("u"), "n"), "u")
    rooted = rooted.select("u", "v", "n", "d", F.coalesce("root_u", "u").alias("root"), (F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).alias("out"))
    # hubs under which no other group was met are done, and so are those with one class in all
    hubs = rooted.groupBy("v").agg(F.count(F.lit(1)).alias("n_met"), F.count(F.when(F.col("out"), 1)).alias("n_out")).where("n_out > 0 and n_met > 1").select("v")
    seen = materialise(rooted.join(hubs, "v"), "seen")
    elements = counted.join(hubs, "v", "left_semi").select("u", "v", F.explode("apart").alias("element")).join(seen.select("u", "v", "root", "out"), ["u", "v"])
    matched = elements.groupBy("v", "element").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("out").alias("any_out")).where("low <> high and any_out")
    useful = elements.select("u", "v", "element").join(matched.select("v", "element", "df"), ["v", "element"])
    small = useful.groupBy("u", "v").agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("useful"))
    joint = materialise(seen.join(small, ["u", "v"]).withColumns({"m": F.size("useful"), "first": F.least("d", alike.apart(F.col("n") + alike.partner(F.col("n"))) + 1) - (F.col("d") - F.size("useful"))}), "joint")
    index = joint.where("first > 0").select("u", "v", "n", "d", "m", "root", "out", F.explode(F.slice("useful", F.lit(1), F.least(F.col("first"), F.col("m")).cast("int"))).alias("e")).withColumn("e", F.col("e.element"))
    a, b = index.where("out").alias("a"), index.alias("b")
    both = lambda c: F.col(f"a.{c}") + F.col(f"b.{c}")
    fits = (both("d") - 2 * F.least("a.m", "b.m") <= alike.apart(both("n"))) & (F.greatest("a.n", "b.n") <= alike.partner(F.least("a.n", "b.n")))
    new = (F.col("a.root") != F.col("b.root")) & (~F.col("b.out") | (F.col("a.u") < F.col("b.u")))
    met = a.join(b, (F.col("a.v") == F.col("b.v")) & (F.col("a.e") == F.col("b.e")) & new & fits).select(F.col("a.u").alias("x"), F.col("b.u").alias("y"), F.col("a.v").alias("v")).distinct()
    side = lambda c: joint.select(F.col("u").alias(c), "v", F.struct("n", "d", F.transform("useful", lambda e: e.element).alias("own")).alias(f"as_{c}"))
    checked = met.join(side("x"), ["x", "v"]).join(side("y"), ["y", "v"])
    apart = F.col("as_x.d") + F.col("as_y.d") - 2 * F.size(F.array_intersect("as_x.own", "as_y.own"))
    links = materialise(checked.where(apart <= alike.apart(F.col("as_x.n") + F.col("as_y.n"))).select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "across")
    forget(seen, joint)
    return links


def meetings(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """signed (cid, keys; equal sets have them at least once), classes (cid, n) -> key, u, v, n_u, n_v, met: each class with the
    hub of each key that it shares, and at how many classes the hub is met at least."""
    # rows of all keys carry half of an id; two classes with the same half may be taken along, which does no harm
    half = F.xxhash64("cid").alias("half")
    members = signed.where("keys is not null").select(F.explode("keys").alias("key"), half)
    own = Window.partitionBy("key")  # rows travel once; a count beside them would send as many again
    shared = members.withColumns({"least": F.min("half").over(own), "most": F.max("half").over(own)}).where("least <> most").select("key", "half").distinct()
    shared = materialise(shared.join(classes.select("cid", "n", half), "half").select("key", "cid", "n"), "shared")
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    keyed = materialise(shared.join(sizes, "key"), "keyed")
    centres = keyed.groupBy("cid").agg(F.sum("size").alias("centre"))
    hubs = keyed.join(centres, "cid").groupBy("key").agg(F.min(F.struct((-F.col("centre")).alias("order"), "cid", "n")).alias("hub"))
    met = keyed.join(hubs, "key").where("cid <> hub.cid")
    met = materialise(met.select("key", F.col("cid").alias("u"), F.col("hub.cid").alias("v"), F.col("n").alias("n_u"), F.col("hub.n").alias("n_v"), (-F.col("hub.order")).alias("met")), "met")
    forget(shared, keyed)
    return met


def unsettled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """u, v: classes beside the hub of a key under which two of different groups met. Alike classes that are not of one group have such a key."""
    rooted = met.join(roots.select("u", F.col("v").alias("root")), "u", "left").select("key", "u", "v", F.coalesce("root", "u").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    return rooted.join(several.select("key"), "key", "left_semi").select("u", "v").distinct()


def groups(docs: DataFrame, shingle: int = SHINGLE, alike: Alike | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    alike = alike or Alike()
    short_batches(docs.sparkSession)
    own = docs.select("doc_id", F.xxhash64("text").alias("at"), "text")
    signed = materialise(own.mapInArrow(_sign(shingle, alike), "doc_id long, at long, cid binary, n long, keys array<long>"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("first")
    classes = materialise(signed.where("n > 0").groupBy("cid").agg(first, F.any_value("n").alias("n")), "sets")
    met = meetings(signed, classes)
    rows = materialise(signed.drop("at", "keys"), "rows")
    forget(signed)
    pairs = materialise(met.drop("key").distinct(), "pairs")
    nodes = pairs.select(F.col("u").alias("cid")).union(pairs.select("v")).distinct()
    wanted = classes.join(nodes, "cid").select(F.col("first.doc_id").alias("_id"), F.col("first.at").alias("_at"))
    mine = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("at") == F.col("_at"))
    # a broadcast set of SLOTS slots at most keeps most texts that no one asks for from being shuffled
    slot = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(SLOTS)).cast("int").alias("_slot")
    asked = own.select("*", slot("doc_id", "at")).join(F.broadcast(wanted.select(slot("_id", "_at")).distinct()), "_slot", "left_semi")
    known = asked.join(wanted.hint("merge"), mine, "left_semi").select("text").mapInArrow(_known(shingle), "cid binary, hashes binary")
    known = materialise(known.groupBy("cid").agg(F.any_value("hashes").alias("hashes")), "hashes")
    counted = materialise(overlaps(pairs, known), "overlaps")
    forget(known)
    roots = components(added(counted, pairs, alike), "groups")
    open_ = materialise(unsettled(met, roots), "open")
    forget(met)
    more = across(counted, open_, classes, roots, alike)
    forget(counted, pairs, open_)
    whole = components(roots.unionByName(more), "groups")
    rooted = classes.select("cid", "first.doc_id").join(whole.select(F.col("u").alias("cid"), F.col("v").alias("root")), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("cid", "component_id")
    result = rows.join(ids, "cid", "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    return groups(docs)
