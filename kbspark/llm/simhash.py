"""Operator 6: near-duplicates by SimHash, with pivot distance tables.

Fingerprints (Arrow, no shuffle) are reduced to distinct ones with their smallest doc_id. Each gets a row of the pivot
table: its Hamming distances to PIVOTS reference fingerprints. If two fingerprints differ in d bits, no coordinate of
their rows differs by more than d, so a pair whose largest coordinate difference exceeds the limit is discarded without
a look at the bits; survivors are verified by XOR and bit count.

Joins of rows that grow with the documents are sort-merge joins by a hint: Spark sizes what comes after an explode by the files
before it, without the rows that the explode adds, and would broadcast all keys of a few hundred thousand fingerprints.

The table is the index too: fingerprints meet in overlapping buckets of a few of its coordinates, in which no two within
the limit part. Distances to random references lie close together, so buckets of all coordinates together would still hold
most fingerprints; a second key splits them and loses no pair: of five blocks of bits two differing bits leave three
untouched, so linked fingerprints agree on one of the ten choices of three blocks (38 bits or more). A key with more than
CROWD fingerprints is split by buckets of further coordinates. What is crowded still goes an exact way whose groups are
bounded: two fingerprints differ in two bits or fewer just when some bit string is within one bit of both, so each is sent
to its 65 such strings, where at most 65 fingerprints meet.

Nulls: null text has no words and fingerprint zero, like any text without words; these link as any other. doc_id may
repeat (each row is returned) or be null (a component of null ids alone has a null component_id). An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components

SHINGLE = 3
DISTANCE = 2
PIVOTS = 24
CROWD = 64
#: Coordinates whose buckets are part of every key, and those that split crowded keys.
INDEX = ((0, 1), (2, 3, 4, 5))
_BLOCK = 65_536


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = iter([b" ".join(words)])
        n = 1
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text").cast(pa.large_binary())
            fp = np.array([fingerprint(x.as_py() or b"", shingle) for x in column], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(distance: int) -> list[int]:
    """Bits that stay the same in some choice of blocks, for two fingerprints within the distance."""
    n = distance + 3
    blocks = [sum(1 << b for b in part) for part in np.array_split(np.arange(64).astype(object), n)]
    return [_signed(sum(kept)) for kept in combinations(blocks, n - distance)]


def references(pivots: int = PIVOTS) -> list[int]:
    return [_signed(xxhash.xxh64_intdigest(f"pivot {i}", 42)) for i in range(pivots)]


def near(a: str, b: str, distance: int, pivots: int) -> Column:
    """Of two aliases with pivot tables: no coordinate differs by more, and then neither do the bits."""
    apart = [F.abs(F.col(f"{a}.p{i}") - F.col(f"{b}.p{i}")) for i in range(pivots)]
    pruned = reduce(lambda x, y: x & y, (d <= distance for d in apart))
    return pruned & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= distance)


def coordinate(i: int) -> Column:
    """Of the pivot table: the fingerprint's distance to reference i."""
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(references(i + 1)[i])))


def buckets(i: int, distance: int) -> Column:
    """Overlapping buckets of coordinate i: coordinates that differ by the distance or less share one."""
    p, width = coordinate(i), 2 * distance + 1
    own = F.floor(p / width).cast("int")
    return F.when(p % width >= width - distance, F.array(own, own + 1)).otherwise(F.array(own))


def _met(rows: DataFrame, label: str) -> DataFrame:
    """rows (key, fp) with n, the number of rows that share the key; keys of one row are left out."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialise(rows.join(sizes.hint("merge"), "key"), label)


def links(distinct: DataFrame, distance: int = DISTANCE, pivots: int = PIVOTS, crowd: int = CROWD) -> DataFrame:
    """distinct (fp) -> (u, v) that join all fingerprints within the distance, directly or through others that are."""
    if distance != 2:
        raise ValueError("the exact way for crowded keys is for a distance of 2")
    blocks = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(_masks(distance))])
    rows, found = distinct.select("fp", F.inline(blocks)).select(F.struct("k", "bits").alias("key"), "fp"), None
    for level, own in enumerate(INDEX):
        for i in own:
            rows = rows.select("key", "fp", F.explode(buckets(i, distance)).alias("bucket")).select(F.struct("key", "bucket").alias("key"), "fp")
        met = _met(rows, f"keys{level}")
        table = met.where(F.col("n") <= crowd).select("key", "fp", *[coordinate(i).cast("tinyint").alias(f"p{i}") for i in range(pivots)])
        a, b = table.alias("a"), table.alias("b")
        same = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
        pairs = a.join(b.hint("merge"), same & near("a", "b", distance, pivots)).select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))
        found = pairs if found is None else found.unionByName(pairs)
        rows = met.where(F.col("n") > crowd).select("key", "fp")
    crowded = rows.select("fp").distinct()
    flips = F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)], F.col("fp"))
    beside = crowded.select("fp", F.explode(flips).alias("between")).groupBy("between").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = beside.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).where("u <> v").select("u", "v")
    return found.unionByName(stars)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of each row."""
    fps = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(ids.hint("merge"), "root").select("fp", "component_id")
    return fps.join(of_fp.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedupe(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns: that of its smallest doc_id; of rows with that doc_id the first by text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = groups(docs).select(F.col("component_id").alias("_kept")).distinct()
    rows = docs.select(row.alias("_row")).join(kept.hint("shuffle_hash"), F.col("_row.doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    first = F.min_by("_row", F.struct("_row.text", F.xxhash64("_row")))
    return rows.groupBy("_row.doc_id").agg(first.alias("_row")).select("_row.*")
