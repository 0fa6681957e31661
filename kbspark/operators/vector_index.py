"""Exact nearest neighbours by cosine over an index of blocks that a search may skip.

Unit vectors are dealt to the nearest of a few centres; a block knows its centre and its radius. On the unit sphere a
query's similarity to a vector falls with their distance, and by the triangle inequality no vector of a block is nearer to
the query than (distance to the centre - radius). A search looks into each query's most promising blocks first; the k-th
score found there is a bound that other blocks have to reach. The rows are those of an exhaustive search, whatever the
data; how many blocks are skipped depends on how they cluster, and plan() tells.

A block is sent once, in parts of PART vectors, and the queries that need it stream past it. Null and empty vectors, whose
similarity is 0, are a block of their own. Centres are vectors of a bounded sample; all vectors are indexed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import shared_folder
from .search import best_of_block
from .sync import top

#: Vectors a centre stands for about, and the most centres (they are sent to all tasks).
PER_CENTRE, CENTRES = 2_048, 4_096
PART = 8_192
#: Queries in a step of a product.
STEP = 256
#: Block of vectors without a direction.
NOWHERE = -1
#: What scores, rounded to nine digits, can be off.
SLACK = 1e-8


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Vectors of a list column as rows, null as empty; shorter ones end in zeros."""
    rows = [np.zeros(0) if x is None else np.array([0.0 if v is None else v for v in x], np.float64) for x in column.to_pylist()]
    out = np.zeros((len(rows), max([width, *map(len, rows)])))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and which have a direction at all."""
    length = np.linalg.norm(vectors, axis=1)
    return np.divide(vectors, length[:, None], out=np.zeros_like(vectors), where=length[:, None] > 0), length > 0


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, max(0, width - a.shape[1]))))


@dataclass(frozen=True)
class Blocks:
    """What tasks know of the index: centres, and of each block its number (a centre's, or NOWHERE), rows, radius and parts."""

    centres: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    parts: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest similarity that each block can have with each query."""
        out = np.zeros((len(queries), len(self.numbers)))
        if len(self.centres):
            width = max(queries.shape[1], self.centres.shape[1])
            q, directed = unit(_wide(queries, width))
            near = np.flatnonzero(self.numbers >= 0)
            cosine = np.clip(q @ _wide(self.centres, width)[self.numbers[near]].T, -1, 1)
            nearest = np.maximum(0, np.sqrt(2 - 2 * cosine) - self.radii[near])
            out[:, near] = np.where(directed[:, None], 1 - nearest**2 / 2, 0)
        return out


@dataclass(frozen=True)
class Index:
    """rows: every vector, as chunk_id, vector, block, part."""

    rows: DataFrame
    blocks: Blocks


def build(chunks: DataFrame, per_centre: int = PER_CENTRE, folder: str | None = None) -> Index:
    """Index chunks (chunk_id, vector) under folder (a new one of the shared folder, if none is given).

    Centres are the vectors of lowest hash; they and a row for each block, CENTRES of both at most, reach the driver.
    """
    n = chunks.select("chunk_id").count()
    sample = chunks.where("size(vector) > 0").orderBy(F.xxhash64("chunk_id", "vector"), "chunk_id").limit(min(CENTRES, max(1, n // per_centre))).select("vector").toArrow()
    centres, directed = unit(matrix(sample.column("vector").combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.float64()))))
    centres = centres[directed]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, has = unit(matrix(b.column("vector"), centres.shape[1]))
            block, away = np.full(b.num_rows, NOWHERE), np.zeros(b.num_rows)
            if len(centres):
                wide = _wide(centres, v.shape[1])
                cosine = v @ wide.T
                block = np.where(has, cosine.argmax(axis=1), NOWHERE)
                away = np.where(has, np.linalg.norm(v - wide[np.maximum(block, 0)], axis=1), 0)
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), b.column("vector"), pa.array(block, pa.int32()), pa.array(away)], names=["chunk_id", "vector", "block", "away"])

    kind = chunks.schema["vector"].dataType.simpleString()
    path, spark = folder or f"{shared_folder(chunks.sparkSession)}/kbspark-index-{uuid.uuid4().hex}", chunks.sparkSession
    schema = f"chunk_id long, vector {kind}, block int, away double"
    # sorted files let a reader pass over the row groups of blocks that nobody looks into
    chunks.select("chunk_id", "vector").mapInArrow(assign, schema).sortWithinPartitions("block").write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    facts = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).orderBy("block").collect()
    sizes = np.array([f.n for f in facts], np.int64)
    parts = np.maximum(1, -(-sizes // PART))
    many = spark.createDataFrame([(f.block, int(p)) for f, p in zip(facts, parts, strict=True)], "block int, parts int")
    rows = rows.join(F.broadcast(many), "block").select("chunk_id", "vector", "block", F.pmod(F.xxhash64("chunk_id"), "parts").cast("int").alias("part"))
    return Index(rows, Blocks(centres, np.array([f.block for f in facts], np.int64), sizes, np.array([f.radius for f in facts]), parts))


def plan(index: Index, queries: DataFrame, k: int, least: DataFrame | None = None) -> DataFrame:
    """query_id, vector, block, part: what a query has to look into. Without least: its most promising blocks, of k vectors
    or more. With least (query_id, score, the k-th found there): all others that could reach it."""
    blocks, again = index.blocks, least is not None
    sizes, parts = blocks.sizes, blocks.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                some = b.slice(at, STEP)
                bound = blocks.bounds(matrix(some.column("vector")))
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1)
                first = np.zeros_like(bound, bool)
                np.put_along_axis(first, order, held - sizes[order] < k, axis=1)
                if again:
                    first = ~first & (bound >= some.column("score").to_numpy(zero_copy_only=False)[:, None] - SLACK)
                q, c = np.nonzero(first)
                q, c = np.repeat(q, parts[c]), np.repeat(c, parts[c])
                part = np.arange(len(c)) - np.searchsorted(q * len(sizes) + c, q * len(sizes) + c)
                yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(q)), some.column("vector").take(pa.array(q)), pa.array(blocks.numbers[c], pa.int32()), pa.array(part, pa.int32())], names=["query_id", "vector", "block", "part"])

    kind = queries.schema["vector"].dataType.simpleString()
    wanted = queries.select("query_id", "vector")
    wanted = wanted if least is None else wanted.join(least.select("query_id", "score"), "query_id")
    return wanted.mapInArrow(run, f"query_id long, vector {kind}, block int, part int")


def _look(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows, a block's own vectors (role 0) and then its queries: the k best of the block for each query."""
        key, own, vectors = None, [], []
        chunks = None
        for b in batches:
            keys = np.stack([b.column("block").to_numpy(), b.column("part").to_numpy(), b.column("role").to_numpy()])
            edges = np.flatnonzero(np.any(np.diff(keys, axis=1), axis=0)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if lo == hi:
                    continue
                some, here = b.slice(lo, hi - lo), tuple(keys[:2, lo])
                if here != key:
                    key, own, vectors, chunks = here, [], [], None
                ids, v = some.column("id").to_numpy(), matrix(some.column("vector"))
                if keys[2, lo] == 0:
                    own.append(ids)
                    vectors.append(v)
                elif own:
                    if chunks is None:
                        width = max(x.shape[1] for x in vectors)
                        ids_of, rows = np.concatenate(own), np.concatenate([_wide(x, width) for x in vectors])
                        order = np.argsort(ids_of, kind="stable")
                        chunks = (ids_of[order], rows[order])
                    yield from best_of_block(chunks, (ids, v), k)

    return run


def _searched(index: Index, plan_: DataFrame, k: int) -> DataFrame:
    kind = plan_.schema["vector"].dataType.simpleString()
    used = index.rows.join(plan_.select("block", "part").distinct(), ["block", "part"], "left_semi")
    rows = used.select("block", "part", F.lit(0).alias("role"), F.col("chunk_id").alias("id"), F.col("vector").cast(kind).alias("vector"))
    rows = rows.unionByName(plan_.select("block", "part", F.lit(1).alias("role"), F.col("query_id").alias("id"), "vector"))
    return rows.repartition("block", "part").sortWithinPartitions("block", "part", "role", "id").mapInArrow(_look(k), "query_id long, chunk_id long, score double")


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: the rows of an exhaustive search. Ids must not be null."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = [F.col("score").desc(), F.col("chunk_id")]
    first = top(_searched(index, plan(index, queries, k), k), ["query_id"], order, k).drop("rank")
    # with fewer than k vectors in all there is nothing else to look into
    least = first.groupBy("query_id").agg(F.min("score").alias("score"))
    more = _searched(index, plan(index, queries, k, least), k)
    return top(first.unionByName(more), ["query_id"], order, k)


def skipped(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, blocks, searched: of how many blocks (parts of them) a search looks into how many."""
    order = [F.col("score").desc(), F.col("chunk_id")]
    first = plan(index, queries, k)
    found = top(_searched(index, first, k), ["query_id"], order, k).groupBy("query_id").agg(F.min("score").alias("score"))
    each = first.unionByName(plan(index, queries, k, found)).groupBy("query_id").agg(F.count(F.lit(1)).alias("searched"))
    return each.select("query_id", F.lit(int(index.blocks.parts.sum())).cast("long").alias("blocks"), "searched")
