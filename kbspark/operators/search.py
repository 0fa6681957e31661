"""Hybrid retrieval for many queries at once: vector top-k, graph boost, recency, re-rank, facets, suggestions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dot
from .sync import top

#: Weights and cuts of the ranking.
WEIGHTS = (0.6, 0.3, 0.1)
MAX_CONNECTIONS = 5
OVERFETCH = 2
EXCERPT = 200
TAGGED, RELATED = "tagged in document ", "document relationship"
#: Queries and chunks in a block of the matrix form.
QUERY_BLOCK = 1024
CHUNK_BLOCK = 8192
SQL_BLOCK = 64


def filter_chunks(chunks: DataFrame, source_types: list[str] | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Inclusive bounds on created_at; an inverted range is an error. Filters reach the scan."""
    if date_from and date_to and date_from > date_to:
        raise ValueError("date_from is after date_to")
    if source_types:
        chunks = chunks.where(F.col("source_type").isin(*source_types))
    if date_from:
        chunks = chunks.where(F.col("created_at") >= F.lit(date_from).cast("timestamp"))
    return chunks.where(F.col("created_at") <= F.lit(date_to).cast("timestamp")) if date_to else chunks


def cosine_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: exact top k of each query, in DataFrame functions alone.

    Queries are packed into blocks that meet each part of the chunks by its number; nothing is broadcast or crossed.
    Norms are taken once a row. Only the two row counts reach the driver. A null or empty vector has a score of 0.
    A row is made for each pair, so this is the form for some ten million pairs; cosine_topk_blocks() gives the same rows.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    parts = max(1, -(-chunks.select("chunk_id").count() // CHUNK_BLOCK))
    blocks = max(1, -(-queries.select("query_id").count() // SQL_BLOCK))
    norm = F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("norm")
    c = chunks.select("chunk_id", "vector", norm, F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"))
    q = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct("query_id", F.col("vector").alias("_q"), norm.alias("_n"))).alias("block"))
    q = q.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    score = F.coalesce(F.try_divide(dot(F.col("vector"), F.col("_q")), F.col("norm") * F.col("_n")), F.lit(0.0))
    scored = c.join(q, "part").select("chunk_id", "vector", "norm", F.inline("block")).select("query_id", "chunk_id", F.round(score, 9).alias("score"))
    return top(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def packed(rows: DataFrame, key: str, n: int, size: int, name: str) -> DataFrame:
    """Rows (key, vector) dealt into blocks of about `size` of n: the block's number under `name`, its rows as a list."""
    rows = rows.select(key, F.coalesce("vector", F.array().cast(rows.schema["vector"].dataType)).alias("vector"))
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // size)))).cast("int").alias(name)).agg(F.collect_list(F.struct(F.col(key).alias("id"), "vector")).alias(f"_{name}"))


def block_of(rows: pa.ListArray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of one packed block, by id."""
    own = rows[at].values
    ids, lists = own.field("id").to_numpy(zero_copy_only=False), own.field("vector")
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0))
    vectors = np.zeros((len(own), width))
    vectors[np.arange(width) < sizes[:, None]] = flat  # vectors that are null or shorter end in zeros
    order = np.argsort(ids, kind="stable")
    return ids[order], vectors[order]


def best_of_block(chunks: tuple[np.ndarray, np.ndarray], queries: tuple[np.ndarray, np.ndarray], k: int, step: int = 128) -> Iterator[pa.RecordBatch]:
    """The k best chunks of a block for each query of a block, `step` queries at once; of equal scores the smaller chunk_id."""
    (own, c), (names, q) = chunks, queries
    width = max(c.shape[1], q.shape[1])  # a block may hold null vectors alone
    c, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (c, q))
    length, n = np.linalg.norm(c, axis=1), min(k, len(own))
    for at in range(0, len(names), step):
        part = q[at : at + step]
        norm = np.linalg.norm(part, axis=1)[:, None] * length
        s = np.round(np.divide(part @ c.T, norm, out=np.zeros_like(norm), where=norm > 0), 9)
        least = np.partition(s, len(own) - n, axis=1)[:, len(own) - n, None]
        above, equal = s > least, s == least
        row, column = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= n - above.sum(axis=1)[:, None])))
        yield pa.RecordBatch.from_pydict({"query_id": names[at + row], "chunk_id": own[column], "score": s[row, column]})


def cosine_topk_blocks(chunks: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK) -> DataFrame:
    """The same by matrix products: each block of queries meets each block of chunks by the block's number; top k of each pair, then of all.

    Only the two row counts reach the driver. Query blocks are repeated for each block of chunks; k rows a query and block of chunks come back.
    """
    if k <= 0:
        raise ValueError("k must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from best_of_block(block_of(b.column("_part"), i), block_of(b.column("_block"), i), k)

    n = chunks.select("chunk_id").count()
    c = packed(chunks, "chunk_id", n, chunk_block, "part")
    q = packed(queries, "query_id", queries.select("query_id").count(), block, "block")
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // chunk_block)) - 1))))
    out = c.join(q, "part").select("_part", "_block").mapInArrow(run, "query_id long, chunk_id long, score double")
    return top(out, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


@dataclass(frozen=True)
class Filters:
    """What a search is limited to. Dates are inclusive; documents need one of the tags, and an edge with one of the entities (names)."""

    source_types: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    tags: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()


def apply_filters(chunks: DataFrame, filters: Filters, documents: DataFrame | None = None, edges: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Chunks that a search may return. One source type is applied here; several are for post_filter_sources, after the cut.

    Tags need documents (id, tags), entities need edges and nodes besides; filters are joined by "and".
    """
    one = list(filters.source_types) if len(filters.source_types) == 1 else None
    chunks = filter_chunks(chunks, one, filters.date_from, filters.date_to)
    if not filters.tags and not filters.entities:
        return chunks
    if documents is None or filters.entities and (edges is None or nodes is None):
        raise ValueError("tags need documents; entities need documents, edges and nodes")
    own = filter_tags(documents, list(filters.tags)) if filters.tags else documents
    own = filter_entities(own, edges, nodes, list(filters.entities)) if filters.entities else own
    return chunks.join(own.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def post_filter_sources(candidates: DataFrame, source_types: list[str]) -> DataFrame:
    """A filter after the candidate cut: may leave fewer than k."""
    return candidates.where(F.col("source_type").isin(*source_types))


def graph_boost(edges: DataFrame, max_connections: int = MAX_CONNECTIONS) -> DataFrame:
    """document_id, graph: outgoing RELATED_TO and TAGGED_WITH edges, up to max_connections, as a share."""
    e = edges.where(F.col("rel_type").isin("RELATED_TO", "TAGGED_WITH") & (F.col("from_label") == "Document"))
    return e.groupBy(F.col("from_id").alias("document_id")).agg(F.least(F.count(F.lit(1)) / F.lit(float(max_connections)), F.lit(1.0)).alias("graph"))


def recency_minmax(candidates: DataFrame) -> DataFrame:
    """recency: place of created_at between the oldest (0) and newest (1) candidate of a query; 1 if all are equal."""
    w = Window.partitionBy("query_id")
    t, lo, hi = F.unix_micros("created_at"), F.min(F.unix_micros("created_at")).over(w), F.max(F.unix_micros("created_at")).over(w)
    return candidates.withColumn("recency", F.when(hi == lo, 1.0).otherwise((t - lo) / F.nullif(hi - lo, F.lit(0))))


def combined_score(candidates: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    v, g, r = weights
    s = F.lit(v) * F.col("score") + F.lit(g) * F.coalesce("graph", F.lit(0.0)) + F.lit(r) * F.col("recency")
    return candidates.withColumn("combined", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 9))


def best_chunk_per_document(scored: DataFrame, k: int) -> DataFrame:
    order = [F.col("combined").desc(), F.col("rank"), F.col("chunk_id")]
    best = top(scored, ["query_id", "document_id"], order, 1, "_best").drop("_best")
    return top(best, ["query_id"], order, k, "position")


def candidates(chunks: DataFrame, queries: DataFrame, k: int, factor: int = OVERFETCH) -> DataFrame:
    """The nearest chunks with all but their vectors and texts, which few rows need in the end."""
    hits = cosine_topk_blocks(chunks, queries, factor * k)
    return hits.join(chunks.drop("vector", "text"), "chunk_id")


def ranked_candidates(queries: DataFrame, chunks: DataFrame, k: int, filters: Filters = Filters(), documents: DataFrame | None = None, edges: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """The candidates of each query that its filters let through; topics and relations of a search are those of all of them."""
    c = candidates(apply_filters(chunks, filters, documents, edges, nodes), queries, k)
    return post_filter_sources(c, list(filters.source_types)) if len(filters.source_types) > 1 else c


def hybrid_search(queries: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 10, filters: Filters = Filters(), documents: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query, with the scores that made the order and an excerpt."""
    c = ranked_candidates(queries, chunks, k, filters, documents, edges, nodes)
    c = combined_score(recency_minmax(c.join(graph_boost(edges), "document_id", "left")))
    best = best_chunk_per_document(c, k)
    return attributions(best.join(chunks.select("chunk_id", "text"), "chunk_id"))


def attributions(ranked: DataFrame, excerpt: int = EXCERPT) -> DataFrame:
    """What a search shows of each document; overall is the score of the query's first one."""
    overall = F.max("combined").over(Window.partitionBy("query_id")).alias("overall")
    return ranked.select("query_id", "position", "document_id", "chunk_id", "score", F.coalesce("graph", F.lit(0.0)).alias("graph"), F.round("recency", 6).alias("recency"), "combined", overall, "title", "source_type", "source_id", "url", "created_at", F.substring("text", 1, excerpt).alias("excerpt"))


def retrieval_entities(found: DataFrame, tagged_with: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics of the documents of candidates, one row for each document and topic."""
    docs = found.select("query_id", "document_id").distinct()
    t = tagged_with.join(topics, F.col("to_id") == topics["id"]).select(F.col("from_id").alias("document_id"), F.col("to_id").alias("topic_id"), F.col("name"))
    context = F.concat(F.lit(TAGGED), F.col("document_id").cast("string")).alias("context")
    return docs.join(t, "document_id").select("query_id", "document_id", "topic_id", "name", F.lit("Topic").alias("type"), context)


def retrieval_relationships(found: DataFrame, related_to: DataFrame) -> DataFrame:
    """Relations that leave the documents of candidates."""
    docs = found.select("query_id", F.col("document_id").alias("from_id")).distinct()
    return docs.join(related_to, "from_id").select("query_id", "from_id", "to_id", F.lit("RELATED_TO").alias("type"), F.lit(RELATED).alias("context"))


def facet_source_types(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("query_id", "source_type").agg(F.count(F.lit(1)).alias("n"))


def facet_months(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("query_id", F.date_format(F.date_trunc("month", "created_at"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def facet_entities(entities: DataFrame, n: int = 10) -> DataFrame:
    return top(entities.groupBy("query_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("type").alias("type")), ["query_id"], [F.col("n").desc(), F.col("name")], n)


def facet_tags(ranked: DataFrame, documents: DataFrame, n: int = 10) -> DataFrame:
    tags = ranked.join(documents.select(F.col("id").alias("document_id"), F.explode("tags").alias("tag")), "document_id").groupBy("query_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    return top(tags, ["query_id"], [F.col("n").desc(), F.col("tag")], n)


def suggest(prefixes: DataFrame, names: DataFrame, n: int = 10) -> DataFrame:
    """prefixes (prefix) x names (label, name): the first n names of each prefix, case ignored.

    Names give a row for each length that is asked for and meet the prefixes by equality; of each prefix and label n names
    are left before anything else is done, so a prefix that very many names share costs no more than n of each task. Null
    names and prefixes match nothing.
    """
    asked = prefixes.where("prefix is not null").select("prefix", F.lower("prefix").alias("_p")).distinct()
    lengths = sorted(r[0] for r in asked.select(F.length("_p")).distinct().collect()) or [0]  # as many as the longest prefix has letters
    d = names.where(F.col("name").isNotNull()).select("label", "name").distinct()
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length(F.lower("name"))), lambda k: F.substring(F.lower("name"), F.lit(1), k))
    keyed = d.select("label", "name", F.explode(heads).alias("_p")).join(asked.select("_p").distinct(), "_p", "left_semi")
    each = top(keyed, ["_p", "label"], [F.col("name")], n).select("_p", "name").distinct()
    return top(asked.join(each, "_p").select("prefix", "name").distinct(), ["prefix"], [F.col("name")], n)


def filter_tags(documents: DataFrame, tags: list[str]) -> DataFrame:
    return documents.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def filter_entities(documents: DataFrame, edges: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """Documents that an edge joins with a node of one of these names."""
    n = nodes.where(F.lower("name").isin(*[x.lower() for x in names]))
    near = edges.where("to_label = 'Document'").join(n.select(F.col("label").alias("from_label"), F.col("id").alias("from_id")), ["from_label", "from_id"], "left_semi").select(F.col("to_id").alias("id"))
    near = near.union(edges.where("from_label = 'Document'").join(n.select(F.col("label").alias("to_label"), F.col("id").alias("to_id")), ["to_label", "to_id"], "left_semi").select(F.col("from_id").alias("id")))
    return documents.join(near, "id", "left_semi")


def expand_hops(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """seed, id, hop: documents within so many undirected hops; the least hop is kept. Each hop is made distinct first."""
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = front = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        front = front.join(both, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id")).distinct().withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen.groupBy("seed", "id").agg(F.min("hop").alias("hop"))
