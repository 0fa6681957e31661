"""Property graph: edges (rel_type, from_label, from_id, to_label, to_id) and nodes (label, id, name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components

#: Relation types, and labels in the order in which a shared id is looked up.
RELATIONS = ("ATTENDED", "MENTIONED_IN", "ASSIGNED_TO", "RELATED_TO", "DECIDED_IN", "WORKS_ON", "TAGGED_WITH", "FOLLOWED_UP_BY", "OWNS", "BLOCKS")
LABELS = ("Person", "Project", "Topic", "Decision", "ActionItem", "Meeting", "Document")
EDGE = ["rel_type", "from_label", "from_id", "to_label", "to_id"]


def get_relationships(edges: DataFrame, rel_type: str, from_id: int | None = None, to_id: int | None = None) -> DataFrame:
    if rel_type not in RELATIONS:
        raise ValueError(f"unknown relation {rel_type}")
    e = edges.where(F.col("rel_type") == rel_type)
    e = e.where(F.col("from_id") == from_id) if from_id is not None else e
    return e.where(F.col("to_id") == to_id) if to_id is not None else e


def list_entities(nodes: DataFrame, label: str | None = None, contains: str | None = None) -> DataFrame:
    n = nodes.where("label <> 'Document'") if label is None else nodes.where(F.col("label") == label)
    return n.where(F.contains(F.lower("name"), F.lit(contains.lower()))) if contains else n


def entity_details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with its outgoing relations as one sorted text array."""
    out = edges.groupBy(F.col("from_label").alias("label"), F.col("from_id").alias("id")).agg(F.array_sort(F.collect_list(F.concat_ws(":", "rel_type", "to_label", F.col("to_id").cast("string")))).alias("relations"))
    return nodes.join(out, ["label", "id"], "left").select("label", "id", "name", F.coalesce("relations", F.array().cast("array<string>")).alias("relations"))


def relationships_touching(edges: DataFrame, ids: DataFrame, rel_type: str | None = None) -> DataFrame:
    """Edges from or to any of ids (label, id); an unknown or absent type means all."""
    e = edges.where(F.col("rel_type") == rel_type) if rel_type in RELATIONS else edges
    a = e.join(ids.select(F.col("label").alias("from_label"), F.col("id").alias("from_id")), ["from_label", "from_id"], "left_semi")
    b = e.join(ids.select(F.col("label").alias("to_label"), F.col("id").alias("to_id")), ["to_label", "to_id"], "left_semi")
    return a.select(EDGE).union(b.select(EDGE)).distinct()


def entity_labels(nodes: DataFrame) -> DataFrame:
    """id -> label and display name: the first label in LABELS wins, a blank name gives the id."""
    order = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))
    n = nodes.select("id", "label", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("id").cast("string")).alias("name"), order.alias("_o"))
    return n.groupBy("id").agg(F.min(F.struct("_o", "label", "name")).alias("b")).select("id", "b.label", "b.name")


def _examined(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each distinct pair (label, source, target) and its outcome."""
    known = nodes.select("label", "id").distinct()
    p = pairs.select("label", "source", "target").distinct()
    for end in ("source", "target"):
        p = p.join(known.select("label", F.col("id").alias(end), F.lit(True).alias(f"_{end}")), ["label", end], "left")
    outcome = F.when(F.col("_source").isNull(), "source_not_found").when(F.col("_target").isNull(), "target_not_found").when(F.col("source") == F.col("target"), "self").otherwise("merged")
    return p.select("label", "source", "target", outcome.alias("outcome"))


def _ends(examined: DataFrame) -> DataFrame:
    """label, id, root: the node that each node of a merged pair ends in."""
    node = lambda c: F.struct("label", F.col(c).alias("id"))
    joined = examined.where("outcome = 'merged'").select(node("source").alias("node"), node("target").alias("other"))
    grouped = components(joined)
    sources = joined.select("node").distinct().withColumn("_source", F.lit(1))
    last = grouped.join(sources, "node", "left").groupBy("root").agg(F.coalesce(F.min(F.when(F.col("_source").isNull(), F.col("node"))), F.min("node")).alias("end"))
    return grouped.join(last, "root").select("node.label", "node.id", F.col("end.id").alias("root"))


def merge_outcomes(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (label, source, target) -> each distinct pair with outcome, and root, the node that its source ends in.

    Nodes that pairs join, directly or through others, become one: the least of those that are merged into nothing, or, in
    a ring, the least of all. outcome: merged; self for a pair of a node with itself; source_not_found or target_not_found
    for a pair with a node that is not there (or null), which joins nothing.
    """
    p = _examined(nodes, pairs)
    ends = _ends(p).select("label", F.col("id").alias("source"), "root")
    return p.join(ends, ["label", "source"], "left").select("label", "source", "target", F.when(F.col("outcome") == "merged", F.col("root")).alias("root"), "outcome")


def merge_entities(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after pairs (label, source, target): edges of merged nodes move to the node that these end in (see
    merge_outcomes), equal edges become one, and merged nodes go."""
    moved = _ends(_examined(nodes, pairs)).where("id <> root")
    for end in ("from", "to"):
        new = moved.select(F.col("label").alias(f"{end}_label"), F.col("id").alias(f"{end}_id"), F.col("root").alias("_root"))
        edges = edges.join(new, [f"{end}_label", f"{end}_id"], "left").withColumn(f"{end}_id", F.coalesce("_root", f"{end}_id")).drop("_root")
    return nodes.join(moved, ["label", "id"], "left_anti").select(nodes.columns), edges.select(EDGE).distinct()


def subgraph(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    n = nodes.where(F.col("label").isin(*labels))
    e = edges.where(F.col("from_label").isin(*labels) & F.col("to_label").isin(*labels))
    e = e.join(n.select(F.col("label").alias("from_label"), F.col("id").alias("from_id")), ["from_label", "from_id"], "left_semi").join(n.select(F.col("label").alias("to_label"), F.col("id").alias("to_id")), ["to_label", "to_id"], "left_semi")
    return n, e.select(*EDGE, F.concat_ws(":", "rel_type", F.col("from_id").cast("string"), F.col("to_id").cast("string")).alias("link_id"))


def path_query(edges: DataFrame, first: str, second: str) -> DataFrame:
    """from_id -first-> via_id -second-> to_id."""
    a = edges.where(F.col("rel_type") == first).select("from_id", F.col("to_label").alias("_l"), F.col("to_id").alias("via_id"))
    b = edges.where(F.col("rel_type") == second).select(F.col("from_label").alias("_l"), F.col("from_id").alias("via_id"), "to_id")
    return a.join(b, ["_l", "via_id"]).select("from_id", "via_id", "to_id")


def graph_stats(nodes: DataFrame, edges: DataFrame, chunks: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """what, n: nodes of each label, edges of each type, and totals of documents, entities and relationships; of chunks and
    of each source type where their tables are given."""
    totals = nodes.select(F.when(F.col("label") == "Document", "documents").otherwise("entities").alias("what")).unionByName(edges.select(F.lit("relationships").alias("what")))
    if chunks is not None:
        totals = totals.unionByName(chunks.select(F.lit("chunks").alias("what")))
    if documents is not None:
        totals = totals.unionByName(documents.select(F.concat(F.lit("source:"), F.col("source_type")).alias("what")))
    totals = totals.groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    n = nodes.groupBy(F.concat(F.lit("node:"), F.col("label")).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return totals.unionByName(n).unionByName(edges.groupBy(F.concat(F.lit("edge:"), F.col("rel_type")).alias("what")).agg(F.count(F.lit(1)).alias("n")))


def top_connected(edges: DataFrame, n: int = 20) -> DataFrame:
    ends = edges.select(F.col("from_label").alias("label"), F.col("from_id").alias("id")).unionByName(edges.select(F.col("to_label").alias("label"), F.col("to_id").alias("id")))
    return ends.groupBy("label", "id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.col("degree").desc(), "label", "id").limit(n)


def ingest_growth(documents: DataFrame, grain: str = "day") -> DataFrame:
    """Documents a period and up to its end. The running sum is over the few rows of periods."""
    d = documents.groupBy(F.date_trunc(grain, "created_at").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("total", F.sum("n").over(Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)))


def activity_feed(parts: dict[str, DataFrame], n: int = 20) -> DataFrame:
    """The newest n of frames (id, at)."""
    out = None
    for kind, df in parts.items():
        rows = df.select(F.lit(kind).alias("kind"), "id", "at")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.col("at").desc(), "kind", "id").limit(n)


def recent_edges(edges: DataFrame, documents: DataFrame, as_of: str, days: int = 7, n: int = 20) -> DataFrame:
    """Degree of nodes over edges that touch documents made in the last days."""
    t = F.lit(as_of).cast("timestamp")
    new = documents.where((F.col("created_at") <= t) & (F.col("created_at") >= t - F.make_dt_interval(F.lit(days)))).select(F.lit("Document").alias("label"), "id")
    return top_connected(relationships_touching(edges, new), n)


def document_edges(documents: DataFrame, topics: DataFrame) -> DataFrame:
    """TAGGED_WITH edges from documents' tags to topics of that name."""
    t = documents.select(F.col("id").alias("from_id"), F.explode("tags").alias("name")).join(topics.select("name", F.col("id").alias("to_id")), "name")
    return t.select(F.lit("TAGGED_WITH").alias("rel_type"), F.lit("Document").alias("from_label"), "from_id", F.lit("Topic").alias("to_label"), "to_id").distinct()


def link_edges(documents: DataFrame) -> DataFrame:
    """RELATED_TO edges from `links` (targets of a note) to documents of that title; the least id of equal titles."""
    by_title = documents.groupBy(F.lower("title").alias("_t")).agg(F.min("id").alias("to_id"))
    links = documents.select(F.col("id").alias("from_id"), F.explode("links").alias("_l")).select("from_id", F.lower("_l").alias("_t"))
    return links.join(by_title, "_t").where("from_id <> to_id").select(F.lit("RELATED_TO").alias("rel_type"), F.lit("Document").alias("from_label"), "from_id", F.lit("Document").alias("to_label"), "to_id").distinct()
