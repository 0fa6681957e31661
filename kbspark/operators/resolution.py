"""Extraction output and entity resolution. Edit-distance joins are blocked by segments, so no pair within it is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import document_id, normalise_name

#: Kinds of entities and relationships.
ENTITY_TYPES = ("person", "project", "topic", "decision", "action_item", "meeting")
RELATIONS = ("ATTENDED", "MENTIONED_IN", "ASSIGNED_TO", "RELATED_TO", "DECIDED_IN", "WORKS_ON", "TAGGED_WITH", "FOLLOWED_UP_BY", "OWNS", "BLOCKS")
#: Names that share a segment at most before they meet under leftovers instead.
CROWD = 256
EXTRACTION = ("entities array<struct<type:string,name:string,properties:map<string,string>,confidence:double,source_span:string>>, "
              "relationships array<struct<source_entity:string,relationship_type:string,target_entity:string,confidence:double,context:string>>, confidence double, _bad string")


def parse_extractions(raw: DataFrame) -> DataFrame:
    """doc_id, entities, relationships. A reply with any invalid item, or that is no JSON, yields empty arrays."""
    body = F.coalesce(F.nullif(F.regexp_extract("raw", r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1), F.lit("")), F.col("raw"))
    x = F.from_json(body, EXTRACTION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    sure = lambda c: c.isNotNull() & (c >= 0) & (c <= 1)
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    p = raw.select("doc_id", x.alias("x"))
    good = F.col("x").isNotNull() & F.col("x._bad").isNull() & sure(F.col("x.confidence")) & F.col("x.entities").isNotNull() & F.col("x.relationships").isNotNull()
    good = good & F.forall("x.entities", lambda e: F.coalesce(e.type.isin(*ENTITY_TYPES) & filled(e["name"]) & sure(e.confidence) & filled(e.source_span), F.lit(False)))
    good = good & F.forall("x.relationships", lambda r: F.coalesce(r.relationship_type.isin(*RELATIONS) & filled(r.source_entity) & filled(r.target_entity) & sure(r.confidence), F.lit(False)))
    ok = F.coalesce(good, F.lit(False))
    return p.select("doc_id", *[F.when(ok, F.col(f"x.{c}")).otherwise(F.slice(F.col(f"x.{c}"), 1, 0)).alias(c) for c in ("entities", "relationships")], ok.alias("valid"))


def explode_entities(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.posexplode("entities").alias("position", "e")).select("doc_id", "position", "e.*")


def explode_relationships(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.posexplode("relationships").alias("position", "r")).select("doc_id", "position", "r.*")


def _segments(name: str, parts: int):
    """(number, start from 1, text) of a name cut into `parts` segments."""
    n = F.length(name)
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("no"), F.substring(F.col(name), F.floor(i * n / parts).cast("int") + 1, F.floor((i + 1) * n / parts).cast("int") - F.floor(i * n / parts).cast("int")).alias("seg")))


def _leftovers(name: str, most: int):
    """What a name gives when up to `most` of its letters are taken out."""
    out = every = F.array(F.col(name))
    without = lambda x: F.transform(F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    for _ in range(most):
        out = F.array_distinct(F.flatten(F.transform(out, without)))
        every = F.concat(every, out)
    return F.array_distinct(every)


def _rare_pairs(a: DataFrame, b: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Of names (type, name) of two tables: the rarest `most` pairs of neighbouring letters of each, as type, name, gram, nth
    (the how manieth such pair of the name it is)."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.substring(F.col("name"), i, F.lit(2)))
    both = a.unionByName(b).distinct().where(F.length("name") > most).select("type", "name", F.posexplode(pairs).alias("at", "gram"))
    both = both.select("type", "name", "gram", F.row_number().over(Window.partitionBy("type", "name", "gram").orderBy("at")).alias("nth"))
    often = both.groupBy("type", "gram", "nth").agg(F.count(F.lit(1)).alias("_often"))
    rank = F.row_number().over(Window.partitionBy("type", "name").orderBy("_often", "gram", "nth"))
    rare = both.join(often, ["type", "gram", "nth"]).withColumn("_rank", rank).where(F.col("_rank") <= most).select("type", "name", "gram", "nth")
    return rare.join(a, ["type", "name"], "left_semi"), rare.join(b, ["type", "name"], "left_semi")


def fuzzy_join(a: DataFrame, b: DataFrame, max_dist: int = 2, min_dist: int = 0) -> DataFrame:
    """a (type, name) and b (type, name) -> type, a_name, b_name, distance: all pairs of distinct names of a type within max_dist.

    b's names are cut into max_dist + 1 segments; of two names within the distance one segment of b stands unchanged in
    a, moved by at most max_dist, and lengths differ by at most max_dist. Shorter names than segments meet by length.
    A segment that more than CROWD names of b share (a common prefix, say) is no key. For distances of 2 or less its names
    meet under what is left of both after at most max_dist letters are taken out, which two names within the distance
    always share and few others do. For larger distances, where such leftovers would be too many, its names meet under their
    rarest pairs of letters: max_dist edits touch 2 * max_dist pairs at most, so of the 2 * max_dist + 1 rarest of either
    name one is among those of the other. Names with too few pairs for that keep the segment as a key.
    Null names and types match nothing; repeated names are one; empty inputs give no rows.
    """
    parts = max_dist + 1
    left, right = a.select("type", F.col("name").alias("a_name")).distinct(), b.select("type", F.col("name").alias("b_name")).distinct()
    cuts = right.where(F.length("b_name") >= parts).select("type", "b_name", F.length("b_name").alias("len"), F.inline(_segments("b_name", parts)))
    offsets = F.sequence(F.lit(-max_dist), F.lit(max_dist))
    probe = left.select("type", "a_name", F.explode(offsets).alias("d")).withColumn("len", F.length("a_name") + F.col("d")).where(F.col("len") >= parts)
    probe = probe.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(max_dist)))).withColumn("shift", F.explode(offsets))
    begin, end = F.floor(F.col("no") * F.col("len") / parts).cast("int"), F.floor((F.col("no") + 1) * F.col("len") / parts).cast("int")
    probe = probe.where(begin + F.col("shift") >= 0).select("type", "a_name", "len", "no", F.substring("a_name", begin + F.col("shift") + 1, end - begin).alias("seg")).distinct()
    key = ["type", "len", "no", "seg"]
    crowded = cuts.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD).drop("_n")
    pairs = probe.join(cuts.join(crowded, key, "left_anti"), key).select("type", "a_name", "b_name")
    if max_dist > 2:
        # at most max_dist letters longer or shorter, so both names of a pair are short or neither is
        few = lambda c: F.length(c) <= 2 * max_dist + 1
        inside = cuts.join(crowded, key, "left_semi")
        pairs = pairs.unionByName(probe.where(F.col("len") <= 3 * max_dist + 1).join(inside, key).where(few("a_name") | few("b_name")).select("type", "a_name", "b_name"))
        grams = _rare_pairs(probe.join(crowded, key, "left_semi").select("type", F.col("a_name").alias("name")).distinct(), inside.select("type", F.col("b_name").alias("name")).distinct(), 2 * max_dist + 1)
        pairs = pairs.unionByName(grams[0].withColumnRenamed("name", "a_name").join(grams[1].withColumnRenamed("name", "b_name"), ["type", "gram", "nth"]).select("type", "a_name", "b_name"))
    else:
        less = lambda df, name: df.join(crowded, key, "left_semi").select("type", name).distinct().select("type", name, F.explode(_leftovers(name, max_dist)).alias("left"))
        pairs = pairs.unionByName(less(probe, "a_name").join(less(cuts, "b_name"), ["type", "left"]).select("type", "a_name", "b_name"))
    short = right.where(F.length("b_name") < parts).select("type", "b_name", F.length("b_name").alias("len"))
    pairs = pairs.unionByName(left.withColumn("len", F.explode(F.transform(offsets, lambda d: F.length("a_name") + d))).join(short, ["type", "len"]).select("type", "a_name", "b_name")).distinct()
    d = pairs.withColumn("distance", F.levenshtein("a_name", "b_name", max_dist))
    return d.where((F.col("distance") >= min_dist) & (F.col("distance") <= max_dist))


def ambiguous_pairs(a: DataFrame, b: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    """Pairs for review: more than low, at most high edits apart."""
    return fuzzy_join(a, b, high, low + 1)


def match_entities(mentions: DataFrame, nodes: DataFrame, max_dist: int = 2) -> DataFrame:
    """mentions (mention_id, type, name, email) against nodes (id, type, name, email): mention_id, node_id, method.

    Email (persons) goes before the exact name, that before the nearest name within max_dist; ties by id. Unmatched
    mentions have null. Only names without an exact hit enter the fuzzy join.
    """
    m = mentions.select("mention_id", "type", normalise_name(F.col("name")).alias("name"), F.nullif(normalise_name(F.col("email")), F.lit("")).alias("email"))
    n = nodes.select(F.col("id").alias("node_id"), "type", normalise_name(F.col("name")).alias("name"), F.nullif(normalise_name(F.col("email")), F.lit("")).alias("email"))
    hit = lambda df, p, k, d: df.select("mention_id", "node_id", F.lit(p).alias("priority"), F.lit(k).alias("method"), d.cast("int").alias("distance"))
    mail = hit(m.where("type = 'person'").select("mention_id", "email").join(n.where("type = 'person'").groupBy("email").agg(F.min("node_id").alias("node_id")), "email"), 0, "email", F.lit(0))
    names = n.groupBy("type", "name").agg(F.min("node_id").alias("node_id"))
    exact = hit(m.select("mention_id", "type", "name").join(names, ["type", "name"]), 1, "name", F.lit(0))
    rest = m.join(names, ["type", "name"], "left_anti")
    near = fuzzy_join(rest.select("type", "name"), names.select("type", "name"), max_dist)
    near = rest.select("mention_id", "type", F.col("name").alias("a_name")).join(near, ["type", "a_name"]).select("mention_id", "type", "b_name", "distance")
    near = near.join(names.withColumnRenamed("name", "b_name"), ["type", "b_name"])
    fuzzy = hit(near, 2, "fuzzy", F.col("distance"))
    best = mail.unionByName(exact).unionByName(fuzzy).groupBy("mention_id").agg(F.min(F.struct("priority", "distance", "node_id", "method")).alias("b"))
    return m.select("mention_id").join(best, "mention_id", "left").select("mention_id", F.col("b.node_id").alias("node_id"), F.col("b.method").alias("method"))


def resolve_new(spark: SparkSession, names: DataFrame, checkpoint, max_dist: int = 2) -> DataFrame:
    """names (type, name) without a node -> type, name, canonical: least name of each chain of names within max_dist.

    The batch form of matching one document after another: it does not depend on their order, so a chain of near names
    becomes one entity. `checkpoint(df)` cuts lineage after each round. Each name takes the least label of its neighbours,
    then the label that this one has itself, so rounds follow the logarithm of a chain in order; they end at the fixed point.
    """
    own = names.select("type", normalise_name(F.col("name")).alias("name")).distinct()
    near = checkpoint(fuzzy_join(own, own, max_dist).where("a_name <> b_name").select("type", "a_name", "b_name"))
    label = checkpoint(own.withColumn("canonical", F.col("name")))
    while True:
        least = near.join(label.withColumnRenamed("name", "b_name"), ["type", "b_name"]).groupBy("type", F.col("a_name").alias("name")).agg(F.min("canonical").alias("other"))
        moved = checkpoint(label.join(least, ["type", "name"], "left").select("type", "name", F.least("canonical", "other").alias("canonical"), (F.coalesce(F.col("other") < F.col("canonical"), F.lit(False))).alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        further = moved.select("type", F.col("name").alias("canonical"), F.col("canonical").alias("further"))
        label = checkpoint(moved.join(further, ["type", "canonical"], "left").select("type", "name", F.coalesce("further", "canonical").alias("canonical")))


def assign_entity_ids(resolved: DataFrame) -> DataFrame:
    """Deterministic ids from type and canonical name."""
    return resolved.withColumn("entity_id", document_id("entity", F.concat_ws(":", "type", "canonical")))


def add_aliases(nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """nodes (id, type, name, aliases) with matched (node_id, name) variants of persons and projects added."""
    v = matched.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("_new"))
    none = F.array().cast("array<string>")
    grown = F.array_distinct(F.concat(F.coalesce("aliases", none), F.filter(F.coalesce("_new", none), lambda x: x != F.col("name"))))
    return nodes.join(v, "id", "left").withColumn("aliases", F.when(F.col("type").isin("person", "project"), grown).otherwise(F.col("aliases"))).drop("_new")


def build_nodes(entities: DataFrame, as_of: str) -> DataFrame:
    """entities (entity_id, type, name, properties) -> node rows with the defaults of their type.

    The name is a decision's summary, an action item's description and a meeting's title too. keywords that are no JSON list give none.
    """
    p = lambda k, d="": F.coalesce(F.col("properties")[k], F.lit(d))
    none = F.array().cast("array<string>")
    t, of = F.lit(as_of).cast("timestamp"), lambda *k: F.col("type").isin(*k)
    return entities.select(
        F.col("entity_id").alias("id"), "type", "name", F.when(of("person"), p("email")).alias("email"), F.when(of("project"), p("description")).when(of("action_item"), F.col("name")).alias("description"),
        F.when(of("action_item"), p("status", "open")).alias("status"), F.when(of("action_item"), p("assignee_id")).alias("assignee_id"),
        F.when(of("decision"), F.col("name")).alias("summary"), F.when(of("decision"), p("context")).alias("context"), F.when(of("meeting"), F.col("name")).alias("title"),
        F.when(of("topic"), F.coalesce(F.from_json(F.col("properties")["keywords"], "array<string>"), none)).alias("keywords"), F.when(of("person", "project"), none).alias("aliases"),
        F.when(of("meeting"), F.coalesce(F.col("properties")["duration_minutes"].try_cast("int"), F.lit(0))).alias("duration_minutes"),
        F.when(of("person"), t).alias("first_seen"), F.when(of("person"), t).alias("last_seen"))


def build_edges(relationships: DataFrame, name_to_id: DataFrame, schema: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two names, exactly as written, are entities of the same document and whose end types fit the relation; one a (relation, from, to)."""
    n = name_to_id.select("doc_id", F.col("name").alias("_n"), "id")
    r = relationships.withColumns({"_s": F.col("source_entity"), "_t": F.col("target_entity")})
    e = r.join(n.select("doc_id", F.col("_n").alias("_s"), F.col("id").alias("from_id")), ["doc_id", "_s"]).join(n.select("doc_id", F.col("_n").alias("_t"), F.col("id").alias("to_id")), ["doc_id", "_t"])
    kinds = nodes.select("id", "type")
    e = e.join(kinds.select(F.col("id").alias("from_id"), F.col("type").alias("from_label")), "from_id").join(kinds.select(F.col("id").alias("to_id"), F.col("type").alias("to_label")), "to_id")
    e = e.join(schema.select(F.col("rel_type").alias("relationship_type"), "from_label", "to_label"), ["relationship_type", "from_label", "to_label"], "left_semi")
    return e.groupBy(F.col("relationship_type").alias("rel_type"), "from_label", "from_id", "to_label", "to_id").agg(F.max_by(F.struct("confidence", "context"), F.struct("doc_id", "position")).alias("props")).select("rel_type", "from_label", "from_id", "to_label", "to_id", "props.*")
