"""Related content, meeting preparation and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import entity_labels
from .schedule import meeting_documents
from .sync import insert_if_absent, top

#: Fixed values.
RELATED_THRESHOLD = 0.7
#: Thresholds from which candidates meet under rare entities alone.
PREFIX = 0.5
TITLE_LENGTH = 40
#: Documents of an entity from which its rows are split.
HUB = 4_096
#: Kinds of entities as titles name them.
FRIENDLY = {"Person": "person", "Project": "project", "Topic": "topic", "Decision": "decision", "ActionItem": "action item", "Meeting": "meeting", "Document": "document"}
TICKETS, NOTES, MAILS = ("jira_issue",), ("obsidian_note", "apple_note"), ("outlook_email",)


def document_entities(edges: DataFrame, labels: tuple[str, ...] = ("Person", "Topic", "Project")) -> DataFrame:
    """document_id, label, id of neighbours in either direction."""
    out = edges.where((F.col("from_label") == "Document") & F.col("to_label").isin(*labels)).select(F.col("from_id").alias("document_id"), F.col("to_label").alias("label"), F.col("to_id").alias("id"))
    into = edges.where((F.col("to_label") == "Document") & F.col("from_label").isin(*labels)).select(F.col("to_id").alias("document_id"), F.col("from_label").alias("label"), F.col("from_id").alias("id"))
    return out.unionByName(into).distinct()


def met_under_entities(own: DataFrame, other: DataFrame, often: DataFrame, hub: int = HUB) -> DataFrame:
    """own (document_id, label, id) joined with other (other_id, label, id), as document_id, other_id for each shared entity.

    An entity on more than hub documents (often: label, id, _often) is a heavy hitter: its rows of other are salted into
    parts of about hub rows, and its rows of own are repeated for each, so no task gets more of one entity than of others.
    """
    heavy = often.where(F.col("_often") > hub).select("label", "id", F.ceil(F.col("_often") / hub).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    salted = other.join(heavy, ["label", "id"], "left").withColumn("_part", F.pmod(F.xxhash64("other_id"), parts).cast("int")).drop("_parts")
    repeated = own.join(heavy, ["label", "id"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return repeated.join(salted, ["label", "id", "_part"]).where("document_id <> other_id").select("document_id", "other_id")


def related_documents(new_docs: DataFrame, entities: DataFrame, threshold: float = RELATED_THRESHOLD, hub: int = HUB) -> DataFrame:
    """new_docs (document_id): other documents with the share of the new one's entities that they have.

    A document that has a share of the new one's n entities has one of its rarest n - share * n + 1. From a threshold of
    PREFIX on, candidates meet under those alone, so an entity on very many documents pairs few; below, where the rarest
    are nearly all, documents meet under every entity. Both give the same rows. Null ids match nothing.
    """
    own = entities.join(new_docs.select("document_id").distinct(), "document_id", "left_semi")
    sizes = own.groupBy("document_id").agg(F.count(F.lit(1)).alias("size"))
    other = entities.select(F.col("document_id").alias("other_id"), "label", "id")
    often = entities.groupBy("label", "id").agg(F.count(F.lit(1)).alias("_often"))
    if threshold >= PREFIX:
        ranked = own.join(often, ["label", "id"]).withColumn("_rank", F.row_number().over(Window.partitionBy("document_id").orderBy("_often", "label", "id")))
        # scores are rounded to six digits, so the bound gives way by as much
        least = F.ceil(F.col("size") * F.lit(threshold - 1e-6))
        rare = ranked.join(sizes, "document_id").where(F.col("_rank") <= F.col("size") - least + 1).select("document_id", "label", "id")
        pairs = met_under_entities(rare, other, often, hub).distinct()
        shared = pairs.join(own, "document_id").join(other, ["other_id", "label", "id"], "left_semi")
    else:
        shared = met_under_entities(own, other, often, hub)
    shared = shared.groupBy("document_id", "other_id").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(sizes, "document_id").withColumn("score", F.round(F.col("shared") / F.col("size"), 6)).where(F.col("score") >= threshold).select("document_id", "other_id", "shared", "score")


def jaccard_pairs(entities: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """Set similarity of the queries' documents with all others, from counts. It is never above the share of entities."""
    sizes = entities.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    r = related_documents(queries, entities, max(0.0, threshold - 1e-6)).select("document_id", "other_id", "shared")
    r = r.join(sizes, "document_id").join(sizes.select(F.col("document_id").alias("other_id"), F.col("n").alias("m")), "other_id")
    return r.withColumn("score", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 6)).where(F.col("score") >= threshold).select("document_id", "other_id", "score")


def related_alerts(related: DataFrame, n: int = 5) -> DataFrame:
    counts = related.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 3).alias("strength"))
    best = top(related, ["document_id"], [F.col("score").desc(), F.col("other_id")], n).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id"))).alias("l"))
    text = F.format_string("Connected to %d existing document(s) via shared entities", F.col("n"))
    return counts.join(best, "document_id").select("document_id", "strength", text.alias("summary"), F.transform("l", lambda x: x.other_id).alias("others"))


def upcoming_meetings(meetings: DataFrame, as_of: str, lead_minutes: int = 60) -> DataFrame:
    t = F.lit(as_of).cast("timestamp")
    return meetings.where(F.col("date").between(t, t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lead_minutes))))


def meeting_context(meetings: DataFrame, attended: DataFrame, mentioned_in: DataFrame, documents: DataFrame, items: DataFrame, assigned_to: DataFrame) -> DataFrame:
    """(meeting_id, part, id, rank): attendees, other meetings (5), tickets, notes, mails and open items (10 each)."""
    who = attended.join(meetings.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("to_id").alias("meeting_id"), F.col("from_id").alias("person")).distinct()
    cut = lambda df, part, order, n: top(df, ["meeting_id"], order, n).select("meeting_id", F.lit(part).alias("part"), "id", "rank")
    people = top(who.select("meeting_id", F.col("person").alias("id")), ["meeting_id"], [F.col("id")], 1 << 30).select("meeting_id", F.lit("attendee").alias("part"), "id", "rank")
    other = who.join(attended.select(F.col("from_id").alias("person"), F.col("to_id").alias("id")), "person").where("id <> meeting_id").select("meeting_id", "id").distinct()
    docs = meeting_documents(meetings, attended, mentioned_in, documents).select("meeting_id", F.col("document_id").alias("id"), "source_type", "created_at")
    newest = [F.col("created_at").desc(), F.col("id")]
    own = who.join(assigned_to.select(F.col("to_id").alias("person"), F.col("from_id").alias("id")), "person").select("meeting_id", "id").distinct().join(items.where("status = 'open'").select("id"), "id", "left_semi")
    out = people.unionByName(cut(other, "meeting", [F.col("id")], 5)).unionByName(cut(own, "item", [F.col("id")], 10))
    for part, types in (("ticket", TICKETS), ("note", NOTES), ("mail", MAILS)):
        out = out.unionByName(cut(docs.where(F.col("source_type").isin(*types)), part, newest, 10))
    return out


def meeting_prep_notifications(meetings: DataFrame, context: DataFrame, persons: DataFrame, existing: DataFrame) -> DataFrame:
    """One high notification for each upcoming meeting that has none yet."""
    names = context.where("part = 'attendee' and rank <= 3").join(persons.select("id", "name"), "id").groupBy("meeting_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("_who"))
    items = context.where("part = 'item'").groupBy("meeting_id").agg(F.count(F.lit(1)).alias("_n"))
    m = meetings.select(F.col("id").alias("meeting_id"), "title").join(names, "meeting_id", "left").join(items, "meeting_id", "left")
    text = F.concat_ws("; ", F.concat(F.lit("Attendees: "), F.col("_who")), F.format_string("%d open action items", F.col("_n")))
    n = m.select(F.concat(F.lit("meeting_prep_"), F.col("meeting_id").cast("string")).alias("id"), F.lit("meeting_prep").alias("type"), F.concat(F.lit("Upcoming: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Meeting"))).alias("title"), F.when(F.col("_who").isNull() & F.col("_n").isNull(), "Meeting starting soon").when(F.col("_n").isNull(), F.concat(F.lit("Attendees: "), F.col("_who"))).otherwise(text).alias("summary"), F.lit("high").alias("priority"), F.to_json(F.struct(F.col("meeting_id").cast("string").alias("meeting_id"))).alias("data"))
    return n.join(existing.select("id"), "id", "left_anti")


def related_notifications(alerts: DataFrame, documents: DataFrame) -> DataFrame:
    j = alerts.join(documents.select(F.col("id").alias("document_id"), "title"), "document_id")
    return j.select(F.concat(F.lit("related_"), F.col("document_id").cast("string")).alias("id"), F.lit("related_content").alias("type"), F.concat(F.lit("Related content: "), F.coalesce("title", F.lit(""))).alias("title"), "summary", F.lit("low").alias("priority"),
                    F.to_json(F.struct(F.col("document_id").alias("new_doc_id"), F.col("others").alias("related_doc_ids"), F.col("strength").alias("connection_strength"))).alias("data"))


def contradiction_notifications(contradictions: DataFrame, nodes: DataFrame, documents: DataFrame, existing: DataFrame) -> DataFrame:
    """A medium notification for each contradiction that has none yet: what changed, on which entity, told by which document."""
    short = F.when(F.length("name") > TITLE_LENGTH, F.concat(F.substring("name", 1, TITLE_LENGTH - 3), F.lit("..."))).otherwise(F.col("name"))
    labels = entity_labels(nodes).select(F.col("id").alias("entity_id"), "name", "label")
    d = documents.select(F.col("id").alias("source_doc_id"), F.col("title").alias("source_title"), "source_type", "source_id")
    c = contradictions.join(labels, "entity_id", "left").join(d, "source_doc_id", "left")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in FRIENDLY.items() for x in pair])[F.col("label")], F.lower("label"))
    title = F.when(F.col("name").isNull(), F.format_string("Contradiction: '%s' on unknown entity", "field_name")).otherwise(F.format_string("'%s' conflict on '%s' (%s)", F.col("field_name"), short, kind))
    summary = F.format_string("Field '%s' changed from '%s' to '%s'", "field_name", "old_value", "new_value")
    data = F.to_json(F.struct(F.col("id").alias("contradiction_id"), "entity_id", "field_name", "source_type", "source_id", "source_title"))
    n = c.select(F.concat(F.lit("contradiction_"), F.col("id")).alias("id"), F.lit("contradiction").alias("type"), title.alias("title"), summary.alias("summary"), F.lit("medium").alias("priority"), data.alias("data"))
    return n.join(existing.select("id"), "id", "left_anti")


def list_notifications(table: DataFrame, unread_only: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    t = table.where("not read") if unread_only else table
    return t.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def unread_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count_if(~F.col("read")).alias("unread"))


def mark_read(table: DataFrame, ids: DataFrame) -> DataFrame:
    j = table.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return j.withColumn("read", F.col("read") | F.coalesce("_hit", F.lit(False))).select(table.columns)


def dismiss(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids, "id", "left_anti")


def missing_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(table, "id", "left_anti")


def route_notifications(table: DataFrame, urls: dict[str, str], fallback: str | None = None) -> DataFrame:
    """target: the type's URL or the global one, https only."""
    own = F.lit(fallback).cast("string")
    for kind, url in urls.items():
        own = F.when(F.col("type") == kind, F.lit(url)).otherwise(own)
    return table.withColumn("target", F.when(F.startswith(own, F.lit("https://")), own))


def add_notifications(table: DataFrame, new: DataFrame) -> DataFrame:
    return insert_if_absent(table, new, ["id"])
