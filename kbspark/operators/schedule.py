"""Priorities, workload, overlaps, digests and conflicts; "now" is always the as_of parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import explicit_priority, urgency
from .sync import top

#: Fixed values of the scores.
W_URGENCY, W_IMPORTANCE, W_EXPLICIT = 0.4, 0.35, 0.25
FULL_CONNECTIONS = 20
ITEM_LOAD, MEETING_LOAD = 10, 5


def importance(items: DataFrame, edges: DataFrame) -> DataFrame:
    """items with connections and importance: edges at either end, over the larger of 20 and the batch's maximum."""
    ends = edges.where("from_label = 'ActionItem'").select(F.col("from_id").alias("id")).unionByName(edges.where("to_label = 'ActionItem'").select(F.col("to_id").alias("id")))
    c = items.join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("connections")), "id", "left").withColumn("connections", F.coalesce("connections", F.lit(0)))
    most = c.agg(F.greatest(F.max("connections"), F.lit(FULL_CONNECTIONS)).alias("_most"))  # one row
    return c.crossJoin(F.broadcast(most)).withColumn("importance", F.least(F.lit(1.0), F.col("connections") / F.col("_most"))).drop("_most")


def prioritized_items(items: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    t = importance(items.where("status = 'open'"), edges).withColumns({"_u": urgency(F.col("due_date"), F.lit(as_of).cast("timestamp")), "_e": explicit_priority(F.col("status"))})
    score = F.least(F.lit(100.0), F.lit(100.0) * (F.lit(W_URGENCY) * F.col("_u") + F.lit(W_IMPORTANCE) * F.col("importance") + F.lit(W_EXPLICIT) * F.col("_e")))
    factors = F.array_compact(F.array(F.when(F.col("_u") >= 1, "overdue").when(F.col("_u") > 0.5, "due soon"), F.when(F.col("importance") > 0.5, "high connectivity"), F.when(F.col("_e") >= 1, "high priority").when(F.col("_e") >= 0.5, "medium priority")))
    return t.select("id", "description", "assignee_id", "due_date", F.round(score, 2).alias("score"), F.round("_u", 4).alias("urgency"), F.round("importance", 4).alias("importance"), F.round("_e", 4).alias("explicit"), factors.alias("factors"))


def team_workload(persons: DataFrame, items: DataFrame, assigned_to: DataFrame, attended: DataFrame, meetings: DataFrame, as_of: str) -> DataFrame:
    week = F.date_trunc("week", F.lit(as_of).cast("timestamp"))
    i = assigned_to.join(items.where("status = 'open'").select(F.col("id").alias("from_id")), "from_id", "left_semi").groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("items"))
    now = meetings.where((F.col("date") >= week) & (F.col("date") < week + F.make_dt_interval(F.lit(7)))).select(F.col("id").alias("to_id"))
    m = attended.join(now, "to_id", "left_semi").groupBy(F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("meetings"))
    t = persons.select("id", "name").join(i, "id", "left").join(m, "id", "left").select("id", "name", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("meetings", F.lit(0)).alias("meetings"))
    t = t.withColumn("score", F.least(F.lit(100), ITEM_LOAD * F.col("items") + MEETING_LOAD * F.col("meetings")))
    return t.withColumn("status", F.when(F.col("score") < 30, "light").when(F.col("score") <= 60, "balanced").when(F.col("score") <= 80, "heavy").otherwise("overloaded"))


def top_items_per_member(prioritized: DataFrame, assigned_to: DataFrame, n: int = 3) -> DataFrame:
    t = prioritized.join(assigned_to.select(F.col("from_id").alias("id"), F.col("to_id").alias("person_id")), "id")
    return top(t, ["person_id"], [F.col("score").desc(), F.col("id")], n).select("person_id", "rank", "id", "score")


def topic_overlaps(items: DataFrame, assigned_to: DataFrame, mentioned_in: DataFrame, tagged_with: DataFrame, persons: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics that two or more people with open items are near. Both sides are made distinct before they meet."""
    busy = assigned_to.join(items.where("status = 'open'").select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("from_id")).distinct()
    by = mentioned_in.join(busy, "from_id", "left_semi").join(tagged_with.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("topic_id")), "to_id").select(F.col("from_id").alias("id"), "topic_id").distinct()
    t = by.join(persons.select("id", "name"), "id").groupBy("topic_id").agg(F.array_sort(F.collect_set("name")).alias("people")).where(F.size("people") >= 2)
    return t.join(topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic")), "topic_id").select("topic", "people", F.size("people").cast("long").alias("n_people"))


def meeting_documents(meetings: DataFrame, attended: DataFrame, mentioned_in: DataFrame, documents: DataFrame) -> DataFrame:
    a = attended.join(meetings.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("to_id").alias("meeting_id"), "from_id").distinct()
    return a.join(mentioned_in, "from_id").select("meeting_id", F.col("to_id").alias("id")).distinct().join(documents.select("id", "title", "source_type", "created_at"), "id").select("meeting_id", F.col("id").alias("document_id"), "title", "source_type", "created_at")


def daily_digest(day: str, as_of: str, meetings: DataFrame, items: DataFrame, edges: DataFrame, attended: DataFrame, mentioned_in: DataFrame, documents: DataFrame) -> DataFrame:
    """(section, id, detail): the day's meetings with their number of documents, overdue and open items with score."""
    d = F.lit(day).cast("timestamp")
    today = meetings.where((F.col("date") >= d) & (F.col("date") < d + F.make_dt_interval(F.lit(1))))
    docs = meeting_documents(today, attended, mentioned_in, documents).groupBy(F.col("meeting_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    m = today.join(docs, "id", "left").select(F.lit("meeting").alias("section"), "id", F.coalesce("n", F.lit(0)).cast("double").alias("detail"))
    p = prioritized_items(items, edges, as_of)
    return m.unionByName(p.select(F.when(F.col("urgency") >= 1, "overdue").otherwise("open").alias("section"), "id", F.col("score").alias("detail")))


def schedule_conflicts(events: DataFrame, attendees: DataFrame, bucket_minutes: int = 60) -> DataFrame:
    """events (id, start, stop), attendees (person_id, event_id) -> person_id, a, b of events that overlap.

    Events are laid into time buckets, so a busy person's events meet only within a bucket; a pair counts in the bucket
    where the later of the two starts.
    """
    step = bucket_minutes * 60
    sec = lambda c: F.unix_seconds(F.col(c))
    e = events.select(F.col("id").alias("event_id"), "start", "stop", F.floor(sec("start") / step).alias("_b"), F.explode(F.sequence(F.floor(sec("start") / step), F.floor((F.greatest(sec("stop") - 1, sec("start"))) / step))).alias("bucket"))
    t = attendees.distinct().join(e, "event_id")
    a, b = t.alias("a"), t.alias("b")
    on = (F.col("a.person_id") == F.col("b.person_id")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.event_id") < F.col("b.event_id")) & (F.col("a.start") < F.col("b.stop")) & (F.col("b.start") < F.col("a.stop")) & (F.col("a.bucket") == F.greatest("a._b", "b._b"))
    return a.join(b, on).select("a.person_id", F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))
