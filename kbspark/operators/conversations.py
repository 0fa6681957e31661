"""Sessions and messages (session_id, timestamp, role, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sync import top


def sessions(messages: DataFrame) -> DataFrame:
    """Title (first user message, trimmed, 50 characters), last message's time and number of messages."""
    user = F.col("role") == "user"
    return messages.groupBy("session_id").agg(
        F.substring(F.trim(F.min_by(F.when(user, F.col("content")), F.when(user, F.col("timestamp")))), 1, 50).alias("title"), F.max("timestamp").alias("updated_at"), F.count(F.lit(1)).alias("n_messages"))


def recent_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n of each session, oldest first by position."""
    t = top(messages, ["session_id"], [F.col("timestamp").desc(), F.col("role")], n, "_back")
    return t.withColumn("position", F.max("_back").over(Window.partitionBy("session_id")) - F.col("_back")).drop("_back")


def route_commands(queries: DataFrame, text: Column) -> DataFrame:
    """route: search, graph or chat; argument: what follows the command."""
    t = F.coalesce(text, F.lit(""))
    route = F.when(t.startswith("/search "), "search").when(t.startswith("/graph "), "graph").otherwise("chat")
    cut = F.when(route == "search", F.substring(t, 9, 1 << 30)).when(route == "graph", F.substring(t, 8, 1 << 30)).otherwise(t)
    return queries.withColumns({"route": route, "argument": cut})


def build_prompts(queries: DataFrame, ranked: DataFrame, history: DataFrame, system: str, k: int = 5) -> DataFrame:
    """query_id, prompt: system text, numbered sources, history (session's recent messages), the question."""
    sources = ranked.where(F.col("position") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "title", "excerpt"))).alias("s"))
    past = history.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "content"))).alias("h"))
    j = queries.join(sources, "query_id", "left").join(past, "session_id", "left")
    blocks = F.array_join(F.transform("s", lambda x: F.format_string("[%d] %s\n%s", x.position, x.title, x.excerpt)), "\n\n")
    lines = F.array_join(F.transform("h", lambda x: F.concat(x.role, F.lit(": "), x.content)), "\n")
    return j.select("query_id", F.concat_ws("\n\n", F.lit(system), blocks, lines, F.col("question")).alias("prompt"))


def delete_sessions(sessions_: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return sessions_.join(ids, "session_id", "left_anti"), messages.join(ids, "session_id", "left_anti")


def extraction_queue_status(log: DataFrame) -> DataFrame:
    """log (id, status, at) -> status, n of the latest state of each id, zero-filled."""
    last = log.groupBy("id").agg(F.max_by("status", F.struct("at", "status")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    every = log.sparkSession.createDataFrame([(s,) for s in ("pending", "processing", "done", "failed")], "status string")
    return every.join(last, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def extraction_backlog(documents: DataFrame, attempts: DataFrame, as_of: str | None = None, lease_minutes: int = 30, max_failures: int = 3) -> DataFrame:
    """documents (document_id, enqueued_at) without a success, and the state of each: pending, processing or failed.

    attempts (document_id, status, at) are folded in the order of their times (of equal ones by status). max_failures failures
    make failed. A last attempt that says processing holds the document until its lease is over at as_of; then, or without
    as_of or a time, the work counts as lost and the document is pending again.
    """
    a = attempts.groupBy("document_id").agg(F.count_if(F.col("status") == "failed").alias("_f"), F.bool_or(F.col("status") == "done").alias("_done"),
                                            F.max_by(F.struct("status", "at"), F.struct("at", "status")).alias("_last"))
    j = documents.join(a, "document_id", "left").where(~F.coalesce("_done", F.lit(False)))
    expires = F.col("_last.at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lease_minutes))
    held = F.coalesce((F.col("_last.status") == "processing") & (expires > F.lit(as_of).cast("timestamp")), F.lit(False))
    state = F.when(F.coalesce("_f", F.lit(0)) >= max_failures, "failed").when(held, "processing").otherwise("pending")
    return j.select("document_id", "enqueued_at", state.alias("state"))


def claim_next(backlog: DataFrame, n: int) -> DataFrame:
    """The n pending documents that have waited longest (a limit is the feature), of equal ones the smaller id."""
    return backlog.where("state = 'pending'").orderBy(F.col("enqueued_at").asc_nulls_last(), "document_id").limit(n)
