"""Change detection, upserts and deletes: joins on keys. Null keys match nothing and are kept as new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_lookback(df: DataFrame, column: str, since: str | None, floor: str) -> DataFrame:
    """Rows since the checkpoint, or since the floor on a first sync."""
    return df.where(F.col(column) >= F.lit(since or floor).cast("timestamp"))


def filter_calendar_window(df: DataFrame, start: str, stop: str, as_of: str, days: int, lookback: str | None = None) -> DataFrame:
    """Events that overlap [as_of - days or lookback, as_of + days]."""
    at = F.lit(as_of).cast("timestamp")
    lo = F.lit(lookback).cast("timestamp") if lookback else at - F.make_dt_interval(F.lit(days))
    return df.where((F.col(start) <= at + F.make_dt_interval(F.lit(days))) & (F.col(stop) >= lo))


def detect_changes_by_version(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of snapshot (key, version, ...) that are new or whose version string differs, with action."""
    old = state.select(F.col("key"), F.col("version").alias("_old"), F.lit(True).alias("_known"))
    j = snapshot.join(old, "key", "left").where(F.col("_known").isNull() | ~F.col("version").eqNullSafe(F.col("_old")))
    return j.withColumn("action", F.when(F.col("_known").isNull(), "new").otherwise("changed")).drop("_old", "_known")


def detect_changes_by_hash(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    """snapshot (key, mtime, text) against state (key, mtime, content_hash): skip, refresh, new or changed.

    Keys and times decide first. Only texts whose time moved are read on and hashed; a skipped row keeps its old hash.
    """
    old = state.select("key", F.col("mtime").alias("_mtime"), F.col("content_hash").alias("_hash"), F.lit(True).alias("_known"))
    timed = snapshot.select("key", "mtime").join(old, "key", "left")
    still = F.col("_known").isNotNull() & F.col("mtime").eqNullSafe(F.col("_mtime"))
    skipped = timed.where(still).select("key", "mtime", F.col("_hash").alias("content_hash"), F.lit("skip").alias("action"))
    moved = timed.where(~still).select("key", "mtime", "_hash", "_known").distinct()
    texts = snapshot.select(F.col("key").alias("_key"), F.col("mtime").alias("_at"), "text")
    here = F.col("key").eqNullSafe(F.col("_key")) & F.col("mtime").eqNullSafe(F.col("_at"))
    hashed = moved.join(texts, here).withColumn("content_hash", F.sha2("text", 256))
    action = F.when(F.col("_known").isNull(), "new").when(F.col("content_hash").eqNullSafe(F.col("_hash")), "refresh").otherwise("changed")
    return skipped.unionByName(hashed.select("key", "mtime", "content_hash", action.alias("action")))


def detect_deletes(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    return state.select("key").join(snapshot.select("key"), "key", "left_anti")


def next_sync_state(state: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    kept = state.join(deleted, "key", "left_anti").join(changed.select("key"), "key", "left_anti")
    return kept.unionByName(changed.select(*state.columns))


def latest(df: DataFrame, key: list[str], sequence: list[Column]) -> DataFrame:
    """One row a key: the last by sequence; of equal ones always the same, by a hash of the row."""
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
    return df.groupBy(*key).agg(F.max_by(F.struct(*[f"`{c}`" for c in df.columns]), F.struct(*sequence, tie)).alias("_row")).select("_row.*")


def upsert_by_key(target: DataFrame, updates: DataFrame, key: list[str], sequence: list[Column]) -> DataFrame:
    """Insert new rows, replace whole rows on match; the last update of a key wins. Running it twice changes nothing."""
    last = latest(updates, key, sequence).select(*target.columns)
    return target.join(last, key, "left_anti").select(*target.columns).unionByName(last)


def insert_if_absent(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return target.unionByName(rows.dropDuplicates(key).join(target, key, "left_anti").select(*target.columns))


def delete_documents(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks, document nodes and edges without those of the documents in ids (id)."""
    gone = ids.select("id").distinct()
    edges = edges.join(gone.select(F.col("id").alias("from_id"), F.lit("Document").alias("from_label")), ["from_label", "from_id"], "left_anti")
    edges = edges.join(gone.select(F.col("id").alias("to_id"), F.lit("Document").alias("to_label")), ["to_label", "to_id"], "left_anti")
    return chunks.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti"), nodes.join(gone.withColumn("label", F.lit("Document")), ["label", "id"], "left_anti"), edges


def reindex(documents: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Documents to chunk and embed again: all, or those whose version moved."""
    return documents if state is None else detect_changes_by_version(documents, state).drop("action")


def sync_summary(documents: DataFrame, errors: DataFrame, listed: int = 100) -> DataFrame:
    """Per source: documents synced, errors, health; where errors have a `message`, the first `listed` different ones by text."""
    d = documents.groupBy("source_type").agg(F.count(F.lit(1)).alias("documents"))
    e = errors.groupBy("source_type").agg(F.count(F.lit(1)).alias("errors"))
    j = d.join(e, "source_type", "full").select("source_type", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("errors", F.lit(0)).alias("errors"))
    j = j.withColumn("health", F.when(F.col("errors") > 0, "degraded").otherwise("healthy"))
    if "message" not in errors.columns:
        return j
    first = top(errors.where("message is not null").select("source_type", "message").distinct(), ["source_type"], [F.col("message")], listed)
    texts = first.groupBy("source_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "message"))), lambda x: x.message).alias("messages"))
    return j.join(texts, "source_type", "left").withColumn("messages", F.coalesce("messages", F.array().cast("array<string>")))


def validate_documents(df: DataFrame, source_types: tuple[str, ...]) -> DataFrame:
    """df with `reasons`: what is wrong with each row (empty: good)."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    tests = {"empty id": F.col("id").isNull(), "empty content": blank("content"), "empty title": blank("title"), "empty source_id": blank("source_id"),
             "unknown source_type": ~F.coalesce(F.col("source_type").isin(*source_types), F.lit(False)), "updated before created": F.coalesce(F.col("updated_at") < F.col("created_at"), F.lit(True))}
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()])))


def first_since(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in arrival order (a limit is the feature)."""
    return df.orderBy(*order).limit(n)


def split_delta(mails: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(live mails, conversation ids to delete, with those stored before; tombstones that name no conversation)."""
    dead = mails.where(F.col("removed").isNotNull())
    named = F.coalesce(F.trim("conversation_id") != "", F.lit(False))
    gone = dead.where(named).select("conversation_id")
    gone = gone if stored is None else gone.unionByName(stored.select("conversation_id"))
    return mails.where(F.col("removed").isNull()), gone.distinct(), dead.where(~named)


def top(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
