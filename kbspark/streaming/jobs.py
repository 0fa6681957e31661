"""Structured Streaming forms; each has a batch twin in operators, and state is bounded by a watermark or kept in tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.chunking import chunk_documents, embed_chunks, hashing_embedder
from ..operators.sync import latest
from ..sources.readers import write_version


def stream_ingest(stream: DataFrame, root: str, checkpoint: str, key: list[str], sequence: list, hook: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Upsert each micro-batch: a file set for each batch id, so a batch that comes again overwrites itself. Deletes are rows with deleted = true."""

    def put(batch: DataFrame, batch_id: int) -> None:
        last = latest(batch, key, sequence)
        last.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch_id}")
        if hook:
            hook(last)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, root: str, key: list[str], sequence: list | None = None) -> DataFrame:
    """The current rows: of each key the last by sequence, without deleted ones.

    An older version that comes in a later batch replaces nothing; the batch's number decides between equal ones. Without
    sequence the last batch's row counts.
    """
    t = latest(live_batches(spark, root), key, [*(sequence or []), F.col("_batch")]).drop("_batch")
    return t.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in t.columns else t


def _folders(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the folders name=number under root that a writer has finished."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    found = [f.getPath() for f in store.listStatus(path) if f.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def live_batches(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the newest fold, and of the batches after it."""
    root = root.rstrip("/")
    fold = max(_folders(spark, root, "fold"), default=-1)
    batches = [f"{root}/batch={n}" for n in _folders(spark, root, "batch") if n > fold]
    return spark.read.option("mergeSchema", "true").parquet(*([f"{root}/fold={fold}"] if fold >= 0 else []), *batches)


def fold_batches(spark: SparkSession, root: str, key: list[str], sequence: list | None = None) -> int:
    """Write the current rows of all batches so far as one folder, fold=<last batch>, and return that number.

    Deleted keys stay in it as such, so that older versions that come late stay out. A fold counts for readers from the
    moment it is whole; batches under it stay for readers that began before, until forget_folded().
    """
    root = root.rstrip("/")
    last = max(_folders(spark, root, "batch"), default=-1)
    if last > max(_folders(spark, root, "fold"), default=-1):
        latest(live_batches(spark, root), key, [*(sequence or []), F.col("_batch")]).write.mode("overwrite").parquet(f"{root}/fold={last}")
    return last


def forget_folded(spark: SparkSession, root: str) -> list[str]:
    """Delete folders of batches that the newest fold holds, and older folds. For times when no reader is under way."""
    root, jvm = root.rstrip("/"), spark.sparkContext._jvm
    fold = max(_folders(spark, root, "fold"), default=-1)
    gone = [f"{root}/{name}={n}" for name in ("batch", "fold") for n in _folders(spark, root, name) if n < fold or n == fold and name == "batch"]
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def compact(spark: SparkSession, root: str, out: str, key: list[str], sequence: list | None = None) -> str:
    return write_version(ingested(spark, root, key, sequence), out)


def debounce_changes(stream: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """events (path, ts, event): the last event of each burst of a path."""
    return stream.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max_by("event", F.struct("ts", "event")).alias("event"), F.count(F.lit(1)).alias("n")).select("path", F.col("w.start").alias("start"), "event", "n")


def debounce_batch(events: DataFrame, gap_seconds: int = 2) -> DataFrame:
    """The same over a table; as in the streaming form, events without a time are in no burst."""
    return events.groupBy("path", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.max_by("event", F.struct("ts", "event")).alias("event"), F.count(F.lit(1)).alias("n")).select("path", F.col("w.start").alias("start"), "event", "n")


def stream_dedupe(stream: DataFrame, time: str, within: str, table: DataFrame | None = None) -> DataFrame:
    """Ids that came within the watermark are skipped, and those of table (id, a static frame), whenever they came."""
    new = stream if table is None else stream.join(table.select("id").distinct(), "id", "left_anti")
    return new.withWatermark(time, within).dropDuplicatesWithinWatermark(["id"])


def stream_new(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Rows (id, ...) whose id no earlier batch has written, whenever that was: the written table is the memory.

    Each batch reads the ids of all earlier ones anew and adds its new rows in a folder of its number, so a batch that
    comes again overwrites itself and no id comes twice. Of rows of a batch with one id the first by a hash stays; rows
    without an id are skipped.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark, root = batch.sparkSession, table.rstrip("/")
        new = latest(batch.where("id is not null"), ["id"], [F.lit(0)])
        done = [f"{root}/batch={n}" for n in _folders(spark, root, "batch") if n < batch_id]
        if done:
            new = new.join(spark.read.parquet(*done).select("id"), "id", "left_anti")
        new.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(documents: DataFrame, embed: Callable = hashing_embedder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks with vectors, document nodes, extraction queue rows) of documents: chunk, embed, then what the tables get.

    chunk_id is `document:index`, so ingesting a document again gives the same keys. A failing embedder fails the job
    before anything is written. Documents without text have a node and no chunks.
    """
    chunks = embed_chunks(chunk_documents(documents), embed)
    d = documents.select(F.col("id").alias("document_id"), "title", "source_type", "source_id", "created_at")
    key = F.concat_ws(":", F.col("document_id").cast("string"), F.col("idx").cast("string")).alias("chunk_id")
    nodes = documents.select(F.lit("Document").alias("label"), "id", F.col("title").alias("name"), "source_type", "source_id", "created_at")
    queue = documents.select(F.col("id").alias("document_id"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    return chunks.join(d, "document_id").select(key, "document_id", "text", "vector", "title", "source_type", "source_id", "created_at"), nodes, queue


def stream_sources(stream: DataFrame, root: str, checkpoint: str, embed: Callable = hashing_embedder) -> StreamingQuery:
    """Documents (id, ..., deleted, version) of a source as they come: deletes first, then inserts, then the checkpoint.

    Each micro-batch keeps the last version of each id and writes, under its own number, the ids that leave the tables and
    the chunks, nodes and queue rows that enter. Structured Streaming commits the batch after that, so a failed batch comes
    again and overwrites itself: the cursor never runs ahead of the tables.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        last = latest(batch, ["id"], [F.col("version")])
        at = lambda name: f"{root.rstrip('/')}/{name}/batch={batch_id}"
        last.select("id", "version").write.mode("overwrite").parquet(at("gone"))
        for name, rows in zip(("chunks", "nodes", "queue"), ingest(last.where(~F.coalesce("deleted", F.lit(False))), embed), strict=True):
            rows.write.mode("overwrite").parquet(at(name))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def source_table(spark: SparkSession, root: str, name: str, key: str = "document_id") -> DataFrame:
    """The current rows of one table of stream_sources: of each id those of the batch that told its last version."""
    rows, gone = spark.read.parquet(f"{root.rstrip('/')}/{name}"), spark.read.parquet(f"{root.rstrip('/')}/gone")
    last = gone.groupBy(F.col("id").alias(key)).agg(F.max_by("batch", F.struct("version", "batch")).alias("batch"))
    return rows.join(last, [key, "batch"], "left_semi").drop("batch")


def stream_meeting_scan(ticks: DataFrame, scan: Callable[[str], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """At each tick (a stream with a column `at`) the notifications of scan(as_of) that the table has not yet.

    scan builds them for a moment, as meeting_prep_notifications does. After a pause a batch holds several ticks; each is
    scanned, and of a notification that several of them make the first stays. Ids that were written before are skipped, so
    a tick that comes again adds nothing. The table's rows are kept a batch a folder.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark, root = batch.sparkSession, table.rstrip("/")
        # one row a scan interval since the last batch
        times = [r.at for r in batch.where("at is not null").select(F.col("at").cast("string").alias("at")).distinct().orderBy("at").collect()]
        if not times:
            return
        found = reduce(DataFrame.unionByName, [scan(at).withColumn("_tick", F.lit(at)) for at in times])
        new = latest(found, ["id"], [F.lit(-1) * F.unix_micros(F.col("_tick").cast("timestamp"))]).drop("_tick")
        done = [f"{root}/batch={n}" for n in _folders(spark, root, "batch") if n != batch_id]
        if done:
            new = new.join(spark.read.parquet(*done).select("id"), "id", "left_anti")
        new.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return ticks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class MeetingTimer(StatefulProcessor):
    """State of one meeting: its date by its latest row, and a timer at the start of its lead time."""

    def __init__(self, lead_minutes: int):
        self.lead = lead_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "told timestamp, date timestamp, due long, sent boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        held = self.known.get() if self.known.exists() else None
        best = held
        for frame in rows:
            for told, date in zip(frame["at"], frame["date"], strict=True):
                if not (told is None or date is None or pd.isna(told) or pd.isna(date)) and (best is None or (told, date) >= (pd.Timestamp(best[0]), pd.Timestamp(best[1]))):
                    best = (told.to_pydatetime(), date.to_pydatetime(), int(date.timestamp() * 1000) - self.lead, bool(held and held[3] and date == pd.Timestamp(held[1])))
        if best is not None and best != held:
            if held is not None and not held[3]:
                self.handle.deleteTimer(held[2])
            self.known.update(best)
            if not best[3]:
                self.handle.registerTimer(best[2])
        yield pd.DataFrame({"id": pd.Series([], dtype="int64"), "date": pd.Series([], dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        told, date, due, _ = self.known.get()
        self.known.update((told, date, due, True))
        yield pd.DataFrame({"id": [key[0]], "date": [date]})

    def close(self) -> None:
        pass


def stream_meeting_timers(meetings: DataFrame, lead_minutes: int = 60, late: str = "0 seconds") -> DataFrame:
    """meetings (id, date, at) as they are told -> id, date of each when its lead time begins, once for each date.

    Time is that of the rows (at): a timer of each meeting fires when the stream's watermark has come to date - lead, so no
    pause loses a meeting. A meeting that is told anew with another date has its timer moved. Rows without a time or a date
    move nothing. The state lies in RocksDB; set spark.sql.streaming.stateStore.providerClass to its provider.
    """
    keyed = meetings.withWatermark("at", late).groupBy("id")
    return keyed.transformWithStateInPandas(MeetingTimer(lead_minutes), outputStructType="id long, date timestamp", outputMode="Append", timeMode="EventTime")


def activity_windows(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling or sliding windows; streams and batches alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("event_type", F.window("ts", width, slide or width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def activity_sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
