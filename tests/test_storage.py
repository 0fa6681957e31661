"""Bucketed tables, streams across batches, leases and heavy hitters."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kbspark.operators import conversations, proactive, sync
from kbspark.sources.buckets import BucketTable
from kbspark.streaming import jobs

T0 = datetime(2026, 1, 1, 9)


def test_bucket_table_rewrites_what_it_touches(spark, tmp_path):
    rng, schema = random.Random(1), spark.createDataFrame([], "id long, text string, version long").schema
    table, want = BucketTable(spark, str(tmp_path / "t"), schema, ("id",), 16), {}
    assert table.read().count() == 0 and table.version() == 0
    for step in range(5):
        rows = [(rng.randrange(300), f"{step}-{i}", rng.randrange(3)) for i in range([400, 3, 1, 40, 0][step])]
        before = table.manifest()
        touched = table.upsert(spark.createDataFrame(rows, schema), [F.col("version"), F.col("text")])
        for i, text, v in sorted(rows, key=lambda r: (r[2], r[1])):
            want[i] = (text, v)
        after = table.manifest()
        assert {b for b in after if after[b] != before.get(b)} == set(touched) and len(touched) <= len({r[0] for r in rows})
        assert {r.id: (r.text, r.version) for r in table.read().collect()} == want
    old = table.version()
    kept = {r.id for r in table.read().collect()}
    gone = sorted(kept)[:7] + [9_999]
    table.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
    assert {r.id for r in table.read().collect()} == kept - set(gone) and {r.id for r in table.read(old).collect()} == kept
    table.upsert(spark.createDataFrame([(None, "a", 1), (None, "b", 1)], schema), [F.col("version")])
    assert table.read().where("id is null").count() == 2
    rows = sorted(map(tuple, table.read().where("id is not null").collect()))
    assert table.vacuum() and sorted(map(tuple, table.read().where("id is not null").collect())) == rows
    held = {os.path.join("data", run, name) for run in os.listdir(tmp_path / "t/data") for name in os.listdir(tmp_path / "t/data" / run) if name.startswith("_bucket=")}
    assert held == set(table.manifest().values())


def test_second_writer_of_a_version_fails(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, text string").schema
    table = BucketTable(spark, str(tmp_path / "t"), schema, ("id",), 4)

    class Slow(BucketTable):
        def version(self):
            return 0

    table.upsert(spark.createDataFrame([(1, "a")], schema), [F.col("text")])
    with pytest.raises(Exception, match="(?i)exist"):
        Slow(spark, table.root, schema, ("id",), 4).upsert(spark.createDataFrame([(2, "b")], schema), [F.col("text")])
    assert [tuple(r) for r in table.read().collect()] == [(1, "a")]


def arriving(spark, tmp_path, schema, folder="in"):
    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))
        return spark.readStream.schema(schema).parquet(str(tmp_path / folder))

    return put


def test_late_older_version_replaces_nothing(spark, tmp_path):
    put, root = arriving(spark, tmp_path, "id long, version long, text string, deleted boolean"), str(tmp_path / "kb")
    order = [F.col("version")]
    run = lambda s: jobs.stream_ingest(s, root, str(tmp_path / "c"), ["id"], order).awaitTermination(60)
    rows = lambda: {r.id: r.text for r in jobs.ingested(spark, root, ["id"], order).collect()}
    run(put((1, 5, "new", False), (2, 1, "x", False), (3, 4, "gone", True)))
    run(put((1, 3, "old", False), (2, 2, "y", False), (3, 2, "late", False)))
    assert rows() == {1: "new", 2: "y"}
    assert jobs.fold_batches(spark, root, ["id"], order) == 1 and jobs.fold_batches(spark, root, ["id"], order) == 1
    assert rows() == {1: "new", 2: "y"}
    run(put((2, 1, "late", False), (3, 3, "late", False), (4, 1, "z", False)))
    assert rows() == {1: "new", 2: "y", 4: "z"}
    gone = jobs.forget_folded(spark, root)
    assert sorted(os.path.basename(g) for g in gone) == ["batch=0", "batch=1"] and rows() == {1: "new", 2: "y", 4: "z"}
    jobs.fold_batches(spark, root, ["id"], order)
    jobs.forget_folded(spark, root)
    assert rows() == {1: "new", 2: "y", 4: "z"} and sorted(x for x in os.listdir(root) if "=" in x) == ["fold=2"]


def test_sources_stream_keeps_the_last_version(spark, tmp_path):
    schema = "id long, title string, source_type string, source_id string, created_at timestamp, content string, version long, deleted boolean"
    put, root = arriving(spark, tmp_path, schema), str(tmp_path / "kb")
    for text, version in (("newer", 5), ("older", 2)):
        jobs.stream_sources(put((1, "t", "jira_issue", "s", T0, text, version, False)), root, str(tmp_path / "c")).awaitTermination(90)
    assert [r.text for r in jobs.source_table(spark, root, "chunks").collect()] == ["newer"]


def test_ids_are_remembered_for_ever(spark, tmp_path):
    put, table = arriving(spark, tmp_path, "id long, at timestamp"), str(tmp_path / "out")
    for rows in ([(1, T0), (1, T0), (2, T0)], [(3, T0 + timedelta(days=40))], [(1, T0 + timedelta(days=80)), (4, T0), (None, T0)]):
        jobs.stream_new(put(*rows), table, str(tmp_path / "c")).awaitTermination(60)
    assert sorted((r.id, r.batch) for r in spark.read.parquet(table).select("id", "batch").collect()) == [(1, 0), (2, 0), (3, 1), (4, 2)]


def test_every_tick_of_a_batch_is_scanned(spark, tmp_path):
    put = arriving(spark, tmp_path, "at timestamp", "ticks")
    scan = lambda at: spark.createDataFrame([("always", at), (f"m{at[14:16]}", at)], "id string, seen string")
    for minutes in ((10, 25, 40), (55,)):
        jobs.stream_meeting_scan(put(*[(T0.replace(minute=m),) for m in minutes]), scan, str(tmp_path / "n"), str(tmp_path / "c")).awaitTermination(60)
    got = {r.id: r.seen[14:16] for r in spark.read.parquet(str(tmp_path / "n")).collect()}
    assert got == {"always": "10", "m10": "10", "m25": "25", "m40": "40", "m55": "55"}


def test_meeting_timers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    put, out = arriving(spark, tmp_path, "id long, date timestamp, at timestamp"), str(tmp_path / "out")
    at = lambda m: T0 + timedelta(minutes=m)
    # 1 and 2 come due in one pause, 3 is moved away before its time, 4 is told late, rows without a time move nothing
    for rows in ([(1, at(70), at(0)), (2, at(75), at(0)), (3, at(80), at(0)), (9, at(900), at(1))], [(3, at(300), at(5)), (1, None, at(6))], [(9, at(900), at(60)), (4, at(90), at(60))], [(9, at(900), at(200)), (1, at(70), at(200))], [(9, at(900), at(260))]):
        q = jobs.stream_meeting_timers(put(*rows), 60).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted((r.id, r.date) for r in spark.read.parquet(out).collect()) == [(1, at(70)), (2, at(75)), (3, at(300)), (4, at(90))]


def test_leases(spark):
    docs = spark.createDataFrame([(i, at) for i, at in enumerate((T0, T0, T0, None, T0 - timedelta(1), T0, T0))], "document_id long, enqueued_at timestamp")
    log = [(0, "processing", T0), (1, "processing", T0 - timedelta(minutes=31)), (2, "failed", T0), (2, "failed", T0), (2, "failed", T0), (5, "done", T0), (5, "failed", T0), (6, "processing", None)]
    got = conversations.extraction_backlog(docs, spark.createDataFrame(log, "document_id long, status string, at timestamp"), str(T0), 30)
    assert {r.document_id: r.state for r in got.collect()} == {0: "processing", 1: "pending", 2: "failed", 3: "pending", 4: "pending", 6: "pending"}
    assert [r.document_id for r in conversations.claim_next(got, 3).collect()] == [4, 1, 6]


def test_hashes_of_moved_rows_alone(spark):
    snap = spark.createDataFrame([(1, 5, "same"), (2, 6, "x"), (3, 6, "new text"), (4, 1, "n"), (5, None, "t")], "key long, mtime long, text string")
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    state = spark.createDataFrame([(1, 5, "old"), (2, 5, sha("x")), (3, 5, "h"), (5, None, "kept")], "key long, mtime long, content_hash string")
    got = {r.key: (r.action, r.content_hash) for r in sync.detect_changes_by_hash(snap, state).collect()}
    assert got == {1: ("skip", "old"), 2: ("refresh", sha("x")), 3: ("changed", sha("new text")), 4: ("new", sha("n")), 5: ("skip", "kept")}


@pytest.mark.parametrize("threshold", [0.05, 0.6])
def test_heavy_hitters_are_split(spark, threshold):
    rng = random.Random(9)
    sets = {d: {f"e{rng.randrange(400)}" for _ in range(rng.randrange(1, 6))} | ({"hot"} if d % 10 == 0 else set()) for d in range(2_000)}
    entities = spark.createDataFrame([(d, "Topic", e) for d, s in sets.items() for e in s], "document_id long, label string, id string")
    new = spark.createDataFrame([(d,) for d in range(0, 2_000, 50)], "document_id long")
    got = {(r.document_id, r.other_id): r.shared for r in proactive.related_documents(new, entities, threshold, hub=20).collect()}
    want = {(d, o): len(sets[d] & s) for d in range(0, 2_000, 50) for o, s in sets.items() if o != d and sets[d] & s and round(len(sets[d] & s) / len(sets[d]), 6) >= threshold}
    assert got == want


def test_parts_of_a_heavy_hitter_are_alike(spark):
    entities = spark.range(40_000).select(F.col("id").alias("document_id"), F.lit("Topic").alias("label"), F.when(F.col("id") % 10 == 0, 0).otherwise(F.col("id") % 9_000 + 1).alias("id"))
    often = entities.groupBy("label", "id").agg(F.count(F.lit(1)).alias("_often"))
    own = entities.where("document_id % 1000 = 0")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        met = proactive.met_under_entities(own, entities.withColumnRenamed("document_id", "other_id"), often, hub=20)
        rows = sorted(r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(rows) == 40 * 3_999 and rows[-1] <= 3 * rows[len(rows) // 2]
