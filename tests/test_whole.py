"""Queries over whole inputs, on small hand-made tables."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from kbspark import registry
from kbspark.operators import search


def test_search_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(300)]
    c, q = spark.createDataFrame(rows, "chunk_id long, vector array<float>"), spark.createDataFrame(rows[::5], "query_id long, vector array<float>")
    want = sorted(map(tuple, search.cosine_topk(c, q, 7).collect()))
    assert len(want) == 7 * 60
    for block, chunk_block in ((8, 16), (8, 1000), (1000, 3)):
        assert sorted(map(tuple, search.cosine_topk_blocks(c, q, 7, block, chunk_block).collect())) == want
    none = q.limit(0)
    assert search.cosine_topk_blocks(c, none, 7).count() == 0 and search.cosine_topk_blocks(c.limit(0), q, 7).count() == 0


def test_every_query_is_searched(spark, tmp_path):
    rng = random.Random(2)
    e = [(i, [rng.uniform(-1, 1) for _ in range(8)], i % 3) for i in range(2300)]
    spark.createDataFrame(e, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"text {i}", "en", "s") for i in range(800)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(dict)
    for r in registry.queries()["cosine_topk_blocks_all"](spark, str(tmp_path)).collect():
        got[r.query_id][r.rank] = r.chunk_id
    v = np.array([x[1] for x in e], np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert got == {i: {k + 1: c for k, c in enumerate(np.lexsort((np.arange(2300), -np.round(v @ v[i], 9)))[:10].tolist())} for i in range(0, 2300, 100)}


def test_every_person_and_order_is_taken(spark, tmp_path):
    spark.createDataFrame([(i, f"p{i}") for i in range(7)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 7) for k in range(21)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.id: r.aliases for r in registry.queries()["add_aliases_all"](spark, str(tmp_path)).collect()}
    assert got == {i: "boss|alias0|alias1|alias2" for i in range(7)}


def test_whole_bodies_and_messages(spark, tmp_path):
    text = [f"{i} " + "long text " * 20 for i in range(60)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(text)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i // 3, i % 3, "user", t) for i, t in enumerate(text)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    notes = {r.id: r.digest for r in registry.queries()["notes_from_relational_all"](spark, str(tmp_path)).collect()}
    assert notes == {i: None if i % 50 == 1 else digest(t) for i, t in enumerate(text) if i % 9}
    routed = {(r.session_id, r.timestamp): (r.route, r.digest) for r in registry.queries()["route_commands_all"](spark, str(tmp_path)).collect()}
    assert routed == {(i // 3, i % 3): (("search", "graph", "chat")[i % 3], digest(t)) for i, t in enumerate(text)}


def test_each_user_has_bursts(spark, tmp_path):
    spark.sql("select id as event_id, timestamp_seconds(id) as ts, id as user_id, 'view' as event_type from range(60)").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((r.path, r.start, r.n) for r in registry.queries()["debounce_changes_all"](spark, str(tmp_path)).collect()) == [(i, i * 1_000_000, 1) for i in range(60)]


def as_sql(spark, folder, name, *tables):
    """The rows of a query, and those of its SQL, over small tables."""
    df, duck = registry.queries()[name](spark, str(folder)), duckdb.connect()
    for t in tables:
        duck.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = duck.sql(registry.oracle_sql()[name])
    return sorted(map(tuple, df.select(*want.columns).collect())), sorted(want.fetchall())


def test_sliding_windows_take_the_nearest_second(spark, tmp_path):
    times = ["2024-01-01 05:59:59.6", "2024-01-01 05:59:59.4", "2024-01-01 05:59:59.5", "2024-01-01 17:59:58.5", "2024-01-02 00:00:00.5", "1969-12-31 23:59:59.5", "2024-01-01 12:00:00"]
    spark.createDataFrame([(f"{i % 2}", t) for i, t in enumerate(times)], "event_type string, ts string").selectExpr("event_type", "cast(ts as timestamp_ntz) as ts").write.parquet(f"{tmp_path}/events.parquet")
    got, want = as_sql(spark, tmp_path, "activity_windows_sliding", "events")
    assert got == want and sum(r[2] for r in got) == 4 * len(times)


@pytest.mark.parametrize("name", ["html_to_text", "html_notes_to_documents"])
def test_references_that_were_cut(spark, tmp_path, name):
    texts = ["a &quot", "a &quo", "&quot;b&quot;", "c &amp", "&ampd &amp;quot; &ampquot;", "&copy &copy; &middot;", "&#x27;e &#x2 &#39;", "&nbsp;f &lt;g&gt &lt", "&", "A&B &AMP; &"]
    pages = [(i, f"u{i}", f'<html><title>{t}</title><h1>{t}</h1><p>{t} end<br>{t}</p><a href="/x?a=1&b=2">{t}</a></html>') for i, t in enumerate(texts)]
    spark.createDataFrame([*pages, (99, "none", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = as_sql(spark, tmp_path, name, "pages")
    assert got == want and len(got) == len(texts) + 1


@pytest.mark.parametrize("name", ["cosine_topk", "cosine_topk_all"])
def test_searches_make_no_row_for_each_pair(spark, tmp_path, name):
    rng = random.Random(8)
    e = [(i, [float(rng.randrange(-3, 4)) for _ in range(8)], i % 3) for i in range(900)]  # many equal scores
    spark.createDataFrame(e, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for t, columns in (("orders", "o_orderkey, o_custkey"), ("lineitem", "l_orderkey, l_partkey"), ("events", "event_id, user_id")):  # of views that the SQL names
        spark.sql("select " + ", ".join(f"1L as {c}" for c in columns.split(", ")) + ", 'view' as event_type").write.parquet(f"{tmp_path}/{t}.parquet")
    got, want = as_sql(spark, tmp_path, name, "embeddings", "documents", "orders", "lineitem", "events")
    assert got == want and len(got) == 90
    plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "inline(block" not in plan
