"""Operators on small hand-made frames."""

import json
import random
import time
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kbspark.functions import columns as C
from kbspark.operators import chunking, contradictions, normalise, proactive, resolution, schedule, search, sync
from kbspark.sources import readers
from kbspark.streaming import jobs

AS_OF = "2026-03-15 09:00:00"


def test_document_id_is_uuid5(spark):
    keys = ["PROJ-1", "é日", ""]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(C.document_id("jira_issue", F.col("k"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_OID, f"jira_issue:{k}")) for k in keys]


def test_note_syntax(spark):
    t = "See [[A|b]] and ![[img|x]] `[[code]]` #tag #a/b\n> [!note] Title"
    d = spark.createDataFrame([(t,)], "t string").select(C.extract_wikilinks(F.col("t")).alias("l"), C.extract_embeds(F.col("t")).alias("e"), C.extract_tags(F.col("t"), F.array(F.lit("front"))).alias("g"), C.extract_callouts(F.col("t")).alias("c"), C.strip_note_syntax(F.col("t")).alias("s")).first()
    assert (d.l, d.e, d.g) == (["A"], ["img"], ["front", "tag", "a/b"])
    assert [(c.type, c.title) for c in d.c] == [("NOTE", "Title")]
    assert d.s.startswith("See b and") and "#" not in d.s


def test_note_syntax_cases(spark):
    def read(f, texts):
        return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]

    none = lambda t: C.extract_tags(t, F.lit(None).cast("array<string>"))
    assert read(none, ["#2026 #v1.2 #_x #café x#no (#no) #a #a", "`#a` ```\n#b\n``` ~~~\n#c\n~~~ #d", "`#a\n#b` #c", "", None]) == [["2026", "v1.2", "_x", "café", "a"], ["d"], ["c"], [], None]
    assert read(C.extract_wikilinks, ["[[ A |b]] [[|x]] [[ ]] ![[no]] [[a[b]] [[c]]", "~~~ [[x]] ~~~ `[[y\n]]` [[z]]"]) == [["A", "c"], ["z"]]
    assert read(C.extract_embeds, ["![[a|b]] `![[in code]]` ![[ c ]]"]) == [["a", "in code", " c "]]
    assert read(C.strip_note_syntax, ["\t![[gone|x]] [[T|shown ]] [[T]] #v1.2 #café a#b\n"]) == ["shown T v1.2 café a#b"]


def test_voices_of_cues(spark):
    cue = lambda body: f"00:00:01.000 --> 00:00:02.000\n{body}\n\n"
    text = "WEBVTT\n\n" + "".join(map(cue, ["<v Ann>Hi</v> <v Bob>Yo</v>", "well <v Bob>yes\nno</v>", "<v Cy>open", "<v Di> </v>"])) + "1:00:00.000 --> 1:00:01.000\nshort hour"
    got = [(r.speaker, r.text) for r in normalise.parse_vtt_segments(spark.createDataFrame([("m", text)], "meeting_id string, text string")).orderBy("seq").collect()]
    assert got == [("Ann", "Hi"), ("Bob", "yes\nno"), ("Unknown", "<v Cy>open")]


def test_mail_rules(spark):
    m = spark.createDataFrame([("f", "a@x.io", None), ("f", None, None), ("f", "plain", None), ("g", "b@y.io", "bad")], "folder_id string, sender string, received string")
    assert [r.sender for r in normalise.filter_mail(m, sender_domains=["x.io"]).collect()] == ["a@x.io"]
    t = spark.createDataFrame([("c", 1, datetime(2026, 1, 1), "2026-01-01T00:00:00Z", "a@x.io", None, "", "one"), ("d", 1, datetime(2026, 1, 1), None, None, ["b@y.io", " "], " RE: Re: x", None)], "conversation_id string, mail_id int, received timestamp, received_text string, sender string, recipients array<string>, subject string, body string")
    got = {r.conversation_id: r for r in normalise.mail_threads(t).collect()}
    assert got["c"].title == "Email: No Subject" and got["c"].content == "From: a@x.io\nDate: 2026-01-01T00:00:00Z\nSubject: \n\none"
    assert got["d"].title == "Email: Re: x" and got["d"].participants == ["b@y.io"] and normalise.threads_to_documents(normalise.mail_threads(t), AS_OF).count() == 2
    stored = spark.createDataFrame([("old",), ("c",)], "conversation_id string")
    dead = t.select("conversation_id").withColumn("removed", F.lit("deleted"))
    assert sorted(r[0] for r in sync.split_delta(dead, stored)[1].collect()) == ["c", "d", "old"]


def test_notification_texts(spark):
    meetings = spark.createDataFrame([(1, "Plan"), (2, ""), (3, None)], "id long, title string")
    none = spark.createDataFrame([], "meeting_id long, part string, id long, rank int")
    people = spark.createDataFrame([], "id long, name string")
    got = {r.id: r for r in proactive.meeting_prep_notifications(meetings, none, people, spark.createDataFrame([("meeting_prep_3",)], "id string")).collect()}
    assert {k: (r.title, r.summary, json.loads(r.data)) for k, r in got.items()} == {"meeting_prep_1": ("Upcoming: Plan", "Meeting starting soon", {"meeting_id": "1"}), "meeting_prep_2": ("Upcoming: Meeting", "Meeting starting soon", {"meeting_id": "2"})}
    c = spark.createDataFrame([("x", 1, "status", "open", "done", 9), ("y", 5, "due_date", "a", "b", 8)], "id string, entity_id long, field_name string, old_value string, new_value string, source_doc_id long")
    nodes = spark.createDataFrame([("ActionItem", 1, "n" * 41)], "label string, id long, name string")
    docs = spark.createDataFrame([(9, "T", "jira_issue", "P-1")], "id long, title string, source_type string, source_id string")
    got = {r.id: r for r in proactive.contradiction_notifications(c, nodes, docs, meetings.select(F.col("title").alias("id")).limit(0)).collect()}
    assert got["contradiction_x"].title == f"'status' conflict on '{'n' * 37}...' (action item)" and got["contradiction_x"].summary == "Field 'status' changed from 'open' to 'done'"
    assert json.loads(got["contradiction_x"].data) == {"contradiction_id": "x", "entity_id": 1, "field_name": "status", "source_type": "jira_issue", "source_id": "P-1", "source_title": "T"}
    assert got["contradiction_y"].title == "Contradiction: 'due_date' on unknown entity"


def test_nodes_and_edges_of_extractions(spark):
    e = [("i1", t, f"n {t}", {"email": "e", "description": "d", "status": "done", "assignee_id": "p", "context": "c", "keywords": '["k"]', "duration_minutes": "30"}) for t in resolution.ENTITY_TYPES] + [("i2", "topic", "t", {"keywords": "k"}), ("i3", "action_item", "a", {})]
    n = {(r.id, r.type): r for r in resolution.build_nodes(spark.createDataFrame(e, "entity_id string, type string, name string, properties map<string,string>"), AS_OF).collect()}
    assert n["i1", "action_item"].description == "n action_item" and n["i1", "action_item"].assignee_id == "p" and n["i3", "action_item"].status == "open"
    assert n["i1", "topic"].keywords == ["k"] and n["i2", "topic"].keywords == [] and n["i1", "decision"].summary == "n decision" and n["i1", "decision"].context == "c" and n["i1", "project"].description == "d" and n["i1", "person"].aliases == []
    r = spark.createDataFrame([("d", 0, "A", "WORKS_ON", "P", 0.5, None), ("d", 1, "a", "WORKS_ON", "P", 0.9, None), ("x", 0, "A", "WORKS_ON", "P", 0.9, None)], "doc_id string, position int, source_entity string, relationship_type string, target_entity string, confidence double, context string")
    ids = spark.createDataFrame([("d", "A", "1"), ("d", "P", "2")], "doc_id string, name string, id string")
    schema = spark.createDataFrame([("WORKS_ON", "person", "project")], "rel_type string, from_label string, to_label string")
    kinds = spark.createDataFrame([("1", "person"), ("2", "project")], "id string, type string")
    assert [(x.from_id, x.to_id, x.confidence) for x in resolution.build_edges(r, ids, schema, kinds).collect()] == [("1", "2", 0.5)]
    assert len({x.entity_id for x in resolution.assign_entity_ids(spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "a")], "type string, canonical string")).collect()}) == 2


def test_long_chains_resolve(spark, tmp_path):
    def keep(df):
        df.write.parquet(p := str(tmp_path / uuid.uuid4().hex))
        return spark.read.parquet(p)

    names = ["a" * i for i in range(6, 130)]  # each within one edit of the next: a chain longer than any bound on rounds
    got = {r.name: r.canonical for r in resolution.resolve_new(spark, spark.createDataFrame([("t", x) for x in names], "type string, name string"), keep).collect()}
    assert got == dict.fromkeys(names, names[0])


def test_offset_timestamps(spark):
    got = [r[0] for r in spark.createDataFrame([("2026-01-01T10:00:00.000+0000",), ("2026-01-01T10:00:00+05:30",), ("2026-01-01T10:00:00Z",), ("bad",), (None,)], "t string").select(C.parse_offset_timestamp(F.col("t")).cast("string")).collect()]
    assert got == ["2026-01-01 10:00:00", "2026-01-01 04:30:00", "2026-01-01 10:00:00", None, None]


def test_vtt(spark):
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:03.500\n<v Ann>Hello\nthere</v>\n\n1\n00:00:04.000 --> 00:00:05.000\nplain\n\nnonsense\n\n00:00:06.000 --> 00:00:07.000\n\n"
    s = normalise.parse_vtt_segments(spark.createDataFrame([("m", vtt), ("n", None), ("e", "")], "meeting_id string, text string"))
    assert [(r.speaker, r.text) for r in s.orderBy("seq").collect()] == [("Ann", "Hello\nthere"), ("Unknown", "plain")]
    assert normalise.transcript_text(s).first().transcript == "Ann: Hello\nthere\nUnknown: plain\n"
    assert {(r.speaker, r.words, r.seconds) for r in normalise.speaker_stats(s).collect()} == {("Ann", 2, 2.5), ("Unknown", 1, 1.0)}


def test_exports(spark, tmp_path):
    name = lambda n: {"displayName": n}
    (tmp_path / "t.json").write_text(json.dumps([
        {"id": "1", "key": "PROJ-1", "fields": {"summary": "S", "description": None, "status": {"name": "Open"}, "labels": ["x"], "components": [{"name": "api"}], "created": "2026-01-02T10:00:00.000+0000", "updated": "2026-01-01T10:00:00.000+0000", "reporter": name("R"), "assignee": None,
         "comment": {"comments": [{"author": name("A"), "body": "hi", "created": "2026-01-03T00:00:00Z"}, {"author": None, "body": "yo", "created": "bad"}]}, "customfield_10016": 3, "customfield_10020": [{"name": "S1"}, {"name": " "}]}}, {"id": "2", "key": "PROJ-2", "fields": None}]))
    t = readers.read_ticket_export(spark, str(tmp_path / "t.json"))
    a, b = normalise.tickets_to_documents(t, "https://j.example/", AS_OF).orderBy("source_id").collect()
    assert a.content == "PROJ-1: S\n\n[A - 2026-01-03]: hi\n[Unknown]: yo" and a.tags == ["x", "component:api"] and a.updated_at == a.created_at
    assert a.custom["status"] == "Open" and "sprint" not in a.custom and a.url == "https://j.example/browse/PROJ-1"
    assert b.content == "PROJ-2: "
    nodes, edges = normalise.ticket_graph(t)
    assert {(r.label, r.id) for r in nodes.collect()} >= {("Person", "R"), ("Project", "PROJ")}
    assert [r.rel_type for r in edges.collect()] == ["MENTIONED_IN"]
    (tmp_path / "m.json").write_text(json.dumps([{"id": "e1", "conversationId": "c", "subject": "Hi", "body": {"content": "<p>a<br>b</p>", "contentType": "html"}, "sender": {"emailAddress": {"address": "a@x.io"}}, "receivedDateTime": "2026-03-15T09:00:00Z"}, {"id": "e2", "conversationId": "c", "subject": " Re: Hi", "body": {"content": "z", "contentType": "text"}, "sender": {"emailAddress": {"address": "b@y.io"}}, "receivedDateTime": "2026-03-15T10:00:00Z"}, {"id": "e3", "conversationId": "d", "@removed": {"reason": "deleted"}}, {"id": "e4", "@removed": {"reason": "deleted"}}]))
    live, gone, lost = sync.split_delta(readers.read_mail_export(spark, str(tmp_path / "m.json")))
    assert [r[0] for r in gone.collect()] == ["d"] and lost.count() == 1
    th = normalise.mail_threads(normalise.mail_body_text(live)).first()
    assert th.title == "Email: Hi" and th.participants == ["a@x.io", "b@y.io"] and th.email_count == 2 and "a\nb" in th.content
    assert normalise.filter_mail(live, sender_domains=["x.io"]).count() == 1
    (tmp_path / "n.json").write_text("not json")
    assert readers.read_notes_export(spark, str(tmp_path / "n.json")).count() == 0


def test_vault(spark, tmp_path):
    (tmp_path / "v" / ".trash").mkdir(parents=True)
    (tmp_path / "v" / "a b.md").write_text("---\ntitle: T\ntags: [x, y]\n---\nBody [[Z]] #q")
    (tmp_path / "v" / ".trash" / "c.md").write_text("gone")
    (tmp_path / "v" / "bad.md").write_text("---\n: [\n---\nrest")
    f = normalise.filter_vault_paths(readers.read_vault(spark, str(tmp_path / "v")), [".trash/"], [".md"])
    d = {r.source_id: r for r in normalise.vault_to_documents(f, "V", AS_OF).collect()}
    assert set(d) == {"a b.md", "bad.md"}
    assert d["a b.md"].title == "T" and d["a b.md"].tags == ["x", "y", "q"] and d["a b.md"].url.endswith("a%20b.md") and d["bad.md"].content == "rest"


def test_markdown():
    assert normalise.html_text('<h1>T</h1><ul><li data-checked="true">a</li><li>b</li></ul><script>x</script>', True) == "# T\n- [x] a\n- b"
    assert normalise.html_text(None) == ""


def test_chunks(spark):
    d = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, "a  b"), (3, " "), (4, None)], "id long, content string")
    c = chunking.chunk_documents(d, 10, 2).orderBy("document_id", "idx").collect()
    assert [(r.document_id, r.idx) for r in c] == [(1, 0), (1, 1), (1, 2), (2, 0)] and c[-1].text == "a  b"
    assert c[0].text.split()[-2:] == c[1].text.split()[:2]
    with pytest.raises(ValueError):
        chunking.chunk_documents(d, 10, 10)
    assert all(len(s.split()) <= 10 for s in chunking.sentences("One two. " * 40, 10, 3)) and chunking.sentences("", 10, 3) == []
    with pytest.raises(Exception, match="vectors for"):
        chunking.embed_chunks(chunking.chunk_documents(d), lambda t: chunking.hashing_embedder(t)[:-1]).collect()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("limit", [2, 5])
def test_fuzzy_join_is_exact(spark, limit):
    rng = random.Random(limit)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(9))) for _ in range(120)})
    df = spark.createDataFrame([("t", w) for w in words], "type string, name string")
    got = {(r.a_name, r.b_name): r.distance for r in resolution.fuzzy_join(df, df, limit).collect()}
    assert got == {(a, b): d for a in words for b in words if (d := distance(a, b)) <= limit}


def test_fuzzy_join_of_names_with_a_shared_prefix(spark):
    rng = random.Random(5)
    names = sorted({f"customer#{rng.randrange(10**6):09d}" for _ in range(3000)} | {"customer#", "customer", "custmer#000000001", ""})
    df = spark.createDataFrame([("t", w) for w in names] + [("u", names[5]), (None, "x"), ("t", None)], "type string, name string")
    resolution.fuzzy_join(df.limit(5), df.limit(5), 2).count()
    took = time.time()
    got = {(r.a_name, r.b_name): r.distance for r in resolution.fuzzy_join(df, df, 2).where("type = 't'").collect()}
    took = time.time() - took
    buckets = {}
    for w in names:  # within two edits means a common leftover
        for i in range(len(w) + 1):
            for j in range(i, len(w) + 1):
                buckets.setdefault(w[:i] + w[i + 1 : j] + w[j + 1 :], set()).add(w)
    near = {(a, b) for own in buckets.values() for a in own for b in own}
    assert got == {(a, b): d for a, b in near if (d := distance(a, b)) <= 2}
    assert took < 60, took


def test_matching_and_resolution(spark):
    m = spark.createDataFrame([(1, "person", "Bob", "X@y.z"), (2, "person", " ANN ", None), (3, "person", "Anm", ""), (4, "topic", "Ann", None)], "mention_id long, type string, name string, email string")
    n = spark.createDataFrame([(10, "person", "ann", "a@y.z"), (11, "person", "Robert", "x@Y.z")], "id long, type string, name string, email string")
    got = {r.mention_id: (r.node_id, r.method) for r in resolution.match_entities(m, n).collect()}
    assert got == {1: (11, "email"), 2: (10, "name"), 3: (10, "fuzzy"), 4: (None, None)}
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    names = spark.createDataFrame([("t", x) for x in ("kitten", "kittens", "kittensxx", "dog-house")], "type string, name string")
    assert {r.name: r.canonical for r in resolution.resolve_new(spark, names, keep).collect()} == {"kitten": "kitten", "kittens": "kitten", "kittensxx": "kitten", "dog-house": "dog-house"}


def test_extractions(spark):
    e = {"type": "person", "name": "A", "properties": {"email": "x"}, "confidence": 0.5, "source_span": "s"}
    ok = {"entities": [e], "relationships": [], "confidence": 1.0}
    raws = [json.dumps(ok), "```json\n" + json.dumps(ok) + "\n```", json.dumps(ok | {"entities": [e, e | {"confidence": 2}]}), json.dumps(ok | {"entities": [e | {"type": "alien"}]}), "oops", None]
    p = resolution.parse_extractions(spark.createDataFrame(list(enumerate(raws)), "doc_id long, raw string"))
    assert {r.doc_id: r.valid for r in p.collect()} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False}
    assert resolution.explode_entities(p).count() == 2


def test_schedule(spark):
    now = datetime(2026, 3, 15, 9)
    items = spark.createDataFrame([(1, "a", "open", now - timedelta(1), 7), (2, "b", "open", None, 7), (3, "c", "done", now, 7)], "id long, description string, status string, due_date timestamp, assignee_id long")
    edges = spark.createDataFrame([("ASSIGNED_TO", "ActionItem", 1, "Person", 7)], "rel_type string, from_label string, from_id long, to_label string, to_id long")
    p = {r.id: r for r in schedule.prioritized_items(items, edges, AS_OF).collect()}
    assert p[1].score == 41.75 and p[1].factors == ["overdue"] and p[2].score == 0 and 3 not in p
    ev = spark.createDataFrame([(i, now + timedelta(minutes=20 * i), now + timedelta(minutes=20 * i + 30)) for i in range(4)], "id long, start timestamp, stop timestamp")
    at = spark.createDataFrame([(1, i) for i in range(4)], "person_id long, event_id long")
    assert {(r.a, r.b) for r in schedule.schedule_conflicts(ev, at).collect()} == {(0, 1), (1, 2), (2, 3)}


def test_sync_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "key long, version string")
    u = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "key long, version string")
    once = sync.upsert_by_key(t, u, ["key"], [F.col("version")])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(map(tuple, sync.upsert_by_key(once, u, ["key"], [F.col("version")]).collect())) == sorted(map(tuple, once.collect()))
    empty = t.limit(0)
    assert sync.upsert_by_key(empty, empty, ["key"], [F.col("version")]).count() == 0 and sync.detect_deletes(empty, t).count() == 2


def test_contradictions(spark):
    old = spark.createDataFrame([(1, "status", "open"), (1, "description", "x")], "entity_id long, field string, value string")
    new = spark.createDataFrame([(1, "status", "done", 9), (1, "description", "y", 9)], "entity_id long, field string, value string, source_doc_id long")
    r = contradictions.detect_contradictions(old, new).collect()
    assert [(x.field_name, x.contradiction_type) for x in r] == [("status", "status")]


def test_search_forms_agree(spark):
    rng = random.Random(0)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)]
    c, q = spark.createDataFrame(rows, "chunk_id long, vector array<float>"), spark.createDataFrame(rows[:7], "query_id long, vector array<float>")
    assert sorted(map(tuple, search.cosine_topk(c, q, 5).collect())) == sorted(map(tuple, search.cosine_topk_blocks(c, q, 5, 3).collect()))
    with pytest.raises(ValueError):
        search.cosine_topk(c, q, 0)
    with pytest.raises(ValueError):
        search.filter_chunks(c, None, "2024-02-01", "2024-01-01")


def test_jaccard_and_routes(spark):
    d = spark.createDataFrame([([1, 2], [2, 3]), ([], [])], "a array<int>, b array<int>")
    assert [round(r[0], 4) for r in d.select(C.jaccard(F.col("a"), F.col("b"))).collect()] == [0.3333, 0.0]
    n = spark.createDataFrame([("x",), ("y",)], "type string")
    assert [r.target for r in proactive.route_notifications(n, {"x": "http://no"}, "https://ok").orderBy("type").collect()] == [None, "https://ok"]


def test_streams_equal_batches(spark, tmp_path):
    now = datetime(2026, 1, 1)
    rows = [("p", now + timedelta(seconds=s), e) for s, e in ((0, "a"), (1, "b"), (60, "c"))]
    spark.createDataFrame(rows, "path string, ts timestamp, event string").write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", now + timedelta(hours=1), "z")], "path string, ts timestamp, event string").write.mode("append").parquet(str(tmp_path / "in"))
    batch = jobs.debounce_batch(spark.read.parquet(str(tmp_path / "in")))
    assert {(r.path, r.event, r.n) for r in batch.collect()} == {("p", "b", 2), ("p", "c", 1), ("z", "z", 1)}
    stream = spark.readStream.schema("path string, ts timestamp, event string").parquet(str(tmp_path / "in"))
    q = jobs.debounce_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    # the last burst waits for its watermark
    assert {(r.path, r.event, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("p", "b", 2), ("p", "c", 1)}
    for _ in range(2):
        jobs.stream_ingest(stream, str(tmp_path / "kb"), str(tmp_path / "c2"), ["path"], [F.col("ts")]).awaitTermination(60)
    assert {(r.path, r.event) for r in jobs.ingested(spark, str(tmp_path / "kb"), ["path"]).collect()} == {("p", "c"), ("z", "z")}


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(1, "jira_issue")], "id long, source_type string")
    a, b = readers.write_documents(d, str(tmp_path)), readers.write_chunks(d, str(tmp_path))
    assert a != b and spark.read.parquet(a).count() == 1


def test_sources_stream(spark, tmp_path):
    schema = "id long, title string, source_type string, source_id string, created_at timestamp, content string, version long, deleted boolean"
    now, root = datetime(2026, 1, 1), str(tmp_path / "kb")

    def arrive(*rows):
        spark.createDataFrame([(i, "t", "jira_issue", "s", now, text, v, gone) for i, text, v, gone in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_sources(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), root, str(tmp_path / "c")).awaitTermination(90)

    arrive((1, "one two", 1, False), (2, "x", 1, False), (3, None, 1, False), (2, "newer", 2, False))
    assert {r.document_id: r.text for r in jobs.source_table(spark, root, "chunks").collect()} == {1: "one two", 2: "newer"}
    arrive((1, "changed", 2, False), (2, None, 3, True))
    assert {(r.chunk_id, r.text) for r in jobs.source_table(spark, root, "chunks").collect()} == {("1:0", "changed")}
    assert {r.id for r in jobs.source_table(spark, root, "nodes", "id").collect()} == {1, 3} and jobs.source_table(spark, root, "queue").count() == 2
    failing = lambda t: 1 / 0
    with pytest.raises(Exception, match="division"):
        jobs.ingest(spark.createDataFrame([(1, "t", "j", "s", now, "x")], "id long, title string, source_type string, source_id string, created_at timestamp, content string"), failing)[0].collect()


def test_meeting_scan_stream(spark, tmp_path):
    table = str(tmp_path / "n")

    def scan(at):
        return spark.createDataFrame([("meeting_prep_1",), (f"meeting_prep_{at[14:16]}",)], "id string")

    for minute in (10, 20):
        spark.createDataFrame([(datetime(2026, 1, 1, 9, minute),)], "at timestamp").write.mode("append").parquet(str(tmp_path / "ticks"))
        jobs.stream_meeting_scan(spark.readStream.schema("at timestamp").parquet(str(tmp_path / "ticks")), scan, table, str(tmp_path / "c")).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(f"{table}/batch=*").collect()) == ["meeting_prep_1", "meeting_prep_10", "meeting_prep_20"]


def test_dedupe_stream_knows_the_table(spark, tmp_path):
    spark.createDataFrame([(i % 4, datetime(2026, 1, 1)) for i in range(9)], "id long, at timestamp").write.parquet(str(tmp_path / "in"))
    s = jobs.stream_dedupe(spark.readStream.schema("id long, at timestamp").parquet(str(tmp_path / "in")), "at", "1 hour", spark.createDataFrame([(2,), (2,)], "id long"))
    s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 3]


def test_related_documents_by_rare_entities(spark):
    rng = random.Random(8)
    sets = {d: {"hot"} | {f"e{rng.randrange(40)}" for _ in range(rng.randrange(12))} for d in range(150)}
    sets |= {200 + d: sets[d] | {"extra"} for d in range(20)} | {300: set()}
    e = spark.createDataFrame([(d, "Topic", x) for d, own in sets.items() for x in own], "document_id long, label string, id string")
    new = spark.createDataFrame([(d,) for d in range(0, 150, 5)] + [(300,), (None,)], "document_id long")
    for t in (0.05, 0.5, 0.7, 2 / 3, 1.0):
        want = {(a, b): (n := len(sets[a] & sets[b]), round(n / len(sets[a]), 6)) for a in range(0, 150, 5) for b in sets if a != b}
        got = {(r.document_id, r.other_id): (r.shared, r.score) for r in proactive.related_documents(new, e, t).collect()}
        assert got == {k: v for k, v in want.items() if v[1] >= t and v[0]}
    j = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in range(0, 150, 5) for b in sets if a != b}
    assert {(r.document_id, r.other_id): r.score for r in proactive.jaccard_pairs(e, new, 0.6).collect()} == {k: v for k, v in j.items() if v >= 0.6}


def test_null_vectors_score_zero(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [])], "chunk_id long, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    want = [(1, 1, 1.0, 1), (1, 2, 0.0, 2), (1, 3, 0.0, 3), (2, 1, 0.0, 1), (2, 2, 0.0, 2), (2, 3, 0.0, 3)]
    for f in (search.cosine_topk, search.cosine_topk_blocks):
        assert sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in f(c, q, 3).collect()) == want
    assert sorted((r.query_id, r.chunk_id) for r in search.cosine_topk_blocks(c, q, 3, chunk_block=1).collect()) == [(a, b) for a in (1, 2) for b in (1, 2, 3)]
