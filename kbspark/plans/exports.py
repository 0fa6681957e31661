"""Queries of parsers, normalisers, extraction output and ingestion, over columns made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph, normalise, resolution, sync
from ..streaming import jobs
from .queries import _CHUNKS, joined, register, uuid_sql
from .views import MEETING_AS_OF, Views

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
NAMED, PERSON = "struct<name:string>", "struct<displayName:string>"


# --- mail -----------------------------------------------------------------------------------------------------------


def mails(v: Views) -> DataFrame:
    """Mails in folders, some from another domain or without a sender, some removed."""
    sender = F.when(F.col("mail_id") % 5 != 4, F.concat(F.col("sender"), F.lit("@"), F.when(F.col("conversation_id") % 2 == 0, "x.io").otherwise("y.io")))
    return v.mail.withColumns({"sender": sender, "folder_id": F.col("mail_id") % 5, "received": F.date_format("received", ISO), "removed": F.when(F.col("conversation_id") % 4 == 3, "deleted")})


register("filter_mail", lambda v: normalise.filter_mail(mails(v), v.table("region").select(F.col("r_regionkey").cast("long").alias("folder_id"), F.col("r_name").alias("name")), ["AFRICA", "ASIA", "EUROPE"], ["ASIA"], ["x.io"], "2024-01-20").select("conversation_id", "mail_id"), "kb_mail",
         "SELECT conversation_id, mail_id FROM kb_mail JOIN region ON r_regionkey = mail_id % 5 WHERE r_name IN ('AFRICA', 'EUROPE') AND mail_id % 5 <> 4 AND conversation_id % 2 = 0 AND received >= TIMESTAMP '2024-01-20'")
register("split_delta", lambda v: sync.split_delta(mails(v).withColumn("conversation_id", F.col("conversation_id").cast("string")), v.message.where("session_id % 7 = 0").select(F.col("session_id").cast("string").alias("conversation_id")))[1].select("conversation_id"), None,
         "SELECT DISTINCT conv_id::VARCHAR AS conversation_id FROM conversations WHERE conv_id % 4 = 3 OR conv_id % 7 = 0")

# --- meetings -------------------------------------------------------------------------------------------------------

_LINE = "trim(regexp_replace(coalesce(content, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')"


def line(c: str) -> F.Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\r\f\x0B]+", " "))


def segments(v: Views) -> DataFrame:
    """A transcript of each session, a cue a turn, parsed again."""
    second = F.lpad((F.col("timestamp") % 60).cast("string"), 2, "0")
    cue = F.concat(F.lit("00:00:"), second, F.lit(".000 --> 00:00:"), second, F.lit(".500\n<v "), F.col("role"), F.lit(">"), line("content"), F.lit("</v>"))
    t = v.message.groupBy(F.col("session_id").alias("meeting_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "role", cue.alias("cue")))), lambda x: x.cue), "\n\n").alias("cues"))
    return normalise.parse_vtt_segments(t.select("meeting_id", F.concat(F.lit("WEBVTT\n\n"), "cues").alias("text")))


_SEGMENTS = f"+ s AS (SELECT session_id AS meeting_id, timestamp, role AS speaker, '00:00:' || lpad((timestamp % 60)::VARCHAR, 2, '0') || '.000' AS start, {_LINE} AS text FROM kb_message), seg AS (SELECT * FROM s WHERE text <> '') "
register("parse_vtt_segments", lambda v: segments(v).select("meeting_id", "speaker", "start", F.md5("text").alias("digest")), "kb_message", _SEGMENTS + "SELECT meeting_id, speaker, start, md5(text) AS digest FROM seg")
register("transcript_text", lambda v: normalise.transcript_text(segments(v)).select("meeting_id", F.md5("transcript").alias("digest")), "kb_message", _SEGMENTS + "SELECT meeting_id, md5(string_agg(speaker || ': ' || text || chr(10), '' ORDER BY timestamp, speaker)) AS digest FROM seg GROUP BY 1")
register("speaker_stats", lambda v: normalise.speaker_stats(segments(v)), "kb_message", _SEGMENTS + "SELECT meeting_id, speaker, count(*) AS utterances, sum(len(string_split(text, ' ')))::BIGINT AS words, round(count(*) * 0.5::DOUBLE, 3) AS seconds FROM seg GROUP BY ALL")


def meeting_export(v: Views) -> DataFrame:
    start = F.expr("timestampadd(HOUR, meeting_id, timestamp'2024-01-01')")
    person = F.struct(F.struct(F.struct(F.concat(F.lit("P"), F.col("meeting_id").cast("string")).alias("displayName")).alias("user")).alias("identity"))
    ids = v.message.select(F.col("session_id").alias("meeting_id")).distinct()
    return ids.select("meeting_id", F.when(F.col("meeting_id") % 5 != 0, F.concat(F.lit("S"), F.col("meeting_id").cast("string"))).alias("subject"), F.date_format(start, ISO).alias("startDateTime"), F.date_format(start + F.expr("interval 45 minutes"), ISO).alias("endDateTime"), F.array(person).alias("attendees"), F.lit(None).cast("string").alias("joinWebUrl"))


register("meetings_to_documents", lambda v: normalise.meetings_to_documents(meeting_export(v), normalise.transcript_text(segments(v)), MEETING_AS_OF).select(F.col("source_id").cast("long").alias("source_id"), "title", F.md5("content").alias("digest"), joined("participants"), F.unix_seconds("created_at").alias("created"), F.col("custom")["duration_minutes"].alias("minutes")), "kb_message",
         _SEGMENTS + "SELECT meeting_id AS source_id, 'Meeting: ' || CASE WHEN meeting_id % 5 = 0 THEN 'Untitled Meeting' ELSE 'S' || meeting_id END AS title, md5(string_agg(speaker || ': ' || text || chr(10), '' ORDER BY timestamp, speaker)) AS digest, 'P' || meeting_id AS participants, epoch(TIMESTAMP '2024-01-01')::BIGINT + 3600 * meeting_id AS created, '45' AS minutes FROM seg GROUP BY meeting_id")


def calendar_export(v: Views) -> DataFrame:
    named = lambda x: F.struct(F.struct(x.alias("address"), F.lit(None).cast("string").alias("name")).alias("emailAddress"))
    at = lambda m: F.struct(F.date_format(F.col("ts").cast("timestamp") + F.expr(f"interval {m} minutes"), ISO).alias("dateTime"))
    user = F.col("user_id").cast("string")
    return v.table("events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("subject"), at(0).alias("start"), at(30).alias("end"), F.struct(F.lit(None).cast("string").alias("content")).alias("body"),
                                    named(F.concat(F.lit("u"), user)).alias("organizer"), F.array(named(F.concat(F.lit("v"), user)), named(F.concat(F.lit("u"), user)), named(F.lit(" "))).alias("attendees"), F.lit(None).cast("string").alias("webLink"), F.lit(None).cast("boolean").alias("isOnlineMeeting"), F.lit(None).cast("string").alias("recurrence"))


register("calendar_to_documents", lambda v: normalise.calendar_to_documents(calendar_export(v), MEETING_AS_OF).select(F.col("source_id").cast("long").alias("source_id"), "title", "content", "author", joined("participants"), F.unix_seconds("created_at").alias("created"), F.col("custom")["duration_minutes"].alias("minutes")), None,
         "SELECT event_id AS source_id, CASE event_type WHEN 'error' THEN 'No Title' ELSE event_type END AS title, 'Calendar Event: ' || CASE event_type WHEN 'error' THEN 'No Title' ELSE event_type END AS content, 'u' || user_id AS author, 'u' || user_id || '|v' || user_id AS participants, epoch_us(ts) // 1000000 AS created, '30' AS minutes FROM events")

# --- tickets --------------------------------------------------------------------------------------------------------


def tickets(v: Views) -> DataFrame:
    key, who = F.concat(F.lit("P-"), F.col("o_orderkey").cast("string")), lambda x: F.struct(x.cast("string").alias("displayName"))
    n, created = F.col("o_orderkey"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'.000+0000'")
    named = lambda x: F.struct(x.cast("string").alias("name"))
    note = F.struct(who(F.when(n % 2 == 0, F.lit("A"))).alias("author"), F.lit("done").alias("body"), created.alias("created"))
    fields = F.struct(
        F.col("o_orderpriority").alias("summary"), F.when(n % 3 == 0, F.lit("more")).alias("description"), named(F.col("o_orderstatus")).alias("status"), named(F.lit("Task")).alias("issuetype"), named(F.lit(None)).alias("priority"),
        who(F.col("o_custkey")).alias("reporter"), who(F.when(n % 4 != 0, F.col("o_custkey") + 1)).alias("assignee"), F.array(F.lit("l")).alias("labels"), F.array(named(F.lit("api")), named(F.lit(None))).alias("components"), created.alias("created"), created.alias("updated"),
        F.struct(F.array(note).alias("comments")).alias("comment"), F.struct(F.when(n % 5 == 0, F.concat(F.lit("P-"), (n + 1).cast("string"))).alias("key")).alias("parent"), F.lit("3").alias("customfield_10016"), F.array(named(F.lit("S1"))).alias("customfield_10020"))
    return v.table("orders").select(key.alias("key"), fields.alias("fields"))


register("tickets_to_documents", lambda v: normalise.tickets_to_documents(tickets(v), "https://j.example/", MEETING_AS_OF).select("source_id", "title", F.md5("content").alias("digest"), joined("tags"), joined("participants"), "url", F.unix_seconds("created_at").alias("created"), F.col("custom")["sprint"].alias("sprint"), F.col("custom")["story_points"].alias("points")), None,
         "SELECT 'P-' || o_orderkey AS source_id, 'P-' || o_orderkey || ': ' || o_orderpriority AS title, md5(concat_ws(chr(10) || chr(10), 'P-' || o_orderkey || ': ' || o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'more' END, '[' || CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'Unknown' END || ' - ' || strftime(o_orderdate, '%Y-%m-%d') || ']: done')) AS digest, 'l|component:api' AS tags, concat_ws('|', o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey + 1 END) AS participants, 'https://j.example/browse/P-' || o_orderkey AS url, epoch(o_orderdate::TIMESTAMP)::BIGINT AS created, 'S1' AS sprint, '3.0' AS points FROM orders")
register("ticket_graph", lambda v: normalise.ticket_graph(tickets(v))[1], None,
         f"SELECT 'MENTIONED_IN' AS rel_type, 'Person' AS from_label, o_custkey::VARCHAR AS from_id, 'Document' AS to_label, {uuid_sql('jira_issue', chr(39) + 'P-' + chr(39) + ' || o_orderkey')} AS to_id FROM orders UNION ALL SELECT 'ASSIGNED_TO' AS rel_type, 'ActionItem' AS from_label, 'P-' || o_orderkey AS from_id, 'Person' AS to_label, (o_custkey + 1)::VARCHAR AS to_id FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'BLOCKS', 'ActionItem', 'P-' || (o_orderkey + 1), 'ActionItem', 'P-' || o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
register("ticket_nodes", lambda v: normalise.ticket_graph(tickets(v))[0], None,
         "SELECT 'ActionItem' AS label, 'P-' || o_orderkey AS id FROM orders UNION SELECT 'Person', o_custkey::VARCHAR FROM orders UNION SELECT 'Person', (o_custkey + 1)::VARCHAR FROM orders WHERE o_orderkey % 4 <> 0 UNION SELECT 'Project', 'P' FROM orders UNION SELECT 'Topic', 'S1' FROM orders")

# --- notes ----------------------------------------------------------------------------------------------------------


def notes(v: Views) -> DataFrame:
    """A note of each document: links, an embed, a callout, tags and code before its whole text."""
    k = F.col("id").cast("string")
    head = F.concat(F.lit("![[img"), k, F.lit("|x]] [[ "), F.col("source_id"), F.lit(" |shown]] [[ ]] `[[code]] #no`\n~~~\n#no [[no]]\n~~~\n> [!note] T"), k, F.lit(" \n#v1."), k, F.lit(" #"), F.col("source_id"), F.lit("/é\n"))
    return v.document.select("id", "source_id", "title", "content", F.concat(head, F.coalesce("content", F.lit(""))).alias("text"))


_WORD = "[\\p{L}\\p{M}\\p{Nd}\\p{Pc}/]"
_TAGS = f"list_filter(list_transform(regexp_split_to_array(coalesce(content, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: regexp_extract(x, '^#({_WORD}(?:{_WORD}|[.-])*)', 1)), lambda x: x <> '')"
register("extract_tags", lambda v: notes(v).select("id", F.array_join(F.array_sort(C.extract_tags(F.col("text"), F.array("source_id"))), "|").alias("tags")), "kb_document",
         f"SELECT id, array_to_string(list_sort(list_distinct([source_id, 'v1.' || id, source_id || '/é'] || {_TAGS})), '|') AS tags FROM kb_document")
register("extract_wikilinks", lambda v: notes(v).select("id", F.array_join(C.extract_wikilinks(F.col("text")), "|").alias("links"), F.array_join(C.extract_embeds(F.col("text")), "|").alias("embeds"), F.array_join(F.transform(C.extract_callouts(F.col("text")), lambda c: F.concat(c["type"], F.lit(":"), c["title"])), "|").alias("callouts")), "kb_document",
         "SELECT id, source_id AS links, 'img' || id AS embeds, 'NOTE:T' || id AS callouts FROM kb_document")
register("strip_note_syntax", lambda v: notes(v).select("id", F.md5(C.strip_note_syntax(F.concat(F.lit(" "), F.col("text")))).alias("digest")), "kb_document",
         f"SELECT id, md5(regexp_replace(regexp_replace('shown  `code no`' || chr(10) || '~~~' || chr(10) || 'no no' || chr(10) || '~~~' || chr(10) || '> [!note] T' || id || ' ' || chr(10) || 'v1.' || id || ' ' || source_id || '/é' || chr(10) || regexp_replace(' ' || coalesce(content, ''), '(^|[ \\t\\n\\r\\f\\v])#({_WORD})', '\\1\\2', 'g')[2:], '^[ \\t\\n\\r\\f\\v]+', ''), '[ \\t\\n\\r\\f\\v]+$', '')) AS digest FROM kb_document")


def vault_files(v: Views) -> DataFrame:
    """A file of each document: with front matter, with malformed front matter, or without."""
    k = F.col("id").cast("string")
    good = F.concat(F.lit('---\ntitle: "Note '), k, F.lit('"\ntags: [b'), k, F.lit(", a]\nn: 3\n---\n"))
    head = F.when(F.col("id") % 3 == 0, good).when(F.col("id") % 3 == 1, "---\n: [bad\n---\n").otherwise("")
    return v.document.select(F.concat(F.lit("Notes/"), "source_id", F.lit("/n"), k, F.lit(".md")).alias("path"), F.lit(MEETING_AS_OF).cast("timestamp").alias("mtime"), F.concat(head, F.lit("Start "), F.coalesce("content", F.lit(""))).alias("text"), "id")


register("parse_front_matter", lambda v: normalise.parse_front_matter(vault_files(v)).select("id", F.col("front")["title"].alias("title"), F.col("front")["tags"].alias("tags"), F.col("front")["n"].alias("n"), F.md5("body").alias("digest")), "kb_document",
         """SELECT id, CASE WHEN id % 3 = 0 THEN 'Note ' || id END AS title, CASE WHEN id % 3 = 0 THEN '["b' || id || '", "a"]' END AS tags, CASE WHEN id % 3 = 0 THEN '3' END AS n, md5('Start ' || coalesce(content, '')) AS digest FROM kb_document""")
register("vault_to_documents", lambda v: normalise.vault_to_documents(vault_files(v), "V", MEETING_AS_OF).select("id", "title", "source_id", "url", F.array_join(F.slice("tags", 1, 2), "|").alias("tags"), F.unix_seconds("created_at").alias("created")).withColumn("tags", F.when(F.col("title").startswith("Note "), F.col("tags"))), "kb_document",
         f"SELECT {uuid_sql('obsidian', chr(39) + 'Notes/' + chr(39) + ' || source_id || ' + chr(39) + '/n' + chr(39) + ' || id || ' + chr(39) + '.md' + chr(39))} AS id, CASE WHEN id % 3 = 0 THEN 'Note ' || id ELSE 'n' || id END AS title, 'Notes/' || source_id || '/n' || id || '.md' AS source_id, 'obsidian://open?vault=V&file=Notes%2F' || source_id || '%2Fn' || id || '.md' AS url, CASE WHEN id % 3 = 0 THEN 'b' || id || '|a' END AS tags, epoch(TIMESTAMP '{MEETING_AS_OF}')::BIGINT AS created FROM kb_document")
register("filter_vault_paths", lambda v: normalise.filter_vault_paths(v.table("documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".MD").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".txt"))).alias("path")), ["src1*", "fr/"], [".md"]), None,
         "SELECT concat_ws('/', source, lang, doc_id || CASE doc_id % 3 WHEN 0 THEN '.MD' ELSE '.md' END) AS path FROM documents WHERE NOT starts_with(coalesce(source, ''), 'src1') AND coalesce(lang, '') <> 'fr' AND doc_id % 3 <> 2")
register("link_edges", lambda v: graph.link_edges(v.document.select("id", F.concat(F.lit("T"), (F.col("id") % 500).cast("string")).alias("title"), F.array(F.concat(F.lit("t"), ((F.col("id") * 7) % 500).cast("string")), F.lit("nowhere")).alias("links"))).select("from_id", "to_id"), None,
         "WITH t AS (SELECT doc_id % 500 AS k, min(doc_id) AS to_id FROM documents GROUP BY 1) SELECT doc_id AS from_id, to_id FROM documents JOIN t ON k = (doc_id * 7) % 500 WHERE doc_id <> to_id")
register("parse_offset_timestamp", lambda v: v.table("events").select("event_id", F.unix_seconds(C.parse_offset_timestamp(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+0530").otherwise("-02:00")))).alias("at")), None,
         "SELECT event_id, epoch_us(ts) // 1000000 - CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 19800 ELSE -7200 END AS at FROM events")
register("document_id", lambda v: v.document.select("id", C.document_id("apple_note", F.col("id").cast("string")).alias("uuid")), "kb_document", f"SELECT id, {uuid_sql('apple_note', 'id::VARCHAR')} AS uuid FROM kb_document")

# --- extraction -----------------------------------------------------------------------------------------------------


def extractions(v: Views) -> DataFrame:
    """A model's reply for each customer: two entities and a relationship; each tenth has a bad confidence, each seventh is fenced."""
    k = F.col("c_custkey")
    sure = F.when(k % 10 == 9, 2.0).otherwise(0.5)
    entity = lambda kind, name, props: F.struct(F.lit(kind).alias("type"), name.alias("name"), props.alias("properties"), sure.alias("confidence"), F.lit("span").alias("source_span"))
    entities = F.array(entity("person", F.col("c_name"), F.create_map(F.lit("email"), F.concat(F.lit("e"), k.cast("string")))), entity("topic", F.col("c_mktsegment"), F.create_map(F.lit("keywords"), F.lit('["k"]'))))
    relation = F.struct(F.col("c_name").alias("source_entity"), F.when(k % 2 == 0, "TAGGED_WITH").otherwise("RELATED_TO").alias("relationship_type"), F.col("c_mktsegment").alias("target_entity"), F.lit(0.75).alias("confidence"), F.lit("c").alias("context"))
    reply = F.to_json(F.struct(entities.alias("entities"), F.array(relation).alias("relationships"), F.lit(1.0).alias("confidence")))
    return v.table("customer").select(k.alias("doc_id"), F.when(k % 7 == 0, F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).otherwise(reply).alias("raw"))


def parsed(v: Views) -> DataFrame:
    return resolution.parse_extractions(extractions(v))


def named_entities(v: Views) -> DataFrame:
    """Exploded entities with ids: persons by document, topics by name."""
    e = resolution.explode_entities(parsed(v))
    return e.withColumn("entity_id", F.when(F.col("type") == "person", F.concat(F.lit("p"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("t"), "name")))


register("parse_extractions", lambda v: parsed(v).select("doc_id", "valid", F.size("entities").alias("n_entities"), F.size("relationships").alias("n_relationships")), None,
         "SELECT c_custkey AS doc_id, c_custkey % 10 <> 9 AS valid, CASE WHEN c_custkey % 10 <> 9 THEN 2 ELSE 0 END AS n_entities, CASE WHEN c_custkey % 10 <> 9 THEN 1 ELSE 0 END AS n_relationships FROM customer")
register("explode_entities", lambda v: resolution.explode_entities(parsed(v)).select("doc_id", "position", "type", "name", "confidence"), None,
         "SELECT c_custkey AS doc_id, unnest([0, 1]) AS position, unnest(['person', 'topic']) AS type, unnest([c_name, c_mktsegment]) AS name, 0.5::DOUBLE AS confidence FROM customer WHERE c_custkey % 10 <> 9")
register("explode_relationships", lambda v: resolution.explode_relationships(parsed(v)).select("doc_id", "position", "source_entity", "relationship_type", "target_entity"), None,
         "SELECT c_custkey AS doc_id, 0 AS position, c_name AS source_entity, CASE WHEN c_custkey % 2 = 0 THEN 'TAGGED_WITH' ELSE 'RELATED_TO' END AS relationship_type, c_mktsegment AS target_entity FROM customer WHERE c_custkey % 10 <> 9")
register("build_nodes", lambda v: resolution.build_nodes(named_entities(v).dropDuplicates(["entity_id"]), MEETING_AS_OF).select("id", "type", "name", "email", joined("keywords"), joined("aliases")), None,
         "SELECT 'p' || c_custkey AS id, 'person' AS type, c_name AS name, 'e' || c_custkey AS email, NULL AS keywords, '' AS aliases FROM customer WHERE c_custkey % 10 <> 9 UNION ALL SELECT DISTINCT 't' || c_mktsegment, 'topic', c_mktsegment, NULL, 'k', NULL FROM customer WHERE c_custkey % 10 <> 9")


def built_edges(v: Views) -> DataFrame:
    e = named_entities(v)
    kinds = v.table("region").where("r_regionkey = 0").select(F.lit("TAGGED_WITH").alias("rel_type"), F.lit("person").alias("from_label"), F.lit("topic").alias("to_label"))
    return resolution.build_edges(resolution.explode_relationships(parsed(v)), e.select("doc_id", "name", F.col("entity_id").alias("id")), kinds, e.select(F.col("entity_id").alias("id"), "type").distinct())


register("build_edges", lambda v: built_edges(v).select("rel_type", "from_id", "to_id", "confidence"), None,
         "SELECT 'TAGGED_WITH' AS rel_type, 'p' || c_custkey AS from_id, 't' || c_mktsegment AS to_id, 0.75::DOUBLE AS confidence FROM customer WHERE c_custkey % 10 <> 9 AND c_custkey % 2 = 0")

# --- ingestion ------------------------------------------------------------------------------------------------------

register("reindex", lambda v: sync.reindex(v.snapshot, v.state).select("key", "version"), "snapshot state", "SELECT s.key, s.version FROM snapshot s LEFT JOIN state t ON t.key = s.key WHERE t.key IS NULL OR t.version <> s.version")
register("ingest", lambda v: jobs.ingest(v.document)[0].select("chunk_id", "document_id", F.md5("text").alias("digest"), "source_type", F.size("vector").alias("width")), "kb_document", _CHUNKS + "SELECT document_id || ':' || idx AS chunk_id, document_id, md5(text) AS digest, source_type, 64 AS width FROM ch JOIN kb_document ON id = document_id")
register("ingest_queue", lambda v: jobs.ingest(v.document)[2], "kb_document", "SELECT id AS document_id, 'pending' AS status, 0 AS attempts FROM kb_document")
