"""Knowledge-base views of the driver's tables, as DataFrames and as the same SELECTs for DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The source types, in the order of their enumeration.
SOURCE_TYPES = ("teams_transcript", "obsidian_note", "outlook_email", "outlook_calendar", "jira_issue", "apple_note")
#: Labels of both ends, and the view, of each relation.
ENDS = {"TAGGED_WITH": ("Document", "Topic", "tagged_with"), "RELATED_TO": ("Document", "Document", "related_to"), "ASSIGNED_TO": ("ActionItem", "Person", "assigned_to"),
        "BLOCKS": ("ActionItem", "ActionItem", "blocks"), "ATTENDED": ("Person", "Meeting", "attended"), "MENTIONED_IN": ("Person", "Document", "mentioned_in")}
SCHEDULE_AS_OF = "2001-07-25 00:00:00"
MEETING_AS_OF = "2024-01-15 10:00:00"


def ts(x: str):
    return F.lit(x).cast("timestamp")


class Views:
    """Views over one directory of tables; nothing is read before a view is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def document(self) -> DataFrame:
        types = F.array(*map(F.lit, SOURCE_TYPES))
        return self.table("documents").select(
            F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.element_at(types, (F.col("doc_id") % 6 + 1).cast("int")).alias("source_type"),
            F.col("source").alias("source_id"), F.array("lang", "source").alias("tags"), F.expr("timestampadd(HOUR, doc_id, timestamp'2024-01-01')").alias("created_at"), F.col("text").alias("content"))

    @cached_property
    def chunk(self) -> DataFrame:
        e = self.table("embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 3").alias("document_id"), F.col("embedding").alias("vector"), F.expr("int(vec_id % 3)").alias("part"))
        d = self.document.select(F.col("id").alias("document_id"), "title", "source_type", "source_id", "created_at", "content")
        # a document's three chunks are the thirds of its text
        n = F.length("content")
        cut = lambda k: F.floor(n * k / 3).cast("int")
        text = F.substring(F.col("content"), cut(F.col("part")) + 1, cut(F.col("part") + 1) - cut(F.col("part")))
        return e.join(d, "document_id").withColumns({"text": text, "url": F.when(F.col("source_type") == "jira_issue", F.concat(F.lit("https://example.org/"), F.col("document_id").cast("string")))}).drop("content", "part")

    @cached_property
    def query(self) -> DataFrame:
        """The whole query set of a search: every row whose id is divisible by 100."""
        return self.table("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))

    @cached_property
    def tagged_with(self) -> DataFrame:
        return self.table("embeddings").select(F.expr("vec_id div 3").alias("from_id"), F.col("label").cast("long").alias("to_id")).distinct()

    @cached_property
    def topic(self) -> DataFrame:
        return self.table("embeddings").select(F.col("label").cast("long").alias("id")).distinct().withColumn("name", F.concat(F.lit("topic-"), F.col("id").cast("string")))

    @cached_property
    def related_to(self) -> DataFrame:
        d = self.table("documents").select(F.col("doc_id").alias("from_id"))
        e = d.where("from_id % 4 < 2").select("from_id", (F.col("from_id") + 1).alias("to_id")).union(d.where("from_id % 5 = 0").select("from_id", (F.col("from_id") + 7).alias("to_id")))
        return e.join(d.select(F.col("from_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id")

    @cached_property
    def person(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lower("c_name"), F.lit("@example.com"))).alias("email"))

    @cached_property
    def action_item(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("done")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("description"),
            status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("due_date"), F.col("o_custkey").alias("assignee_id"))

    @cached_property
    def assigned_to(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("from_id"), F.col("o_custkey").alias("to_id"))

    @cached_property
    def blocks(self) -> DataFrame:
        o = self.table("orders").select(F.col("o_orderkey").alias("from_id"))
        return o.where("from_id % 5 = 0").withColumn("to_id", F.col("from_id") + 1).join(o.select(F.col("from_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id")

    @cached_property
    def meeting(self) -> DataFrame:
        return self.table("events").where("event_type = 'view'").select(
            F.col("event_id").alias("id"), F.concat(F.lit("meeting "), F.col("event_id").cast("string")).alias("title"), F.col("ts").cast("timestamp").alias("date"), F.lit(30).alias("duration_minutes"))

    @cached_property
    def attended(self) -> DataFrame:
        e = self.table("events").where("event_type = 'view'")
        return e.select(F.col("user_id").alias("from_id"), F.col("event_id").alias("to_id")).union(e.select((F.col("user_id") + 1).alias("from_id"), F.col("event_id").alias("to_id")))

    @cached_property
    def mentioned_in(self) -> DataFrame:
        n = self.table("documents").agg(F.count(F.lit(1)).alias("n"))
        o = self.table("orders").select("o_orderkey", "o_custkey")
        li = self.table("lineitem").select("l_orderkey", "l_partkey")
        return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).crossJoin(F.broadcast(n)).select(F.col("o_custkey").alias("from_id"), (F.col("l_partkey") % F.col("n")).alias("to_id")).distinct()

    @cached_property
    def edges(self) -> DataFrame:
        """All relations: rel_type, from_label, from_id, to_label, to_id."""
        out = None
        for r in ENDS:
            out = self.relation(r) if out is None else out.unionByName(self.relation(r))
        return out

    def relation(self, rel_type: str) -> DataFrame:
        """The edges of one type, so that a query reads no others."""
        a, b, name = ENDS[rel_type]
        return getattr(self, name).select(F.lit(rel_type).alias("rel_type"), F.lit(a).alias("from_label"), "from_id", F.lit(b).alias("to_label"), "to_id")

    @cached_property
    def nodes(self) -> DataFrame:
        """All nodes: label, id, name."""
        parts = (("Person", self.person, "name"), ("Topic", self.topic, "name"), ("ActionItem", self.action_item, "description"), ("Meeting", self.meeting, "title"), ("Document", self.document, "title"))
        rows = [d.select(F.lit(k).alias("label"), "id", F.col(c).alias("name")) for k, d, c in parts]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    @cached_property
    def message(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("timestamp"), "role", F.col("text").alias("content"))

    @cached_property
    def mail(self) -> DataFrame:
        c = self.table("conversations")
        first = c.where("turn = 0").select("conv_id", F.substring("text", 1, 30).alias("first"))
        return c.join(first, "conv_id").select(
            F.col("conv_id").alias("conversation_id"), F.col("turn").alias("mail_id"), F.expr("timestampadd(MINUTE, turn, timestampadd(DAY, conv_id, timestamp'2024-01-01'))").alias("received"),
            F.col("role").alias("sender"), F.concat(F.when(F.col("turn") > 0, "Re: ").otherwise(""), F.col("first")).alias("subject"), F.col("text").alias("body"))

    @cached_property
    def notification(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), (F.col("value") < 100).alias("read"), F.col("ts").cast("timestamp").alias("created_at"))

    @cached_property
    def snapshot(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("key"), F.col("n_chars").cast("string").alias("version"), "text")

    @cached_property
    def state(self) -> DataFrame:
        d = self.table("documents")
        kept = d.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 10 == 5, F.col("n_chars") + 1).otherwise(F.col("n_chars")).cast("string").alias("version"))
        gone = d.where("doc_id % 50 = 0").select((-1 - F.col("doc_id")).alias("key"), F.lit("0").alias("version"))
        return kept.union(gone)

    @cached_property
    def facts(self) -> tuple[DataFrame, DataFrame]:
        """(existing, incoming): entity_id, field, value, and the source document of the incoming ones."""
        a = self.action_item
        value = lambda status, who: F.inline(F.array(
            F.struct(F.lit("status").alias("field"), status.alias("value")), F.struct(F.lit("due_date").alias("field"), F.date_format("due_date", "yyyy-MM-dd").alias("value")),
            F.struct(F.lit("assignee_id").alias("field"), who.cast("string").alias("value")), F.struct(F.lit("description").alias("field"), F.col("description").alias("value"))))
        old = a.select(F.col("id").alias("entity_id"), value(F.col("status"), F.col("assignee_id")))
        b = a.where("id % 10 = 0").withColumn("description", F.lit("changed"))
        new = b.select(F.col("id").alias("entity_id"), (F.col("id") % 1000).alias("source_doc_id"), value(F.lit("done"), F.col("assignee_id") + 1))
        return old, new


#: The same views for DuckDB; queries name those they use.
SQL = {
    "kb_document": "SELECT doc_id AS id, substr(text, 1, 40) AS title, " + str(list(SOURCE_TYPES)) + "[doc_id % 6 + 1] AS source_type, source AS source_id, [lang, source] AS tags, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at, text AS content FROM documents",
    "kb_chunk": "SELECT e.vec_id AS chunk_id, e.vec_id // 3 AS document_id, e.embedding AS vector, d.title, d.source_type, d.source_id, CASE WHEN d.source_type = 'jira_issue' THEN 'https://example.org/' || d.id END AS url, d.created_at, substr(d.content, (length(d.content) * (e.vec_id % 3)) // 3 + 1, (length(d.content) * (e.vec_id % 3 + 1)) // 3 - (length(d.content) * (e.vec_id % 3)) // 3) AS text FROM embeddings e JOIN kb_document d ON d.id = e.vec_id // 3",
    "kb_query": "SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0",
    "tagged_with": "SELECT DISTINCT vec_id // 3 AS from_id, label::BIGINT AS to_id FROM embeddings",
    "kb_topic": "SELECT DISTINCT label::BIGINT AS id, 'topic-' || label AS name FROM embeddings",
    "related_to": "SELECT * FROM (SELECT doc_id AS from_id, doc_id + 1 AS to_id FROM documents WHERE doc_id % 4 < 2 UNION ALL SELECT doc_id, doc_id + 7 FROM documents WHERE doc_id % 5 = 0) WHERE to_id IN (SELECT doc_id FROM documents)",
    "kb_person": "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN lower(c_name) || '@example.com' END AS email FROM customer",
    "kb_action_item": "SELECT o_orderkey AS id, 'order ' || o_orderkey || ' ' || o_orderpriority AS description, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'done' END AS status, o_orderdate::TIMESTAMP AS due_date, o_custkey AS assignee_id FROM orders",
    "assigned_to": "SELECT o_orderkey AS from_id, o_custkey AS to_id FROM orders",
    "blocks": "SELECT o_orderkey AS from_id, o_orderkey + 1 AS to_id FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey + 1 IN (SELECT o_orderkey FROM orders)",
    "kb_meeting": "SELECT event_id AS id, 'meeting ' || event_id AS title, ts::TIMESTAMP AS date, 30 AS duration_minutes FROM events WHERE event_type = 'view'",
    "attended": "SELECT user_id AS from_id, event_id AS to_id FROM events WHERE event_type = 'view' UNION ALL SELECT user_id + 1, event_id FROM events WHERE event_type = 'view'",
    "mentioned_in": "SELECT DISTINCT o_custkey AS from_id, l_partkey % (SELECT count(*) FROM documents) AS to_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "edges": "SELECT 'TAGGED_WITH' AS rel_type, 'Document' AS from_label, from_id, 'Topic' AS to_label, to_id FROM tagged_with UNION ALL SELECT 'RELATED_TO', 'Document', from_id, 'Document', to_id FROM related_to UNION ALL SELECT 'ASSIGNED_TO', 'ActionItem', from_id, 'Person', to_id FROM assigned_to UNION ALL SELECT 'BLOCKS', 'ActionItem', from_id, 'ActionItem', to_id FROM blocks UNION ALL SELECT 'ATTENDED', 'Person', from_id, 'Meeting', to_id FROM attended UNION ALL SELECT 'MENTIONED_IN', 'Person', from_id, 'Document', to_id FROM mentioned_in",
    "nodes": "SELECT 'Person' AS label, id, name FROM kb_person UNION ALL SELECT 'Topic', id, name FROM kb_topic UNION ALL SELECT 'ActionItem', id, description FROM kb_action_item UNION ALL SELECT 'Meeting', id, title FROM kb_meeting UNION ALL SELECT 'Document', id, title FROM kb_document",
    "kb_message": "SELECT conv_id AS session_id, turn AS timestamp, role, text AS content FROM conversations",
    "kb_mail": "SELECT c.conv_id AS conversation_id, c.turn AS mail_id, TIMESTAMP '2024-01-01' + to_days(c.conv_id::INT) + to_minutes(c.turn) AS received, c.role AS sender, CASE WHEN c.turn > 0 THEN 'Re: ' ELSE '' END || substr(f.text, 1, 30) AS subject, c.text AS body FROM conversations c JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0",
    "kb_notification": "SELECT event_id AS id, event_type AS type, value < 100 AS read, ts::TIMESTAMP AS created_at FROM events",
    "snapshot": "SELECT doc_id AS key, n_chars::VARCHAR AS version, text FROM documents",
    "state": "SELECT doc_id AS key, CASE WHEN doc_id % 10 = 5 THEN n_chars + 1 ELSE n_chars END::VARCHAR AS version FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT -1 - doc_id, '0' FROM documents WHERE doc_id % 50 = 0",
    "facts_old": "SELECT id AS entity_id, unnest(['status', 'due_date', 'assignee_id', 'description']) AS field, unnest([status, strftime(due_date, '%Y-%m-%d'), assignee_id::VARCHAR, description]) AS value FROM kb_action_item",
    "facts_new": "SELECT id AS entity_id, id % 1000 AS source_doc_id, unnest(['status', 'due_date', 'assignee_id', 'description']) AS field, unnest(['done', strftime(due_date, '%Y-%m-%d'), (assignee_id + 1)::VARCHAR, 'changed']) AS value FROM kb_action_item WHERE id % 10 = 0",
}
#: What a view is made of, besides tables.
_NEEDS = {"kb_chunk": ["kb_document"], "facts_old": ["kb_action_item"], "facts_new": ["kb_action_item"],
          "edges": ["tagged_with", "related_to", "assigned_to", "blocks", "attended", "mentioned_in"], "nodes": ["kb_person", "kb_topic", "kb_action_item", "kb_meeting", "kb_document"]}


def with_views(names: str, select: str) -> str:
    """select with the named views (blank-separated) before it, as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, ()):
            need(x)
        if name not in order:
            order.append(name)

    for n in names.split():
        need(n)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH {head}{',' if select.lstrip().startswith('+') else ''} {select.lstrip().removeprefix('+')}"
