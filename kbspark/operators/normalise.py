"""Exports of meetings, mail, calendars, tickets, vaults and notes -> canonical documents.

All give id, content, title, source_type, source_id, author, participants, tags, url, created_at, updated_at, synced_at
and custom (map of strings). Missing parts have the defaults named below; nothing raises on malformed rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import document_id, extract_embeds, extract_tags, extract_wikilinks, parse_offset_timestamp, percent_encoded, strip_note_syntax, stripped

COLUMNS = ["id", "content", "title", "source_type", "source_id", "author", "participants", "tags", "url", "created_at", "updated_at", "synced_at", "custom"]


def or_else(x: Column, default: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(default) if isinstance(default, str) else default)


def _strings(items: Column) -> Column:
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))


def _document(df: DataFrame, as_of: str, **c: Column) -> DataFrame:
    defaults = {"author": F.lit(None).cast("string"), "participants": F.array().cast("array<string>"), "tags": F.array().cast("array<string>"), "url": F.lit(None).cast("string"), "custom": F.create_map().cast("map<string,string>")}
    c = defaults | c | {"synced_at": F.lit(as_of).cast("timestamp")}
    c["updated_at"] = F.greatest(c["updated_at"], c["created_at"])
    return df.select(*[c[k].alias(k) for k in COLUMNS])


def _map(**values: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())


def parse_vtt_segments(transcripts: DataFrame) -> DataFrame:
    """transcripts (meeting_id, text) -> meeting_id, seq, speaker, start, stop, text of each cue with text.

    The first closed voice anywhere in a cue is its speaker and text; a cue without one is whole and of Unknown.
    """
    t = transcripts.select("meeting_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), r"\n{2,}")).alias("seq", "cue"))
    time = r"(?:^|\n)(\d{2}:\d{2}:\d{2}\.\d{3})[^\S\n]+-->[^\S\n]+(\d{2}:\d{2}:\d{2}\.\d{3})[^\n]*\n(.+)"
    part = lambda k: F.regexp_extract("cue", f"(?s){time}", k)
    spoken = r"(?s)<v\s+([^>]+)>(.*?)</v>"
    voice = lambda k, other: F.when(F.col("body").rlike(spoken), stripped(F.regexp_extract("body", spoken, k))).otherwise(other)
    t = t.select("meeting_id", "seq", part(1).alias("start"), part(2).alias("stop"), stripped(part(3)).alias("body")).where("start <> ''")
    return t.select("meeting_id", "seq", voice(1, F.lit("Unknown")).alias("speaker"), "start", "stop", voice(2, F.col("body")).alias("text")).where("text <> ''")


def transcript_text(segments: DataFrame) -> DataFrame:
    line = F.concat("speaker", F.lit(": "), "text", F.lit("\n"))
    return segments.groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x.line), "").alias("transcript"))


def _seconds(t: str) -> Column:
    p = F.split(t, ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def speaker_stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy("meeting_id", "speaker").agg(F.count(F.lit(1)).alias("utterances"), F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("words"), F.round(F.sum(_seconds("stop") - _seconds("start")), 3).alias("seconds"))


def _minutes(start: Column, stop: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.floor((F.unix_seconds(stop) - F.unix_seconds(start)) / 60)), F.lit(0)).cast("int")


def meetings_to_documents(meetings: DataFrame, transcripts: DataFrame, as_of: str) -> DataFrame:
    """Meetings without a transcript are left out."""
    m = meetings.join(transcripts, "meeting_id")
    now, subject = F.lit(as_of).cast("timestamp"), or_else(F.col("subject"), "Untitled Meeting")
    start, stop = parse_offset_timestamp(F.col("startDateTime")), parse_offset_timestamp(F.col("endDateTime"))
    title = F.concat(F.lit("Meeting: "), subject)
    return _document(m, as_of, id=document_id("teams", F.col("meeting_id")), content=or_else(F.col("transcript"), title), title=title, source_type=F.lit("teams_transcript"), source_id=F.col("meeting_id"), url=F.col("joinWebUrl"),
                     participants=_strings(F.transform("attendees", lambda a: a.identity.user.displayName)), created_at=F.coalesce(start, now), updated_at=F.coalesce(start, now), custom=_map(duration_minutes=_minutes(start, stop)))


def filter_mail(mails: DataFrame, folders: DataFrame | None = None, allow: list[str] | None = None, exclude: list[str] | None = None, sender_domains: list[str] | None = None, date_from: str | None = None) -> DataFrame:
    """mails (folder_id, sender, received): allow-list, then exclude-list, sender's domain, and date (unreadable dates pass).

    With a list of domains a mail without a sender's address goes.
    """
    m = mails.join(folders.select("folder_id", F.col("name").alias("_f")), "folder_id", "left") if folders is not None else mails.withColumn("_f", F.lit(None).cast("string"))
    name = F.coalesce("_f", F.lit(""))
    m = m.where(name.isin(*allow)) if allow else m
    m = m.where(~name.isin(*exclude)) if exclude else m
    if sender_domains:
        m = m.where(F.coalesce(F.contains("sender", F.lit("@")) & F.substring_index("sender", "@", -1).isin(*sender_domains), F.lit(False)))
    if date_from:
        m = m.where(F.coalesce(parse_offset_timestamp(F.col("received").cast("string")) >= F.lit(date_from).cast("timestamp"), F.lit(True)))
    return m.drop("_f")


def limit_mail(mails: DataFrame, order: list[Column], n: int = 500) -> DataFrame:
    return mails.orderBy(*order).limit(n)


def mail_threads(mails: DataFrame) -> DataFrame:
    """mails (conversation_id, mail_id, received ts, received_text, sender, recipients, subject, body) -> a row for each thread.

    received_text is the date as it came, for the text. The title is the last mail's subject, or "No Subject".
    A thread is one document, so its mails meet in one row. Rows without a conversation are left out.
    """
    m = mails.where(F.coalesce(F.trim(F.col("conversation_id").cast("string")) != "", F.lit(False)))
    text = F.concat(F.lit("From: "), F.coalesce("sender", F.lit("")), F.lit("\nDate: "), F.coalesce("received_text", F.lit("")), F.lit("\nSubject: "), F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    people = F.concat(F.array("sender"), F.coalesce("recipients", F.array().cast("array<string>")))
    t = m.groupBy("conversation_id").agg(
        F.min("received").alias("created_at"), F.max("received").alias("updated_at"), F.count(F.lit(1)).alias("email_count"), F.max_by("subject", F.struct("received", "mail_id")).alias("_s"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("received", "mail_id", text.alias("t")))), lambda x: x.t), "\n\n---\n\n").alias("content"),
        F.array_sort(F.array_distinct(_strings(F.flatten(F.collect_list(people))))).alias("participants"))
    subject = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif("_s", F.lit("")), F.lit("No Subject")), r"(?U)^\s+", ""), r"^(Re|RE|Fwd|FWD|Fw): ", "")
    return t.select("conversation_id", F.concat(F.lit("Email: "), subject).alias("title"), "content", "participants", "created_at", "updated_at", "email_count")


def threads_to_documents(threads: DataFrame, as_of: str) -> DataFrame:
    key = F.col("conversation_id").cast("string")
    return _document(threads, as_of, id=document_id("outlook_email", key), content=F.col("content"), title=F.col("title"), source_type=F.lit("outlook_email"), source_id=key, participants=F.col("participants"),
                     created_at=F.col("created_at"), updated_at=F.col("updated_at"), custom=_map(email_count=F.col("email_count")))


class _Text(HTMLParser):
    """Plain text or Markdown of a page; scripts and styles are left out."""

    BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer blockquote pre".split())

    def __init__(self, markdown: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.markdown, self.href = 0, markdown, [""]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.BLOCKS:
            self.out.append("\n")
        if self.markdown:
            a = dict(attrs)
            if tag[:1] == "h" and tag[1:].isdigit():
                self.out.append("#" * int(tag[1:]) + " ")
            elif tag == "li":
                self.out.append({"true": "- [x] ", "false": "- [ ] "}.get(a.get("data-checked", ""), "- "))
            elif tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("_")
            elif tag == "a":
                self.href.append(a.get("href") or "")
                self.out.append("[")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n")
        if self.markdown:
            if tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("_")
            elif tag == "a" and len(self.href) > 1:
                self.out.append(f"]({self.href.pop()})")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)


def html_text(html: str | None, markdown: bool = False) -> str:
    p = _Text(markdown)
    p.feed(html or "")
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def html_to_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in pages:
        yield s.map(html_text)


@F.pandas_udf(T.StringType())
def html_to_markdown(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in pages:
        yield s.map(lambda x: html_text(x, True))


def mail_body_text(mails: DataFrame) -> DataFrame:
    """body from body_html (content_type html) or as it is."""
    return mails.withColumn("body", F.when(F.lower("content_type") == "html", html_to_text(F.col("body"))).otherwise(F.col("body")))


def calendar_to_documents(events: DataFrame, as_of: str) -> DataFrame:
    now, start, stop = F.lit(as_of).cast("timestamp"), parse_offset_timestamp(F.col("start.dateTime")), parse_offset_timestamp(F.col("end.dateTime"))
    title = or_else(F.col("subject"), "No Title")
    people = F.concat(F.array(F.col("organizer.emailAddress.address")), F.coalesce(F.transform("attendees", lambda a: a.emailAddress.address), F.array().cast("array<string>")))
    return _document(events, as_of, id=document_id("outlook_calendar", F.col("id")), content=or_else(F.col("body.content"), F.concat(F.lit("Calendar Event: "), title)), title=title, source_type=F.lit("outlook_calendar"), source_id=F.col("id"), url=F.col("webLink"),
                     author=F.col("organizer.emailAddress.address"), participants=F.array_distinct(_strings(people)), created_at=F.coalesce(start, now), updated_at=F.coalesce(start, now),
                     custom=_map(duration_minutes=_minutes(start, stop), is_online=F.coalesce("isOnlineMeeting", F.lit(False)), is_recurring=F.col("recurrence").isNotNull()))


def ticket_comments_text(comments: Column) -> Column:
    def line(c: Column) -> Column:
        who, at = or_else(c.author.displayName, "Unknown"), parse_offset_timestamp(c.created)
        return F.concat(F.lit("["), who, F.coalesce(F.concat(F.lit(" - "), F.date_format(at, "yyyy-MM-dd")), F.lit("")), F.lit("]: "), F.coalesce(c.body, F.lit("")))

    return F.array_join(F.transform(F.coalesce(comments, F.slice(comments, 1, 0)), line), "\n")


def ticket_tags(fields: str = "fields") -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(f"{fields}.labels", none), F.coalesce(F.transform(F.filter(f"{fields}.components", lambda c: c["name"].isNotNull()), lambda c: F.concat(F.lit("component:"), c["name"])), none))


def tickets_to_documents(tickets: DataFrame, base_url: str, as_of: str) -> DataFrame:
    now, f = F.lit(as_of).cast("timestamp"), lambda k: F.col(f"fields.{k}")
    created = F.coalesce(parse_offset_timestamp(f("created")), now)
    head = F.concat(F.col("key"), F.lit(": "), F.coalesce(f("summary"), F.lit("")))
    notes = F.nullif(ticket_comments_text(f("comment.comments")), F.lit(""))
    sprint = F.nullif(F.trim(F.try_element_at(f("customfield_10020"), F.lit(-1))["name"]), F.lit(""))
    return _document(tickets, as_of, id=document_id("jira_issue", F.col("key")), content=F.concat_ws("\n\n", head, F.nullif(F.trim(f("description")), F.lit("")), notes), title=head, source_type=F.lit("jira_issue"), source_id=F.col("key"), author=f("reporter.displayName"),
                     participants=F.array_distinct(_strings(F.array(f("reporter.displayName"), f("assignee.displayName")))), tags=ticket_tags(), url=F.concat(F.lit(base_url.rstrip("/") + "/browse/"), F.col("key")), created_at=created, updated_at=F.coalesce(parse_offset_timestamp(f("updated")), created),
                     custom=_map(status=f("status.name"), priority=f("priority.name"), type=f("issuetype.name"), assignee=f("assignee.displayName"), parent=f("parent.key"), sprint=sprint, story_points=f("customfield_10016").try_cast("double")))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: * and ? also match slashes, as in file-name matching of whole strings."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob.rstrip("/")) + "$"


def filter_vault_paths(files: DataFrame, exclude: list[str], extensions: list[str]) -> DataFrame:
    """Leave out paths that a glob matches as a whole, by a leading part or by one component; keep allowed suffixes."""
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    globs = "|".join(map(glob_regex, exclude))
    bad = F.exists(F.concat(heads, parts), lambda p: p.rlike(globs)) if globs else F.lit(False)
    return files.where(~bad & F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1))).isin(*[e.lower() for e in extensions]))


_FRONT = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)"


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _yaml(blocks: pd.Series) -> pd.Series:
    import json

    import yaml

    def read(block: str | None) -> dict | None:
        if not block:
            return {}
        try:
            x = yaml.safe_load(block)
        except (yaml.YAMLError, ValueError):
            return {}
        return {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in x.items() if v is not None} if isinstance(x, dict) else {}

    return blocks.map(read)


def parse_front_matter(notes: DataFrame) -> DataFrame:
    """notes with front (map; empty if there is none or it is malformed) and body (the rest)."""
    block = F.regexp_extract("text", _FRONT, 1)
    return notes.withColumns({"front": _yaml(block), "body": F.regexp_replace("text", _FRONT, "")})


def vault_to_documents(files: DataFrame, vault: str, as_of: str) -> DataFrame:
    """files (path, mtime ts, text)."""
    f = parse_front_matter(files.withColumn("text", F.coalesce("text", F.lit(""))))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    own = F.coalesce(F.from_json(F.col("front")["tags"], "array<string>"), F.when(F.col("front")["tags"].isNotNull(), F.split(F.col("front")["tags"], r"\s*,\s*")))
    title = or_else(F.col("front")["title"], stem)
    at = F.coalesce("mtime", F.lit(as_of).cast("timestamp"))
    return _document(f, as_of, id=document_id("obsidian", F.col("path")), content=or_else(strip_note_syntax(F.col("body")), title), title=title, source_type=F.lit("obsidian_note"), source_id=F.col("path"), tags=extract_tags(F.col("body"), own), url=F.concat(F.lit(f"obsidian://open?vault={vault}&file="), percent_encoded(F.col("path"))),
                     created_at=at, updated_at=at, custom=_map(wikilinks=F.to_json(extract_wikilinks(F.col("body"))), embeds=F.to_json(extract_embeds(F.col("body")))))


def html_notes_to_documents(notes: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    created = F.coalesce(parse_offset_timestamp(F.col("created")), now)
    title = or_else(F.col("name"), "Untitled Note")
    body = F.coalesce("body", F.lit(""))
    return _document(notes, as_of, id=document_id("apple_note", F.col("id")), content=or_else(html_to_markdown(body), title), title=title, source_type=F.lit("apple_note"), source_id=F.col("id"), tags=_strings(F.array("folder")), created_at=created,
                     updated_at=F.coalesce(parse_offset_timestamp(F.col("modified")), created), custom=_map(folder=F.col("folder"), has_images=F.contains(F.lower(body), F.lit("<img")), has_checklists=F.contains(body, F.lit("data-checked"))))


def notes_from_relational(objects: DataFrame, bodies: DataFrame) -> DataFrame:
    """objects (pk, title, folder_pk, created, modified, deleted; seconds from 2001) with bodies (note_pk, body) -> notes."""
    folders = objects.select(F.col("pk").alias("folder_pk"), F.col("title").alias("_folder"))
    at = lambda c: F.timestamp_seconds(F.col(c) + 978_307_200)
    n = objects.where(~F.coalesce("deleted", F.lit(False))).join(bodies.withColumnRenamed("note_pk", "pk"), "pk").join(folders, "folder_pk", "left")
    return n.select(F.col("pk").alias("id"), or_else(F.col("title"), "Untitled").alias("name"), "body", or_else(F.col("_folder"), "Notes").alias("folder"), at("created").alias("created"), at("modified").alias("modified"))


def ticket_graph(tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of tickets: item, people, project, sprint; assignment, reports, blocking parents."""
    key, f = F.col("key"), lambda k: F.col(f"fields.{k}")
    project, sprint = F.substring_index("key", "-", 1), F.try_element_at(f("customfield_10020"), F.lit(-1))["name"]
    node = lambda label, x: F.struct(F.lit(label).alias("label"), x.alias("id"))
    edge = lambda rel, a, x, b, y: F.struct(F.lit(rel).alias("rel_type"), F.lit(a).alias("from_label"), x.alias("from_id"), F.lit(b).alias("to_label"), y.alias("to_id"))
    assignee, reporter = f("assignee.displayName"), f("reporter.displayName")
    nodes = tickets.select(F.inline(F.array(node("ActionItem", key), node("Person", assignee), node("Person", reporter), node("Project", project), node("Topic", sprint)))).where("id is not null").distinct()
    edges = tickets.select(F.inline(F.array(edge("ASSIGNED_TO", "ActionItem", key, "Person", assignee), edge("MENTIONED_IN", "Person", reporter, "Document", document_id("jira_issue", key)), edge("BLOCKS", "ActionItem", f("parent.key"), "ActionItem", key))))
    return nodes, edges.where("from_id is not null and to_id is not null").distinct()
