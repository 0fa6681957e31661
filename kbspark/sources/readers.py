"""Readers of exports, with explicit schemas, and writers of the index tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIL_NAME = "struct<emailAddress:struct<address:string,name:string>>"
MAIL = f"id string, conversationId string, subject string, body struct<content:string,contentType:string>, sender {_MAIL_NAME}, toRecipients array<{_MAIL_NAME}>, ccRecipients array<{_MAIL_NAME}>, receivedDateTime string, parentFolderId string, isRead boolean, `@removed` struct<reason:string>"
CALENDAR = f"id string, subject string, start struct<dateTime:string,timeZone:string>, `end` struct<dateTime:string,timeZone:string>, body struct<content:string,contentType:string>, organizer {_MAIL_NAME}, attendees array<struct<emailAddress:struct<address:string,name:string>,type:string>>, isOnlineMeeting boolean, recurrence string, webLink string"
MEETING = "id string, subject string, startDateTime string, endDateTime string, attendees array<struct<identity:struct<user:struct<displayName:string>>>>, joinWebUrl string"
_NAMED, _PERSON = "struct<name:string>", "struct<displayName:string>"
TICKET = (f"id string, key string, fields struct<summary:string,description:string,status:{_NAMED},issuetype:{_NAMED},priority:{_NAMED},reporter:{_PERSON},assignee:{_PERSON},labels:array<string>,components:array<{_NAMED}>,created:string,updated:string,"
          f"comment:struct<comments:array<struct<author:{_PERSON},body:string,created:string>>>,parent:struct<key:string>,customfield_10016:string,customfield_10020:array<{_NAMED}>>")
NOTE = "id string, name string, body string, folder string, created string, modified string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array in each file, or, where the files' names end in .jsonl, an object a line, which Spark can split."""
    return spark.read.schema(schema).option("multiLine", not path.rstrip("*/").endswith(".jsonl")).option("mode", "PERMISSIVE").json(path)


def read_mail_export(spark: SparkSession, path: str) -> DataFrame:
    m, address = _json(spark, path, MAIL), lambda x: x.emailAddress.address
    to = lambda c: F.coalesce(F.transform(c, address), F.array().cast("array<string>"))
    at = F.try_to_timestamp("receivedDateTime")
    return m.where("id is not null").select(F.col("id").alias("mail_id"), F.col("conversationId").alias("conversation_id"), "subject", F.col("body.content").alias("body"), F.col("body.contentType").alias("content_type"), F.col("sender.emailAddress.address").alias("sender"),
                                            F.concat(to("toRecipients"), to("ccRecipients")).alias("recipients"), at.alias("received"), F.col("receivedDateTime").alias("received_text"), F.col("parentFolderId").alias("folder_id"), F.col("`@removed`.reason").alias("removed"))


def read_calendar_export(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, CALENDAR).where("id is not null")


def read_meeting_export(spark: SparkSession, meetings: str, transcripts: str) -> tuple[DataFrame, DataFrame]:
    """(meetings, transcripts as meeting_id and text); a transcript's file is named after its meeting."""
    m = _json(spark, meetings, MEETING).where("id is not null").withColumnRenamed("id", "meeting_id")
    t = spark.read.text(transcripts, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.vtt")
    name = F.regexp_replace(F.substring_index(F.col("_metadata.file_name"), "/", -1), r"\.vtt$", "")
    return m, t.select(name.alias("meeting_id"), F.col("value").alias("text"))


def read_ticket_export(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, TICKET).where("key is not null")


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """path (below the vault), mtime, text (bad bytes replaced)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/").removeprefix("file://")
    below = F.regexp_replace(F.regexp_replace(F.url_decode("path"), "^file:(//)?(?=/)", ""), "^" + re.escape(root) + "/", "")
    return f.select(below.alias("path"), F.col("modificationTime").alias("mtime"), F.expr("cast(content as string)").alias("text"))


def read_notes_export(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of notes; what is no list of notes gives no rows."""
    return _json(spark, path, NOTE).where("id is not null")


def write_version(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write a new version of a table and return its path; readers switch to it when it is whole."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def write_documents(df: DataFrame, root: str) -> str:
    return write_version(df, root, ["source_type"])


def write_chunks(df: DataFrame, root: str) -> str:
    return write_version(df, root, ["source_type"])


def write_nodes(df: DataFrame, root: str) -> str:
    return write_version(df, root, ["label"])


def write_edges(df: DataFrame, root: str) -> str:
    return write_version(df, root, ["rel_type"])
