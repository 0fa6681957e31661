"""Contradictions between stored and incoming facts (entity_id, field, value as strings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sync import insert_if_absent, top

#: The fields that are compared, by kind of contradiction.
FIELDS = {"date": ("due_date", "made_at", "date", "deadline"), "status": ("status",), "assignment": ("assignee_id", "assignee", "owner_id", "owner")}


def kind(field: Column) -> Column:
    out = None
    for k, names in FIELDS.items():
        out = F.when(field.isin(*names), k) if out is None else out.when(field.isin(*names), k)
    return out


def detect_contradictions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming has source_doc_id too. The id is a digest of entity, field, new value and document."""
    old = existing.select("entity_id", "field", F.col("value").alias("old_value"))
    j = incoming.withColumn("contradiction_type", kind(F.col("field"))).where("contradiction_type is not null").join(old, ["entity_id", "field"]).where("old_value <> value")
    key = F.md5(F.concat_ws("|", F.col("entity_id").cast("string"), "field", "value", F.col("source_doc_id").cast("string")))
    return j.select(key.alias("id"), "entity_id", F.col("field").alias("field_name"), "old_value", F.col("value").alias("new_value"), "source_doc_id", "contradiction_type")


def existing_properties(items: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Stored facts of action items, and of projects (id, description) their description; blanks are left out."""
    f = F.inline(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in (("status", F.col("status")), ("due_date", F.date_format("due_date", "yyyy-MM-dd")), ("assignee_id", F.col("assignee_id").cast("string")))]))
    facts = items.select(F.col("id").alias("entity_id"), f)
    if projects is not None:
        facts = facts.unionByName(projects.select(F.col("id").alias("entity_id"), F.lit("description").alias("field"), F.col("description").alias("value")))
    return facts.where(F.trim("value") != "")


def persist_contradictions(table: DataFrame, new: DataFrame) -> DataFrame:
    return insert_if_absent(table, new, ["id"])


def list_contradictions(table: DataFrame, unresolved_only: bool = True, n: int | None = None) -> DataFrame:
    t = table.where("not resolved") if unresolved_only else table
    t = t.orderBy(F.col("detected_at").desc(), "id")
    return t.limit(n) if n else t


def resolve_contradictions(table: DataFrame, ids: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(table with those ids resolved, ids that are not there)."""
    j = table.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    done = j.withColumns({"resolved_at": F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("resolved_at")), "resolved": F.col("resolved") | hit}).select(table.columns)
    return done, ids.join(table, "id", "left_anti")


def severity(contradiction_type: Column) -> Column:
    return F.when(contradiction_type == "date", "high").when(contradiction_type == "status", "medium").otherwise("low")


def auto_resolve_latest(table: DataFrame) -> DataFrame:
    """The newest fact of each entity and field."""
    return top(table, ["entity_id", "field_name"], [F.col("detected_at").desc(), F.col("id")], 1, "_rn").drop("_rn").withColumn("severity", severity(F.col("contradiction_type")))
