"""Column functions of the knowledge base: ids, names, dates, note syntax, URLs. All are built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the OID namespace of UUIDs (RFC 4122).
OID = "6ba7b8129dad11d180b400c04fd430c8"


def document_id(prefix: str, key: Column) -> Column:
    """UUIDv5 of "prefix:key" in the OID namespace; null for a null key."""
    h = F.sha1(F.concat(F.unhex(F.lit(OID)), F.encode(F.concat(F.lit(f"{prefix}:"), key), "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def normalise_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def parse_offset_timestamp(text: Column) -> Column:
    """ISO-8601 with Z, +0000 or +05:30; null if it cannot be read."""
    return F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2"))


def stripped(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


#: Links, embeds, tags, code and callouts of notes.
LINK, EMBED, TAG = r"(?<!!)\[\[([^\[\]]+?)\]\]", r"!\[\[([^\[\]|]+?)(?:\|[^\[\]]*?)?\]\]", r"(?U)(?<!\S)#([\w/][\w/.-]*)"
FENCED, INLINE = r"(?s)```.*?```|~~~.*?~~~", r"`[^`]*`"
CALLOUT = r"(?Umd)^>\s*\[!(\w+)\][ \t]*(.*?)[ \t]*$"


def masked_code(text: Column) -> Column:
    """Code fenced by ``` or ~~~, then inline code (over line breaks too), gives way to a blank."""
    return F.regexp_replace(F.regexp_replace(text, FENCED, " "), INLINE, " ")


def extract_wikilinks(text: Column) -> Column:
    """Targets of links outside code; blank ones are left out."""
    return F.filter(F.transform(F.regexp_extract_all(masked_code(text), F.lit(LINK), 1), lambda x: stripped(F.split(x, r"\|")[0])), lambda x: x != "")


def extract_embeds(text: Column) -> Column:
    """Targets of embeds, in code too."""
    return F.regexp_extract_all(text, F.lit(EMBED), 1)


def extract_tags(text: Column, front_matter: Column) -> Column:
    """Tags of the front matter, then those in the text outside code; each once."""
    inline = F.regexp_extract_all(masked_code(text), F.lit(TAG), 1)
    return F.array_distinct(F.concat(F.coalesce(front_matter, F.array().cast("array<string>")), inline))


def extract_callouts(text: Column) -> Column:
    """Array of (type, title)."""
    p = F.lit(CALLOUT)
    return F.transform(F.arrays_zip(F.regexp_extract_all(text, p, 1).alias("a"), F.regexp_extract_all(text, p, 2).alias("b")), lambda x: F.struct(F.upper(x["a"]).alias("type"), x["b"].alias("title")))


def strip_note_syntax(text: Column) -> Column:
    """Without embeds; links give way to what they show, tags to their words."""
    t = F.regexp_replace(text, EMBED, "")
    t = F.regexp_replace(t, r"(?U)(?<!!)\[\[(?=[^\[\]])(?:[^\[\]|]*\|)*\s*([^\[\]|]*?)\s*\]\]", "$1")
    return stripped(F.regexp_replace(t, TAG, "$1"))


def percent_encoded(text: Column) -> Column:
    """Percent-encoding with nothing but unreserved characters left (blank is %20, * is %2A, ~ stays)."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def source_url(url: Column, source_type: Column, source_id: Column, base: str) -> Column:
    """url, or a deep link for a vault note without one; paths that climb out get none."""
    climbs = source_id.rlike(r"(^|/)\.\.(/|$)") | source_id.startswith("/")
    return F.coalesce(url, F.when((source_type == "obsidian_note") & ~climbs, F.concat(F.lit(base), percent_encoded(source_id))))


def urgency(due: Column, as_of: Column) -> Column:
    """0 without a date, 1 when due, else exp(-days / 7)."""
    days = (F.unix_micros(due) - F.unix_micros(as_of)) / F.lit(86_400_000_000.0)
    return F.when(due.isNull(), 0.0).when(days <= 0, 1.0).otherwise(F.exp(-days / 7))


def explicit_priority(status: Column) -> Column:
    return F.when(status == "high", 1.0).when(status == "medium", 0.5).otherwise(0.0)


def recency_decay(created_at: Column, as_of: Column, tau_days: float) -> Column:
    return F.exp(-(F.unix_micros(as_of) - F.unix_micros(created_at)) / F.lit(86_400_000_000.0 * tau_days))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; two empty sets have 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in doubles; 0 if either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
