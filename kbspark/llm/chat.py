"""Operator 7: chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example: all turns before it are context, its text alone is under the loss mask. Turns
after the last assistant turn make one more row without a mask, so that no turn is lost. All examples of a conversation
are prefixes of one formatted text; they are cut from it and never built turn by turn.

A turn is written `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts a backslash is doubled and `<|` becomes
`<\\|`, so no text can open a control string, and reading back undoes both. In roles a line break becomes `\\n` in letters.

Rows are ordered by turn (null first), then role and text; nulls in role or text are empty; a null conv_id is a
conversation of its own; repeated rows are turns of their own; an empty table gives no rows. A conversation is one value
in the contract (its digest), so its turns meet in one row; examples are exploded afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ROLE = "assistant"
#: The turn that the contract adds as conversation -1.
PROBE = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a doubled backslash is read first, so that an n after it stays a letter
    lines = F.regexp_replace(role, r"\G((?:[^\\]++|\\[\\|])*+)\\n", "$1\n")
    return unescape(lines)


def format_conversations(conversations: DataFrame, role: str = ROLE) -> DataFrame:
    """One row a conversation: conv_id, formatted, and targets: for each turn of the role its mask [start, stop) in it,
    the turn's end, and the mask's first byte and bytes."""
    empty = F.lit("")
    named = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    head, body = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")), F.concat(escape(F.col("text")), F.lit(CLOSE + "\n"))
    turns = named.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    # ends are running sums over the turns, so they take as long as there are turns
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumns({
        "place": F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")),
        "end": F.sum(F.length("head") + F.length("body")).over(before).cast("int"),
        "end_byte": F.sum(F.octet_length("head") + F.octet_length("body")).over(before).cast("int"),
    })
    closing = len(CLOSE) + 1
    mask = F.struct((F.col("end") - F.length("body")).alias("start"), (F.col("end") - closing).alias("stop"), "end", (F.col("end_byte") - F.octet_length("body")).alias("byte"), (F.octet_length("body") - closing).alias("bytes"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", F.concat("head", "body").alias("piece"), F.when(F.col("role") == role, mask).alias("mask")))).alias("turns"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.mask.isNotNull()), lambda t: t.mask).alias("targets"))


def _goals(formatted: DataFrame) -> Column:
    """The targets, and one more without a mask for a conversation that does not end in a reply."""
    last, length = F.coalesce(F.element_at("targets", -1).end, F.lit(0)), F.length("formatted")
    none = F.lit(None).cast("int")
    rest = F.struct(none.alias("start"), none.alias("stop"), length.alias("end"), none.alias("byte"), none.alias("bytes"))
    return F.when(F.size("targets") == 0, F.array(rest)).when(last < length, F.array_append("targets", rest)).otherwise(F.col("targets"))


def expand(formatted: DataFrame) -> DataFrame:
    """One row an example: conv_id, example (from 0), formatted (all up to its reply's end), loss_start, loss_stop, loss_byte,
    loss_bytes, last.

    Positions are code points; loss_byte and loss_bytes are the same mask in bytes of UTF-8. last marks a conversation's last
    example, which holds all of it. A conversation that does not end in a reply has one more row, whose mask is null.
    """
    # bytes are cut, as counting code points up to each end would take far longer than copying
    n, raw = F.size("goals"), F.col("formatted").cast("binary")
    rows = formatted.select("conv_id", raw.alias("raw"), _goals(formatted).alias("goals")).select("conv_id", "raw", n.alias("n"), F.posexplode("goals").alias("example", "goal"))
    upto = F.coalesce(F.col("goal.byte") + F.col("goal.bytes") + len(CLOSE) + 1, F.octet_length("raw"))
    return rows.select(
        "conv_id", "example", F.substring(F.col("raw"), F.lit(1), upto).cast("string").alias("formatted"), F.col("goal.start").alias("loss_start"), F.col("goal.stop").alias("loss_stop"),
        F.col("goal.byte").alias("loss_byte"), F.col("goal.bytes").alias("loss_bytes"), (F.col("example") == F.col("n") - 1).alias("last"))


def trained(examples: DataFrame) -> Column:
    """The text under the mask of an example, unescaped; null without a mask."""
    return unescape(F.substring(examples["formatted"].cast("binary"), examples["loss_byte"] + 1, examples["loss_bytes"]).cast("string"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    ends = len(CLOSE) + 1

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - ends)).alias("text"))

    return F.transform(pieces, turn)


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its examples."""
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ROLE).alias("role"), F.lit(PROBE).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    examples = expand(format_conversations(rows))
    read = examples.select("conv_id", "example", trained(examples).alias("reply"), F.when(F.col("last"), F.col("formatted")).alias("formatted"))
    back = read.groupBy("conv_id").agg(
        F.max("formatted").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))), lambda r: r.reply), "").alias("loss"))
    turns = F.transform(read_turns(F.col("whole")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return back.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("whole").cast("long").alias("formatted_chars"))


SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n'))
           + {len(OPEN) + len(CLOSE) + 2})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
