"""Operator 1: mix sources to target weights by systematic sampling, in DataFrame functions alone.

Documents of a source are laid out in an order of length. Each one expects target / source_size copies; the running sum
of expected copies, moved by one offset a source, crosses whole numbers, and a document is emitted once for each crossed.
As neighbours are of like length, a source's taken words miss its target by one document at most; a long one can be a
large part of a small source, so the offset is chosen of OFFSETS equally spaced ones, the first of them random.

The running sum is distributed: rows are dealt into (source, length class, salt) buckets, buckets are counted with
partial aggregation, bucket starts are summed over the small tables of classes and salts, and ranks are taken inside the
buckets. A source with a third of all rows thus has SALTS tasks' worth of buckets in each length class.

Nulls: a null source is a source of its own, last in order; null text has size 0. A source without words has target 0 and
is not emitted. Repeated rows are rows: each is ranked by itself. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words

#: Buckets of a (source, length class); raise with the corpus so that a bucket fits a task.
SALTS = 64
#: A source gives at most so many copies of each document.
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
SEED = 42
#: Offsets that are tried for each source.
OFFSETS = 64


def _hash32(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """From rows (source, source_size): weight and target of each source.

    Sources by code point, nulls last, weigh `weights` in turn. Targets share the whole by weight but stop at max_copies
    times the source's size; the excess goes to the others by weight. With sources by size / weight, those below the
    first level that fits are full, and the level of the rest is what remains by remaining weight. The table has a row
    for each source, so one task orders it.
    """
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    cap = F.lit(max_copies) * F.col("source_size")
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = sizes.withColumn("weight", w).withColumn("fill", cap.cast("double") / F.col("weight"))
    t = t.withColumns({
        "full_before": F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "all_words": F.sum("source_size").over(everything),
        "all_weight": F.sum("weight").over(everything),
    })
    level = (F.col("all_words") - F.col("full_before")).cast("double") / (F.col("all_weight") - F.col("weight_before"))
    t = t.withColumn("level", F.max(F.when(level <= F.col("fill"), level)).over(everything))
    return t.select("source", "source_size", "weight", F.when(F.col("fill") <= F.col("level"), cap.cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def _placed(docs: DataFrame, carry: list[str], salts: int) -> DataFrame:
    """carry and what a row is laid out by: its source, size, length class and salt."""
    size = n_words(F.col("text"))
    base = docs.select(*carry, F.col("source").alias("_source"), size.alias("_size"), F.coalesce(F.md5(F.col("text")), F.lit("")).alias("_md5"), F.col("doc_id").alias("_id"))
    return base.select(
        *carry, "_size", "_md5", "_id", F.coalesce("_source", F.lit("")).alias("_key"), F.col("_source").isNull().alias("_none"),
        # 8 classes to each doubling of the size; integer steps so that classes are exact
        F.when(F.col("_size") == 0, F.lit(-1)).otherwise(F.floor(F.log2(F.col("_size").cast("double")) * 8)).cast("long").alias("_class"),
        F.pmod(_hash32(F.concat_ws(":", F.col("_id").cast("string"), F.col("_md5"))), F.lit(salts)).alias("_salt"))


def _crossed(rank: Column, offset: Column) -> Column:
    """Whole numbers that the running sum has crossed after so many rows."""
    return F.floor(rank.cast("double") * F.col("_rate") + offset)


def _layout(placed: DataFrame, seed: int) -> DataFrame:
    """For each bucket its first rank, and its source's size, target, rate and offset.

    Of OFFSETS equally spaced offsets, the first of them random, a source gets the one whose taken words are nearest to its
    target. placed is read twice.
    """
    key = ["_key", "_none", "_class", "_salt"]
    buckets = materialise(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("words")), "buckets")
    classes = buckets.groupBy("_key", "_none", "_class").agg(F.sum("n").alias("class_n"), F.sum("words").alias("class_words"))
    sizes = classes.groupBy("_key", "_none").agg(F.sum("class_words").alias("source_size")).withColumn("source", F.when(~F.col("_none"), F.col("_key")))
    targets = source_targets(sizes.select("source", "source_size")).select(
        F.coalesce("source", F.lit("")).alias("_key"), F.col("source").isNull().alias("_none"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    rate = F.coalesce(F.try_divide(F.col("_target"), F.col("_source_size")), F.lit(0.0))
    # a multiple of 2^-16, so that whole rates stay whole in doubles
    first = F.floor(_hash32(F.concat(F.lit(f"{seed}:"), F.col("_key"))) / 65536) / 65536
    targets = targets.withColumns({"_rate": rate, "_first": first})
    prior = lambda *by: Window.partitionBy(*by)
    running = (Window.unboundedPreceding, -1)
    classes = classes.withColumn("class_start", F.coalesce(F.sum("class_n").over(prior("_key", "_none").orderBy("_class").rowsBetween(*running)), F.lit(0)))
    starts = buckets.join(classes.select("_key", "_none", "_class", "class_start").hint("merge"), ["_key", "_none", "_class"]).withColumn(
        "_start", F.col("class_start") + F.coalesce(F.sum("n").over(prior("_key", "_none", "_class").orderBy("_salt").rowsBetween(*running)), F.lit(0)))
    starts = materialise(starts.join(targets.hint("merge"), ["_key", "_none"]).select(*key, "_start", "_source_size", "_target", "_rate", "_first"), "starts")
    offsets = [F.pmod(F.col("_first") + F.lit(k / OFFSETS), F.lit(1.0)) for k in range(OFFSETS)]
    ranked = _ranked(placed, starts)
    taken = [F.sum((_crossed(F.col("_rank"), x) - _crossed(F.col("_rank") - 1, x)) * F.col("_size")) for x in offsets]
    misses = [F.struct(F.abs(t - F.first("_target")).alias("miss"), F.lit(k).alias("k")) for k, t in enumerate(taken)]
    best = ranked.groupBy("_key", "_none").agg(F.least(*misses).getField("k").alias("_k"))
    # a row for each bucket and one for each source
    return starts.join(best.hint("merge"), ["_key", "_none"]).withColumn("_offset", F.pmod(F.col("_first") + F.col("_k") / OFFSETS, F.lit(1.0))).drop("_first", "_k")


def _ranked(placed: DataFrame, starts: DataFrame) -> DataFrame:
    key = ["_key", "_none", "_class", "_salt"]
    # buckets grow with the sources, so they are not broadcast; ranks need the rows of a bucket together anyhow
    return placed.join(starts.hint("merge"), key).withColumn("_rank", F.col("_start") + F.row_number().over(Window.partitionBy(*key).orderBy("_size", "_id", "_md5")))


def systematic_copies(docs: DataFrame, carry: list[str], seed: int = SEED, salts: int = SALTS) -> DataFrame:
    """Rows of docs with _size, _source_size, _target and _copies (how many times the mix takes the row), and `carry`."""
    narrow = materialise(_placed(docs, [], salts), "sizes")
    layout = materialise(_layout(narrow, seed), "layout")
    # carried rows are read again where they are wide
    ranked = _ranked(_placed(docs, carry, salts) if carry else narrow.withColumnRenamed("_id", "doc_id").withColumn("_id", F.col("doc_id")), layout)
    copies = _crossed(F.col("_rank"), F.col("_offset")) - _crossed(F.col("_rank") - 1, F.col("_offset"))
    return ranked.withColumn("_copies", copies).select(*(carry or ["doc_id"]), "_size", "_source_size", "_target", "_copies")


def mix(docs: DataFrame, seed: int = SEED, salts: int = SALTS) -> DataFrame:
    """docs with each row as often as the mix takes it; columns as they were. Any column names are kept."""
    names = docs.columns
    packed = docs.select(F.col("doc_id"), F.col("source"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    copies = systematic_copies(packed, ["_row"], seed, salts).where(F.col("_copies") > 0)
    return copies.select(F.explode(F.array_repeat("_row", F.col("_copies").cast("int"))).alias("_row")).select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document."""
    t = systematic_copies(docs.select("doc_id", "source", "text"), [])
    return t.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


SQL = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(source, '') AS k, source IS NULL AS none,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
         coalesce(md5(text), '') AS m
  FROM documents),
placed AS (
  SELECT *, CASE WHEN size = 0 THEN -1 ELSE floor(log2(size::DOUBLE) * 8) END::BIGINT AS class,
         ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, m)), 1, 8))::BIGINT % {SALTS} AS salt
  FROM base),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k, none ORDER BY class, salt, size, doc_id NULLS FIRST, m) AS rank FROM placed),
sizes AS (SELECT k, none, sum(size)::BIGINT AS source_size FROM base GROUP BY ALL),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY none, k) - 1) % 3 + 1 AS weight FROM sizes),
filled AS (SELECT *, (3 * source_size)::DOUBLE / weight AS fill FROM weighed),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM filled)
             - coalesce(sum(3 * source_size) OVER (ORDER BY fill, none, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / ((SELECT sum(weight) FROM filled)
             - coalesce(sum(weight) OVER (ORDER BY fill, none, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM filled),
chosen AS (SELECT max(level) AS level FROM levels WHERE level <= fill),
targets AS (
  SELECT k, none, source_size,
         CASE WHEN fill <= chosen.level THEN (3 * source_size)::DOUBLE ELSE weight * chosen.level END AS target,
         floor(('0x' || substr(md5('{SEED}:' || k), 1, 8))::BIGINT / 65536) / 65536 AS off0
  FROM filled, chosen),
rates AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END AS rate FROM targets),
tries AS (SELECT k, none, r, target, rate, (off0 + r / {OFFSETS}.0::DOUBLE) - floor(off0 + r / {OFFSETS}.0::DOUBLE) AS off FROM rates, range({OFFSETS}) AS t(r)),
sums AS (
  SELECT k, none, r, off, abs(sum((floor(rank::DOUBLE * rate + off) - floor((rank - 1)::DOUBLE * rate + off))::BIGINT * size)::DOUBLE - first(target)) AS miss
  FROM ranked JOIN tries USING (k, none) GROUP BY k, none, r, off),
best AS (SELECT k, none, first(off ORDER BY miss, r) AS off FROM sums GROUP BY k, none)
SELECT doc_id, size, source_size, target,
       ((floor(rank::DOUBLE * rate + off) - floor((rank - 1)::DOUBLE * rate + off)) * size)::BIGINT AS taken
FROM ranked JOIN rates USING (k, none) JOIN best USING (k, none)
"""
