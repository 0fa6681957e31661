"""Mentions of known names in whole texts, by an index of token n-grams: texts meet the dictionary, not each name.

A name is the sequence of its words (runs of letters and digits), case ignored. Every run of words of a text that is as long
as some name becomes a key. Two broadcast sieves drop keys that no name can have before anything is shuffled: one of the
names' first words, one of whole names, each a Bloom filter that grows with the dictionary up to SLOTS bits. What is left
meets the dictionary by equality. A name on very many documents is no hot key, as keys are salted by document; of the
dictionary only names that texts have go on, and of these only the very common ones are repeated for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what a word is.
TOKEN = r"[\p{L}\p{N}]+"
#: Bits of a sieve at most (16 MB), bits for a value, longs of 64 bits in a bucket, salts of a name's key, and keys from which a name is very common.
SLOTS = 1 << 27
SHARE = 16
LONGS = 16
SALTS = 16
HOT = 1 << 16


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def name_index(names: DataFrame) -> DataFrame:
    """names (id, name) -> id, name, gram (its words), n (how many), as often as they come. Names without a word, and null ids, are in no index."""
    words = tokens(F.col("name"))
    return names.where("id is not null").select("id", "name", F.array_join(words, " ").alias("gram"), F.size(words).alias("n")).where("n > 0")


def first_word(gram: str = "gram") -> Column:
    return F.substring_index(gram, " ", 1)


def bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def bits(value: Column) -> list[Column]:
    """The three bits of a value in its bucket."""
    h = F.xxhash64(value, F.lit(1))
    return [F.pmod(F.shiftrightunsigned(h, 16 * k), F.lit(64 * LONGS)).cast("int") for k in range(3)]


def buckets_for(values: int) -> int:
    return max(1, min(values * SHARE, SLOTS) // (64 * LONGS))


def sieve(values: DataFrame, buckets: int) -> DataFrame:
    """values (value) -> _bucket, _bits: a Bloom filter whose rows are buckets of bits."""
    rows = values.select(bucket(F.col("value"), buckets).alias("_bucket"), *[b.alias(f"_{k}") for k, b in enumerate(bits(F.col("value")))]).repartition("_bucket")
    own = lambda k, i: F.when(F.shiftright(f"_{k}", 6) == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"_{k}").bitwiseAND(63))).otherwise(F.lit(0).cast("long"))
    return rows.groupBy("_bucket").agg(F.array(*[F.bit_or(own(0, i).bitwiseOR(own(1, i)).bitwiseOR(own(2, i))) for i in range(LONGS)]).alias("_bits"))


def sieved(rows: DataFrame, value: Column, filled: DataFrame, buckets: int) -> DataFrame:
    """rows whose value may be one of the sieve's: all of those, and few others."""
    held = F.broadcast(filled)
    found = rows.withColumn("_bucket", bucket(value, buckets)).join(held, "_bucket")
    one = lambda b: F.call_function("shiftrightunsigned", F.get("_bits", F.shiftright(b, 6)), b.bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long")) == 1
    x, y, z = map(one, bits(value))
    return found.where(x & y & z).drop("_bucket", "_bits")


def whole_runs(documents: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document_id, at, n, gram, _part of each run of words that is a name, but those inside longer ones; gram, _part, id, name of names found)."""
    index = name_index(names)
    sizes = index.groupBy("n").agg(F.approx_count_distinct("gram").alias("grams"), F.approx_count_distinct(first_word()).alias("firsts")).collect()  # as many as the longest name has words, at most
    lengths = [r.n for r in sizes] or [1]
    words, none = F.col("words"), F.array().cast("array<struct<at:int,n:int,gram:string>>")

    def runs_of(n: int) -> Column:
        run = lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("gram"))
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), run)).otherwise(none)

    runs = F.flatten(F.array(*map(runs_of, sorted(lengths))))
    keys = documents.where("id is not null and content is not null").select(F.col("id").alias("document_id"), tokens(F.col("content")).alias("words")).select("document_id", F.inline(runs))
    for value, n in ((first_word(), sum(r.firsts for r in sizes)), (F.col("gram"), sum(r.grams for r in sizes))):
        keys = sieved(keys, value, sieve(index.select(value.alias("value")), buckets_for(n)), buckets_for(n))
    keys = keys.withColumn("_salt", F.pmod(F.xxhash64("document_id"), F.lit(SALTS)).cast("int")).where("_salt is not null").repartition("gram", "_salt")
    # the test for nulls and the last row make both uses of the keys the same to Spark: one shuffle, and texts are read once
    used = keys.groupBy("gram", "_salt").agg(F.count(F.lit(1)).alias("_keys"), F.max(F.struct("document_id", "at", "n")).alias("_last")).where("_last is not null")
    told = used.groupBy("gram").agg(F.collect_list("_salt").alias("_salts"), (F.sum("_keys") > HOT).alias("_hot"))
    # joins by a hint where Spark would size keys by the files before they are made
    owned = index.select("gram", "id", "name").hint("merge").join(told, "gram").distinct()
    part = F.when(F.col("_hot"), F.col("_salt")).otherwise(-1).alias("_part")
    parts = owned.select("gram", "_salts", "_hot").distinct().select("gram", "_hot", F.explode("_salts").alias("_salt")).select("gram", "_salt", part)
    found = keys.join(parts.hint("merge"), ["gram", "_salt"])
    # an earlier or longer run that ends as late or later holds this one
    end = F.col("at") + F.col("n")
    before = Window.partitionBy("document_id").orderBy("at", F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = found.withColumn("_held", F.max(end).over(before)).where((F.col("_held") < end) | F.col("_held").isNull())
    owners = owned.select("gram", "id", "name", F.explode(F.when(F.col("_hot"), F.col("_salts")).otherwise(F.array(F.lit(-1)))).alias("_part"))
    return whole.select("document_id", "at", "n", "gram", "_part"), owners


def mentions(documents: DataFrame, names: DataFrame) -> DataFrame:
    """documents (id, content) -> document_id, at (place of the first word, from 0), n (words), id, name.

    Of names at one place the longest counts: a mention inside a longer one is none, overlapping ones both are. Documents
    without text, and null ids, mention nobody. A name of several persons is a mention of each.
    """
    whole, owners = whole_runs(documents, names)
    return whole.join(owners, ["gram", "_part"]).select("document_id", "at", "n", "id", "name")


def mention_edges(documents: DataFrame, names: DataFrame) -> DataFrame:
    """MENTIONED_IN edges from persons to the documents that name them, with the least name found and the number of mentions.

    A place of a document is in one run, so runs are counted before they meet the persons. Few owners are broadcast by
    Spark at run time; then a document's edges stay where its runs are.
    """
    whole, owners = whole_runs(documents, names)
    runs = whole.groupBy("document_id", "gram", "_part").agg(F.count(F.lit(1)).alias("n"))
    one = owners.groupBy("gram", "_part", "id").agg(F.min("name").alias("name"))
    edges = runs.join(one, ["gram", "_part"]).groupBy("id", "document_id").agg(F.min("name").alias("context"), F.sum("n").alias("n"))
    return edges.select(F.lit("MENTIONED_IN").alias("rel_type"), F.lit("Person").alias("from_label"), F.col("id").alias("from_id"), F.lit("Document").alias("to_label"), F.col("document_id").alias("to_id"), "context", "n")
