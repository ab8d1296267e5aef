"""Exact deduplication by progressive refinement, with DataFrame functions only.

Rows are told apart by ever dearer keys: the length of the normalised text, then a hash of its prefix, then a hash of
all of it. Between the levels, what is known of the groups that still have more than one row goes to the scan as a
bitmap of fixed size (`BITMAP_BITS`): a row whose bit is not set has no partner and is never looked at more closely;
a bit that is set for another group's sake only costs a hash. So the text itself is never shuffled, the broadcast
doesn't grow with the data, and only rows of surviving groups have their full content hashed.

Equality is that of two independent 64-bit hashes together with the length and the prefix hash.

Defined cases: null text is an empty text; texts of white space alone equal one space, not the empty text; rows that
share a doc_id and a text are one group whose rows all count, and one of the rows with the smallest doc_id is kept
(all of those that share it, as they can't be told apart); null doc_ids are larger than others; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.llm.common import SPACE_CLASS, materialise, text_of

PREFIX = 128
#: 2^24 bits in 2^18 words: 4 MB to broadcast, whatever the input.
BITMAP_BITS = 24


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), SPACE_CLASS, " ")


def _bit(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << BITMAP_BITS))


def _bitmap(groups: DataFrame, *keys: str) -> DataFrame:
    """Words of 64 bits, one bit set for each group: at most 2^(BITMAP_BITS - 6) rows."""
    b = _bit(*map(F.col, keys))
    words = groups.select(b.alias("b"))
    words = words.select(F.shiftright("b", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("bit"))
    return words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _marked(rows: DataFrame, bitmap: DataFrame, *keys: str) -> DataFrame:
    """rows with `alive`: whether a group of more than one row may hold them."""
    at = rows.withColumn("b", _bit(*map(F.col, keys))).withColumn("word", F.shiftright("b", 6).cast("int"))
    hit = F.expr("coalesce(shiftright(bits, cast(b % 64 as int)) & 1L, 0L) = 1")
    return at.join(F.broadcast(bitmap), "word", "left").withColumn("alive", hit).drop("word", "b", "bits")


def groups_of_copies(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) of every row. carry: columns made from the normalised text `t` to go along."""
    carry = carry or {}
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("t"))
    keyed = text.select("doc_id", "t", F.length("t").alias("n"))
    # Level 1: lengths that more than one row has.
    lengths = keyed.groupBy("n").agg(F.count("*").alias("c")).where("c > 1")
    by_length = materialise(_bitmap(lengths, "n"), "dedup-lengths")
    alive = _marked(keyed, by_length, "n").where("alive")
    # Level 2: of those, prefixes that more than one row has.
    prefixed = alive.withColumn("p", F.xxhash64(F.substring("t", 1, PREFIX)))
    prefixes = prefixed.groupBy("n", "p").agg(F.count("*").alias("c")).where("c > 1")
    by_prefix = materialise(_bitmap(prefixes, "n", "p"), "dedup-prefixes")
    # Level 3: full content, of what is still there. Others get no hash and are alone.
    p = F.when(F.col("alive"), F.xxhash64(F.substring("t", 1, PREFIX)))
    lined = _marked(keyed, by_length, "n").withColumn("p", p).withColumnRenamed("alive", "by_length")
    lined = _marked(lined, by_prefix, "n", "p").withColumn("alive", F.col("by_length") & F.col("alive"))
    h, h2 = (F.when(F.col("alive"), x) for x in (F.xxhash64("t"), F.xxhash64(F.lit(1), "t")))
    full = materialise(lined.select("doc_id", "n", "p", h.alias("h"), h2.alias("h2"), *(c.alias(k) for k, c in carry.items())), "dedup-keys")
    hashed, alone = full.where("h is not null"), full.where("h is null")
    groups = hashed.groupBy("n", "p", "h", "h2").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # `j` keeps the join from using the groups' own partitioning, in which a hot group couldn't be split.
    j = F.xxhash64("h2", "h").alias("j")
    members = hashed.select("doc_id", "n", "p", "h", "h2", j, *carry).join(groups.select("*", j), ["n", "p", "h", "h2", "j"], "left")
    keep, size = F.coalesce("keep_id", "doc_id"), F.coalesce("group_size", F.lit(1))
    out = members.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), *carry)
    out = out.unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *carry))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
