"""Inverted postings, (block_key, side, entity_id, term, tf), and the vocabulary of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["block_key", "side", "entity_id"]


def postings(entities: DataFrame, terms: Column) -> DataFrame:
    """entities (block_key, side, entity_id, ...); terms: an array column of theirs."""
    return entities.select(*KEY, F.explode(terms).alias("term")).groupBy(*KEY, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, sizes: DataFrame, min_df: int, max_df: float, max_features: int) -> DataFrame:
    """(block_key, term, df, n): terms inside the bounds, the max_features most frequent ones of a block.

    counts (block_key, term, df, total); sizes (block_key, n)."""
    inside = counts.join(sizes, "block_key").where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * F.col("n")))
    w = Window.partitionBy("block_key").orderBy(F.desc("total"), "term")
    return inside.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_features).drop("rn", "total")
