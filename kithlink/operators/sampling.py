"""Samples that depend on ids alone, so that the same rows come from any partitioning: by the MD5 of seed and id, which any
SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), F.col(key)]


def sample_entities(df: DataFrame, n: int, seed: int = 42, key: str = "entity_id") -> DataFrame:
    """n rows, spread by hash."""
    return df.orderBy(*_order(key, seed)).limit(n)


def sample_by_country(df: DataFrame, cap: int, s1: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of df in the countries of s1: all if they are at most cap, else as many of each country, cap in all, one at least."""
    here = s1.select("country_norm").distinct()
    inside = df.join(here, "country_norm", "left_semi").select(*df.columns)
    if inside.count() <= cap:
        return inside
    w = Window.partitionBy("country_norm").orderBy(*_order("entity_id", seed))
    return inside.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max(1, cap // max(here.count(), 1))).drop("__rn")


def catalogue_cap(n: int) -> int:
    return max(400 * n, 100_000)


def cap_training(features: DataFrame, cap: int, seed: int = 42, key: str = "source1_entity_id") -> DataFrame:
    """The rows of at most cap query entities."""
    ids = features.select(key).distinct()
    if ids.count() <= cap:
        return features
    return features.join(ids.orderBy(*_order(key, seed)).limit(cap), key, "left_semi")
