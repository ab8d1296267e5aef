"""Readers of entities, ground truth and cached tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.functions.text import blank
from kithlink.operators.normalise import RAW, normalise


def read_tsv(spark: SparkSession, path: str, columns: list[str], multiline: bool = False) -> DataFrame:
    """All columns as text, blanks for missing ones; NA is text. multiline: fields hold line ends, which costs split reads."""
    schema = ", ".join(f"{c} string" for c in columns)
    r = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    df = r.csv(path)
    return df.select(*(blank(F.col(c)).alias(c) for c in columns))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, RAW)


def load_and_normalise(spark: SparkSession, path: str, cache: str | None = None, force: bool = False) -> DataFrame:
    """Normalised entities; with cache, a Parquet table there that is made where it's missing, or anew with force."""
    if cache is None:
        return normalise(read_entities(spark, path))
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
    if force or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        normalise(read_entities(spark, path)).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


@dataclass(frozen=True)
class Truth:
    """entities: every query id, those without a match too; pairs: the matches."""

    entities: DataFrame
    pairs: DataFrame


def truth_of(rows: DataFrame) -> Truth:
    """rows (source1_entity_id, matched_entity_ids), a comma list; a repeated id counts as its last row stands."""
    line = rows.withColumn("__at", F.monotonically_increasing_id())
    last = line.groupBy("source1_entity_id").agg(F.max_by("matched_entity_ids", "__at").alias("m"))
    listed = last.select("source1_entity_id", F.explode(F.split(F.trim(blank(F.col("m"))), ",")).alias("candidate_entity_id"))
    return Truth(last.select("source1_entity_id"), listed.where("candidate_entity_id <> ''").distinct())


def load_ground_truth(spark: SparkSession, path: str) -> Truth:
    return truth_of(read_tsv(spark, path, ["source1_entity_id", "matched_entity_ids"]))


def load_split(spark: SparkSession, folder: str, split: str, sample: int | None = None, cache: str | None = None, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised S1, S2, S3 of `train` or `test`, sampled if asked for."""
    from kithlink.operators.sampling import catalogue_cap, sample_by_country, sample_entities

    s1, s2, s3 = (load_and_normalise(spark, f"{folder}/{split}_source{i}.tsv", f"{cache}/{split}_source{i}_normalized.parquet" if cache else None, force) for i in (1, 2, 3))
    if sample:
        s1 = sample_entities(s1, sample)
        s2, s3 = (sample_by_country(s, catalogue_cap(sample), s1) for s in (s2, s3))
    return s1, s2, s3


