"""The corpus pipeline: from raw documents to packed sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns what its operator keeps, whole rows with the columns of documents;
the last returns pieces of sequences. `run` writes each stage's rows to the shared folder and reads them again for the
next, so a stage's lineage ends there; a stage's table is deleted once the next one's is written, but for the last.

Defined cases: null, empty and blank texts have no words and go with the quality rules; rows without doc_id lose no lines
and are no near copies; rows that share a doc_id are one document to the near-copy stage, which leaves one row of it;
repeated rows of other stages go or stay alike; extra columns are kept up to packing, whatever their names; an empty
table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kithlink.llm import line_dedup, packing, quality_rules, shingle_groups, simhash, toxicity
from kithlink.llm.common import documents, release, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train_labels(spark, sf_dir))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle_groups.near_or_similar_groups)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_bad), ("line_dedup", drop_lines), ("simhash", drop_near_copies), ("packing", pack)]
#: Models, fingerprints and token ids are outside SQL; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        kept, path = stage(spark, docs, sf_dir), scratch(spark, f"pipeline-{name}")
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            release(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
