"""Business entities derived from the driver's documents: one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY_SQL = """
select doc_id as k,
       case when doc_id % 3 = 0 then 1 when doc_id % 3 = 1 then 2 else 3 end as src,
       concat('D', cast(doc_id as string)) as entity_id,
       concat(regexp_extract(trim(replace(text, chr(10), ' ')), '^([^ ]+( +[^ ]+){0,5})', 1),
              case when n_chars % 4 = 0 then ' & Co. Ltd' when n_chars % 4 = 1 then ' Inc.' when n_chars % 4 = 2 then ' Pvt' else '' end) as business_name,
       concat(cast(1 + n_chars % 97 as string), case when n_chars % 5 = 0 then 'b' else '' end, ' ',
              reverse(regexp_extract(reverse(trim(replace(text, chr(10), ' '))), '^([^ ]+ +[^ ]+)', 1)),
              ' Rd, near Sq. ', cast(10000 + n_chars % 911 as string)) as business_address,
       case when doc_id % 41 = 0 then '' when lang = 'en' then 'U.S.' when lang = 'de' then 'Bharat' else lang end as country,
       md5(text) as h
from documents
"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, src, RAW, h)"""
    return spark.sql(ENTITY_SQL.replace("from documents", "from {docs}").replace("{0,5}", "{{0,5}}"), docs=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def truth_pairs(ent: DataFrame) -> DataFrame:
    """Exact copies across the sides are true matches, in whatever country they are."""
    q = ent.where("src = 1").select(F.col("entity_id").alias("source1_entity_id"), "h")
    c = ent.where("src <> 1").select(F.col("entity_id").alias("candidate_entity_id"), "h")
    return q.join(c, "h").select("source1_entity_id", "candidate_entity_id")
