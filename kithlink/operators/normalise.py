"""Raw entities to normalised entities: one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.functions import text as T

RAW = ["entity_id", "business_name", "business_address", "country"]


def normalise(df: DataFrame) -> DataFrame:
    """df (RAW, and other columns that stay) with the derived columns."""
    d = df.withColumns({c: T.blank(F.col(c)) for c in RAW[1:]})
    d = d.withColumns({"__name": T.tokens(F.col("business_name")), "__addr": T.expand_address(T.tokens(F.col("business_address")))})
    d = d.withColumns({"name_tokens": T.core_tokens(F.col("__name")), "addr_norm": F.array_join("__addr", " ")})
    core = F.col("name_tokens")
    return d.withColumns(
        {
            "name_norm": F.array_join(core, " "),
            "name_full_norm": F.array_join("__name", " "),
            "name_suffix": T.last_suffix(F.col("__name")),
            "name_first_token": F.coalesce(F.get(core, F.lit(0)), F.lit("")),
            "name_acronym": T.acronym(core),
            "name_token_count": F.size(core),
            "addr_token_count": F.size("__addr"),
            "addr_pin": T.pin(F.col("business_address")),
            "addr_street_num": T.street_number(F.col("addr_norm")),
            "addr_landmark": T.landmark(F.col("addr_norm")),
            "country_norm": T.country(F.col("country")),
        }
    ).drop("__name", "__addr")


def normalise_name(raw: str) -> dict:
    """One name, by the same rules, on the driver (for debugging)."""
    return _one(business_name=raw)


def normalise_address(raw: str) -> dict:
    return _one(business_address=raw)


def normalise_country(raw: str) -> str:
    return _one(country=raw)["country_norm"]


def _one(**given: str) -> dict:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    row = {c: given.get(c, "") for c in RAW}
    return normalise(spark.createDataFrame([row], "entity_id string, business_name string, business_address string, country string")).first().asDict()
