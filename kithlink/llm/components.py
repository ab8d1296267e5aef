"""Connected components of a graph given as edges, by alternating large and small stars.

Each round is two joins or aggregations over edges, written to the shared folder; hot nodes are pre-aggregated and their
edges are split by the adaptive skew join. The edges become stars around the smallest node of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.llm.common import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: neighbours above u go to u's least neighbour; small: neighbours below."""
    if large:
        sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges
    least = sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    # `j` asks for an exchange of its own above the aggregation, in which a hot node can be split.
    j = F.xxhash64(F.lit(7), "u").alias("j")
    met = sides.select("u", "v", j).join(least.select("u", "m", j), ["u", "j"])
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v): every node that isn't the least of its component, and the least. edges: two columns of longs."""
    a, b = edges.columns
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, before = materialise(e, "cc"), None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return e
        before = now
        e = materialise(_stars(materialise(_stars(e, True), "cc-large"), False), "cc-small")
    raise RuntimeError("components haven't settled")
