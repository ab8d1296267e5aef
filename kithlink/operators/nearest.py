"""The nearest catalogue vectors of each query vector of a block, exactly, by products of sparse tiles.

A block's query vectors are dealt to parts of about `QUERIES`, its catalogue vectors to parts of about `CATALOGUE`; two
parts are one unit of work, so no block has to fit in a task. (`nearest_tiles` gets its vectors packed as such parts.) A unit's catalogue is turned into postings, and each query sums the
products of its terms' postings for every entity at once; only its `top_k` leave the unit. So shuffles and results grow
with the entities and the number of parts, never with the pairs.

Defined cases: an entity without terms has no vector and meets nothing; ties go to the smaller id, by its bytes.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithlink.operators.grams import unpacked

PAIR = ["source1_entity_id", "candidate_entity_id"]
QUERIES, CATALOGUE = 4096, 8192
FOUND = pa.schema([(PAIR[0], pa.string()), (PAIR[1], pa.string()), ("score", pa.float64()), ("n", pa.int64()), ("n2", pa.int64())])
FOUND_SQL = f"{PAIR[0]} string, {PAIR[1]} string, score double, n long, n2 long"


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: halves of the shortest decimal form go up."""
    unit = 10.0**digits
    y = x * unit
    whole = np.floor(y)
    out = (whole + (y - whole >= 0.5)) / unit
    for i in np.flatnonzero(np.abs(y - whole - 0.5) < 1e-6):  # the product may lie on the other side of the half
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def flat(lists: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The lists' values one after another, and the lists' lengths."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def nearest_in(unit: pa.Table, floor: float, top_k: int, digits: int) -> pa.Table:
    """The top_k of each query among the unit's catalogue. unit: (side, entity_id, terms, weights)"""
    q = unit.filter(pc.equal(unit["side"], "q"))
    c = unit.filter(pc.equal(unit["side"], "c"))
    if not q.num_rows or not c.num_rows:
        return FOUND.empty_table()
    c = c.take(pc.sort_indices(c, sort_keys=[("entity_id", "ascending")]))
    (qt, n), (ct, n2) = flat(q["terms"]), flat(c["terms"])
    codes = pa.concat_arrays([qt, ct]).dictionary_encode()
    terms, codes = len(codes.dictionary), codes.indices.to_numpy().astype(np.int64)
    qw, cw = (flat(x["weights"])[0].to_numpy() for x in (q, c))
    i, j, scores = products(n, codes[: len(qt)], qw, n2, codes[len(qt) :], cw, terms, floor, top_k, digits)
    return pa.Table.from_arrays([q["entity_id"].take(pa.array(i)), c["entity_id"].take(pa.array(j)), pa.array(scores), pa.array(n[i]), pa.array(n2[j])], schema=FOUND)


def products(n: np.ndarray, qt: np.ndarray, qw: np.ndarray, n2: np.ndarray, ct: np.ndarray, cw: np.ndarray, terms: int, floor: float, top_k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, catalogue row, score) of the top_k of each query; the catalogue stands in order of its ids.

    n, n2: how many terms each row has; qt, ct: their codes below terms, row after row; qw, cw: their weights."""
    by = np.argsort(ct, kind="stable")
    docs, weights = np.repeat(np.arange(len(n2)), n2)[by], cw[by]
    at = np.append(0, np.cumsum(np.bincount(ct, minlength=terms)))
    ends = np.cumsum(n)
    least = floor - 10.0**-digits
    rows, found, scores = [], [], []
    for i in range(len(n)):
        mine = slice(ends[i] - n[i], ends[i])
        spans = [(a, b) for a, b in zip(at[qt[mine]].tolist(), at[qt[mine] + 1].tolist()) if a < b]
        if not spans:
            continue
        each = [w * weights[a:b] for w, a, b in zip(qw[mine][at[qt[mine]] < at[qt[mine] + 1]].tolist(), *zip(*spans))]
        dot = np.bincount(np.concatenate([docs[a:b] for a, b in spans]), np.concatenate(each), len(n2))
        hit = np.flatnonzero(dot >= least)
        if len(hit) > top_k:  # what is a unit of rounding below the last of the best can't be one
            hit = hit[dot[hit] >= np.partition(dot[hit], len(hit) - top_k)[len(hit) - top_k] - 10.0**-digits]
        score = rounded(dot[hit], digits)
        hit, score = hit[score >= floor], score[score >= floor]
        best = np.argsort(-score, kind="stable")[:top_k]
        rows.append(np.full(len(best), i))
        found.append(hit[best])
        scores.append(score[best])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def nearest(vectors: DataFrame, floor: float, top_k: int, *, digits: int = 0, queries: int = QUERIES, catalogue: int = CATALOGUE) -> DataFrame:
    """(PAIR, score, n, n2): of each query vector the top_k catalogue vectors of its block by product, rounded, floor at least.

    vectors: (block_key, side, entity_id, terms, weights), read twice; n, n2: how many terms either side has."""
    count = lambda side: F.sum((F.col("side") == side).cast("long"))
    parts = vectors.groupBy("block_key").agg(F.ceil(count("q") / queries).cast("int").alias("qs"), F.ceil(count("c") / catalogue).cast("int").alias("cs"))
    parts = F.broadcast(parts.where("qs > 1 or cs > 1"))  # fewer than there are parts
    one, asks = F.lit(1), F.col("side") == "q"
    v = vectors.join(parts, "block_key", "left").withColumns({"qs": F.greatest(F.coalesce("qs", one), one), "cs": F.greatest(F.coalesce("cs", one), one)})
    mine = F.pmod(F.xxhash64("entity_id"), F.when(asks, F.col("qs")).otherwise(F.col("cs"))).cast("int")
    v = v.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(asks, F.col("cs")).otherwise(F.col("qs")) - 1)))
    v = v.select("block_key", F.when(asks, F.col("mine")).otherwise(F.col("other")).alias("a"), F.when(asks, F.col("other")).otherwise(F.col("mine")).alias("b"), "side", "entity_id", "terms", "weights")

    def run(unit: pa.Table) -> pa.Table:
        return nearest_in(unit, floor, top_k, digits)

    return best_of(v.groupBy("block_key", "a", "b").applyInArrow(run, FOUND_SQL), top_k)


def best_of(found: DataFrame, top_k: int) -> DataFrame:
    best = Window.partitionBy(PAIR[0]).orderBy(F.desc("score"), PAIR[1])
    return found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= top_k).drop("rn")


def nearest_tiles(tiles: DataFrame, floor: float, top_k: int, *, digits: int = 0) -> DataFrame:
    """As `nearest` and with block_key, of staged tiles of `grams.tiles`. Each task reads its two tiles from where they lie, so no vector is
    dealt out once for each tile that it meets."""
    held = {r["side"]: r["count"] for r in tiles.groupBy("side").count().collect()}

    def side(name: str) -> DataFrame:
        return tiles.where(F.col("side") == name).drop("side").select(*(F.col(c).alias(f"{name}_{c}") for c in tiles.columns if c != "side")).repartition(max(1, held.get(name, 0)))

    # Two bounds instead of an equality, which would deal all tiles of a block to one task.
    met = side("q").join(side("c"), F.expr("q_block_key >= c_block_key and q_block_key <= c_block_key"))

    def run(batches):
        for x in batches:
            for row in range(x.num_rows):
                (ids, n, qt, qw, terms), (ids2, n2, ct, cw, _) = (unpacked(x, row, s) for s in "qc")
                i, j, scores = products(n, qt, qw, n2, ct, cw, terms, floor, top_k, digits)
                key = pa.array([x["q_block_key"][row].as_py()] * len(i), pa.string())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids2.take(pa.array(j)), pa.array(scores), pa.array(n[i]), pa.array(n2[j]), key], names=[*FOUND.names, "block_key"])

    return best_of(met.mapInArrow(run, f"{FOUND_SQL}, block_key string"), top_k)
