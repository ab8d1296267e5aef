"""Near copies by shared five-word shingles: groups of texts linked by a Jaccard similarity of 0.8 or more.

Texts with the same set of shingles are one node. Candidates come from minhashes, 28 bands of 7: two texts of similarity
0.8 share a band with probability 0.9986, of 0.85 with 0.99998. Texts that share bands form coarse groups, and in these the
shingle sets themselves are compared, so every link is exact; a coarse group of more than `TILE` nodes is cut into
tiles, each pair of which is one unit of work.

Only texts in coarse groups are shuffled: the others are told apart at the scan by a bitmap of fixed size.

Defined cases: null, empty and blank texts have no shingle and are copies of each other; texts of fewer than 5 words are
one shingle; rows without doc_id take no part; rows that share a doc_id each have a set; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.llm.common import materialise, text_of
from kithlink.llm.components import components
from kithlink.llm.exact_dedup import _bitmap, _marked
from kithlink.llm.simhash import _Forest, near_groups

SHINGLE, SEED, BANDS, ROWS, TILE = 5, 42, 28, 7, 256


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted."""
    import xxhash

    h = xxhash.xxh64_intdigest
    w = text.encode().lower().split()
    if len(w) < SHINGLE:
        return np.array([h(b" ".join(w), SEED)] if w else [], dtype=np.uint64)
    return np.unique(np.array([h(b" ".join(x), SEED) for x in zip(*(w[i:] for i in range(SHINGLE)))], dtype=np.uint64))


def _long(data: bytes, seed: int = SEED) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(data, seed)
    return x - (1 << 64) if x >> 63 else x


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    n, m = sorted((len(a), len(b)))
    return 5 * n >= 4 * m and 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (n + m)


_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def bands(hashes: np.ndarray) -> list[int]:
    """A long for each band."""
    if not len(hashes):
        return []
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(x), 512):
        low = np.minimum(low, (x[at : at + 512] * _MUL + _ADD).min(axis=1))
    return [_long(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]


def links_within(keys: list[int], sets: list[np.ndarray], tile: list[int], cross: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links of one unit. cross: two tiles, whose inner links are other units' work."""
    forest, out = _Forest(len(keys)), []
    for i in range(len(keys)):
        for j in range(i):
            if (not cross or tile[i] != tile[j]) and forest.root(i) != forest.root(j) and similar(sets[i], sets[j]):
                forest.join(i, j)
                out.append((keys[i], keys[j]))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bands)"""

    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([_long(s.tobytes()) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "key", "bands"]
            )

    return docs.mapInArrow(run, "doc_id long, key long, bands array<long>")


def _units(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(cluster, a, b, tile, key, text): what is to be compared. members: (key, rep, cluster, tiles, tile)"""
    bitmap = materialise(_bitmap(members, "rep"), "shingles-bitmap")
    alive = _marked(docs.withColumn("rep", F.col("doc_id")), bitmap, "rep").where("alive").select("doc_id", "text")

    def run(batches):
        for b in batches:
            keys = [_long(shingles(t.as_py()).tobytes()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), b.column(1)], names=["rep", "key", "text"])

    rows = alive.mapInArrow(run, "rep long, key long, text string").join(members, ["rep", "key"])
    rows = rows.select("cluster", "tile", "key", "text", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    return rows.select("cluster", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "key", "text")


def links(units: DataFrame) -> DataFrame:
    """(a, b): exact links that connect what is connected."""

    def run(batches):
        now, seen = None, {}

        def found():
            pairs = links_within(list(seen), [s for s, _ in seen.values()], [t for _, t in seen.values()], now[1] != now[2])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            c = [batch.column(n).to_pylist() for n in ("cluster", "a", "b", "tile", "key")]
            for unit, tile, key, text in zip(zip(*c[:3]), c[3], c[4], batch.column("text")):
                if unit != now:
                    if seen:
                        yield found()
                    now, seen = unit, {}
                if key not in seen:
                    seen[key] = shingles(text.as_py()), tile
        if seen:
            yield found()

    dealt = units.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).where("doc_id is not null")
    rows = materialise(_keyed(docs), "shingles-keys")
    nodes = materialise(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "shingles-nodes")
    each = nodes.select("key", F.explode("bands").alias("value"))
    hubs = each.groupBy("value").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1")
    # `j` asks for an exchange above the aggregation, in which a hot bucket can be split.
    j = F.xxhash64(F.lit(7), "value").alias("j")
    pairs = each.select("key", "value", j).join(hubs.select("value", "hub", j), ["value", "j"]).where("key <> hub")
    coarse = materialise(components(pairs.select("key", "hub").distinct()), "shingles-coarse")
    members = coarse.select(F.col("u").alias("key"), F.col("v").alias("cluster"))
    members = members.unionByName(coarse.select(F.col("v").alias("key"), F.col("v").alias("cluster")).distinct())
    j = F.xxhash64(F.lit(7), "cluster").alias("j")
    sizes = coarse.groupBy(F.col("v").alias("cluster")).agg(F.ceil((F.count("*") + 1) / TILE).cast("int").alias("tiles"))
    members = members.select("key", "cluster", j).join(sizes.select("cluster", "tiles", j), ["cluster", "j"])
    members = members.join(nodes.select("key", "rep"), "key")
    members = materialise(members.select("key", "rep", "cluster", "tiles", F.pmod(F.xxhash64("key"), "tiles").cast("int").alias("tile")), "shingles-members")
    stars = components(links(_units(members, docs)))
    rooted = nodes.join(stars.withColumnRenamed("u", "key"), "key", "left").select("key", "rep", F.coalesce("v", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    j = F.xxhash64(F.lit(7), "root").alias("j")
    labels = rooted.select("key", "root", j).join(least.select("root", "component_id", j), ["root", "j"]).select("key", "component_id")
    return rows.select("doc_id", "key").join(materialise(labels, "shingles-labels"), "key").select("doc_id", "component_id")


def near_or_similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id: linked by near fingerprints (`simhash.near_groups`) or by shared shingles.

    The links of both are one graph, so a chain of either kind is one group. Rows that share a doc_id are one document of it."""
    docs = docs.where("doc_id is not null")
    near = materialise(near_groups(docs).select("doc_id", "component_id"), "near-groups")
    both = near.unionByName(materialise(similar_groups(docs), "similar-groups")).select("doc_id", "component_id")
    stars = components(both.distinct())
    j = F.xxhash64(F.lit(7), "doc_id").alias("j")
    met = near.select("doc_id", j).join(stars.select(F.col("u").alias("doc_id"), "v", F.xxhash64(F.lit(7), "u").alias("j")), ["doc_id", "j"], "left")
    return met.select("doc_id", F.coalesce("v", "doc_id").alias("component_id"))
