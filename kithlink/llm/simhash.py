"""Near-duplicates by SimHash with pivot distance tables.

Fingerprints: 4-word shingles of the ASCII-lower-cased text, repeats included, XXH64 with seed 42, majority per bit.
Links: fingerprints that differ in at most 4 bits.

Pairs to look at come from buckets of fingerprints equal under a mask: of 6 blocks of bits, 4 differences leave at least
2 untouched, so every link lies in one of 15 buckets. In a bucket, each fingerprint has a row of Hamming distances to
many reference fingerprints (the pivots). By the triangle inequality two fingerprints within 4 bits have no coordinate
that differs by more than 4; pairs with a larger difference go unseen, and only survivors are verified bit by bit.

Equal fingerprints are one node from the start. A bucket of more than `BUCKET` fingerprints is dealt again by 15 masks
over its remaining bits, which loses no link for the same reason; what is still larger is cut into tiles, each pair of
which is one unit of work, so no bucket has to fit in a task. Only links that join different parts of a task's graph
leave it.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like others; texts of fewer than 4
words are one shingle; rows that share a doc_id each have a fingerprint; null doc_ids never name a component unless it
has no other; an empty table gives no rows; other columns are ignored, or kept by `keep_one`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.llm.common import materialise, numbered, text_of
from kithlink.llm.components import components

SHINGLE, SEED, MAX_BITS, PIVOTS, BUCKET = 4, 42, 4, 32, 512


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest
    w = text.encode().lower().split()
    if not w:
        return 0
    if len(w) < shingle:
        hashes = [h(b" ".join(w), SEED)]
    else:
        hashes = [h(b" ".join(x), SEED) for x in zip(*(w[i:] for i in range(shingle)))]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        a = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(bits: list[int], blocks: int = 6, keep: int = 2) -> list[int]:
    """Masks of `keep` of `blocks` blocks of the given bits: blocks - keep differences leave one of them untouched."""
    cut = [bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks] for i in range(blocks)]
    return [sum(1 << b for block in chosen for b in block) for chosen in combinations(cut, keep)]


FIRST = _masks(list(range(64)))
#: For each first mask, those over the bits that it leaves.
SECOND = [[m | s for s in _masks([b for b in range(64) if not m >> b & 1])] for m in FIRST]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fps ^ p) for p in refs], axis=1).astype(np.int8)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def links_within(group: np.ndarray, fps: np.ndarray, tile: np.ndarray, cross: np.ndarray, refs: np.ndarray, max_bits: int = MAX_BITS):
    """Links among rows of one group (rows sorted by group), as (fp, fp) of a spanning forest.

    cross: the group is a pair of different tiles, whose links within one tile are another group's work."""
    nodes, at = np.unique(fps, return_inverse=True)
    table, forest = distance_table(nodes, refs), _Forest(len(nodes))
    here = np.arange(len(fps))
    for off in range(1, len(fps)):
        here = here[: np.searchsorted(here, len(fps) - off)]
        here = here[group[here] == group[here + off]]
        if not len(here):
            break
        pair = here[~cross[here] | (tile[here] != tile[here + off])]
        i, j = at[pair], at[pair + off]
        near = np.ones(len(i), dtype=bool)
        for c in range(0, table.shape[1], 8):  # most pairs fail on the first few pivots
            k = np.flatnonzero(near)
            near[k] = (np.abs(table[i[k], c : c + 8] - table[j[k], c : c + 8]) <= max_bits).all(axis=1)
        i, j = i[near], j[near]
        true = np.bitwise_count(nodes[i] ^ nodes[j]) <= max_bits
        for x, y in zip(i[true].tolist(), j[true].tolist()):
            forest.join(x, y)
    roots = np.array([forest.root(i) for i in range(len(nodes))], dtype=np.int64)
    k = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[k], nodes[roots[k]]


def _hot(rows: DataFrame, limit: int) -> DataFrame:
    """rows (mask, value, fp) with n, the fingerprints in the bucket where they are more than limit, else null."""
    sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(f"n > {limit}")
    j = F.xxhash64("value", "mask").alias("j")
    return rows.select("*", j).join(sizes.select("mask", "value", "n", j), ["mask", "value", "j"], "left").drop("j")


def _masked(rows: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in masks))
    return rows.select("fp", F.explode(each).alias("k")).select("k.mask", "k.value", "fp")


def links(fps: DataFrame, *, bucket: int = BUCKET, n_pivots: int = PIVOTS) -> DataFrame:
    """(a, b): links that connect what is connected among distinct fingerprints `fp`."""
    first = _hot(_masked(fps, list(enumerate(FIRST))), bucket)
    first = materialise(first, "simhash-buckets")
    plain, hot = first.where("n is null"), first.where("n is not null")
    second = None
    for i in sorted(r[0] for r in hot.select("mask").distinct().collect()):  # 15 masks at most
        part = _masked(hot.where(F.col("mask") == i), [(100 + 15 * i + k, m) for k, m in enumerate(SECOND[i])])
        second = part if second is None else second.unionByName(part)
    zero = F.lit(0)
    work = plain.select("mask", "value", zero.alias("a"), zero.alias("b"), zero.alias("tile"), "fp")
    if second is not None:
        second = materialise(_hot(second, bucket), "simhash-hot")
        tiles = F.ceil(F.col("n") / bucket).cast("int")
        mine = F.pmod(F.xxhash64("fp"), tiles).cast("int")
        tiled = second.where("n is not null").select("mask", "value", "fp", tiles.alias("tiles"), mine.alias("tile"))
        tiled = tiled.select("*", F.explode(F.sequence(zero, F.col("tiles") - 1)).alias("other"))
        tiled = tiled.select("mask", "value", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "fp")
        rest = second.where("n is null").select("mask", "value", zero.alias("a"), zero.alias("b"), zero.alias("tile"), "fp")
        work = work.unionByName(rest).unionByName(tiled)
    refs = pivots(n_pivots)

    def run(batches):
        kept = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def found(c):
            key = np.stack([c["mask"], c["value"], c["a"], c["b"]])
            new = np.append(False, (key[:, 1:] != key[:, :-1]).any(axis=0))
            x, y = links_within(np.cumsum(new), c["fp"].view(np.uint64), c["tile"], c["a"] != c["b"], refs)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], schema=schema)

        for b in batches:
            c = {n: b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in b.schema.names}
            c = c if kept is None else {n: np.concatenate([kept[n], c[n]]) for n in c}
            last = np.flatnonzero((c["mask"] != c["mask"][-1]) | (c["value"] != c["value"][-1]) | (c["a"] != c["a"][-1]) | (c["b"] != c["b"][-1]))
            at = last[-1] + 1 if len(last) else 0
            kept = {n: v[at:] for n, v in c.items()}
            if at:
                yield found({n: v[:at] for n, v in c.items()})
        if kept is not None and len(kept["fp"]):
            yield found(kept)

    dealt = work.repartition("mask", "value", "a", "b").sortWithinPartitions("mask", "value", "a", "b")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows = materialise(fingerprints(docs), "simhash-fps")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    stars = components(links(nodes.select("fp")))
    root = F.coalesce("v", "fp").alias("root")
    rooted = nodes.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "rep", root)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    j = F.xxhash64(F.lit(7), "root").alias("j")
    labels = rooted.select("fp", "root", j).join(least.select("root", "component_id", j), ["root", "j"]).select("fp", "component_id")
    return rows.join(materialise(labels, "simhash-labels"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, groups=near_groups) -> DataFrame:
    """One row of each group: that of the smallest doc_id. Rows without doc_id stay.

    Rows that share a doc_id are one document: it goes if any of them has a smaller doc_id in its group, else the row stays
    that comes first by its text, then by its columns as JSON. Extra columns are kept, whatever their names."""
    plain, names = numbered(docs)
    doc, text = names["doc_id"], names["text"]
    seen = materialise(groups(plain.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))), "simhash-groups")
    drop = seen.where("doc_id <> component_id").select(F.col("doc_id").alias("__doc")).distinct()
    kept = plain.join(drop, F.col(doc) == F.col("__doc"), "left_anti")
    again = seen.where("doc_id is not null").groupBy(F.col("doc_id").alias("__doc")).agg(F.count("*").alias("n")).where("n > 1")
    again = materialise(again.select("__doc"), "simhash-again")
    if not again.isEmpty():
        same, row = F.col(doc) == F.col("__doc"), F.struct(*plain.columns)
        first = kept.join(again, same, "left_semi").groupBy(doc).agg(F.min_by(row, F.struct(F.col(text), F.to_json(row))).alias("__row"))
        kept = kept.join(again, same, "left_anti").unionByName(first.select("__row.*"))
    return kept.toDF(*docs.columns)
