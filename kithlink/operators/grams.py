"""TF-IDF vectors of character n-grams, made text by text: no row stands for a text's term, so only sums by term and the texts
are shuffled.

A block's texts are dealt to parts of about `TEXTS`, or `TILE` for packed ones; each part meets its block's vocabulary, at most max_features rows, so
neither a block's texts nor all blocks' vocabularies have to fit in a task. The n-grams are those of `functions.text.word_ngrams`.

Defined cases: a null or blank text has no terms, and a text without kept terms no vector."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXTS, TILE = 8192, 16384
#: Sums by term that a task holds before it gives them out, and words whose n-grams it remembers.
HELD, REMEMBERED = 300_000, 50_000
TILED = pa.schema([("block_key", pa.string()), ("side", pa.string()), ("ids", pa.list_(pa.string())), *((c, pa.binary()) for c in ("lens", "norms", "codes", "tfs", "idf"))])
BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


class Grams:
    """From texts to counts of n-grams inside words padded by one blank."""

    def __init__(self, low: int, high: int):
        self.low, self.high, self.known = low, high, {}

    def of(self, word: str) -> list[str]:
        p = f" {word} "
        n = len(p)
        return [p] if n < self.low else [p[i : i + k] for k in range(self.low, min(self.high, n) + 1) for i in range(n - k + 1)]

    def counts(self, text: str | None) -> Counter:
        found: list[str] = []
        for w in BLANKS.split(text or ""):
            if w:
                g = self.known.get(w)
                if g is None:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    g = self.known[w] = self.of(w)
                found += g
        return Counter(found)


def counts(texts: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """(block_key, term, df, total) of texts (block_key, column)."""

    def run(batches):
        grams, sums = Grams(low, high), {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in (0, 1))], names=["block_key", "term", "df", "total"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for term, n in grams.counts(text).items():
                    x = sums.get((key, term))
                    if x is None:
                        sums[key, term] = [1, n]
                    else:
                        x[0] += 1
                        x[1] += n
                if len(sums) >= HELD:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    some = texts.select("block_key", column).mapInArrow(run, "block_key string, term string, df long, total long")
    return some.groupBy("block_key", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def idf(df: int, n: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


class Coded:
    """From texts to vectors of tf times idf: places of a text's terms in the list, in order, and weights. idf: of each term."""

    def __init__(self, terms: list[str], idf: list[float], low: int, high: int):
        self.code, self.idf = {t: i for i, t in enumerate(terms)}, np.array(idf)
        self.grams, self.known = Grams(low, high), {}

    def of(self, word: str) -> array:
        c = self.known.get(word)
        if c is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            c = self.known[word] = array("q", [self.code[g] for g in self.grams.of(word) if g in self.code])
        return c

    def vectors(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """(lists of codes, lists of weights), empty for a text without terms."""
        codes, ends = array("q"), []
        for text in texts:
            for w in BLANKS.split(text or ""):
                if w:
                    codes.extend(self.of(w))
            ends.append(len(codes))
        size = max(len(self.idf), 1)
        rows = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        keys, tf = np.unique(rows * size + np.frombuffer(codes, np.int64), return_counts=True)
        rows, codes = keys // size, keys % size
        w = tf * self.idf[codes]
        norms = np.sqrt(np.bincount(rows, w * w, len(texts)))
        at = pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=len(texts)))), pa.int32())
        return pa.ListArray.from_arrays(at, pa.array(codes)), pa.ListArray.from_arrays(at, pa.array(w / norms[rows]))


def vectors_in(texts: pa.Table, vocabulary: pa.Table, low: int, high: int, sublinear: bool) -> pa.Table:
    """(block_key, side, entity_id, terms, weights) of one part. texts (block_key, side, entity_id, text), vocabulary (term, df, n)."""
    held = {t: idf(df, n) for t, df, n in zip(*(vocabulary[c].to_pylist() for c in ("term", "df", "n")))}
    grams, rows, lens, terms, weights = Grams(low, high), [], [0], [], []
    for i, text in enumerate(texts["text"].to_pylist()):
        mine = sorted((t, n) for t, n in grams.counts(text).items() if t in held)
        if mine:
            w = [((1 + math.log(n)) if sublinear else n) * held[t] for t, n in mine]
            norm = math.sqrt(sum(x * x for x in w))
            terms += [t for t, _ in mine]
            weights += [x / norm for x in w]
            rows.append(i)
            lens.append(len(terms))
    ends, kept = pa.array(np.array(lens, dtype=np.int32)), texts.select(["block_key", "side", "entity_id"]).take(pa.array(rows, pa.int64()))
    lists = pa.ListArray.from_arrays(ends, pa.array(terms, pa.string())), pa.ListArray.from_arrays(ends, pa.array(weights, pa.float64()))
    return kept.append_column("terms", lists[0]).append_column("weights", lists[1])


def packed(x: list, kind: type) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    return np.array(x, dtype=np.min_scalar_type(max(x))).tobytes() if kind is int else np.array(x, dtype=np.float64).tobytes()


def tiles_in(texts: pa.Table, vocabulary: pa.Table, low: int, high: int) -> pa.Table:
    """One part's vectors as one row for each side: terms as their places in the vocabulary, and what the weights are made of.

    ids in their order; n: terms of each; norms of each; codes, tfs: row after row; idf: by code."""
    known = sorted(zip(*(vocabulary[c].to_pylist() for c in ("term", "df", "n"))))
    code, idf = {t: i for i, (t, _, _) in enumerate(known)}, [math.log((1 + n) / (1 + df)) + 1 for _, df, n in known]
    grams, out = Grams(low, high), []
    texts = texts.take(pc.sort_indices(texts, sort_keys=[("entity_id", "ascending")]))
    for side in "qc":
        mine = texts.filter(pc.equal(texts["side"], side))
        ids, lens, norms, codes, tfs = [], [], [], array("I"), array("I")
        for e, text in zip(mine["entity_id"].to_pylist(), mine["text"].to_pylist()):
            if terms := sorted((code[t], n) for t, n in grams.counts(text).items() if t in code):
                ids.append(e)
                lens.append(len(terms))
                norms.append(math.sqrt(sum(w * w for w in ((1 + math.log(n)) * idf[c] for c, n in terms))))
                codes.extend(c for c, _ in terms)
                tfs.extend(n for _, n in terms)
        if ids:
            out.append((mine["block_key"][0].as_py(), side, ids, packed(lens, int), packed(norms, float), packed(codes, int), packed(tfs, int), packed(idf, float)))
    return pa.Table.from_pylist([dict(zip(TILED.names, x)) for x in out], TILED)


def unpacked(x: pa.RecordBatch, row: int, side: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]:
    """(ids, terms of each, codes, weights, terms in the vocabulary) of one side of a row with two tiles."""
    ids = x[f"{side}_ids"][row].values
    raw = {c: x[f"{side}_{c}"][row].as_py() for c in TILED.names[3:]}
    whole = lambda c, n: np.frombuffer(raw[c], f"u{len(raw[c]) // n}").astype(np.int64)
    n = whole("lens", len(ids))
    codes, tfs = whole("codes", n.sum()), whole("tfs", n.sum())
    idf, norms = (np.frombuffer(raw[c], np.float64) for c in ("idf", "norms"))
    each, at = np.unique(tfs, return_inverse=True)
    logs = np.array([1 + math.log(k) for k in each.tolist()])  # as when the norms were made
    return ids, n, codes, logs[at] * idf[codes] / np.repeat(norms, n), len(idf)


def dealt(texts: DataFrame, column: str, vocabulary: DataFrame, sizes: DataFrame, part: int):
    """Texts and their block's vocabulary, by part. A part is little to read and much to work on: adaptive execution, which goes by bytes,
    would lay all of them into a task or two, so the number of partitions is given."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.broadcast(sizes.select("block_key", F.ceil(F.col("n") / part).cast("int").alias("parts")).where("parts > 1"))  # fewer than there are parts
    n = F.coalesce("parts", F.lit(1))
    mine = texts.select("block_key", "side", "entity_id", F.col(column).alias("text")).join(parts, "block_key", "left")
    mine = mine.select("block_key", F.pmod(F.xxhash64("entity_id", "side"), n).cast("int").alias("part"), "side", "entity_id", "text")
    theirs = vocabulary.join(parts, "block_key", "left").select("block_key", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"), "term", "df", "n")
    mine, theirs = (x.repartition(tasks, "block_key", "part") for x in (mine, theirs))
    return mine.groupBy("block_key", "part").cogroup(theirs.groupBy("block_key", "part"))


def vectors(texts: DataFrame, column: str, vocabulary: DataFrame, sizes: DataFrame, low: int, high: int, *, sublinear: bool = True, part: int = TEXTS) -> DataFrame:
    """(block_key, side, entity_id, terms, weights): unit vectors over the kept terms, which stand in order.

    texts (block_key, side, entity_id, column); vocabulary (block_key, term, df, n); sizes (block_key, n)."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return vectors_in(a, b, low, high, sublinear)

    schema = "block_key string, side string, entity_id string, terms array<string>, weights array<double>"
    return dealt(texts, column, vocabulary, sizes, part).applyInArrow(run, schema)


def tiles(texts: DataFrame, column: str, vocabulary: DataFrame, sizes: DataFrame, low: int, high: int, *, part: int = TILE) -> DataFrame:
    """The vectors of `vectors` (sublinear), packed by part and side: 3 bytes a term for the usual vocabulary."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return tiles_in(a, b, low, high)

    schema = "block_key string, side string, ids array<string>, " + ", ".join(f"{c} binary" for c in TILED.names[3:])
    return dealt(texts, column, vocabulary, sizes, part).applyInArrow(run, schema)
