"""Deduplication of lines across documents over levelled sorted runs, with DataFrame functions only.

A line's key is the line without white space at its ends, ASCII lower case; two independent 64-bit hashes stand for it.
Keys that are long enough and lie in enough documents are heavy. Their occurrences go through an index of sorted runs
in batches of descending doc_id and about as many rows each: each batch merge-anti-joins the runs for the keys that no
larger document holds, which are the batch's own and become a new sorted run; any other occurrence is a repetition. Runs
of one level are merged into one of the next when there are `FANOUT` of them, so a batch meets few runs. A run is a table
bucketed by key and sorted in its buckets, and so are a batch's own keys: the merge joins read both as they lie. The runs (`LineIndex`) stay usable: later tables can be held against them.

Defined cases: null and empty texts are one empty line; a text that loses all lines becomes empty; rows that share a
doc_id count as one document and lose the same lines; a line twice in one document counts once and both stay or go;
rows with a null doc_id keep all lines and count for nothing; an empty table gives no rows. Extra columns are ignored
by `line_stats` and `dropped_keys` and kept by `drop_lines`, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.llm.common import SPACES, ascii_lower, materialise, numbered, scratch, text_of

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2


def lines(column: str = "text") -> Column:
    return F.split(text_of(column), "\n", -1)


def key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashes(k: Column) -> Column:
    return F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))


class LineIndex:
    """Levels of sorted runs (a, b, keeper): which document keeps a heavy line."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        for r in self.runs():
            keys = keys.join(r.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        return keys

    def _sorted(self, rows: DataFrame, level: int) -> DataFrame:
        name = f"kithlink_lines_{uuid.uuid4().hex}"
        dealt = rows.select("a", "b", "keeper").repartition(self.buckets, "a", "b")  # a file for each bucket
        dealt.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", scratch(self.spark, f"lines-run{level}")).saveAsTable(name)
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> None:
        """batch (a, b, doc_id): its unseen keys become a run, kept by the batch's largest document."""
        # Written before the joins, which would otherwise go below the aggregation and shuffle every occurrence of a hot line.
        own = self._sorted(batch.groupBy("a", "b").agg(F.max("doc_id").alias("keeper")), 0)
        self.levels[0].append(self._sorted(self.unseen(own), 0) if self.runs() else own)
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = level[0]
                for r in level[1:]:  # keys of different runs are different: a union is a merge
                    merged = merged.unionByName(r)
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._sorted(merged, i + 1))
                self.levels[i] = []

    def all(self) -> DataFrame:
        rows = self.spark.createDataFrame([], "a long, b long, keeper long")
        for r in self.runs():
            rows = rows.unionByName(r)
        return rows


def dropped_keys(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, drops): the hashes of the keys that a document loses. Documents that lose none aren't there."""
    long = F.filter(F.transform(lines(), key), lambda k: F.length(k) >= min_chars)
    held = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(F.transform(long, _hashes))).alias("k"))
    held = held.select("doc_id", F.col("k.a").alias("a"), F.col("k.b").alias("b"))
    # Rows that share a doc_id: the largest and smallest tell one document from more, and only few keys need an exact count.
    counts = held.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("hi"), F.min("doc_id").alias("lo")).where(f"n >= {min_docs} and (hi > lo or {min_docs} < 2)")
    may = materialise(counts.select("a", "b"), "lines-frequent")
    occurrences = materialise(held.join(may, ["a", "b"]).select("a", "b", "doc_id"), "lines-held")
    distinct = occurrences.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))
    heavy = materialise(distinct.groupBy("a", "b").agg(F.count("*").alias("n")).where(f"n >= {min_docs}").select("a", "b"), "lines-heavy")
    j = F.xxhash64("b", "a").alias("j")
    occurrences = materialise(distinct.select("a", "b", "doc_id", j).join(heavy.select("a", "b", j), ["a", "b", "j"]).select("a", "b", "doc_id"), "lines-occurrences")
    cuts = occurrences.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    index = LineIndex(docs.sparkSession, fanout)
    if cuts is not None:
        above = None
        for cut in [*sorted(set(cuts), reverse=True), None]:
            part = occurrences if cut is None else occurrences.where(F.col("doc_id") > cut)
            index.add(part if above is None else part.where(F.col("doc_id") <= above))
            above = cut
    # `j` asks for an exchange of both sides, in which a hot key can be split.
    again = occurrences.select("a", "b", "doc_id", j).join(index.all().select("a", "b", "keeper", j), ["a", "b", "j"]).where("doc_id <> keeper")
    return again.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("drops"))


def _kept(drops: str = "drops") -> Column:
    """Lines of the text that stay, in order."""
    gone = lambda line: F.when(F.length(key(line)) >= 1, F.array_contains(F.col(drops), _hashes(key(line)))).otherwise(False)
    return F.when(F.col(drops).isNull(), lines()).otherwise(F.filter(lines(), lambda x: ~gone(x)))


def _joined(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, and columns that don't clash) with __drops."""
    return docs.join(dropped_keys(docs.select("doc_id", "text"), **options).withColumnsRenamed({"doc_id": "__doc", "drops": "__drops"}), F.col("doc_id") == F.col("__doc"), "left").drop("__doc")


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the lines gone and n_chars, if there is one, put right."""
    plain, names = numbered(docs)
    rows = _joined(plain.withColumnsRenamed({names["doc_id"]: "doc_id", names["text"]: "text"}), **options)
    new = F.when(F.col("__drops").isNull(), F.col("text")).otherwise(F.array_join(_kept("__drops"), "\n"))
    rows = rows.withColumn("text", new).withColumnsRenamed({"doc_id": names["doc_id"], "text": names["text"]})
    if n := names.get("n_chars"):
        rows = rows.withColumn(n, F.when(F.col("__drops").isNull(), F.col(n)).otherwise(F.length(names["text"]).cast(docs.schema["n_chars"].dataType)))
    return rows.select(*plain.columns).toDF(*docs.columns)


def line_stats(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row, text as it stays."""
    rows = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    n = F.size(lines())
    out = rows.select("doc_id", n.cast("long").alias("n_lines"), _kept("__drops").alias("kept"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
