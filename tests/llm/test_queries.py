"""The queries over the driver's tables, against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from kithlink.llm.queries import ORACLES, QUERIES
from tests.compare import frames, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    got, want = frames(spark, name, SF, QUERIES, ORACLES)
    assert same(got, want) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_for_each_input_row(spark, name):
    table = "pages" if "html" in name else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = QUERIES[name](spark, SF).toPandas()
    assert got[got.columns[0]].nunique() == n and (len(got) == n or "packing" in name)


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, blank and long texts, ties, repeated rows, clashing columns; then no rows."""
    good = " ".join(" ".join(f"word{i}x{k}" for k in range(9)) + "." for i in range(8))  # one line, with a number another in each
    shared = "a line of more than forty characters that many documents hold."
    rows = [(i, f"{good} {i}\n{shared}" if i % 2 else f"{' '.join(f'other{i}y{k}' for k in range(60))}.\n{shared}", "s", 1, "a", 2) for i in range(20)]
    rows += [rows[4], rows[4], (None, rows[4][1], None, None, None, None), (100, None, "s", 1, "a", 2), (101, "", "s", 1, "a", 2), (102, " \n ", "s", 1, "a", 2), (103, " ".join(f"long{k}" for k in range(60_000)), None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, __doc string, c0 int").repartition(3)
    first = {"toxicity": 0, "quality_rules": 3, "line_dedup": 0}
    now, ids = docs, [r[0] for r in rows]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        got = [r["doc_id"] for r in now.collect()]
        assert now.columns == docs.columns and set(got) <= set(ids)
        if name in first:
            assert len(ids) - len(got) == first[name], name
        ids = got
    # of the odd rows one stays, being near copies; of the repeated row one; rows without doc_id stay
    assert sorted(x for x in ids if x is not None) == sorted([*range(0, 20, 2), 1, 103]) and ids.count(None) == 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(ids)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []


def test_pipeline(spark):
    """On a table with enough labels for a model. Each stage's operator is held against plain Python in test_operators."""
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= ids, name
        assert len(now) < len(ids) or name == "line_dedup", name
        ids = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, at).toPandas()
    assert set(pieces.doc_id) == ids
    again = corpus_pipeline.run(spark, at).toPandas()  # cuts depend on the order in which tasks read the queues
    assert set(again.doc_id) == ids and again.length.sum() == pieces.length.sum()


def test_near_copies_by_fingerprint_or_by_shingles(spark):
    """A pair that fingerprints alone link, a chain through it by shingles, and a text that neither links."""
    from kithlink.llm import shingle_groups, simhash

    said = "one two three four five " * 60
    ends = [" ".join(f"{c}{i}" for i in range(12)) for c in "xy"]
    plain = " ".join(f"word{i}" for i in range(60))
    rows = [(1, said + ends[0]), (2, said + ends[1]), (3, said + ends[1] + " z"), (4, plain), (5, plain + " more"), (6, "a text by itself"), (None, plain)]
    assert not shingle_groups.similar(*(shingle_groups.shingles(rows[i][1]) for i in (0, 1)))
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() <= simhash.MAX_BITS
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 1, 4, 6]
