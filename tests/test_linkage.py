"""Golden cases, properties and SQL twins of the linkage engine."""

import numpy as np
import pyarrow as pa
import pytest

from kithlink.config import FEATURE_COLS, FIXTURE, Config
from kithlink.functions import similarity as S
from kithlink.operators import evaluation as E
from kithlink.operators.normalise import normalise, normalise_country
from kithlink.plans.queries import ORACLES, QUERIES
from tests.compare import frames, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    got, want = frames(spark, name, SF, QUERIES, ORACLES)
    assert same(got, want) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"match_predict"}))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, SF).toPandas()) > 0


def test_match_predict_trains_the_whole_model(spark, monkeypatch):
    from kithlink.operators import model

    class Seen(Exception):
        pass

    def train(features, truth, cfg):
        whole = Config()
        assert (cfg.trees, cfg.learning_rate, cfg.max_depth, cfg.n_folds) == (whole.trees, whole.learning_rate, whole.max_depth, whole.n_folds)
        raise Seen

    monkeypatch.setattr(model, "train_matcher", train)
    with pytest.raises(Seen):
        QUERIES["match_predict"](spark, SF)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


NAMES = [
    ("Tata Motors Pvt. Ltd.", "tata motors", "tata motors pvt ltd", "ltd", "tata", "tm", 2),
    ("AT&T Inc", "at and t", "at and t inc", "inc", "at", "aat", 3),
    ("Société Générale SA", "société générale", "société générale sa", "sa", "société", "sg", 2),
    (None, "", "", "", "", "", 0),
    ("Ltd", "", "ltd", "ltd", "", "", 0),
    ("Co-op Company Foods", "op foods", "co op company foods", "co", "op", "of", 2),
    ("A B C D E F G", "a b c d e f g", "a b c d e f g", "", "a", "", 7),
    ("हिन्दी Store", "ह न द store", "ह न द store", "", "ह", "हनदs", 4),
]
ADDRESSES = [
    ("12-A, MG Rd, Nr. City Mall, Bengaluru 560001", "12 a mg road near city mall bengaluru 560001", "560001", "12", "city mall bengaluru 560001", 9),
    ("12a St. Marks Sq", "12a street marks square", "", "12a", "", 4),
    ("12345 Main St, New York 90210", "12345 main street new york 90210", "12345", "12345", "", 6),
    ("No 5 Linear Rd", "number 5 linear road", "", "", "road", 4),
    ("12ab X Rd", "12ab x road", "", "", "", 3),
    ("PO 1234567 Ste 9", "po 1234567 suite 9", "", "", "", 4),
    (None, "", "", "", "", 0),
]


def test_normalisation(spark):
    d = spark.createDataFrame([(str(i), n[0], None, None) for i, n in enumerate(NAMES)], "entity_id string, business_name string, business_address string, country string")
    got = normalise(d).orderBy("entity_id").select("name_norm", "name_full_norm", "name_suffix", "name_first_token", "name_acronym", "name_token_count").collect()
    assert [tuple(r) for r in got] == [n[1:] for n in NAMES]
    d = spark.createDataFrame([(str(i), None, a[0], None) for i, a in enumerate(ADDRESSES)], "entity_id string, business_name string, business_address string, country string")
    got = normalise(d).orderBy("entity_id").select("addr_norm", "addr_pin", "addr_street_num", "addr_landmark", "addr_token_count").collect()
    assert [tuple(r) for r in got] == [a[1:] for a in ADDRESSES]


@pytest.mark.parametrize(("raw", "want"), [("U.S.", "united states"), (" USA ", "united states"), ("Bharat", "india"), ("FR", "france"), ("République Française", "france"), ("Germany", "germany"), ("", "")])
def test_countries(spark, raw, want):
    assert normalise_country(raw) == want


@pytest.mark.parametrize(
    ("a", "b", "jw", "ratio", "sort"),
    [("tata motors", "tata motor", 0.981818, 0.952381, 0.952381), ("martha", "marhta", 0.961111, 0.833333, 0.833333), ("abcd", "axyz", 0.5, 0.25, 0.25), ("dixon", "dicksonx", 0.813333, 0.615385, 0.615385), ("tata motors", "motors tata", 0.492424, 0.545455, 1.0)],
)
def test_similarities(a, b, jw, ratio, sort):
    for x, y in ((a, b), (b, a)):
        assert round(S.jaro_winkler_of(x, y), 6) == jw and round(S.ratio_of(x, y), 6) == ratio and round(S.token_sort_of(x, y), 6) == sort


def test_longest_common_subsequence():
    import random

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 20))) for _ in range(2))
        assert S.lcs_length(a, b) == plain(a, b)


def test_ngrams(spark):
    from pyspark.sql import functions as F

    from kithlink.functions.text import word_ngrams

    d = spark.createDataFrame([("ab",), ("a",), ("abc",), ("",)], "w string")
    got = {r["w"]: sorted(r["g"]) for r in d.select("w", word_ngrams(F.col("w"), 3, 5).alias("g")).collect()}
    assert got == {"ab": sorted([" ab", "ab ", " ab "]), "a": [" a "], "abc": sorted([" ab", "abc", "bc ", " abc", "abc ", " abc "]), "": []}


@pytest.mark.parametrize(("pred", "true", "want"), [({1, 2}, {1}, 0.555556), ({1}, {1, 2}, 0.833333), ({1}, {2}, 0), (set(), set(), 1), ({1}, set(), 0)])
def test_f_half(spark, pred, true, want):
    pairs = lambda s: spark.createDataFrame([("a", str(x)) for x in s], "source1_entity_id string, candidate_entity_id string")
    ids = spark.createDataFrame([("a",)], "source1_entity_id string")
    assert round(E.entity_scores(pairs(pred), pairs(true), ids).first()["f_half"], 6) == want


def test_candidates_do_not_depend_on_partitions(spark):
    from kithlink.operators.blocking import run_blocking
    from kithlink.sources.adapter import entities

    def run(n):
        d = normalise(entities(spark, SF)).repartition(n)
        return run_blocking(*(d.where(f"src = {i}") for i in (1, 2, 3)), FIXTURE).toPandas()

    a, b = run(1), run(7)
    assert same(a, b) == "" and a.groupby("source1_entity_id").size().max() <= Config().prune_hard_cap


def test_production_settings_against_plain_python(spark):
    """Cosines with min_df 5, max_df 0.02 and 15,000 terms at most, on a corpus that is large enough for them."""
    import math
    import random
    from collections import Counter

    from kithlink.operators.blocking import blocks, tfidf_pairs

    r, cfg = random.Random(6), Config()
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    words = ["".join(r.choices(syllables, k=r.choice([2, 3]))) for _ in range(500)]
    names = [" ".join(r.choices(words, k=r.choice([1, 2, 3]))) for _ in range(700)]
    rows = [(f"D{i}", names[i], "utopia", i % 2) for i in range(700)]
    d = spark.createDataFrame(rows, "entity_id string, name_norm string, country_norm string, side_no int").repartition(3)
    got = {(x[0], x[1]): x[2] for x in tfidf_pairs(blocks(d.where("side_no = 0"), d.where("side_no = 1")), "name_norm", "name_sim", cfg).collect()}

    def grams(name):
        return Counter(p[i : i + n] for w in name.split() for p in [f" {w} "] for n in range(3, 6) for i in range(len(p) - n + 1))

    tf = [grams(n) for n in names]
    df, total = Counter(t for g in tf for t in g), Counter()
    for g in tf:
        total.update(g)
    vocabulary = sorted((t for t in df if cfg.min_df <= df[t] <= cfg.max_df * 700), key=lambda t: (-total[t], t))[: cfg.max_features]
    assert 100 < len(vocabulary) < len(df)
    idf = {t: math.log(701 / (1 + df[t])) + 1 for t in vocabulary}
    vec = []
    for g in tf:
        v = {t: (1 + math.log(n)) * idf[t] for t, n in g.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec.append({t: x / norm for t, x in v.items()})
    want = {}
    for q in range(0, 700, 2):
        sims = [(round(sum(x * vec[c].get(t, 0.0) for t, x in vec[q].items()), 6), f"D{c}") for c in range(1, 700, 2)]
        for s, c in sorted(((s, c) for s, c in sims if s >= cfg.sim_floor), key=lambda x: (-x[0], x[1]))[: cfg.top_k]:
            want[(f"D{q}", c)] = s
    assert len(want) > 300 and set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_nearest_in_many_parts(spark):
    """Against all pairs in plain Python: many parts, a large group of copies, ties, one-sided blocks."""
    import random

    from kithlink.operators.nearest import nearest, rounded

    assert rounded(np.array([0.27595, 0.2759499, 0.5, 1.0, 1.005]), 4).tolist() == [0.276, 0.2759, 0.5, 1.0, 1.005]
    assert rounded(np.array([1.005, 2.5, 0.285]), 2).tolist() == [1.01, 2.5, 0.29]
    r = random.Random(3)
    rows = []
    for i in range(900):
        terms = ["a", "b"] if i % 3 == 0 else sorted(r.sample("abcdefghijklmnopqrstuvwxyz", r.randint(1, 6)))
        rows.append(("x" if i % 5 else "y", "qc"[i % 2], f"D{i}", terms, [1.0] * len(terms)))
    rows += [("q only", "q", "D900", ["a"], [1.0]), ("c only", "c", "D901", ["a"], [1.0])]
    v = spark.createDataFrame(rows, "block_key string, side string, entity_id string, terms array<string>, weights array<double>").repartition(5)
    got = sorted(tuple(x) for x in nearest(v, 2, 4, queries=40, catalogue=60).collect())
    want = []
    for key, side, q, mine, _ in rows:
        if side == "q":
            found = [(len({*mine} & {*t}), c, len(t)) for k, s, c, t, _ in rows if (k, s) == (key, "c")]
            want += [(q, c, float(n), len(mine), m) for n, c, m in sorted((f for f in found if f[0] >= 2), key=lambda f: (-f[0], f[1]))[:4]]
    assert len(want) > 900 and got == sorted(want)
    plan = nearest(v, 2, 4, queries=40, catalogue=60)._jdf.queryExecution().optimizedPlan().toString()
    assert "term" in plan and plan.count("Join") == 1  # with the numbers of parts: no row for a term that two entities share


def test_address_products_row_by_row():
    from kithlink.operators.features import sparse_dots

    a = [["a", "c", "é"], [], ["b"], None], [[0.5, 0.25, 0.75], [], [1.0], None]
    b = [["c", "é", "z"], ["b"], ["b"], ["b"]], [[0.5, 0.5, 0.1], [1.0], [0.5], [1.0]]
    arrays = [tuple(pa.array(x, pa.list_(kind)) for x, kind in zip(side, (pa.string(), pa.float64()))) for side in (a, b)]
    assert sparse_dots(*arrays).tolist() == [0.5, 0.0, 0.5, 0.0]


def test_samples(spark):
    from kithlink.operators import sampling as A

    d = spark.createDataFrame([(f"D{i}", "abc"[i % 3] if i < 90 else "d") for i in range(100)], "entity_id string, country_norm string")
    s1 = A.sample_entities(d.where("country_norm in ('a', 'b')"), 20)
    assert s1.count() == 20 and A.sample_by_country(d, 1000, s1).count() == 60
    some = A.sample_by_country(d.repartition(7), 10, s1).collect()
    assert sorted(r["country_norm"] for r in some) == ["a"] * 5 + ["b"] * 5
    assert {r["entity_id"] for r in some} == {r["entity_id"] for r in A.sample_by_country(d, 10, s1).collect()}
    assert A.sample_by_country(d, 1, s1).count() == 2  # one of each at least


def test_a_table_is_staged_once_while_it_stays_the_same(spark, tmp_path):
    from kithlink.sources.stage import stage_once

    at, made = str(tmp_path / "t"), []
    make = lambda: (made.append(1), spark.read.parquet(at))[1]
    spark.range(3).write.parquet(at)
    assert stage_once(spark, at, "x", make).count() == stage_once(spark, at, "x", make).count() == 3 and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(at)
    assert stage_once(spark, at, "x", make).count() == 5 and len(made) == 2


def test_the_command_starts():
    import subprocess
    import sys
    from pathlib import Path

    done = subprocess.run([sys.executable, "-m", "kithlink", "--help"], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert done.returncode == 0 and "--sample" in done.stdout


def test_files_to_files(spark, tmp_path):
    """Train, save, load, predict, write, validate, with quoted fields and blank truth."""
    import csv

    from kithlink.plans.pipeline import run_prediction, run_training
    from kithlink.sources.adapter import entities, truth_pairs
    from kithlink.sources.tsv import load_ground_truth, load_split, read_entities

    ent = entities(spark, "/root/testdata/sf0.01")
    for split in ("train", "test"):
        for i in (1, 2, 3):
            ent.where(f"src = {i}").select("entity_id", "business_name", "business_address", "country").toPandas().to_csv(tmp_path / f"{split}_source{i}.tsv", sep="\t", index=False)
    truth = truth_pairs(ent).toPandas().groupby("source1_entity_id").candidate_entity_id.agg(",".join).reset_index()
    truth.columns = ["source1_entity_id", "matched_entity_ids"]
    truth.loc[len(truth)] = ["D9999", ""]
    truth.to_csv(tmp_path / "train_ground_truth.tsv", sep="\t", index=False)
    gt = load_ground_truth(spark, str(tmp_path / "train_ground_truth.tsv"))
    assert gt.entities.count() == len(truth) and gt.pairs.count() == truth_pairs(ent).distinct().count()
    cfg = Config(min_df=2, max_df=0.5, addr_min_df=2, addr_max_df=0.5, trees=3, learning_rate=0.3, max_depth=3, n_folds=2)
    out = str(tmp_path / "out")
    m = run_training(*load_split(spark, str(tmp_path), "train", cache=f"{out}/cache"), gt, out, cfg)
    again = type(m).load(f"{out}/model", spark)
    assert len(again.folds) == 2 and abs(again.threshold - m.threshold) < 1e-6
    matches = run_prediction(*load_split(spark, str(tmp_path), "test"), out, cfg)
    assert E.macro_f_half(matches, gt.pairs).first()[0] > 0.5
    lines = [r for p in sorted((tmp_path / "out" / "matching_results.tsv").glob("part-*")) for r in csv.DictReader(p.open(), delimiter="\t")]
    ids = [r["source1_entity_id"] for r in lines]
    assert ids == sorted(ids) and len(ids) == ent.where("src = 1").count()
    (tmp_path / "odd.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n1\t"A ""quoted"" co"\t\tNA\n')
    assert tuple(read_entities(spark, str(tmp_path / "odd.tsv")).first()) == ("1", 'A "quoted" co', "", "NA")
    assert set(FEATURE_COLS) <= set(spark.read.parquet(f"{out}/train_features.parquet").columns)


def test_stream(spark, tmp_path):
    from kithlink.sources.adapter import entities
    from kithlink.streaming.link import link_stream

    ent = entities(spark, SF)
    raw = ["entity_id", "business_name", "business_address", "country"]
    ent.where("src = 1").select(*raw).repartition(2).write.parquet(str(tmp_path / "in"))
    n = normalise(ent.select("src", *raw))
    s = spark.readStream.schema(ent.select(*raw).schema).parquet(str(tmp_path / "in"))
    link_stream(s, n.where("src = 2"), n.where("src = 3"), str(tmp_path / "out"), str(tmp_path / "cp"), FIXTURE).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_ngram_vectors_without_a_row_for_each_term(spark):
    """Vectors made text by text in many parts are those of the column functions' n-grams, and nothing but texts and sums is dealt out."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    from kithlink.functions.text import word_ngrams
    from kithlink.operators import grams

    texts = ["ab", "a", "", None, "straße 𝒜𝒷 x", "  two  blanks\tand a tab ", "münchen ab ab", "  hard blank", "ab münchen", "a b"] * 3
    d = spark.createDataFrame([("uv"[i % 2], "qc"[i % 3 == 0], f"E{i}", t) for i, t in enumerate(texts)], "block_key string, side string, entity_id string, t string").repartition(3)
    sizes = d.groupBy("block_key").agg(F.count("*").alias("n"))
    rows = [(r["block_key"], r["entity_id"], Counter(r["g"] or [])) for r in d.select("block_key", "entity_id", word_ngrams(F.col("t"), 3, 5).alias("g")).collect()]
    df, total = Counter((b, t) for b, _, c in rows for t in c), sum((Counter({(b, t): n for t, n in c.items()}) for b, _, c in rows), Counter())
    summed = grams.counts(d, "t", 3, 5)
    assert {(r["block_key"], r["term"]): (r["df"], r["total"]) for r in summed.collect()} == {k: (df[k], total[k]) for k in df}
    assert "Generate" not in summed._jdf.queryExecution().optimizedPlan().toString()
    kept = {k for k in df if df[k] > 3}
    v = grams.vectors(d, "t", summed.where("df > 3").join(sizes, "block_key"), sizes, 3, 5, part=4)
    got = {(r["block_key"], r["entity_id"]): (r["terms"], r["weights"]) for r in v.collect()}
    n, want = {r["block_key"]: r["n"] for r in sizes.collect()}, {}
    for b, e, c in rows:
        if w := {t: (1 + math.log(k)) * (math.log((1 + n[b]) / (1 + df[b, t])) + 1) for t, k in sorted(c.items()) if (b, t) in kept}:
            want[b, e] = list(w), [x / math.sqrt(sum(y * y for y in w.values())) for x in w.values()]
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.allclose(got[k][1], want[k][1]) for k in want) and len(got) > 10


def test_tiles_are_read_where_they_lie(spark):
    """Packed tiles give what the vectors give, in many parts, with long repeats in a text; no vector is dealt out once for each tile it meets."""
    import random

    from pyspark.sql import functions as F

    from kithlink.operators import grams
    from kithlink.operators.nearest import nearest, nearest_tiles
    from kithlink.sources.stage import stage

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 5)))
    rows = [("xyz"[i % 7 % 3], "qcc"[i % 3], f"D{i}", " ".join(word() for _ in range(r.randint(0, 4)))) for i in range(400)]
    rows += [("x", s, f"L{s}{i}", "abc" * 400 + "d" * i) for s in "qc" for i in range(3)] + [("q only", "q", "D1000", "abc abc"), ("c only", "c", "D1001", "abc")]
    d = spark.createDataFrame(rows, "block_key string, side string, entity_id string, t string").repartition(3)
    sizes = d.groupBy("block_key").agg(F.count("*").alias("n"))
    known = grams.counts(d, "t", 3, 5).where("df > 1").join(sizes, "block_key")
    tiles = stage(grams.tiles(d, "t", known, sizes, 3, 5, part=30), "tiles")
    assert tiles.count() > 20
    got = nearest_tiles(tiles, 0.25, 4, digits=6)
    want = nearest(grams.vectors(d, "t", known, sizes, 3, 5), 0.25, 4, digits=6)
    assert sorted(map(tuple, got.drop("block_key").collect())) == sorted(map(tuple, want.collect())) and got.count() > 200
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan


def test_equal_names_have_one_vector(spark, monkeypatch):
    """Groups of equal names on both sides, larger than top_k, and names that tie: the pairs of all vectors, from one vector a name."""
    import random
    from dataclasses import replace

    from pyspark.sql import functions as F

    from kithlink.operators import blocking as B
    from kithlink.operators import grams
    from kithlink.operators.nearest import nearest

    r = random.Random(7)
    names = ["alpha beta", "beta alpha", "alpha beta gamma", "delta", "", None, "alphas betas"] + ["".join(r.choice("abcd") for _ in range(5)) for _ in range(12)]
    rows = [("xx*"[i % 3], "qcc"[i % 5 % 3], f"D{i}", names[0] if i % 4 == 0 else r.choice(names)) for i in range(300)]
    b = spark.createDataFrame(rows, "block_key string, side string, entity_id string, t string").repartition(3)
    # A catalogue entity stands in its own block and in '*', where it may be of another group.
    b = b.unionByName(b.where("side = 'c' and block_key = 'x'").withColumn("block_key", F.lit("*")))
    cfg = replace(FIXTURE, top_k=6)
    v = grams.vectors(b, "t", B.ngram_vocabulary(b, "t", cfg), B.sizes(b), *cfg.ngrams)
    want = sorted((x[0], x[1], x[2]) for x in nearest(v, cfg.sim_floor, cfg.top_k, digits=6).collect())
    made = []
    monkeypatch.setattr(grams, "tiles", lambda texts, *a, f=grams.tiles, **k: made.append(texts.count()) or f(texts, *a, **k))
    assert sorted(map(tuple, B.tfidf_pairs(b, "t", "s", cfg).collect())) == want and len(want) > 300
    assert made == [b.select("block_key", "side", "t").where("t is not null").distinct().count()] and made[0] < 120


def test_folds_are_trained_at_the_same_time(spark, monkeypatch):
    import threading
    from dataclasses import replace

    from pyspark.ml.classification import GBTClassifier

    from kithlink.operators import model

    cfg = replace(FIXTURE, n_folds=3, trees=2, min_child=1)
    pairs = [(f"D{i}", f"D{i + 500 + j}", *[float((i * j) % 7)] * len(FEATURE_COLS)) for i in range(60) for j in range(2)]
    f = spark.createDataFrame(pairs, ", ".join(["source1_entity_id string, candidate_entity_id string", *(f"{c} double" for c in FEATURE_COLS)]))
    met, fit = threading.Barrier(3), GBTClassifier.fit

    def together(self, rows):
        met.wait(60)
        return fit(self, rows)

    monkeypatch.setattr(GBTClassifier, "fit", together)
    matcher, scored = model.train_matcher(f, f.where("name_jw > 2").select("source1_entity_id", "candidate_entity_id"), cfg)
    assert len(matcher.folds) == 3 and scored.count() == 120


def test_truth_is_of_the_staged_entities(spark):
    from kithlink.plans.queries import _truth

    t = _truth(spark, SF)
    assert t.count() > 0 and not [f for f in t.inputFiles() if "documents.parquet" in f]


def test_blocks_are_made_once(spark):
    from kithlink.operators import blocking as B
    from kithlink.plans.queries import _sides

    n, s1, _ = _sides(spark, SF)
    c = B.run_blocking(s1, n.where("src = 2"), n.where("src = 3"), FIXTURE)
    assert "LeftSemi" not in c._jdf.queryExecution().optimizedPlan().toString() and c.count() > 0


def test_small_parts_are_not_laid_into_one_task(spark):
    from kithlink.operators import grams

    d = spark.createDataFrame([("x", "qc"[i % 2], f"e{i}", f"some text {i % 7}") for i in range(64)], "block_key string, side string, entity_id string, t string")
    sizes = d.groupBy("block_key").count().withColumnRenamed("count", "n")
    known = grams.counts(d, "t", 3, 5).join(sizes, "block_key")
    v = grams.vectors(d, "t", known, sizes, 3, 5, part=4)
    assert v.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and v.count() == 64


def test_coded_vectors_are_the_vectors(spark):
    from kithlink.operators import grams

    texts = ["12 main road", "12 main rd", "main main main road", "x", "zürich 日本 5", "", "main"]
    d = spark.createDataFrame([("", "", t) for t in texts], "block_key string, side string, entity_id string")
    sizes = d.groupBy("block_key").count().withColumnRenamed("count", "n")
    known = grams.counts(d, "entity_id", 2, 4).where("df > 1").join(sizes, "block_key").select("block_key", "term", "df", "n")
    want = {r["entity_id"]: (r["terms"], r["weights"]) for r in grams.vectors(d, "entity_id", known, sizes, 2, 4, sublinear=False).collect()}
    rows = sorted(known.select("term", "df", "n").collect())
    terms = [r["term"] for r in rows]
    got = grams.Coded(terms, [grams.idf(r["df"], r["n"]) for r in rows], 2, 4).vectors(texts)
    for t, codes, w in zip(texts, *(x.to_pylist() for x in got)):
        terms_of, weights_of = want.get(t, ([], []))
        assert [terms[c] for c in codes] == terms_of and np.allclose(w, weights_of, rtol=1e-14, atol=0)
    assert 0 < len(want) < len(texts)
    empty = grams.Coded([], [], 2, 4).vectors(["a", ""])
    assert [x.to_pylist() for x in empty] == [[[], []]] * 2


def test_pair_features_deals_no_vectors_and_no_tokens(spark):
    from kithlink.operators.features import compute_features
    from kithlink.plans.queries import _candidates

    f = compute_features(*_candidates(spark, SF), FIXTURE)
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Join") == 3  # the best of each candidate, and either side's attributes
    scans = [x for x in f._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    assert scans and not [x for x in scans if "name_tokens" in x or "name_acronym" in x]


def test_jaro_winkler_takes_the_first_free_place_in_reach():
    rng = np.random.default_rng(5)

    def plain(a, b):
        reach, used, first = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
        for i, x in enumerate(a):
            j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == x), None)
            if j is not None:
                used.add(j)
                first.append(x)
        m = len(first)
        t = sum(x != b[j] for x, j in zip(first, sorted(used))) // 2
        jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3 if m else 0.0
        prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
        return jaro if jaro <= 0.7 else jaro + prefix * 0.1 * (1 - jaro)

    for _ in range(500):
        a, b = ("".join(rng.choice(list("ab c日"), rng.integers(1, 14))) for _ in "ab")
        assert S.jaro_winkler_of(a, b) == (1.0 if a == b else plain(a, b)), (a, b)


def boosted(spark, trees, depth=3, n=1500, folds=3, seed=1, parts=3):
    """Pairs with features of 24 values, two and one, so that bins are those of Spark ML; weights of three kinds; how they are trained."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    rng = np.random.default_rng(seed)
    x = rng.integers(0, 24, (n, len(FEATURE_COLS))) / 32
    x[:, ::3] = x[:, ::3] > 0.7
    x[:, FEATURE_COLS.index("name_rank")] = 3
    x[:, FEATURE_COLS.index("name_match_addr_mismatch")] = rng.random(n) < 0.1
    ids = [(f"D{i // 4}", f"C{i}") for i in range(n)]
    f = spark.createDataFrame([(*k, *r) for k, r in zip(ids, x.tolist())], ", ".join(["source1_entity_id string, candidate_entity_id string", *(f"{c} double" for c in FEATURE_COLS)])).repartition(parts)
    truth = f.where(F.col("name_jw") + F.col("addr_lev") * F.col("name_lev") + 0.2 * F.rand(3) > 1.1).select("source1_entity_id", "candidate_entity_id").localCheckpoint()
    return f, truth, replace(FIXTURE, trees=trees, max_depth=depth, n_folds=folds, learning_rate=0.1, min_child=10)


@pytest.mark.parametrize("depth", [3, 5, 6])
def test_trees_are_those_of_spark_ml(spark, depth):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from kithlink.operators import model

    f, truth, cfg = boosted(spark, 4, depth)
    matcher, scored = model.train_matcher(f, truth, cfg)
    got = {r["candidate_entity_id"]: r["raw"] for r in scored.collect()}
    rows = E.weighted(E.labelled(f, truth), cfg).withColumn("fold", E.fold(cfg))
    rows = VectorAssembler(inputCols=FEATURE_COLS, outputCol="features").transform(rows).cache()
    assert rows.select("weight").distinct().count() == 3
    want = {}
    for i in range(cfg.n_folds):
        gbt = GBTClassifier(labelCol="is_match", weightCol="weight", maxIter=cfg.trees, stepSize=cfg.learning_rate, maxDepth=depth, minInstancesPerNode=cfg.min_child)
        out = gbt.fit(rows.where(F.col("fold") != i)).transform(rows.where(F.col("fold") == i))
        want |= {r[0]: r[1] for r in out.select("candidate_entity_id", vector_to_array("probability")[1]).collect()}
    assert got.keys() == want.keys() and len(set(got.values())) > 10
    assert max(abs(got[k] - want[k]) for k in want) < 1e-5


def test_trees_take_no_jobs_of_their_own(spark):
    from kithlink.operators import model

    jobs = []
    for trees in (2, 9):
        f, truth, cfg = boosted(spark, trees, n=300)
        spark.sparkContext.setJobGroup(f"trees {trees}", "")
        try:
            matcher, _ = model.train_matcher(f, truth, cfg)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees {trees}")))
        assert [len(m.value) for m in matcher.folds] == [trees] * cfg.n_folds
    assert 0 < jobs[1] < jobs[0] + 7  # a job a tree would be 21 more


def test_trees_are_the_same_for_any_tasks(spark, monkeypatch):
    from kithlink.operators import boosting, model

    f, truth, cfg = boosted(spark, 5)
    made = []
    for task, parts in ((10**9, 1), (300, 5)):
        monkeypatch.setattr(boosting, "TASK", task)
        matcher, _ = model.train_matcher(f.repartition(parts), truth, cfg)
        made.append([(m.feature.tolist(), m.at.tolist(), m.value.tolist()) for m in matcher.folds])
    assert made[0] == made[1]


def test_trees_start_anew_with_the_stage():
    """After a task has gone, the next attempt's tasks get whole models; strangers are turned away."""
    import socket
    import struct
    import threading

    from kithlink.operators import boosting as T

    cfg = Config(trees=3, max_depth=2, n_folds=2, min_child=1)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (len(FEATURE_COLS), 200)) * 1.0
    bins = T.Bins([np.array([0.5, 1.5])] * len(FEATURE_COLS))
    codes, y, fold = bins.codes(x), np.where(x[0] > 1, 1, -1), rng.integers(0, 2, 200)
    share = lambda s: T.Share(bins, cfg, [1.0], codes[:, s], y[s], np.zeros(100, int), fold[s])
    listener, done = socket.create_server(("127.0.0.1", 0)), []
    listener.settimeout(1)
    lead = threading.Thread(target=T._lead, args=(listener, b"secret", 2, lambda: [T.Grower(bins, cfg, [1.0]) for _ in range(2)], done), daemon=True)
    lead.start()

    def meet(which, attempt, secret=b"secret"):
        s = socket.create_connection(listener.getsockname(), 60)
        s.sendall(struct.pack("<qq", which, attempt) + secret)
        return s

    meet(0, 1).close()
    meet(0, 9, b"guess!")
    for s in [meet(0, 3), meet(1, 3)]:
        s.close()
    tasks = [threading.Thread(target=lambda k=k: share(slice(100 * k, 100 * k + 100)).follow(meet(k, 7)), daemon=True) for k in range(2)]
    for t in tasks:
        t.start()
    for t in [*tasks, lead]:
        t.join(60)
    listener.close()
    assert len(done) == 1 and [(m.margins(codes) > 0).tolist() for m in done[0]] == [(y > 0).tolist()] * 2


def test_equal_scores_are_calibrated_as_one_point(spark, monkeypatch):
    from pyspark.ml.regression import IsotonicRegression

    from kithlink.operators import model

    met, fit = [], IsotonicRegression.fit
    monkeypatch.setattr(IsotonicRegression, "fit", lambda self, rows: met.append(rows.count()) or fit(self, rows))
    f, truth, cfg = boosted(spark, 2, depth=2)
    matcher, scored = model.train_matcher(f, truth, cfg)
    assert met == [scored.select("raw").distinct().count()] and met[0] < 100 < scored.count()
    want = fit(IsotonicRegression(featuresCol="raw", labelCol="is_match", predictionCol="score"), scored.drop("score"))
    for a, b in ((matcher.calibrator.boundaries, want.boundaries), (matcher.calibrator.predictions, want.predictions)):
        assert len(a) == len(b) and np.allclose(a.toArray(), b.toArray(), atol=1e-12)
