"""Named queries of the linkage engine over entities derived from the driver's documents.

Bounds of document frequency are relaxed (config.FIXTURE), as the smaller tables have few entities in a block.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.config import FEATURE_COLS, FIXTURE
from kithlink.operators import blocking as B
from kithlink.operators import evaluation as E
from kithlink.operators import features as X
from kithlink.operators import model as M
from kithlink.operators import sampling as A
from kithlink.operators.normalise import normalise
from kithlink.plans.oracles import ORACLES  # noqa: F401
from kithlink.sources import sinks
from kithlink.sources.adapter import entities, truth_pairs
from kithlink.sources.stage import stage, stage_once

QUERIES: dict = {}
Q1, CAND = B.PAIR


def query(f):
    QUERIES[f.__name__] = f
    return f


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised entities; query side; catalogue."""
    # Met by every strategy on both sides, and the same for all queries.
    n = stage_once(spark, f"{sf_dir}/documents.parquet", "entities", lambda: normalise(entities(spark, sf_dir)))
    return n, n.where("src = 1"), n.where("src <> 1")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s1, cat = _sides(spark, sf_dir)
    return B.blocks(s1, cat)


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, s1, cat = _sides(spark, sf_dir)
    c = stage_once(spark, f"{sf_dir}/documents.parquet", "candidates", lambda: B.run_blocking(s1, n.where("src = 2"), n.where("src = 3"), FIXTURE))
    return c, s1, cat


def _r(*names: str, digits: int = 4):
    """Rounded as a whole number of units: a value on a half, rounded before, goes the way its binary value times 10^digits goes."""
    return [(F.round(F.col(n) * float(10**digits)) / float(10**digits)).alias(n) for n in names]


@query
def norm_name(spark, sf_dir):
    n, _, _ = _sides(spark, sf_dir)
    return n.select("entity_id", "name_norm", "name_full_norm", "name_suffix", "name_first_token", "name_acronym", F.col("name_token_count").cast("long").alias("name_token_count"))


@query
def norm_address(spark, sf_dir):
    n, _, _ = _sides(spark, sf_dir)
    return n.select("entity_id", "addr_norm", "addr_pin", "addr_street_num", "addr_landmark", F.col("addr_token_count").cast("long").alias("addr_token_count"))


@query
def norm_country(spark, sf_dir):
    n, _, _ = _sides(spark, sf_dir)
    return n.groupBy("country", "country_norm").agg(F.count("*").alias("n"))


@query
def block_anchor(spark, sf_dir):
    """Which catalogue entities sit at the same building as each query entity."""
    _, s1, cat = _sides(spark, sf_dir)
    pairs = B.prune(B.union_pairs([B.anchor_pairs(B.blocks(s1, cat))]), FIXTURE)
    return sinks.candidate_pairs(pairs, s1)


@query
def anchor_pairs(spark, sf_dir):
    return B.anchor_pairs(_blocks(spark, sf_dir))


@query
def block_token(spark, sf_dir):
    return B.token_pairs(_blocks(spark, sf_dir), FIXTURE).select(Q1, CAND, "shared", *_r("token_jaccard"))


@query
def idf_vocab(spark, sf_dir):
    return B.ngram_vocabulary(_blocks(spark, sf_dir), "name_norm", FIXTURE)


@query
def block_tfidf(spark, sf_dir):
    return B.tfidf_pairs(_blocks(spark, sf_dir), "name_norm", "name_sim", FIXTURE).select(Q1, CAND, *_r("name_sim", digits=6))


@query
def block_tfidf_address(spark, sf_dir):
    return B.tfidf_pairs(_blocks(spark, sf_dir), "addr_norm", "addr_sim", replace(FIXTURE, sim_floor=0.5, top_k=5)).select(Q1, CAND, *_r("addr_sim", digits=6))


@query
def fallback_block(spark, sf_dir):
    b = _blocks(spark, sf_dir).where(F.col("block_key") == B.ANY)
    return B.token_pairs(b, FIXTURE).select(Q1, CAND, "shared", *_r("token_jaccard"))


@query
def blocked_candidates(spark, sf_dir):
    c, _, _ = _candidates(spark, sf_dir)
    return c.select(Q1, CAND, *_r("name_sim", "blend_score", digits=6), *_r("addr_sim", "token_jaccard", "addr_anchor"), "name_rank", "addr_rank", F.col("candidate_count").cast("long").alias("candidate_count"))


@query
def candidate_pairs(spark, sf_dir):
    c, s1, _ = _candidates(spark, sf_dir)
    return sinks.candidate_pairs(c, s1)


@query
def matching_results(spark, sf_dir):
    c, s1, _ = _candidates(spark, sf_dir)
    return sinks.matching_results(c.where(F.col("blend_score") >= 0.8), s1)


@query
def run_statistics(spark, sf_dir):
    c, s1, _ = _candidates(spark, sf_dir)
    return sinks.run_statistics(c.where(F.col("blend_score") >= 0.8), s1)


@query
def output_violations(spark, sf_dir):
    """How often each rule is broken in outputs with planted faults; without them no rule is."""
    c, s1, cat = _candidates(spark, sf_dir)
    m = c.where(F.col("blend_score") >= 0.8)
    if sinks.violations(m, c, s1, cat).count():
        raise ValueError("the outputs are inconsistent before any fault is planted")
    odd = m.union(m.where(F.col(CAND).endswith("3")).withColumn(CAND, F.concat(CAND, F.lit("x"))))
    c = c.union(c.where(F.col(CAND).endswith("1")).withColumn(CAND, F.concat(CAND, F.lit("z")))).union(c.where(F.col(Q1).endswith("4")).withColumn(Q1, F.concat(Q1, F.lit("y"))))
    return sinks.violations(odd, c, s1.union(s1.where(F.col("entity_id").endswith("6"))), cat)


def _with_attributes(spark, sf_dir):
    c, s1, cat = _candidates(spark, sf_dir)
    return X.with_attributes(c, s1, cat)


@query
def features_native(spark, sf_dir):
    d = X.native_features(_with_attributes(spark, sf_dir))
    whole = ["name_exact", "suffix_match", "first_token_match", "acronym_match", "name_common_tokens", "name_token_count_diff", "pin_match", "street_num_match", "country_match", "pin_conflict", "street_num_conflict"]
    return d.select(Q1, CAND, *(F.col(c).cast("long").alias(c) for c in whole), *_r("name_lev", "name_common_ratio", "addr_lev"))


@query
def features_jw(spark, sf_dir):
    d = X.fuzzy_features(_with_attributes(spark, sf_dir), FIXTURE)
    return d.select(Q1, CAND, *_r("name_jw", "addr_jw"), F.col("name_match_addr_mismatch").cast("long").alias("name_match_addr_mismatch"))


@query
def features_token_ratio(spark, sf_dir):
    d = X.fuzzy_features(_with_attributes(spark, sf_dir), FIXTURE)
    return d.select(Q1, CAND, *_r("name_token_set", "name_token_sort"))


@query
def feature_addr_cosine(spark, sf_dir):
    c, s1, cat = _candidates(spark, sf_dir)
    return X.addr_cosine(X.with_attributes(c, s1, cat), X.addresses(c, s1, cat), FIXTURE).select(Q1, CAND, *_r("addr_tfidf_cos"))


@query
def reciprocal_nn(spark, sf_dir):
    c, _, _ = _candidates(spark, sf_dir)
    return X.reciprocal(c).select(Q1, CAND, F.col("is_reciprocal_nn").cast("long").alias("is_reciprocal_nn"))


def _truth(spark, sf_dir):
    # The staged entities keep the texts' hash, so no text is read for it again.
    n, _, _ = _sides(spark, sf_dir)
    return truth_pairs(n)


@query
def labels_weights(spark, sf_dir):
    c, _, _ = _candidates(spark, sf_dir)
    d = c.withColumn("name_match_addr_mismatch", ((F.col("name_sim") > 0.9) & (F.col("addr_anchor") == 0)).cast("int"))
    d = E.weighted(E.labelled(d, _truth(spark, sf_dir)), FIXTURE)
    fold = E.fold(FIXTURE).cast("long").alias("fold")
    return d.select(Q1, CAND, F.col("is_match").cast("long").alias("is_match"), *_r("weight"), fold)


@query
def blocking_recall(spark, sf_dir):
    c, _, _ = _candidates(spark, sf_dir)
    return E.blocking_recall(c, _truth(spark, sf_dir)).select("n_found", "n_true", *_r("recall"))


@query
def reduction_ratio(spark, sf_dir):
    c, s1, cat = _candidates(spark, sf_dir)
    return E.reduction_ratio(c, s1, cat).select("n_candidates", "n_s1", "n_catalogue", *_r("reduction_ratio", digits=6))


@query
def entity_f05(spark, sf_dir):
    c, s1, _ = _candidates(spark, sf_dir)
    ids = s1.select(F.col("entity_id").alias(Q1))
    return E.entity_scores(c.where(F.col("blend_score") >= 0.8), _truth(spark, sf_dir), ids).select(Q1, "n_pred", "n_true", "hits", *_r("f_half"))


@query
def macro_f05(spark, sf_dir):
    c, s1, _ = _candidates(spark, sf_dir)
    return E.macro_f_half(c.where(F.col("blend_score") >= 0.8), _truth(spark, sf_dir)).select(*_r("macro_f_half"))


@query
def threshold_sweep(spark, sf_dir):
    c, s1, _ = _candidates(spark, sf_dir)
    ids = s1.select(F.col("entity_id").alias(Q1))
    return E.threshold_sweep(c, _truth(spark, sf_dir), ids, FIXTURE, "blend_score").select(*_r("threshold", digits=2), *_r("macro_f_half"))


@query
def ground_truth_lists(spark, sf_dir):
    """Comma lists of true matches read back as pairs, with how many each query entity has."""
    from kithlink.sources.tsv import truth_of

    _, s1, _ = _sides(spark, sf_dir)
    t = truth_of(sinks.matching_results(_truth(spark, sf_dir), s1))
    n = t.pairs.groupBy(Q1).agg(F.count("*").alias("n"))
    return t.entities.join(n, Q1, "left").select(Q1, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query
def train_cap_ids(spark, sf_dir):
    c, _, _ = _candidates(spark, sf_dir)
    return A.cap_training(c, 50).select(Q1).distinct()


@query
def country_sample(spark, sf_dir):
    _, s1, cat = _sides(spark, sf_dir)
    some = A.sample_entities(s1, 50)
    return some.select("entity_id", "country_norm").unionByName(A.sample_by_country(cat, 100, some).select("entity_id", "country_norm"))


@query
def pair_features(spark, sf_dir):
    c, s1, cat = _candidates(spark, sf_dir)
    return X.compute_features(c, s1, cat, FIXTURE).select(Q1, CAND, *_r(*FEATURE_COLS))


@query
def match_predict(spark, sf_dir):
    """Features, grouped folds of boosted trees, calibration, threshold, matches. All trees and folds of the settings."""
    c, s1, cat = _candidates(spark, sf_dir)
    f = stage(X.compute_features(c, s1, cat, FIXTURE), "features")
    matcher, _ = M.train_matcher(f, _truth(spark, sf_dir), FIXTURE)
    return M.predict(f, matcher).select(Q1, CAND, *_r("score"))
