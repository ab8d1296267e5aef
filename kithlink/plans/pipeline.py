"""Training and prediction from files to files.

    python -m kithlink --mode full --data DIR --out DIR [--sample N] [--force-normalize]
    spark-submit --conf spark.checkpoint.dir=SHARED run.py --mode full ...    # any file that calls main()
"""

from __future__ import annotations

import argparse
import logging
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from kithlink.config import Config
from kithlink.operators import evaluation as E
from kithlink.operators import model as M
from kithlink.operators.blocking import PAIR, run_blocking
from kithlink.operators.features import compute_features
from kithlink.operators.sampling import cap_training
from kithlink.sources import sinks
from kithlink.sources.tsv import Truth, load_ground_truth, load_split

log = logging.getLogger("kithlink")


def setup_logging(path: str | None = None) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if path:
        handlers.append(logging.FileHandler(path, encoding="utf-8"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s", handlers=handlers, force=True)


def stored(df: DataFrame, path: str) -> DataFrame:
    sinks.write_parquet(df, path)
    return df.sparkSession.read.parquet(path)


def run_training(s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: Truth, out: str, cfg: Config, cap: bool = True) -> M.Matcher:
    """Candidates, their quality, features, and the matcher, each stored under out."""
    catalogue = s2.unionByName(s3)
    candidates = stored(run_blocking(s1, s2, s3, cfg), f"{out}/train_candidates.parquet")
    here = truth.pairs.join(s1.select(s1["entity_id"].alias(PAIR[0])), PAIR[0], "left_semi")
    log.info("blocking recall %s", E.blocking_recall(candidates, here).first().asDict())
    log.info("reduction ratio %s", E.reduction_ratio(candidates, s1, catalogue).first().asDict())
    features = stored(compute_features(candidates, s1, catalogue, cfg), f"{out}/train_features.parquet")
    if cap:
        features = cap_training(features, cfg.train_cap, cfg.seed)
        if E.n_entities(features) < E.n_entities(candidates):  # what isn't trained on isn't missed either
            here = here.join(features.select(PAIR[0]).distinct(), PAIR[0], "left_semi")
    matcher, scored = M.train_matcher(features, here, cfg)
    matcher.save(f"{out}/model", s1.sparkSession)
    log.info("threshold %.2f, fold accuracy (in-sample for the calibrator) %s", matcher.threshold, [r.asDict() for r in M.fold_accuracy(scored).collect()])
    log.info("features %s", M.feature_importance(matcher))
    return matcher


def run_prediction(s1: DataFrame, s2: DataFrame, s3: DataFrame, out: str, cfg: Config, matcher: M.Matcher | None = None) -> DataFrame:
    """Matches, written with the candidates under out, and validated."""
    matcher = matcher or M.Matcher.load(f"{out}/model", s1.sparkSession)
    catalogue = s2.unionByName(s3)
    candidates = stored(run_blocking(s1, s2, s3, cfg), f"{out}/test_candidates.parquet")
    matches = stored(M.predict(compute_features(candidates, s1, catalogue, cfg), matcher), f"{out}/test_matches.parquet")
    sinks.write_tsv(sinks.matching_results(matches, s1), f"{out}/matching_results.tsv")
    sinks.write_tsv(sinks.candidate_pairs(candidates, s1), f"{out}/candidate_pairs.tsv")
    log.info("statistics %s", sinks.run_statistics(matches, s1).first().asDict())
    broken = [r.asDict() for r in sinks.violations(matches, candidates, s1, catalogue).collect()]
    if broken:
        raise ValueError(f"invalid output: {broken}")
    return matches


def ship(spark: SparkSession) -> None:
    """Python workers import the package too, wherever it lies on the driver."""
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="kithlink-package-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/kithlink", "zip", package.parent, package.name))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Link business entities")
    p.add_argument("--mode", choices=["train", "predict", "full"], default="full")
    p.add_argument("--sample", type=int)
    p.add_argument("--force-normalize", action="store_true")
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--trees", type=int, default=Config.trees)
    p.add_argument("--log")
    a = p.parse_args(argv)
    setup_logging(a.log)
    spark, cfg = SparkSession.builder.appName("kithlink").getOrCreate(), Config(trees=a.trees)
    ship(spark)
    load = lambda split: load_split(spark, a.data, split, a.sample, f"{a.out}/cache", a.force_normalize)
    matcher = None
    if a.mode in ("train", "full"):
        matcher = run_training(*load("train"), load_ground_truth(spark, f"{a.data}/train_ground_truth.tsv"), a.out, cfg, cap=not a.sample)
    if a.mode in ("predict", "full"):
        run_prediction(*load("test"), a.out, cfg, matcher)


if __name__ == "__main__":
    main()
