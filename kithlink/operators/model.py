"""Training, calibration, threshold choice and prediction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.config import FEATURE_COLS, Config
from kithlink.operators import boosting as T
from kithlink.operators import evaluation as E
from kithlink.operators.blocking import PAIR
from kithlink.sources.stage import stage


@dataclass
class Matcher:
    folds: list[T.Trees]
    calibrator: IsotonicRegressionModel
    threshold: float

    def save(self, path: str, spark: SparkSession) -> None:
        trees = [(i, t, *(x[t].tolist() for x in (m.feature, m.at, m.gain, m.value))) for i, m in enumerate(self.folds) for t in range(len(m.value))]
        spark.createDataFrame(trees, "fold int, tree int, feature array<int>, at array<int>, gain array<double>, value array<double>").write.mode("overwrite").parquet(f"{path}/trees")
        self.calibrator.write().overwrite().save(f"{path}/calibrator")
        settings = len(self.folds), round(self.threshold, 6), self.folds[0].rate, [e.tolist() for e in self.folds[0].bins.edges]
        spark.createDataFrame([settings], "folds int, threshold double, rate double, edges array<array<double>>").write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Matcher:
        n, threshold, rate, edges = spark.read.parquet(f"{path}/settings").first()
        if not n:
            raise ValueError(f"no fold models in {path}")
        bins, rows = T.Bins([np.array(e) for e in edges]), sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: (r["fold"], r["tree"]))
        part = lambda i, c: np.array([r[c] for r in rows if r["fold"] == i])
        return cls([T.Trees(bins, *(part(i, c) for c in ("feature", "at", "gain", "value")), rate) for i in range(n)], IsotonicRegressionModel.load(f"{path}/calibrator"), threshold)


def complete(features: DataFrame) -> DataFrame:
    """features with nulls as 0. A missing column is an error."""
    missing = [c for c in FEATURE_COLS if c not in features.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return features.na.fill(0.0, FEATURE_COLS)


def train_matcher(features: DataFrame, truth: DataFrame, cfg: Config) -> tuple[Matcher, DataFrame]:
    """The matcher, and out-of-fold calibrated scores (PAIR, fold, is_match, raw, score)."""
    rows = E.weighted(E.labelled(complete(features), truth), cfg).withColumn("fold", E.fold(cfg))
    rows = stage(rows.select(*PAIR, *FEATURE_COLS, "is_match", "weight", "fold"), "training")
    bins = T.Bins(T.edges_of(rows))
    models = T.train(T.coded(rows, bins), bins, cfg)
    oof = stage(T.scored(rows, [*PAIR, "fold", "is_match"], models), "oof")
    # Equal scores are one point, as the regression takes them, so that many don't meet in one task.
    points = oof.groupBy("raw").agg(F.avg("is_match").alias("is_match"), F.count("*").cast("double").alias("n"))
    calibrator = IsotonicRegression(featuresCol="raw", labelCol="is_match", weightCol="n", predictionCol="score").fit(points)
    scored = calibrator.transform(oof)
    threshold = E.best_threshold(E.threshold_sweep(scored, truth, features.select(PAIR[0]), cfg)).first()["threshold"]
    return Matcher(models, calibrator, float(threshold)), scored


def fold_accuracy(scored: DataFrame) -> DataFrame:
    return scored.groupBy("fold").agg(F.avg(((F.col("raw") >= 0.5).cast("int") == F.col("is_match")).cast("double")).alias("accuracy"))


def feature_importance(matcher: Matcher, top: int = 10) -> list[tuple[str, float]]:
    """Mean over folds, the largest first."""
    mean = sum(m.importances() for m in matcher.folds) / len(matcher.folds)
    return sorted(zip(FEATURE_COLS, mean.tolist()), key=lambda x: (-x[1], x[0]))[:top]


def score(features: DataFrame, matcher: Matcher) -> DataFrame:
    """(PAIR, raw, score): the mean over the folds, calibrated."""
    if not matcher.folds:
        raise ValueError("the matcher has no models")
    rows = T.scored(complete(features), PAIR, matcher.folds)
    return matcher.calibrator.setPredictionCol("score").setFeaturesCol("raw").transform(rows)


def predict(features: DataFrame, matcher: Matcher) -> DataFrame:
    """(PAIR, score) of the pairs at or above the threshold."""
    return score(features, matcher).where(F.col("score") >= matcher.threshold).select(*PAIR, "score")
