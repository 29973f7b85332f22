"""Machine learning over the result table.

Results do not depend on partition layout: the label noise and the
train/test split are derived from a seeded hash of the row key (not
``rand``/``randomSplit``, whose streams depend on how rows are partitioned),
the forest's bagging and the k-means' starts too (``forest``, ``clusters``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.operators.clusters import k_means
from deckscope.operators.forest import fit_forest, prediction
from deckscope.operators.portfolio import derived_features, existing
from deckscope.operators.ranking import materialize

DERIVED = ["market_traction_ratio", "team_execution_score", "business_clarity_score", "overall_strength",
           "score_variance"]
FEATURES = [*L.DIMENSIONS, *DERIVED]


def _uniform(key: Column, seed: int, salt: int) -> Column:
    """Deterministic uniform (0, 1) from a hash of the key."""
    h = F.xxhash64(key, F.lit(seed), F.lit(salt))
    return (F.pmod(h, F.lit(1 << 30)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 30))


def hash_normal(key: Column, seed: int = 42) -> Column:
    """Standard normal noise from two hashed uniforms (Box-Muller)."""
    u1, u2 = _uniform(key, seed, 1), _uniform(key, seed, 2)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def soft_label(df: DataFrame, key: str = "deck_name", seed: int = 42, noise: float = 0.1) -> DataFrame:
    """clip((composite + N(0, noise)) / 10, 0, 1) as ``label``."""
    y = (F.col("composite_score") + hash_normal(F.col(key), seed) * F.lit(noise)) / F.lit(10.0)
    return df.withColumn("label", F.least(F.lit(1.0), F.greatest(F.lit(0.0), y)))


def split_train_test(df: DataFrame, key: str = "deck_name", test_fraction: float = 0.3, seed: int = 42):
    """Reproducible split by a seeded hash of the key."""
    u = _uniform(F.col(key), seed, 3)
    return df.filter(u >= test_fraction), df.filter(u < test_fraction)


def feature_pipeline(df: DataFrame) -> Pipeline:
    """N1 + N4: category code (alphabetical, unseen -> extra code per row),
    assembled features, z-scores fitted on the training rows."""
    stages = []
    cols = existing(df, FEATURES)
    if "category" in df.columns:
        stages.append(StringIndexer(inputCol="category", outputCol="category_encoded", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        cols = cols + ["category_encoded"]
    stages.append(VectorAssembler(inputCols=cols, outputCol="raw_features", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=stages), cols


@dataclass
class SuccessModel:
    """``model`` makes the features; ``trees`` is empty when there were too few rows to fit."""

    model: PipelineModel | None
    trees: list
    gains: np.ndarray
    feature_names: list
    train: DataFrame
    test: DataFrame

    def _predicted(self, df: DataFrame) -> DataFrame:
        if not self.trees:
            return df.withColumn("prediction", F.lit(None).cast("double"))
        out = self.model.transform(df)
        return out.withColumn("prediction", prediction(out, self.trees, vector_to_array("raw_features")))

    def r2(self) -> tuple[float, float]:
        """R^2 on the train rows and on the test rows (NaN without a model or with < 2 test rows)."""
        ev = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="r2")
        if not self.trees:
            return float("nan"), float("nan")
        train_r2 = ev.evaluate(self._predicted(self.train))
        test_r2 = ev.evaluate(self._predicted(self.test)) if self.test.limit(2).count() > 1 else float("nan")
        return train_r2, test_r2

    def importances(self, spark) -> DataFrame:
        """(feature, importance) sorted by importance desc; no rows without a model."""
        rows = list(zip(self.feature_names, [float(x) for x in self.gains])) if self.trees else []
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.col("importance").desc(), F.col("feature"))

    def predict(self, df: DataFrame) -> DataFrame:
        """N8 + H5: ``success_probability`` clipped to [0, 1], NULL without a model."""
        p = self._predicted(derived_features(df))
        return p.withColumn("success_probability", F.when(F.col("prediction").isNotNull(),
                            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))))).drop(
            "prediction", "raw_features", "features", "category_encoded")


def fit_success_model(df: DataFrame, key: str = "deck_name", num_trees: int = 100, max_depth: int = 30,
                      seed: int = 42, min_rows: int = 4, max_fit_rows: int = 4000) -> SuccessModel:
    """Random-forest regressor on the soft label (100 trees, all features
    per split, seed 42), fitted on the train rows.  Without ``min_rows`` of
    them there are no trees, and probabilities are NULL.  At most
    ``max_fit_rows`` labelled rows, chosen by a hash of the key, are fitted on;
    predictions cover every row.  Rows without a composite have no label and
    are not fitted on."""
    data = soft_label(derived_features(df), key, seed).filter(F.col("composite_score").isNotNull())
    train, test = split_train_test(data, key, 0.3, seed)
    pipe, cols = feature_pipeline(data)
    hashed = train.withColumn("_hash", F.xxhash64(key))
    train = materialize(hashed.orderBy("_hash", key, *existing(df, FEATURES)).limit(max_fit_rows))
    if train.limit(min_rows).count() < min_rows:
        return SuccessModel(None, [], np.zeros(0), cols, train, test)
    model = pipe.fit(train)
    given = model.transform(train).withColumn("_x", vector_to_array("raw_features")).orderBy("_hash", key, "_x")
    trees, gains = fit_forest(given, "_x", "label", "_hash", num_trees, max_depth, seed)
    return SuccessModel(model, trees, gains, cols, train, test)


def prediction_ranking(pred: DataFrame) -> DataFrame:
    """K9 + A8 + M9: deck, composite, probability (x100, 1 decimal), category,
    probability band; highest first."""
    from deckscope.operators.portfolio import probability_band
    from deckscope.operators.ranking import np_round

    pct = np_round(F.col("success_probability") * F.lit(100.0), 1)
    return pred.select("deck_name", "composite_score", pct.alias("success_probability"),
                       *existing(pred, ["category"]), probability_band(pct).alias("probability_band")) \
        .orderBy(F.col("success_probability").desc(), F.col("deck_name"))


def cluster_performance(df: DataFrame, k_max: int = 4, seed: int = 42, key: str = "deck_name") -> DataFrame:
    """Z-scored dimensions, k-means with k = min(4, n); clusters named by
    descending mean composite (strongest group = 'High Performers').  Needs at
    least 3 complete rows and 3 dimensions; with fewer, and for a row with a
    NULL dimension, cluster, name and features are NULL."""
    dims = existing(df, L.DIMENSIONS)
    given = df
    df = given.dropna(subset=dims) if dims else given
    n = df.limit(max(3, k_max)).count()
    if n < 3 or len(dims) < 3:
        from pyspark.ml.linalg import VectorUDT

        return given.withColumns({"cluster": F.lit(None).cast("int"), "features": F.lit(None).cast(VectorUDT()), "cluster_name": F.lit(None).cast("string")})
    out, _ = k_means(df, dims, key, min(k_max, n), seed)
    means = out.groupBy("cluster").agg(F.avg("composite_score").alias("_m"))
    names = F.array(*[F.lit(x) for x in L.CLUSTER_NAMES])
    order = F.row_number().over(Window.orderBy(F.col("_m").desc(), F.col("cluster")))
    means = means.withColumn("_r", order).withColumn(
        "cluster_name", F.when(F.col("_r") <= len(L.CLUSTER_NAMES), F.element_at(names, F.col("_r")))
        .otherwise(F.concat(F.lit("Cluster "), F.col("_r").cast("string"))))
    out = out.join(F.broadcast(means.select("cluster", "cluster_name")), "cluster", "left")     # at most k rows
    lacks = given.where(" or ".join(f"`{c}` is null or isnan(`{c}`)" for c in dims))
    return out.unionByName(lacks, allowMissingColumns=True)


def project_2d(clustered: DataFrame) -> DataFrame:
    """2-D coordinates of the z-scored features (PCA; linear stand-in
    for the non-linear embedding); rows without a cluster have none."""
    clustered = clustered.where("features is not null")
    if not clustered.limit(1).count():
        return clustered.select("deck_name", "cluster", "cluster_name", "composite_score", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    projected = PCA(k=2, inputCol="features", outputCol="xy").fit(clustered).transform(clustered)
    xy = vector_to_array(projected["xy"])
    return projected.select("deck_name", "cluster", "cluster_name", "composite_score",
                            xy[0].alias("x"), xy[1].alias("y"))
