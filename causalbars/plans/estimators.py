"""Walk-forward evaluation of ``pyspark.ml`` regressors: elastic net, Huber, forests, boosted trees."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import splits

#: Recipes by name; each call makes a fresh estimator.
RECIPES: dict[str, Callable[[], Estimator]] = {
    "elastic_net": lambda: LinearRegression(labelCol="actual", predictionCol="pred", regParam=0.001, elasticNetParam=0.5),
    "huber": lambda: LinearRegression(labelCol="actual", predictionCol="pred", loss="huber", epsilon=1.35, maxIter=50),
    "forest": lambda: RandomForestRegressor(labelCol="actual", predictionCol="pred", numTrees=20, maxDepth=4, seed=7),
    "boosted": lambda: GBTRegressor(labelCol="actual", predictionCol="pred", maxIter=10, maxDepth=3, seed=7),
    "boosted_absolute": lambda: GBTRegressor(labelCol="actual", predictionCol="pred", maxIter=10, maxDepth=3, lossType="absolute", seed=7),
}


def pipeline(features: Sequence[str], estimator: Estimator) -> Pipeline:
    """Median imputation, assembly, standardisation, estimator; all fitted on train rows only."""
    filled = [f"_{f}" for f in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="features", withMean=True), estimator])


def walk_forward(rows: DataFrame, features: Sequence[str], names: Sequence[str], folds: int = 2) -> DataFrame:
    """Predictions (series, model, fold, t, close, actual, pred) of pooled models; one fit a fold and recipe."""
    cast = rows.withColumns({f: F.col(f).cast("double") for f in features})
    marked = splits.walk_forward(cast, folds).persist()
    done = None
    for fold in range(1, folds + 1):
        own = marked.where(F.col("fold") == fold)
        for name in names:
            model = pipeline(features, RECIPES[name]()).fit(own.where("role = 'train'"))
            scored = model.transform(own.where("role = 'validation'")).select("series", F.lit(name).alias("model"), "fold", "t", "close", "actual", "pred")
            done = scored if done is None else done.unionByName(scored)
    return done
