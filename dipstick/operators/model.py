"""Random forests: importance ranking, training, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipstick.operators import clean
from dipstick.operators.timeline import station

# Feature values are binned before splits are searched; more bins come closer to exact splits.
MAX_BINS = 128
# Node statistics held at once; more memory means fewer passes over the data.
MEMORY_MB = 512


def _pipeline(features: Sequence[str], **forest) -> Pipeline:
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    classify = RandomForestClassifier(
        featuresCol="features", labelCol="Target", seed=42, maxBins=MAX_BINS,
        featureSubsetStrategy="sqrt", maxMemoryInMB=MEMORY_MB, **forest,
    )
    return Pipeline(stages=[assemble, classify])


def matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns in order as doubles, missing values and absent features 0."""
    return df.select(*keep, *clean.feature_projection(df, features))


def fit_importance_forest(df: DataFrame, features: Sequence[str], trees: int = 100, depth: int = 30) -> PipelineModel:
    """The ranking forest: all rows, effectively unlimited depth."""
    return _pipeline(features, numTrees=trees, maxDepth=depth).fit(matrix(df, features, ["Target"]))


def fit_forest(
    df: DataFrame, features: Sequence[str], trees: int = 200, depth: int = 12, min_leaf: int = 3, bootstrap: bool = True
) -> PipelineModel:
    """The refill classifier, with balanced class weights."""
    weighted = with_class_weights(df)
    return _pipeline(
        features, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, weightCol="weight", bootstrap=bootstrap
    ).fit(matrix(weighted, features, ["Target", "weight"]))


def class_weights(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``n / (2 * n_class)`` per class."""
    counts = df.groupBy(*by, "Target").agg(F.count("*").alias("n"))
    if by:
        whole = F.sum("n").over(station())
    else:
        whole = df.agg(F.count("*")).scalar()
    return counts.withColumn("weight", whole / (2 * F.col("n")))


def with_class_weights(df: DataFrame) -> DataFrame:
    """``weight`` column; two classes, so the lookup is two scalars and not a join."""
    n = df.agg(F.struct(F.count("*").alias("all"), F.count_if(F.col("Target") == 1).alias("ones"))).scalar()
    own = F.when(F.col("Target") == 1, n["ones"]).otherwise(n["all"] - n["ones"])
    return df.withColumn("weight", n["all"] / (2 * own))


def importance_table(model: PipelineModel) -> DataFrame:
    """(Feature, Importance), largest first; one row per feature."""
    features = model.stages[0].getInputCols()
    weights = model.stages[-1].featureImportances.toArray()
    spark = SparkSession.active()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    return spark.createDataFrame(rows, "Feature string, Importance double").orderBy(F.desc("Importance"), "Feature")


def select_features(table: DataFrame, least: float = 0.01) -> DataFrame:
    return table.where(F.col("Importance") >= least)


def dropped_features(table: DataFrame, least: float = 0.01) -> DataFrame:
    return table.where(F.col("Importance") < least)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("station_id", "Date", "Target")) -> DataFrame:
    """Predicted class, P(refill) as ``score`` and the larger class probability as ``confidence``."""
    features = model.stages[0].getInputCols()
    scored = model.transform(matrix(df, features, [c for c in keep if c not in features]))
    kept = [c for c in keep if c not in features]
    p = vector_to_array("probability")
    return scored.select(
        *kept, F.col("prediction").cast("int").alias("prediction"), p[1].alias("score"), F.array_max(p).alias("confidence")
    )
