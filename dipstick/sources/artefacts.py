"""Small artefacts in: multipliers, feature list, metrics, importance table, model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipstick.config import FALLBACK_FEATURES, FALLBACK_IMPORTANCES, FALLBACK_METRICS
from dipstick.operators import clean, stats
from dipstick.sources.readers import path_exists, read_csv


def _whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def read_multipliers(spark: SparkSession, path: str) -> DataFrame:
    """JSON object of month to multiplier as (Month, multiplier); an absent file is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "Month int, multiplier double")
    entries = F.from_json("value", "map<string,double>")
    return _whole_text(spark, path).select(F.explode(entries).alias("key", "multiplier")).select(
        F.col("key").cast("int").alias("Month"), "multiplier"
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Ordered feature list as (position, Feature); an absent file gives the default list."""
    if path_exists(spark, path):
        listed = _whole_text(spark, path).select(F.from_json("value", "array<string>").alias("features"))
    else:
        listed = spark.range(1).select(F.array(*[F.lit(f) for f in FALLBACK_FEATURES]).alias("features"))
    return listed.select(F.posexplode("features").alias("position", "Feature"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Stored metrics; a missing file or key takes its default."""
    kinds = ", ".join(f"{k} double" for k in FALLBACK_METRICS)
    raw = (
        spark.read.schema(f"station_id string, {kinds}").json(path)
        if path_exists(spark, path)
        else spark.range(1).select(F.lit(None).cast("string").alias("station_id"),
                                   *[F.lit(None).cast("double").alias(k) for k in FALLBACK_METRICS])
    )
    return raw.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in FALLBACK_METRICS.items()})


def read_importances(spark: SparkSession, path: str, ledger: DataFrame | None = None) -> DataFrame:
    """Importance table with a correlation column; looked up in ``ledger`` when the file has none."""
    if not path_exists(spark, path):
        return spark.createDataFrame(
            list(FALLBACK_IMPORTANCES), "Feature string, Importance double, Correlation_with_Target double"
        )
    raw = read_csv(spark, path)
    kept = [c for c in raw.columns if c != "Feature"]
    table = raw.select("Feature", *[F.col(c).cast("double") for c in kept])
    if "Correlation_with_Target" in table.columns or ledger is None:
        return table
    return with_correlations(table, ledger)


def with_correlations(table: DataFrame, ledger: DataFrame) -> DataFrame:
    """Left join of feature correlations per station; a feature without one gets 0.

    The table, one row per feature, is packed into an array on each station's row.
    """
    numbers = [c for c in clean.numeric_columns(ledger) if c != "Target"]
    found = stats.correlations(ledger, numbers).select(
        "station_id", F.col("feature").alias("Feature"), F.col("correlation").alias("_corr")
    )
    packed = table.agg(F.collect_list(F.struct(*table.columns))).scalar()
    wanted = ledger.select("station_id").distinct().select("station_id", F.inline(packed))
    return wanted.join(found, ["station_id", "Feature"], "left").select(
        "station_id", *table.columns, F.coalesce("_corr", F.lit(0.0)).alias("Correlation_with_Target")
    )


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path
