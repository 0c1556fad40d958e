"""Tables behind the prediction card and the printable report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipstick.config import SERVE, Tank
from dipstick.functions import calendar, numeric, text
from dipstick.operators import forecast, profile, timeline
from dipstick.operators import model as forests


def summary(prediction: DataFrame, cfg: Tank = SERVE) -> DataFrame:
    """The prediction record as it is shown, with its traffic lights."""
    stock, pct = F.col("closing_stock"), F.col("confidence") * 100
    safe = stock >= cfg.threshold
    return prediction.select(
        "station_id",
        calendar.display(F.col("refill_date"), "long").alias("refill_date_long"),
        calendar.display(F.col("refill_date"), "short").alias("refill_date_short"),
        "days_remaining",
        numeric.days_band(F.col("days_remaining")).alias("days_band"),
        numeric.half_even(pct, 1).alias("confidence_pct"),
        numeric.confidence_band(pct).alias("confidence_band"),
        text.litres(F.col("avg_sold")).alias("avg_sold"),
        text.litres(stock).alias("closing_stock"),
        numeric.closing_band(stock).alias("closing_band"),
        F.when(safe, "safe").otherwise("below threshold").alias("status"),
    )


def recent_mean(df: DataFrame, k: int = 7) -> DataFrame:
    """Mean sales of each station's last ``k`` days."""
    return timeline.tail(df, k).groupBy("station_id").agg(F.avg("Total_Sold").alias("recent_mean"))


def reasons(prediction: DataFrame, ledger: DataFrame, metrics: DataFrame | None = None, cfg: Tank = SERVE) -> DataFrame:
    """Reason codes per station, in the order they are shown."""
    facts = prediction.join(recent_mean(ledger), "station_id")
    accuracy: Column = F.lit(0.0)
    if metrics is not None:
        facts = facts.join(metrics.select("station_id", "accuracy"), "station_id", "left")
        accuracy = F.coalesce("accuracy", F.lit(0.0))
    stock = F.col("closing_stock")
    low = F.format_string("critically low, %d%% of capacity", F.rint(stock / cfg.capacity * 100).cast("int"))
    return facts.select(
        "station_id",
        F.posexplode(
            F.array(
                F.when(stock < 2 * cfg.threshold, low).otherwise("at moderate level"),
                F.when(F.col("recent_mean") > F.col("avg_sold"), "above overall average").otherwise("within normal range"),
                F.format_string(
                    "accuracy %d%%, confidence %d%%",
                    F.rint(accuracy * 100).cast("int"),
                    F.rint(F.col("confidence") * 100).cast("int"),
                ),
            )
        ).alias("position", "reason"),
    )


def metric_rows(metrics: DataFrame) -> DataFrame:
    """One row per stored metric with its percentage and light."""
    labels = (("accuracy", "Accuracy"), ("f1_score", "F1 Score"), ("roc_auc", "ROC-AUC"))
    entries = F.array(
        *[F.struct(F.lit(label).alias("metric"), numeric.half_even(F.col(c) * 100, 1).alias("pct")) for c, label in labels]
    )
    return metrics.select("station_id", F.inline(entries)).withColumn("band", numeric.metric_band(F.col("pct")))


def simulation_table(walked: DataFrame) -> DataFrame:
    """Simulated days as display text with the refill mark."""
    return walked.select(
        "station_id",
        calendar.display(F.col("Date"), "iso").alias("Date"),
        calendar.weekday_name(F.col("Date")).alias("Day"),
        *[text.litres(F.col(c)).alias(c) for c in ("Opening_Stock", "Est_Sold", "Closing_Stock")],
        F.when(F.col("triggered"), "High (Refill Triggered)").otherwise("Low").alias("Refill_Probability"),
        F.col("triggered").alias("Refill_Triggered"),
    )


def stock_path(walked: DataFrame, cfg: Tank = SERVE) -> DataFrame:
    """Opening and closing per simulated day with the below-threshold mark and the axis label."""
    d = F.col("Date")
    return walked.select(
        "station_id",
        (F.col("step") + 1).alias("day_idx"),
        F.concat(calendar.display(d, "weekday"), F.lit(" "), calendar.display(d, "day_first")).alias("label"),
        F.rint("Opening_Stock").cast("bigint").alias("opening"),
        F.rint("Closing_Stock").cast("bigint").alias("closing"),
        (F.rint("Closing_Stock") < cfg.threshold).alias("below"),
    )


def first_below(path: DataFrame) -> DataFrame:
    """The first day of each station's path that ends below the threshold."""
    below = F.when(F.col("below"), F.col("day_idx"))
    return path.groupBy("station_id").agg(F.min(below).alias("day_idx"), F.min_by("label", below).alias("label"))


def predict_with_model(model, features: DataFrame, multipliers: DataFrame, cfg: Tank = SERVE) -> DataFrame:
    """The refill decision whose confidence is the model's on the last simulated day."""
    seeded = forecast.seeded_state(features, multipliers, cfg)
    walked = forecast.walk(seeded, forecast.PREDICT, cfg)
    last_days = timeline.edge_rows(walked, ["Date"]).withColumnRenamed("Date", "_last")
    scored = scored_walk(model, walked, profile.weekday_profile(features, cfg), cfg)
    confidence = scored.join(last_days, "station_id").where(F.col("Date") == F.col("_last")).select(
        "station_id", F.col("confidence").alias("_confidence")
    )
    return (
        forecast.decide(seeded, cfg)
        .join(confidence, "station_id", "left")
        .withColumn("confidence", F.coalesce("_confidence", "confidence"))
        .drop("_confidence")
    )


def scored_walk(model, walked: DataFrame, weekdays: DataFrame, cfg: Tank = SERVE) -> DataFrame:
    """Model probability, label and confidence for all simulated days in one batch."""
    rows = forecast.feature_rows(walked, weekdays, cfg)
    return forests.score(model, rows, ("station_id", "Date")).select(
        "station_id",
        "Date",
        numeric.half_even(F.col("score"), 3).alias("Refill_Prob"),
        F.when(F.col("prediction") == 1, "REFILL").otherwise("No").alias("Model_Says"),
        "confidence",
    )
