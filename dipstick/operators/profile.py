"""Small lookup tables per station: weekday profile, product shares, monthly multipliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipstick.config import DEFAULT_SHARES, PRODUCTS, SALES, SERVE, Tank
from dipstick.functions import calendar, numeric
from dipstick.operators import timeline


def weekday_profile(df: DataFrame, cfg: Tank = SERVE) -> DataFrame:
    """Seven rows per station: weighted mean, recent mean, their blend and product shares.

    A weekday without history takes the station mean and the default shares. The weighted mean is
    the end of the running form over the whole history, rounded to nine digits: a running sum leaves
    noise behind them, which whole litres must not see.
    """
    products = [p for p in PRODUCTS if p in df.columns]
    picked = df.select("station_id", "Date", "DayOfWeek", "Total_Sold", *products)
    weighted = timeline.weekday_ewm(picked, "Total_Sold", cfg.alpha, "_ewm", position="_nth")
    rows = F.count("*").over(Window.partitionBy("station_id", "DayOfWeek"))
    per_day = (
        weighted.withColumn("_back", rows - F.col("_nth") + 1)
        .groupBy("station_id", "DayOfWeek")
        .agg(
            numeric.half_even(F.max_by("_ewm", "_nth"), 9).alias("ewm_avg"),
            F.avg(F.when(F.col("_back") <= cfg.recent, F.col("Total_Sold"))).alias("recent_avg"),
            F.sum("Total_Sold").alias("_sold"),
            F.count("*").alias("_days"),
            *[numeric.safe_ratio(F.avg(p), F.avg("Total_Sold")).alias(f"_{p}") for p in products],
        )
    )
    values = ["recent_avg", "ewm_avg", *[f"_{p}" for p in products]]
    entry = F.struct("DayOfWeek", *values)
    # One array of at most seven entries per station, spread over all seven weekdays.
    wide = per_day.groupBy("station_id").agg(
        (F.sum("_sold") / F.sum("_days")).alias("mean_sold"),
        F.map_from_entries(F.collect_list(F.struct("DayOfWeek", entry))).alias("_by_day"),
    )
    spread = wide.select(
        "station_id", "mean_sold", "_by_day", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("DayOfWeek")
    ).withColumn("_entry", F.col("_by_day")[F.col("DayOfWeek")])
    recent = F.coalesce("_entry.recent_avg", "mean_sold")
    weighted = F.coalesce("_entry.ewm_avg", "mean_sold")
    return spread.select(
        "station_id",
        "DayOfWeek",
        (F.lit(cfg.blend) * recent + F.lit(1 - cfg.blend) * weighted).alias("blended"),
        recent.alias("recent_avg"),
        weighted.alias("ewm_avg"),
        "mean_sold",
        *[
            (
                F.coalesce(F.col(f"_entry._{p}"), F.lit(DEFAULT_SHARES[p])) if p in products else F.lit(DEFAULT_SHARES[p])
            ).alias(p)
            for p in PRODUCTS
        ],
    )


def product_shares(df: DataFrame) -> DataFrame:
    """Mean product litres over mean total litres per weekday; 0 where nothing was sold."""
    return df.groupBy("station_id", "DayOfWeek").agg(
        *[numeric.safe_ratio(F.avg(p), F.avg("Total_Sold")).alias(p) for p in PRODUCTS]
    )


def winsor_bounds(df: DataFrame, columns: Sequence[str] = SALES, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row per station with ``<column>_lo`` and ``<column>_hi``: exact interpolated quantiles."""
    both = F.array(F.lit(low), F.lit(high))
    return (
        df.groupBy("station_id")
        .agg(*[F.percentile(c, both).alias(f"_{c}") for c in columns])
        .select(
            "station_id",
            *[F.col(f"_{c}")[i].alias(f"{c}_{end}") for c in columns for i, end in enumerate(("lo", "hi"))],
        )
    )


def winsorise(df: DataFrame, columns: Sequence[str] = SALES) -> DataFrame:
    """Clamp columns to the station's 1st and 99th percentile; no row is dropped."""
    bounds = winsor_bounds(df, columns)
    capped = {
        c: numeric.clip(F.col(c).cast("double"), F.col(f"{c}_lo"), F.col(f"{c}_hi")) for c in columns
    }
    return df.join(bounds, "station_id").withColumns(capped).select(*df.columns)


def monthly_multipliers(df: DataFrame, cap: bool = True) -> DataFrame:
    """Month mean over station mean, four digits, from capped sales; 1 where a station sold nothing."""
    capped = winsorise(df, ["Total_Sold"]) if cap else df
    per_month = capped.groupBy("station_id", F.month("Date").alias("Month")).agg(
        F.sum("Total_Sold").alias("_sold"), F.count("*").alias("_days")
    )
    whole = timeline.station()
    overall = F.sum("_sold").over(whole) / F.sum("_days").over(whole)
    return per_month.withColumn("_all", overall).select(
        "station_id",
        "Month",
        numeric.half_even(F.coalesce(F.try_divide(F.col("_sold") / F.col("_days"), F.col("_all")), F.lit(1.0)), 4).alias("multiplier"),
    )


def label_months(df: DataFrame) -> DataFrame:
    return df.withColumn("label", calendar.month_label(F.col("Month")))
