"""Feature pipelines: ``normalise`` for serving, ``prepare`` for the clean table, and training features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipstick.config import PREP, SERVE, Tank
from dipstick.functions import calendar, numeric, text
from dipstick.operators import clean, timeline


def with_station(df: DataFrame, name: str = "tank") -> DataFrame:
    """A ledger without a station column is the ledger of a single tank."""
    return df if "station_id" in df.columns else df.withColumn("station_id", F.lit(name))


def calendar_columns(df: DataFrame) -> DataFrame:
    d = F.col("Date")
    return df.withColumns(
        {
            "Month": F.month(d),
            "Year": F.year(d),
            "DayOfWeek": calendar.weekday(d),
            "Day": calendar.weekday_name(d),
            "Is_Weekend": calendar.is_weekend(calendar.weekday(d)),
        }
    )


def season_flags(df: DataFrame, cfg: Tank) -> dict:
    month = F.col("Month")
    flags = {
        "Is_Festival_Month": calendar.in_months(month, cfg.festival_months),
        "Is_Monsoon_Month": calendar.in_months(month, cfg.monsoon_months),
    }
    return {c: e for c, e in flags.items() if c not in df.columns}


def normalise(df: DataFrame, cfg: Tank = SERVE) -> DataFrame:
    """Clean a ledger and add every serving feature that is absent and can be derived.

    Which columns exist is known while the plan is built, so no job runs here. Calendar columns
    and the rolling mean are always recomputed.
    """
    df = clean.rename_date(with_station(df))
    dated = "Date" in df.columns
    if dated:
        df = calendar_columns(clean.parse_dates(df))
    df = clean.type_derived(clean.coerce_numbers(df))
    df = clean.derive_closing(clean.derive_target(clean.derive_total(df)))
    if not dated:
        return df

    have = set(df.columns)
    sold, closing = "Total_Sold" in have, "Closing_Stock" in have
    opening = "Opening_Stock" in have
    new = {}
    if sold:
        new["Rolling_7d_Sales"] = timeline.trailing_mean("Total_Sold", 7, cfg.rolling_digits)
    if closing:
        new["Prev_Closing"] = timeline.previous("Closing_Stock", cfg.first_prev_closing)
    if closing and (opening or cfg.ratio_to == "capacity"):
        new["Stock_Ratio"] = clean.stock_ratio(cfg)
    new |= season_flags(df, cfg)
    if sold:
        new["Lag1_Total_Sold"] = timeline.lag_or_mean("Total_Sold", 1)
        new["Lag2_Total_Sold"] = timeline.lag_or_mean("Total_Sold", 2)
    if closing and opening:
        new["Lag1_Closing"] = timeline.lag_or_mean("Closing_Stock", 1, "Opening_Stock")
    always = {"Rolling_7d_Sales"}
    df = df.withColumns({c: e for c, e in new.items() if c in always or c not in have})
    # Windows in date order come first and the weekday's last, so that each order is sorted for once.
    if "Target" in df.columns and "Days_Since_Refill" not in have:
        df = timeline.days_since_refill(df)
    if sold and "Sales_Trend" not in have:
        df = df.withColumn("Sales_Trend", sales_trend())
    if sold and "DOW_Avg_Sales" not in have:
        df = timeline.weekday_ewm(df, "Total_Sold", cfg.alpha, "DOW_Avg_Sales")
    return df


def sales_trend(rolling: str = "Rolling_7d_Sales", sold: str = "Total_Sold"):
    """Rolling mean over the station's mean, four digits."""
    mean = F.avg(sold).over(timeline.station())
    return numeric.half_even(numeric.safe_ratio(F.col(rolling), mean, None), 4)


def prepare(df: DataFrame, cfg: Tank = PREP, layout: str = "dd-MM-yyyy") -> DataFrame:
    """The clean table: strict dates, forward fill, calendar, strict target and business features."""
    df = with_station(df)
    if df.schema["Date"].dataType.simpleString() == "string":
        df = clean.parse_dates_strict(df, layout=layout)
    df = clean.forward_fill(df)
    named = "Day" in df.columns
    day = F.col("Day") if named else calendar.weekday_name(F.col("Date"))
    df = df.withColumns(
        {
            "Year": F.year("Date"),
            "Month": F.month("Date"),
            "DayOfWeek": calendar.weekday(F.col("Date")),
            "Quarter": F.quarter("Date"),
            "Is_Weekend": calendar.is_weekend(calendar.weekday(F.col("Date"))),
            "Day_Num": calendar.weekday_number(day),
            "Target": text.refill_flag_strict(F.col("Refill_Required")),
        }
    )
    return df.withColumns(
        {
            "Stock_Ratio": clean.stock_ratio(cfg),
            "Rolling_7d_Sales": timeline.trailing_mean("Total_Sold", 7, cfg.rolling_digits),
            "Prev_Closing": timeline.previous("Closing_Stock", cfg.first_prev_closing),
            "Is_Festival_Month": calendar.in_months(F.col("Month"), cfg.festival_months),
            "Is_Monsoon_Month": calendar.in_months(F.col("Month"), cfg.monsoon_months),
        }
    )


def training_features(prepared: DataFrame, cfg: Tank = PREP) -> DataFrame:
    """Lags, weekday mean, trend and days since refill on top of ``prepare``."""
    df = prepared.withColumns(
        {
            "Lag1_Total_Sold": timeline.lag_or_mean("Total_Sold", 1),
            "Lag2_Total_Sold": timeline.lag_or_mean("Total_Sold", 2),
            "Lag1_Closing": timeline.lag_or_mean("Closing_Stock", 1, "Opening_Stock"),
            "Sales_Trend": sales_trend(),
        }
    )
    return timeline.weekday_ewm(timeline.days_since_refill(df), "Total_Sold", cfg.alpha, "DOW_Avg_Sales")
