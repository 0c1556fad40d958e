"""Cleaning: names, dates, numbers, labels, gaps. Pure DataFrame to DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dipstick.config import DATE_ALIASES, DERIVED_TYPES, IDENTIFIERS, LEAKS, NUMERIC, SERVE, TOTAL_PARTS, Tank
from dipstick.functions import calendar, numeric, text
from dipstick.operators import timeline


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def rename_date(df: DataFrame, aliases: Sequence[str] = DATE_ALIASES) -> DataFrame:
    """First alias present becomes ``Date``; nothing happens when ``Date`` is there already."""
    found = [] if "Date" in df.columns else [a for a in aliases if a in df.columns]
    return df.withColumnsRenamed({found[0]: "Date"}) if found else df


def date_column(df: DataFrame) -> str | None:
    """The first column called ``date`` in any case."""
    return next((c for c in df.columns if c.lower() == "date"), None)


def parse_dates(df: DataFrame, column: str = "Date") -> DataFrame:
    """Text dates are parsed leniently, timestamps cut to days, rows without a date dropped."""
    kind = df.schema[column].dataType
    d = calendar.parse_date(F.col(column)) if isinstance(kind, T.StringType) else F.col(column).cast("date")
    return df.withColumn(column, d).dropna(subset=[column])


def unreadable_dates(df: DataFrame, column: str = "Date") -> DataFrame:
    """(value, n): the non-blank texts that ``parse_dates`` cannot read and therefore drops."""
    value = F.col(column).cast("string")
    lost = (F.trim(value) != "") & calendar.parse_date(value).isNull()
    return df.where(lost).groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def parse_dates_strict(df: DataFrame, column: str = "Date", layout: str = "dd-MM-yyyy") -> DataFrame:
    return df.withColumn(column, calendar.parse_date_strict(F.col(column), layout))


def coerce_numbers(df: DataFrame, columns: Iterable[str] = NUMERIC) -> DataFrame:
    """Named columns become numbers, bad cells 0. Columns that are numeric already keep their type."""

    def coerced(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            return numeric.to_number(F.col(c))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).otherwise(F.lit(0.0).cast(kind))
        return F.coalesce(F.col(c), F.lit(0).cast(kind))

    return df.withColumns({c: coerced(c) for c in columns if c in df.columns})


def type_derived(df: DataFrame) -> DataFrame:
    """Derived columns that come back from a text file get their types again."""
    text_columns = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    kinds = {c: k for c, k in DERIVED_TYPES.items() if c in text_columns}
    return df.withColumns({c: F.trim(F.col(c)).try_cast("double").cast(k) for c, k in kinds.items()})


def forward_fill(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Last known value per station; leading gaps stay."""
    columns = [c for c in df.columns if c not in ("station_id", "Date")] if columns is None else columns
    return df.withColumns({c: timeline.last_known(c) for c in columns})


def derive_total(df: DataFrame) -> DataFrame:
    """``Total_Sold`` from whichever part columns exist, only if it is absent."""
    parts = [c for c in TOTAL_PARTS if c in df.columns]
    if "Total_Sold" in df.columns or not parts:
        return df
    return df.withColumn("Total_Sold", numeric.row_total([F.col(c) for c in parts]))


def derive_target(df: DataFrame) -> DataFrame:
    """``Target`` from the first label column present, only if it is absent."""
    label = next((c for c in ("Refill_Required", "Refill") if c in df.columns), None)
    if "Target" in df.columns or label is None:
        return df
    return df.withColumn("Target", text.refill_flag(F.col(label)))


def derive_closing(df: DataFrame) -> DataFrame:
    """``Closing_Stock = max(opening - sold, 0)``, only if it is absent."""
    if "Closing_Stock" in df.columns or not {"Opening_Stock", "Total_Sold"} <= set(df.columns):
        return df
    left = F.col("Opening_Stock") - F.col("Total_Sold")
    return df.withColumn("Closing_Stock", F.greatest(left, F.lit(0).cast(df.schema["Opening_Stock"].dataType)))


def stock_ratio(cfg: Tank = SERVE) -> Column:
    """Closing over capacity, or over opening clipped to [0, 1]; four digits."""
    closing = F.col("Closing_Stock")
    if cfg.ratio_to == "capacity":
        return numeric.half_even(closing / float(cfg.capacity), 4)
    return numeric.half_even(numeric.clip(numeric.safe_ratio(closing, F.col("Opening_Stock")), 0.0, 1.0), 4)


def candidate_features(df: DataFrame) -> DataFrame:
    """All columns but identifiers, the target and those that leak it."""
    return df.drop(*IDENTIFIERS, *LEAKS)


def feature_projection(df: DataFrame, features: Sequence[str]) -> list[Column]:
    """Features in their contract order; an absent feature or missing value is 0."""
    return [
        (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0)).alias(f)
        for f in features
    ]


def assemble_feature_list(selected: Sequence[str], columns: Sequence[str], extra: Sequence[str]) -> list[str]:
    """Selected features that exist, then extras that are new, each once."""
    return list(dict.fromkeys([*(f for f in selected if f in columns), *extra]))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def empty_unless(df: DataFrame, columns: Iterable[str], schema: str) -> DataFrame | None:
    """An empty table of the declared schema when a required column is missing, else None."""
    if set(columns) <= set(df.columns):
        return None
    return df.sparkSession.createDataFrame([], schema)
