"""Made ledgers: a date spine and normally distributed sales rolled forward."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipstick.config import SERVE, Tank
from dipstick.functions import numeric
from dipstick.operators.rollforward import roll_forward


def date_spine(stations: DataFrame, start: str, days: int) -> DataFrame:
    """``days`` consecutive dates from ``start`` for every station."""
    first = F.lit(start).cast("date")
    return stations.select(
        "station_id", F.explode(F.sequence(first, F.date_add(first, days - 1))).alias("Date")
    )


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on its keys only, so a re-run task repeats it."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys), 11)
    return (bits.cast("double") + 0.5) / float(2**53)


def normal(*keys: Column) -> Column:
    """Standard normal by the Box-Muller transform of two keyed uniforms."""
    u, v = uniform(F.lit("u"), *keys), uniform(F.lit("v"), *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def synthetic_ledger(
    stations: DataFrame, days: int = 365, start: str = "2024-01-01", seed: int = 42, cfg: Tank = SERVE
) -> DataFrame:
    """Sales ``clip(N(4500, 400), 2000, 7000)`` per station and day, rolled forward."""
    spine = date_spine(stations, start, days)
    drawn = cfg.default_sales + 400 * normal(F.lit(seed), F.col("station_id"), F.col("Date"))
    sold = numeric.half_even(numeric.clip(drawn, 2000.0, 7000.0), 0).cast("bigint")
    return roll_forward(spine.withColumn("Total_Sold", sold), cfg)
