"""Exact quantiles by counted ranges: no buffer holds distinct values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipstick.session import materialise

RANGES = 1024


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join in which NULL keys are equal; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys])
    return left.join(renamed, same).drop(*[f"_{k}" for k in keys])


def ranked_values(values: DataFrame, ranks: DataFrame, keys: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """(keys, rank, value): the value at each wanted rank (0 is the least) of ``values`` (keys, value).

    A round counts the values of equal ranges between a rank's bounds, keeps the one range that holds
    the rank, and takes the least and the largest value found there as the next bounds. Counts are
    combined before their shuffle, so at most ``ranges`` rows a rank and task are sent; no value is. The
    bounds' own values fall into different ranges, so each round narrows until both are one value.
    """
    whole = values.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    open_ = materialise(_join(ranks, whole, keys).withColumn("below", F.lit(0).cast("bigint")), "ranks")
    done = open_.where("lo = hi")
    open_ = open_.where("lo < hi")
    while not open_.isEmpty():
        bounds = open_.select(*keys, "lo", "hi", "below").distinct()
        # Halves, so that the widest range of doubles has a width.
        at = F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * ranges)
        inside = _join(values, bounds, keys).where(F.col("value").between(F.col("lo"), F.col("hi")))
        counted = inside.groupBy(*keys, F.col("lo").alias("of"), "below", F.least(at, F.lit(ranges - 1)).alias("at")).agg(
            F.count("*").alias("n"), F.min("value").alias("next_lo"), F.max("value").alias("next_hi")
        )
        upto = F.sum("n").over(Window.partitionBy(*keys, "of").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        held = counted.withColumn("upto", F.col("below") + upto).drop("below")
        found = _join(open_.select(*keys, "rank", F.col("lo").alias("of")), held, [*keys, "of"])
        found = found.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        narrowed = materialise(
            found.select(*keys, "rank", F.col("next_lo").alias("lo"), F.col("next_hi").alias("hi"), (F.col("upto") - F.col("n")).alias("below")), "ranks"
        )
        done = done.unionByName(narrowed.where("lo = hi"))
        open_ = narrowed.where("lo < hi")
    return done.select(*keys, "rank", F.col("lo").alias("value"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = ("station_id",), ranges: int = RANGES) -> DataFrame:
    """(by, column, share, value): interpolated quantiles of every column and group, as ``percentile`` gives them.

    For histories or groups of any size, where ``percentile`` would hold each distinct value of a group.
    Missing values are left out; a column without values gives no row.
    """
    keys = [*by, "column"]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    values = df.select(*by, F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    sizes = materialise(values.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    asked = sizes.select(*keys, "n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    asked = asked.withColumn("place", F.col("share") * (F.col("n") - 1))
    asked = asked.withColumns({"low": F.floor("place"), "high": F.ceil("place")})
    ranks = asked.select(*keys, F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = materialise(ranked_values(values, ranks, keys, ranges), "quantiles")
    ends = {end: found.select(*keys, F.col("rank").alias(end), F.col("value").alias(f"{end}_value")) for end in ("low", "high")}
    both = _join(_join(asked, ends["low"], [*keys, "low"]), ends["high"], [*keys, "high"])
    between = (F.col("high") - F.col("place")) * F.col("low_value") + (F.col("place") - F.col("low")) * F.col("high_value")
    return both.select(*keys, "share", F.when(F.col("low") == F.col("high"), F.col("low_value")).otherwise(between).alias("value"))
