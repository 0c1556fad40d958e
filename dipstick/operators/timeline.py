"""Windows over a station's days.

A built ledger has one row per station and day, so a window partition is bounded by the calendar, not
by the raw volume. Frames count rows, so rows of one day follow each other instead of being summed. Every window here partitions by the station or by the station and weekday, and all
are served by one hash exchange on the station.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dipstick.functions import numeric, series


def days() -> WindowSpec:
    return Window.partitionBy("station_id").orderBy("Date")


def latest_first() -> WindowSpec:
    return Window.partitionBy("station_id").orderBy(F.desc("Date"))


def station() -> WindowSpec:
    return Window.partitionBy("station_id")


def same_weekday() -> WindowSpec:
    return Window.partitionBy("station_id", "DayOfWeek").orderBy("Date")


def trailing_mean(column: str, rows: int = 7, digits: int | None = None) -> Column:
    """Mean of this row and the ``rows - 1`` before it, fewer at the start."""
    mean = F.avg(column).over(days().rowsBetween(1 - rows, 0))
    return numeric.half_even(mean, digits)


def lag_or_mean(column: str, k: int, mean_of: str | None = None) -> Column:
    """Value ``k`` rows back; before the start, the whole-series mean."""
    mean = F.avg(mean_of or column).over(station())
    return F.coalesce(F.lag(column, k).over(days()).cast("double"), mean)


def previous(column: str, first: float) -> Column:
    return F.coalesce(F.lag(column, 1).over(days()).cast("double"), F.lit(float(first)))


def last_known(column: str) -> Column:
    return F.last(column, ignorenulls=True).over(days().rowsBetween(Window.unboundedPreceding, 0))


def weekday_ewm(df: DataFrame, column: str, alpha: float, out: str, block: int | None = None, position: str | None = None) -> DataFrame:
    """Exponentially weighted mean over the same weekday, current row included.

    Written out, the recursion is a sum of ``x * (1-a)^(n-i)``. Scaled by the power it is a plain
    running sum, one addition per row and no array. The sum restarts every ``block`` known values,
    where the scale has reached 1e150, far from overflow; what all earlier blocks have carried is
    folded from their ends, one short array entry per block.

    The mean starts at the first known value: NULLs before it give NULL, later ones repeat the mean.
    Rows of one day follow each other, in one order for all windows here. ``position`` names a
    column to keep for that order, the row's number within the weekday.
    """
    keep = 1 - alpha
    block = block or series.ewm_depth(alpha, 1e-150)
    x = F.col(column).cast("double")
    so_far = same_weekday().rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumns({"_pos": F.row_number().over(same_weekday()), "_rn": F.count(x).over(so_far)}).withColumns(
        {"_block": F.expr(f"greatest(_rn - 1, 0) div {block}"), "_at": F.expr(f"greatest(_rn - 1, 0) % {block}").cast("double")}
    )
    share = F.when(F.col("_rn") == 1, x).otherwise(x * alpha) / F.pow(F.lit(keep), F.col("_at"))
    inside = Window.partitionBy("station_id", "DayOfWeek", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = numbered.withColumn("_local", F.sum(share).over(inside) * F.pow(F.lit(keep), F.col("_at")))
    end = F.when(x.isNotNull() & (F.col("_at") == block - 1), F.col("_local"))
    # The same order as by position alone, written so that the sort just made serves it too.
    by_block = Window.partitionBy("station_id", "DayOfWeek").orderBy("_block", "_pos")
    ends = F.collect_list(end).over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    before = F.aggregate(F.col("_ends"), F.lit(0.0), lambda y, e: y * F.lit(keep**block) + e)
    value = F.col("_local") + before * F.pow(F.lit(keep), F.col("_at") + 1)
    found = summed.withColumn("_ends", ends).withColumn(out, F.when(F.col("_rn") > 0, value))
    if position:
        found = found.withColumn(position, F.col("_pos"))
    return found.drop("_pos", "_rn", "_block", "_at", "_local", "_ends")


def days_since_refill(df: DataFrame, flag: str = "Target", out: str = "Days_Since_Refill") -> DataFrame:
    """Rows since the last refill day, read before the reset on the refill day itself.

    A cycle starts on the row after a refill; both windows share the station's order, so this
    costs one sort and no second partitioning.
    """
    after_refill = F.lag(flag).over(days()) == 1
    numbered = df.withColumns({"_rn": F.row_number().over(days()), "_after": after_refill})
    start = F.max(F.when(F.col("_after"), F.col("_rn"))).over(days().rowsBetween(Window.unboundedPreceding, 0))
    since = F.col("_rn") - F.coalesce(start, F.lit(1))
    return numbered.withColumn(out, since.cast("int")).drop("_rn", "_after")


def days_since_refill_islands(df: DataFrame, flag: str = "Target", out: str = "Days_Since_Refill") -> DataFrame:
    """The same measure as a running count inside each refill cycle."""
    cycle = F.coalesce(F.lag(flag).over(days()).cast("int"), F.lit(0))
    grouped = df.withColumn("_step", cycle).withColumn("_cycle", F.sum("_step").over(days().rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("station_id", "_cycle").orderBy("Date")
    return grouped.withColumn(out, (F.row_number().over(inside) - 1).cast("int")).drop("_step", "_cycle")


def tail(df: DataFrame, k: int) -> DataFrame:
    """The last ``k`` days of every station; rows are cut before they are shuffled."""
    return df.withColumn("_back", F.row_number().over(latest_first())).where(F.col("_back") <= k).drop("_back")


def edge_rows(df: DataFrame, columns: list[str], which: str = "last") -> DataFrame:
    """One row per station: its columns on the first or last day. A partial aggregate, no sort."""
    pick = F.max_by if which == "last" else F.min_by
    row = pick(F.struct(*columns), F.col("Date")).alias("_row")
    return df.groupBy("station_id").agg(row).select("station_id", "_row.*")


def chronological_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """``split`` = train for the first ``int(share * n)`` days of a station, else test."""
    rank = F.row_number().over(days())
    size = F.floor(F.count("*").over(station()) * F.lit(share))
    return df.withColumn("split", F.when(rank <= size, "train").otherwise("test"))


def recent_trailing_mean(df: DataFrame, column: str, k: int = 60, rows: int = 7) -> DataFrame:
    """Trailing mean restarted inside each station's last ``k`` days."""
    return tail(df, k).withColumn("Rolling_7d", trailing_mean(column, rows))
