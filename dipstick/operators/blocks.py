"""Windows over long histories in two levels: a station is dealt into blocks of dates, and blocks hand over what they end with."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipstick.functions import numeric
from dipstick.session import materialise

SPAN = 366  # days of a block


def dealt(df: DataFrame, span: int = SPAN) -> DataFrame:
    """``_block``: the number of a row's block of dates. Windows by station and block spread a station over tasks."""
    return df.withColumn("_block", F.floor(F.unix_date("Date") / span).cast("int"))


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join in which NULL stations are equal; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r{k}"]) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"_r{k}" for k in keys])


def last_known(df: DataFrame, columns: Sequence[str], span: int = SPAN) -> DataFrame:
    """``columns`` filled forward by station: inside blocks first, then from the last known value of earlier blocks.

    What a block hands over is one row, so only these meet by station. Values before the first known
    one stay NULL, and rows of one day follow each other in one order, as in ``timeline.last_known``.
    """
    columns = list(columns)
    rows = materialise(dealt(df, span), "blocks")
    # A day's rows are told apart by their values, so that both levels see one order.
    order = ["Date", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    inside = Window.partitionBy("station_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    place = F.struct(*order[:1], order[1].alias("_order"))
    ends = rows.groupBy("station_id", "_block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_end_{c}") for c in columns])
    before = Window.partitionBy("station_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("station_id", "_block", *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_from_{c}") for c in columns])
    joined = _join(filled, carried, ["station_id", "_block"])
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_from_{c}")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def numbered(df: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_rn``, their number by station and date, and ``_end``, that of their block's last row; and (station_id, _block, _offset), the rows before each block."""
    rows = dealt(df, span)
    sizes = materialise(rows.groupBy("station_id", "_block").agg(F.count("*").alias("_size")), "sizes")
    before = Window.partitionBy("station_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("station_id", "_block", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("station_id", "_block").orderBy("Date", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    counted = _join(rows.withColumn("_rn", F.row_number().over(inside)), offsets, ["station_id", "_block"])
    counted = counted.withColumns({"_rn": F.col("_rn") + F.col("_offset"), "_end": F.col("_offset") + F.col("_size")})
    return counted.drop("_offset", "_size"), offsets.drop("_size")


def trailing_mean(df: DataFrame, column: str, out: str, rows: int = 7, digits: int | None = None, span: int = SPAN) -> DataFrame:
    """``out``: mean of this row and the ``rows - 1`` before it, where each block also receives the last rows before it.

    A row is sent to its own block and, as a halo, to every later block that starts within the next
    ``rows - 1`` rows; the row numbers at which blocks start make that an equi-join. Each block is
    then averaged by itself.
    """
    own, offsets = numbered(df, span)
    own = materialise(own, "numbered")
    # Only the last rows of a block reach the start of another one.
    last = own.where(F.col("_end") <= F.col("_rn") + (rows - 2))
    halo = last.select("station_id", "_rn", column, F.explode(F.sequence(F.col("_end"), F.col("_rn") + (rows - 2))).alias("_offset"))
    starts = offsets.where("_offset > 0")
    sent = _join(halo, starts, ["station_id", "_offset"]).where("_block IS NOT NULL").drop("_offset") if rows > 1 else None
    kept = own.withColumn("_own", F.lit(True))
    both = kept if sent is None else kept.unionByName(sent.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    frame = Window.partitionBy("station_id", "_block").orderBy("_rn").rowsBetween(1 - rows, 0)
    mean = numeric.half_even(F.avg(column).over(frame), digits)
    return both.withColumn(out, mean).where("_own").select(*df.columns, out)
