"""Stock roll-forward: opening, closing and refill flag from daily sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipstick.config import SERVE, Tank
from dipstick.session import materialise


def roll_forward(daily: DataFrame, cfg: Tank = SERVE, sold: str = "Total_Sold") -> DataFrame:
    """Add Opening_Stock, Closing_Stock and Target to one row per station and day.

    A day opens full after a refill day and with the last closing otherwise. Only the opening
    stocks are sequential; they are folded in two levels (days within a month, months within a
    station), which keeps appending close to linear in the number of days, and everything else is
    computed from them row by row. The input has one row per station and day, which bounds a
    station's array by its calendar, however many raw rows stood behind a day.
    """
    carried = [c for c in daily.columns if c not in ("station_id", "Opening_Stock", "Closing_Stock", "Target")]
    litre = daily.schema[sold].dataType.simpleString()
    full, empty, threshold = (F.lit(v).cast(litre) for v in (cfg.capacity, 0, cfg.threshold))

    # Both groupings are hash-partitioned by station: the first exchange serves the second.
    months = (
        daily.repartition("station_id")
        .groupBy("station_id", F.trunc("Date", "month").alias("_month"))
        .agg(F.sort_array(F.collect_list(F.struct("Date", *[c for c in carried if c != "Date"]))).alias("_days"))
    )
    stations = months.groupBy("station_id").agg(
        F.sort_array(F.collect_list(F.struct("_month", "_days"))).alias("_months")
    )

    def next_opening(openings: Column, litres: Column) -> Column:
        left = F.greatest(empty, F.element_at(openings, -1) - litres)
        return F.concat(openings, F.array(F.when(left < threshold, full).otherwise(left)))

    def one_month(done: Column, m: Column) -> Column:
        """A month's openings, led by none and followed by the opening of the next month."""
        first = F.array(F.element_at(F.element_at(done, -1), -1))
        return F.concat(done, F.array(F.aggregate(m["_days"][sold], first, next_opening)))

    folded = F.aggregate(
        "_months",
        F.array(F.array(full)),
        one_month,
        lambda done: F.flatten(F.transform(done, lambda a: F.slice(a, 1, F.size(a) - 1))),
    )
    days = F.flatten(F.col("_months")["_days"])
    closing = F.greatest(empty, F.col("Opening_Stock") - F.col(sold))
    return (
        stations.select("station_id", F.inline(F.arrays_zip(days.alias("day"), folded.alias("Opening_Stock"))))
        .select("station_id", "day.*", "Opening_Stock")
        .withColumn("Closing_Stock", closing)
        .withColumn("Target", (F.col("Closing_Stock") < threshold).cast("int"))
        .select("station_id", *carried, "Opening_Stock", "Closing_Stock", "Target")
    )


def _exact(sold: str, kind: str) -> Column:
    """Sales as decimals, whose sums do not depend on their order."""
    return F.col(f"`{sold}`").cast("decimal(28,9)" if kind in ("double", "float") else "decimal(20,0)" if "int" in kind else kind)


def refill_starts(days: DataFrame, room: float) -> DataFrame:
    """(_key, _n): the first day, and every day after a refill, of ``days`` (_key, _n, _litres, _upto).

    A tank that is full on the morning of day i is refilled on the first day whose running sum exceeds
    that before day i by more than ``room``. One sort of sums and limits together finds that day for
    every i. From these pointers, doubled each round, the starts that day one reaches are marked: the
    rounds are the logarithm of the refills of a station, each of them two equi-joins.
    """
    sums = days.select("_key", F.col("_upto").alias("_value"), F.col("_n").alias("_refill"), F.lit(None).cast("bigint").alias("_n"))
    limits = days.select("_key", (F.col("_upto") - F.col("_litres") + F.lit(room)).alias("_value"), F.lit(None).cast("bigint").alias("_refill"), "_n")
    # From the largest down, a limit before the sums equal to it and later days first: the last sum seen is the earliest day beyond the limit.
    falling = Window.partitionBy("_key").orderBy(F.desc("_value"), F.desc_nulls_first("_refill"))
    seen = F.last("_refill", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    both = sums.unionByName(limits.withColumn("_value", F.col("_value").cast(sums.schema["_value"].dataType)))
    hops = both.withColumn("_refill", seen).where("_n IS NOT NULL AND _refill IS NOT NULL").select("_key", "_n", (F.col("_refill") + 1).alias("_to"))
    hops = materialise(hops, "hops")
    reached = days.where("_n = 1").select("_key", "_n")
    while not hops.isEmpty():
        reached = materialise(reached.unionByName(reached.join(hops, ["_key", "_n"]).select("_key", F.col("_to").alias("_n"))), "reached")
        again = hops.select("_key", F.col("_n").alias("_to"), F.col("_to").alias("_next"))
        hops = materialise(hops.join(again, ["_key", "_to"]).select("_key", "_n", F.col("_next").alias("_to")), "hops")
    return reached


def roll_forward_by_pointers(daily: DataFrame, cfg: Tank = SERVE, sold: str = "Total_Sold") -> DataFrame:
    """``roll_forward`` without an array of days: for histories that no calendar bounds.

    Running sums, an ordered lookup and pointer doubling, all as windows and joins; nothing but single
    rows is held. Days with negative sales break the order of the sums; stations that have some
    are folded. Floating sales are taken to nine decimals.
    """
    carried = [c for c in daily.columns if c not in ("station_id", "Opening_Stock", "Closing_Stock", "Target")]
    kind = daily.schema[sold].dataType.simpleString()
    order = Window.partitionBy("_key").orderBy("Date", *[c for c in carried if c != "Date"])
    litres = F.coalesce(_exact(sold, kind), F.lit(cfg.capacity))  # an unknown day empties the tank, as in the fold
    days = daily.select("station_id", *carried).withColumns(
        {"_key": F.coalesce(F.concat(F.lit("#"), "station_id"), F.lit("")), "_litres": litres}
    )
    days = days.withColumns(
        {
            "_n": F.row_number().over(order).cast("bigint"),
            "_upto": F.sum("_litres").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_returns": F.min("_litres").over(Window.partitionBy("_key")) < 0,
        }
    )
    days = materialise(days, "sums")
    plain, returns = days.where("NOT _returns"), days.where("_returns").select("station_id", *carried)
    starts = refill_starts(plain.select("_key", "_n", "_litres", "_upto"), cfg.capacity - cfg.threshold)
    by_day = Window.partitionBy("_key").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    marked = plain.join(starts.withColumn("_starts", F.lit(True)), ["_key", "_n"], "left")
    before = F.col("_upto") - F.col("_litres")
    full = F.lit(cfg.capacity) + F.last(F.when(F.col("_starts"), before), ignorenulls=True).over(by_day)
    rolled = marked.withColumn("_full", full).select(
        "station_id", *carried,
        (F.col("_full") - before).cast(kind).alias("Opening_Stock"),
        F.greatest(F.lit(0), F.col("_full") - F.col("_upto")).cast(kind).alias("Closing_Stock"),
        (F.col("_full") - F.col("_upto") < cfg.threshold).cast("int").alias("Target"),
    )
    return rolled.unionByName(roll_forward(returns, cfg, sold))
