"""From raw order lines to one ledger row per station and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dipstick.config import PAYMENTS, PRODUCTS, SERVE, Tank
from dipstick.functions import calendar
from dipstick.functions.numeric import choose
from dipstick.operators.rollforward import roll_forward

# Which part types make up which product, which priorities which payment.
PRODUCT_OF_TYPE = {
    "PROMO": "MS_Sold",
    "ECONOMY": "HSD1_Sold", "LARGE": "HSD1_Sold",
    "MEDIUM": "HSD2_Sold", "SMALL": "HSD2_Sold",
    "STANDARD": "HSD3_Sold",
}
PAYMENT_OF_PRIORITY = {"1": "Cash", "2": "Cash", "3": "Online", "4": "Online", "5": "Card"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _lookup(column: Column, mapping: dict[str, str]) -> Column:
    return choose((column == key, F.lit(value)) for key, value in mapping.items())


def daily_quantities(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity per product and cents per payment for every station and day.

    The only step that touches raw volume. No broadcast is forced: joins go by the sizes Spark
    measures, and a hot part or customer is split by the adaptive skew join. Order lines are summed
    per order on the key they are shuffled by for the next join, so an order with very many lines
    leaves each map task as one row, and the daily sums are combined before their shuffle too.
    """
    part = table(spark, folder, "part").select("p_partkey", _lookup(F.col("p_type"), PRODUCT_OF_TYPE).alias("product"))
    quantity = F.col("l_quantity").cast("bigint")
    per_order = (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_partkey", quantity.alias("q"),
                F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(
            F.sum("q").alias("q"),
            F.sum("cents").alias("cents"),
            *[F.sum(F.when(F.col("product") == p, F.col("q")).otherwise(0)).alias(p) for p in PRODUCTS],
        )
    )
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("station_id"))
    orders = (
        table(spark, folder, "orders")
        .select(
            "o_orderkey",
            "o_custkey",
            F.col("o_orderdate").cast("date").alias("Date"),
            _lookup(F.substring("o_orderpriority", 1, 1), PAYMENT_OF_PRIORITY).alias("payment"),
        )
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "station_id", "Date", "payment")
    )
    return (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("station_id", "Date")
        .agg(
            F.sum("q").alias("q"),
            *[F.sum(p).alias(p) for p in PRODUCTS],
            *[F.sum(F.when(F.col("payment") == p, F.col("cents")).otherwise(0)).alias(p) for p in PAYMENTS],
        )
    )


def daily_sales(spark: SparkSession, folder: str, cfg: Tank = SERVE) -> DataFrame:
    """Daily litres: quantities scaled so that a station's mean day is ``cfg.default_sales``."""
    station = Window.partitionBy("station_id")
    mean = int(cfg.default_sales)

    def scaled(column: str):
        return F.expr(f"coalesce((`{column}` * {mean} * _days) div nullif(_q, 0), 0)")

    return (
        daily_quantities(spark, folder)
        .withColumns({"_days": F.count("*").over(station), "_q": F.sum("q").over(station)})
        .select(
            "station_id",
            "Date",
            scaled("q").alias("Total_Sold"),
            *[scaled(p).alias(p) for p in PRODUCTS],
            *PAYMENTS,
        )
    )


def build_ledger(spark: SparkSession, folder: str, cfg: Tank = SERVE) -> DataFrame:
    """The daily ledger: sales, payments, rolled stock, dip reading and refill label."""
    rolled = roll_forward(daily_sales(spark, folder, cfg), cfg)
    return rolled.select(
        "station_id",
        "Date",
        calendar.weekday_name(F.col("Date")).alias("Day"),
        "Opening_Stock",
        "Total_Sold",
        *PRODUCTS,
        *PAYMENTS,
        F.greatest(F.lit(1), F.expr("Closing_Stock div 200")).cast("bigint").alias("Dip"),
        "Closing_Stock",
        "Target",
        F.when(F.col("Target") == 1, "Yes").otherwise("No").alias("Refill_Required"),
    )
