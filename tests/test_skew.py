"""Raw tables in which one order, one part, one customer or one day holds a third of all rows."""

import datetime as dt
import random

import pandas as pd
import pytest

from dipstick.sources import tables

PRODUCT = {"PROMO": "MS_Sold", "ECONOMY": "HSD1_Sold", "LARGE": "HSD1_Sold", "MEDIUM": "HSD2_Sold", "SMALL": "HSD2_Sold", "STANDARD": "HSD3_Sold"}
PAYMENT = {"1": "Cash", "2": "Cash", "3": "Online", "4": "Online", "5": "Card"}


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("hot")
    customers, parts, orders, lines = 30, 40, 300, 6000
    third = lambda hot_key, n: hot_key if rng.random() < 1 / 3 else rng.randrange(n)
    frames = {
        "customer": pd.DataFrame({"c_custkey": range(customers), "c_mktsegment": [f"S{i % 4}" for i in range(customers)]}),
        "part": pd.DataFrame({"p_partkey": range(parts), "p_type": [list(PRODUCT)[i % 6] for i in range(parts)]}),
        "orders": pd.DataFrame(
            {
                "o_orderkey": range(orders),
                "o_custkey": [third(3, customers) for _ in range(orders)],
                "o_orderdate": [pd.Timestamp("2020-01-01") + dt.timedelta(days=third(5, 60)) for _ in range(orders)],
                "o_orderpriority": [f"{rng.randrange(1, 6)}-P" for _ in range(orders)],
            }
        ),
        "lineitem": pd.DataFrame(
            {
                "l_orderkey": [third(7, orders) for _ in range(lines)],
                "l_partkey": [third(9, parts) for _ in range(lines)],
                "l_quantity": [float(rng.randrange(1, 50)) for _ in range(lines)],
                "l_extendedprice": [rng.randrange(100, 10**7) / 100 for _ in range(lines)],
            }
        ),
    }
    for name, frame in frames.items():
        for c in frame.select_dtypes("datetime"):
            frame[c] = frame[c].astype("datetime64[us]")
        frame.to_parquet(folder / f"{name}.parquet", row_group_size=300)
    return str(folder), frames


def _brute_force(frames):
    orders = frames["orders"].merge(frames["customer"], left_on="o_custkey", right_on="c_custkey")
    rows = frames["lineitem"].merge(frames["part"], left_on="l_partkey", right_on="p_partkey").merge(
        orders, left_on="l_orderkey", right_on="o_orderkey"
    )
    out = {}
    for r in rows.itertuples():
        day = out.setdefault((r.c_mktsegment, r.o_orderdate.date()), dict.fromkeys(["q", *PRODUCT.values(), *PAYMENT.values()], 0))
        day["q"] += int(r.l_quantity)
        day[PRODUCT[r.p_type]] += int(r.l_quantity)
        day[PAYMENT[r.o_orderpriority[0]]] += round(r.l_extendedprice * 100)
    return out


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_hot_keys(spark, hot, threshold):
    folder, frames = hot
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = tables.daily_quantities(spark, folder).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {(r.station_id, r.Date): {k: v for k, v in r.asDict().items() if k not in ("station_id", "Date")} for r in rows}
    assert got == _brute_force(frames)


def test_hot_part_and_customer_are_split(spark, hot):
    """With thresholds fit for this size, the adaptive join splits the partition of a hot key."""
    folder, frames = hot
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.files.maxPartitionBytes": "4KB",
        "spark.sql.files.openCostInBytes": "0",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = tables.daily_quantities(spark, folder)
        rows = df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert "skew=true" in text
    got = {(r.station_id, r.Date): {k: v for k, v in r.asDict().items() if k not in ("station_id", "Date")} for r in rows}
    assert got == _brute_force(frames)
