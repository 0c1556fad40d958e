"""The roll-forward by pointers gives the folded ledger, and holds no array of days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dipstick.operators.rollforward import roll_forward, roll_forward_by_pointers

START = dt.date(2020, 1, 1)


def ledger(spark, sales, kind="bigint"):
    rows = [(s, START + dt.timedelta(days=i), x) for s, days in sales.items() for i, x in enumerate(days)]
    return spark.createDataFrame(rows, f"station_id string, Date date, Total_Sold {kind}").withColumn("note", F.lit("n"))


def same(df):
    got, want = roll_forward_by_pointers(df), roll_forward(df)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    return got


def test_random_sales(spark):
    rng = random.Random(4)
    sales = {
        "steady": [rng.randint(3500, 5500) for _ in range(200)],
        "wild": [rng.choice([0, 0, 1, 10_000, 10_001, 9_999, 30_000, 2_500]) for _ in range(150)],
        "idle": [0] * 30,
        "daily": [12_000] * 20,
        "edge": [5_000, 5_000, 1] * 15,  # exactly at the threshold is no refill
        None: [4_000] * 9,
        "one": [11_000],
    }
    same(ledger(spark, sales))


def test_unknown_and_returned_litres(spark):
    same(ledger(spark, {"a": [4000, None, 3000, None, 9000, 9000], "b": [4000, -500, 8000, -9000, 15_000, 2000, 100], "c": [5000] * 8}))


@pytest.mark.parametrize("kind", ["int", "double"])
def test_other_numbers(spark, kind):
    df = ledger(spark, {"a": [4500, 4600, 100, 800, 9000, 300] * 4}).withColumn("Total_Sold", F.col("Total_Sold").cast(kind))
    same(df)


def test_plan_has_no_collected_days(spark):
    text = roll_forward_by_pointers(ledger(spark, {"a": [4500] * 40}))._jdf.queryExecution().optimizedPlan().toString()
    stations = text.split("Union")[1] if "Union" in text else text
    assert "_starts" in text and stations.index("_starts") < (stations.index("collect_list") if "collect_list" in stations else len(stations))
    assert roll_forward_by_pointers(ledger(spark, {"a": []})).count() == 0
