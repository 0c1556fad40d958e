"""Windows in two levels give what one window by station gives, with a station over many tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dipstick.operators import blocks, timeline

KIND = "station_id string, Date date, x bigint, y double, note string"


def history(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for station, step in (("dense", 1), ("sparse", 40), ("gappy", 7), (None, 3), ("single", 1)):
        day = dt.date(1999, 12, 25)
        for i in range(1 if station == "single" else 150):
            day += dt.timedelta(days=rng.randint(1, step))
            rows.append((station, day, rng.choice([None, i, 2 * i]), None if i < 5 or rng.random() < 0.7 else float(i), f"n{i}"))
    return spark.createDataFrame(rows, KIND)


def same(got, want):
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("span", [1, 10, 366])
def test_filled_forward(spark, span):
    df = history(spark)
    want = df.withColumns({c: timeline.last_known(c) for c in ("x", "y")})
    same(blocks.last_known(df, ["x", "y"], span), want)


@pytest.mark.parametrize("span, rows", [(1, 7), (5, 7), (366, 7), (10, 1), (3, 30)])
def test_trailing_mean(spark, span, rows):
    df = history(spark)
    same(blocks.trailing_mean(df, "x", "mean", rows, 4, span), df.withColumn("mean", timeline.trailing_mean("x", rows, 4)))


def test_a_station_is_many_groups(spark):
    """The windows of rows are by station and block; by station alone there are only rows of blocks."""
    df = history(spark)
    for made in (blocks.last_known(df, ["x"], 30), blocks.trailing_mean(df, "x", "mean", 7, None, 30)):
        text = made._jdf.queryExecution().optimizedPlan().toString()
        by_row = [line for line in text.split("\n") if "Window" in line and ("Date#" in line or "_rn#" in line)]
        assert by_row and all("_block#" in line.split("windowspecdefinition(")[1].split("ASC")[0] for line in by_row)
    assert blocks.last_known(df.limit(0), ["x"]).count() == 0 and blocks.trailing_mean(df.limit(0), "x", "m").count() == 0
