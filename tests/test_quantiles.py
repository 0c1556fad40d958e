"""Quantiles by counted ranges equal those of the built-in aggregate, on awkward values too."""

import random

import pytest
from pyspark.sql import functions as F

from dipstick.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
KIND = "station_id string, x double, y int"


@pytest.mark.parametrize("ranges", [2, 16, 1024])
def test_equal_to_the_aggregate(spark, ranges):
    rng = random.Random(ranges)
    rows = [("even", rng.uniform(-5, 5), rng.randrange(4)) for _ in range(200)]
    rows += [("steep", rng.choice([-1, 1]) * 10.0 ** rng.randrange(-30, 30), i) for i in range(100)]
    rows += [("same", 7.5, 1)] * 40 + [("hot", rng.choice([1.0, 1.0, 1.0, 2.0, 1e308, -1e308]), rng.randrange(10**6)) for _ in range(300)]
    rows += [(None, float(i), None) for i in range(11)] + [("one", 3.0, 4), ("none", None, None), ("gap", None, 5), ("gap", float("nan"), 6)]
    df = spark.createDataFrame(rows, KIND).repartition(4)
    known = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    want = {}
    for r in known.groupBy("station_id").agg(*[F.percentile(c, F.array(*map(F.lit, SHARES))).alias(c) for c in ("x", "y")]).collect():
        want |= {(r.station_id, c, s): v for c in ("x", "y") if r[c] for s, v in zip(SHARES, r[c])}
    got = {(r.station_id, r["column"], r.share): r.value for r in exact_quantiles(df, ["x", "y"], SHARES, ranges=ranges).collect()}
    assert got == want


def test_counts_are_combined_before_their_shuffle(spark):
    assert exact_quantiles(spark.createDataFrame([], KIND), ["x"], [0.5]).count() == 0
    df = spark.range(20_000).select(F.lit("s").alias("station_id"), (F.col("id") * 37 % 20_011).cast("double").alias("x"), F.lit(1).alias("y"))
    assert [r.value for r in exact_quantiles(df, ["x"], [0.5]).collect()] == [df.agg(F.percentile("x", 0.5)).first()[0]]
