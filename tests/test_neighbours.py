"""Pruned neighbour search: exact answers, and work that grows with the rows where they lie in clusters."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dipstick.operators import smote
from dipstick.session import materialise

FEATURES = ["a", "b", "c"]
KIND = "station_id string, Date date, a double, b double, c double"


def clustered(spark, n, station="s", seed=1, spread=1.0, clusters=40):
    rng = random.Random(seed)
    centres = [[rng.uniform(0, 1e4) for _ in FEATURES] for _ in range(clusters)]
    start = dt.date(1900, 1, 1)
    rows = [(station, start + dt.timedelta(days=i), *[c + rng.gauss(0, spread) for c in centres[rng.randrange(clusters)]]) for i in range(n)]
    return spark.createDataFrame(rows, KIND)


def shipped(df, block, k=5):
    """(rows sent to other blocks, pairs of blocks met, pairs of blocks there are)."""
    points = materialise(smote.blocks(df, FEATURES, block), "points")
    inside = smote.neighbours(points.drop("_block"), FEATURES, k, 1 << 20)  # exact distances, so the least that must be sent
    inside = inside.select("station_id", "row", (F.col("distance") ** 2).alias("d2"))
    asked = smote.asked_elsewhere(points, inside, FEATURES, k)
    last = points.agg(F.max("_block")).first()[0] + 1
    return asked.count(), asked.select("station_id", "_block", "_other").distinct().count(), last * (last - 1)


def answers(df, block, k=5):
    return sorted((r.station_id, r.row, r["rank"], r.neighbour_row, r.distance) for r in smote.neighbours(df, FEATURES, k, block).collect())


@pytest.mark.parametrize("spread", [0.0, 1.0, 5e3])
def test_answers_do_not_depend_on_pruning(spark, spread):
    df = clustered(spark, 500, spread=spread)  # without spread most distances are equal
    assert answers(df, 32) == answers(df, 1 << 20)


def test_work_grows_below_the_square(spark):
    small, large = (shipped(clustered(spark, n, clusters=n // 25), 50) for n in (1000, 4000))
    assert large[0] < 8 * small[0] and large[1] < 8 * small[1]  # sixteen times where all blocks meet
    assert large[0] < 4000 * 79 / 20 and large[1] < large[2] / 4


def test_a_station_with_most_rows(spark):
    df = clustered(spark, 1500, "big").unionByName(clustered(spark, 7, "small", 2)).unionByName(clustered(spark, 1, "single", 3))
    found = answers(df, 64)
    assert found == answers(df, 1 << 20)
    assert {s: sum(r[0] == s for r in found) for s in ("big", "small", "single")} == {"big": 7500, "small": 35, "single": 0}


def test_unknown_values_neither_ask_nor_answer(spark):
    df = clustered(spark, 60).withColumn("b", F.when(F.dayofmonth("Date") == 3, None).when(F.dayofmonth("Date") == 4, float("nan")).otherwise(F.col("b")))
    rows = smote.neighbours(df, FEATURES, 3, 8).collect()
    assert rows and all(r.Date.day not in (3, 4) and r.neighbour.day not in (3, 4) for r in rows)
    assert smote.neighbours(df.limit(0), FEATURES).count() == 0


def test_mutual_pairs(spark):
    near = smote.neighbours(clustered(spark, 80), FEATURES, 3)
    pairs = {(r.row, r.neighbour_row): r["rank"] for r in near.collect()}
    want = sorted((i, j) for i, j in pairs if i < j and (j, i) in pairs)
    start = dt.date(1900, 1, 1)
    got = sorted(((r.Date - start).days + 1, (r.neighbour - start).days + 1) for r in smote.mutual_neighbours(near).collect())
    assert got == want
