"""The correlation matrix from one buffer a station: NULLs, constants, large offsets, and the plan."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipstick.operators import stats

KIND = "station_id string, a double, b double, c double, d double"


def pairwise(rows, i, j):
    xy = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
    x, y = (np.array(v) for v in zip(*xy)) if xy else (np.array([]),) * 2
    if len(x) < 1 or x.min() == x.max() or y.min() == y.max():
        return None
    return float(np.corrcoef(x, y)[0, 1])


@pytest.mark.parametrize("offset", [0.0, 1e7])
def test_against_pairs_of_complete_rows(spark, offset):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a = rng.gauss(0, 3)
        b = None if rng.random() < 0.2 else 2 * a + rng.gauss(0, 1) + offset
        rows.append((f"s{i % 3}", a + offset, b, None if i % 3 == 1 else rng.random(), 7.1))
    rows += [("one", 1.0, 2.0, 3.0, 4.0), ("none", None, None, None, None)]
    df = spark.createDataFrame(rows, KIND).repartition(4)
    found = {(r.station_id, r.feature, r.other): r.correlation for r in stats.correlation_matrix(df, list("abcd")).collect()}
    assert len(found) == 16 * len({r[0] for r in rows})
    for station in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == station]
        for i, x in enumerate("abcd", 1):
            for j, y in enumerate("abcd", 1):
                want, got = pairwise(own, i, j), found[station, x, y]
                assert (got is None) == (want is None) and (want is None or math.isclose(got, want, abs_tol=2e-6)), (station, x, y)


def test_rows_are_not_multiplied(spark):
    df = spark.range(1000).select(F.lit("s").alias("station_id"), *[(F.col("id") * k % 97).alias(n) for k, n in ((3, "a"), (5, "b"), (7, "c"), (11, "d"))])
    text = stats.correlation_matrix(df, list("abcd"))._jdf.queryExecution().executedPlan().toString()
    # Read from the bottom: the rows go into a partial sum by station before anything is generated.
    assert text.rindex("partial_sum(") > text.rindex("Generate")
    assert stats.correlation_matrix(df.limit(0), list("abcd")).count() == 0
