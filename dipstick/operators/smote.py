"""Balancing a training set with synthetic minority rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipstick.session import materialise
from dipstick.sources.synthetic import uniform

BLOCK = 256

# Send this module's functions to the workers by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _nearest(wanted: np.ndarray, points: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of ``wanted``, rows of ``points``, squared distances), nearest first; ties go to the lower row.

    ``own`` is the row of ``points`` that a wanted row itself is, or -1.
    """
    for start in range(0, len(wanted), BLOCK):
        some = wanted[start : start + BLOCK]
        d2 = np.zeros((len(some), len(points)))
        for f in range(points.shape[1]):
            d2 += (some[:, f, None] - points[None, :, f]) ** 2
        selves = own[start : start + BLOCK]
        d2[np.flatnonzero(selves >= 0), selves[selves >= 0]] = np.inf
        cut = np.partition(d2, min(k, len(points)) - 1, axis=1)[:, min(k, len(points)) - 1]
        for i in range(len(some)):
            near = np.flatnonzero((d2[i] <= cut[i]) & np.isfinite(d2[i]))
            near = near[np.argsort(d2[i][near], kind="stable")][:k]
            yield start + i, near, d2[i][near]


def numbered(minority: DataFrame, features: Sequence[str]) -> DataFrame:
    """``_row``: a row's number within its station, by date; rows of one day by their features."""
    order = Window.partitionBy("station_id").orderBy("Date", *features, F.xxhash64(*minority.columns))
    return minority.withColumn("_row", F.row_number().over(order))


def curve(features: Sequence[str]) -> Column:
    """Place of a row on a Z-order curve through its station's values: rows near on it are near in every feature."""
    station = Window.partitionBy("station_id")
    bits = max(1, min(10, 60 // len(features)))
    cells = []
    for f in features:
        low, high = F.min(f).over(station), F.max(f).over(station)
        cells.append(F.floor(F.coalesce(F.try_divide(F.col(f) - low, high - low), F.lit(0.0)) * (2**bits - 1)).cast("bigint"))
    place = F.lit(0).cast("bigint")
    for bit in range(bits):
        for i, cell in enumerate(cells):
            place = place + F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("bigint")), bit * len(cells) + i)
    return place


def _gap(features: Sequence[str], low: str, high: str, other_low: str, other_high: str) -> Column:
    """Squared distance of two boxes, feature by feature in the order in which points are compared."""
    total = F.lit(0.0)
    for f in features:
        apart = F.greatest(F.lit(0.0), F.col(f"{other_low}{f}") - F.col(f"{high}{f}"), F.col(f"{low}{f}") - F.col(f"{other_high}{f}"))
        total = total + apart * apart
    return total


FOUND = "station_id string, Date date, row int, neighbour date, neighbour_row int, d2 double"


def _answers(left: pd.DataFrame, right: pd.DataFrame, features: Sequence[str], own: np.ndarray, k: int) -> pd.DataFrame:
    left_dates, rows, right_dates, others = left["Date"].to_numpy(), left["_row"].to_numpy(), right["o_Date"].to_numpy(), right["o__row"].to_numpy()
    found = _nearest(left[features].to_numpy(dtype=float), right[[f"o_{f}" for f in features]].to_numpy(dtype=float), own, k)
    out = [
        (left["station_id"].iat[0], left_dates[i], int(rows[i]), right_dates[j], int(others[j]), float(d))
        for i, near, d2 in found
        for j, d in zip(near, d2)
    ]
    return pd.DataFrame(out, columns=["station_id", "Date", "row", "neighbour", "neighbour_row", "d2"])


def blocks(minority: DataFrame, features: Sequence[str], block: int) -> DataFrame:
    """(station_id, Date, _row, features, _block): a station's rows cut along the curve, so that blocks are compact."""
    points = minority if "_row" in minority.columns else numbered(minority, features)
    points = points.select("station_id", "Date", "_row", *[F.col(f).cast("double").alias(f) for f in features])
    along = F.row_number().over(Window.partitionBy("station_id").orderBy("_curve", "_row"))
    known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(f) for f in features])
    return points.where(known).withColumn("_curve", curve(features)).withColumn("_block", ((along - 1) / block).cast("int")).drop("_curve")


def asked_elsewhere(points: DataFrame, inside: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """The rows of ``points`` that must also be compared with another block, once for each: ``_other``.

    A row has its ``k``-th distance from its own block. Another block can hold a nearer row, or one as
    near, only if its bounding box is not farther than that. Pairs of blocks whose boxes are farther
    apart than the largest such distance are dropped before rows are looked at.
    """
    reach = inside.groupBy("station_id", F.col("row").alias("_row")).agg(
        F.when(F.count("*") < k, float("inf")).otherwise(F.max("d2")).alias("_reach")
    )
    reaching = points.join(reach, ["station_id", "_row"], "left").fillna(float("inf"), ["_reach"])
    sides = [f(c).alias(f"{name}{c}") for c in features for f, name in ((F.min, "l_"), (F.max, "h_"))]
    boxes = reaching.groupBy("station_id", "_block").agg(F.max("_reach").alias("_farthest"), *sides)
    others = boxes.select("station_id", F.col("_block").alias("_other"), *[F.col(f"{s}{c}").alias(f"o{s}{c}") for c in features for s in ("l_", "h_")])
    near = (F.col("_block") != F.col("_other")) & (_gap(features, "l_", "h_", "ol_", "oh_") <= F.col("_farthest"))
    pairs = boxes.join(others, "station_id").where(near).drop(*[f"{s}{c}" for c in features for s in ("l_", "h_")], "_farthest")
    met = reaching.join(pairs, ["station_id", "_block"]).where(_gap(features, "", "", "ol_", "oh_") <= F.col("_reach"))
    return met.select("station_id", "Date", "_row", *features, "_block", "_other")


def neighbours(minority: DataFrame, features: Sequence[str], k: int = 5, block: int = 2048) -> DataFrame:
    """(station_id, Date, row, rank, neighbour, neighbour_row, distance): the ``k`` nearest rows within a station.

    Exact, with pruned blocks. A station's rows are cut into compact blocks. Every row is compared
    with its own block; with another one only if that block's bounding box is within the row's
    ``k``-th distance so far (``asked_elsewhere``), in a task of at most two blocks, and a row's answers
    are merged by distance and row. The result does not depend on the size of a block. Several rows
    of one day are told apart by ``row``. Rows with an unknown feature neither ask nor answer.
    """
    features = list(features)
    points = blocks(minority, features, block)

    def own_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row")
        return _answers(rows, rows.rename(columns=lambda c: f"o_{c}"), features, np.arange(len(rows)), k)

    def other_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["station_id", "Date", "row", "neighbour", "neighbour_row", "d2"])
        return _answers(left.sort_values("_row"), right.sort_values("o__row"), features, np.full(len(left), -1), k)

    def answered(rows: DataFrame) -> DataFrame:
        return rows.groupBy("station_id", "_block").applyInPandas(own_block, FOUND)

    sizes = minority.groupBy("station_id").count()
    if sizes.where(F.col("count") > block).isEmpty():  # every station is one block: nothing is left to compare
        near = answered(points)
    else:
        points = materialise(points, "points")
        inside = materialise(answered(points), "near")
        asked = materialise(asked_elsewhere(points, inside, features, k), "asked")
        wanted = asked.select("station_id", F.col("_block").alias("o__asks"), F.col("_other").alias("_block")).distinct()
        renamed = [F.col(c).alias(f"o_{c}") for c in ("station_id", "Date", "_row", *features)]
        offered = points.join(wanted, ["station_id", "_block"]).select(*renamed, "o__asks", F.col("_block").alias("o__answers"))
        across = (
            asked.groupBy("station_id", "_block", "_other")
            .cogroup(offered.groupBy("o_station_id", "o__asks", "o__answers"))
            .applyInPandas(other_block, FOUND)
        )
        near = inside.unionByName(across)
    rank = F.row_number().over(Window.partitionBy("station_id", "row").orderBy("d2", "neighbour_row"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "station_id", "Date", "row", "rank", "neighbour", "neighbour_row", F.sqrt("d2").alias("distance")
    )


def mutual_neighbours(near: DataFrame) -> DataFrame:
    """(station_id, Date, rank, neighbour, rank_back, distance) of pairs each of which is among the other's nearest, earlier row first."""
    back = near.select(
        "station_id", F.col("row").alias("neighbour_row"), F.col("neighbour_row").alias("row"), F.col("rank").alias("rank_back")
    )
    return near.join(back, ["station_id", "row", "neighbour_row"]).where(F.col("row") < F.col("neighbour_row")).select(
        "station_id", "Date", "rank", "neighbour", "rank_back", "distance"
    )


def minority_rows(train: DataFrame, target: str = "Target") -> DataFrame:
    """Rows of each station's smaller class, with the deficit to the larger one."""
    counts = train.groupBy("station_id").agg(
        F.count_if(F.col(target) == 0).alias("_n0"), F.count_if(F.col(target) == 1).alias("_n1")
    )
    smaller = counts.select(
        "station_id",
        F.when(F.col("_n1") <= F.col("_n0"), 1).otherwise(0).alias("_class"),
        F.abs(F.col("_n0") - F.col("_n1")).alias("_deficit"),
        F.least("_n0", "_n1").alias("_size"),
    )
    return train.join(smaller, "station_id").where(F.col(target) == F.col("_class")).drop("_class")


def synthetic_rows(train: DataFrame, features: Sequence[str], k: int = 5, seed: int = 42, target: str = "Target") -> DataFrame:
    """New minority rows on the segments between a row and one of its nearest neighbours.

    Each station gets exactly its deficit. Base rows take turns in a keyed random order; every
    random number depends on keys only, so a task run again after a loss gives the same rows.
    """
    features = list(features)
    minority = numbered(minority_rows(train, target), features)
    key = [F.lit(seed), F.col("station_id"), F.col("Date")]
    turn = F.row_number().over(Window.partitionBy("station_id").orderBy(F.xxhash64(*key), "Date", "_row"))
    copies = F.expr("_deficit div _size") + F.when(F.col("_turn") <= F.expr("_deficit % _size"), 1).otherwise(0)
    bases = (
        minority.withColumn("_turn", turn)
        .withColumn("_copies", copies.cast("int"))
        .where(F.col("_copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("station_id", "Date", "_row", "copy", target, *features)
    )
    # Up to k neighbours per row, so the array is bounded.
    near = (
        neighbours(minority, features, k)
        .groupBy("station_id", F.col("row").alias("_row"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour_row"))).alias("_near"))
    )
    other = minority.select(
        "station_id", F.col("_row").alias("_other"), F.col("Date").alias("_other_date"), *[F.col(f).alias(f"_{f}") for f in features]
    )
    draw = [F.lit(seed), F.col("station_id"), F.col("Date"), F.col("_row"), F.col("copy")]
    pick = F.floor(uniform(F.lit("pick"), *draw) * F.size("_near")).cast("int")
    step = uniform(F.lit("step"), *draw)
    return (
        bases.join(near, ["station_id", "_row"])
        .withColumns({"_other": F.get(F.col("_near")["neighbour_row"], pick), "u": step})
        .join(other, ["station_id", "_other"])
        .select(
            "station_id",
            F.col("Date").alias("base"),
            F.col("_other_date").alias("neighbour"),
            "copy",
            "u",
            target,
            *[(F.col(f) + F.col("u") * (F.col(f"_{f}") - F.col(f))).alias(f) for f in features],
        )
    )


def balance(train: DataFrame, features: Sequence[str], k: int = 5, seed: int = 42, target: str = "Target") -> DataFrame:
    """Training rows plus synthetic ones; both classes of every station are then equal in size.

    Not so where the smaller class has one row or none: there is no neighbour to move towards, and
    ``unbalanced`` names those stations.
    """
    columns = ["station_id", target, *[F.col(f).cast("double").alias(f) for f in features]]
    return train.select(*columns).unionByName(synthetic_rows(train, features, k, seed, target).select(*columns))


def unbalanced(train: DataFrame, target: str = "Target") -> DataFrame:
    """(station_id, n_rows, n_minority) of the stations that cannot be balanced."""
    ones = F.count_if(F.col(target) == 1)
    sizes = train.groupBy("station_id").agg(F.count("*").alias("n_rows"), F.least(ones, F.count("*") - ones).alias("n_minority"))
    return sizes.where((F.col("n_minority") < 2) & (F.col("n_rows") > 2 * F.col("n_minority")))
