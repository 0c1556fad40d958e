"""Classifier metrics from a (Target, prediction, score) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipstick.functions import numeric
from dipstick.session import materialise

BY = ("station_id",)


def confusion(scored: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """tn, fp, fn, tp in one partial aggregate."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return scored.groupBy(*by).agg(
        *[
            F.count_if((F.col("Target") == actual) & (F.col("prediction") == said)).alias(name)
            for name, (actual, said) in cells.items()
        ]
    )


def _f1(precision: Column, recall: Column) -> Column:
    return numeric.safe_ratio(2 * precision * recall, precision + recall)


def accuracy(scored: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    hit = (F.col("Target") == F.col("prediction")).cast("int")
    return scored.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def f1_score(scored: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """F1 of the positive class; 0 when it is never right."""
    tp, wrong = F.col("tp"), F.col("fp") + F.col("fn")
    return confusion(scored, by).select(*by, numeric.safe_ratio(2 * tp, 2 * tp + wrong).alias("f1_score"))


def classification_report(scored: DataFrame, by: Sequence[str] = BY, digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted rows."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    ratio = numeric.safe_ratio
    classes = confusion(scored, by).withColumns(
        {
            "p0": ratio(tn, tn + fn), "r0": ratio(tn, tn + fp), "n0": tn + fp,
            "p1": ratio(tp, tp + fp), "r1": ratio(tp, tp + fn), "n1": tp + fn,
        }
    )
    classes = classes.withColumns({f"f{i}": _f1(F.col(f"p{i}"), F.col(f"r{i}")) for i in (0, 1)})
    n0, n1 = F.col("n0"), F.col("n1")

    def macro(x: str) -> Column:
        return (F.col(f"{x}0") + F.col(f"{x}1")) / 2

    def weighted(x: str) -> Column:
        return ratio(F.col(f"{x}0") * n0 + F.col(f"{x}1") * n1, n0 + n1)

    hit = ratio(tn + tp, n0 + n1)
    rows = [
        ("No Refill", F.col("p0"), F.col("r0"), F.col("f0"), n0),
        ("Refill", F.col("p1"), F.col("r1"), F.col("f1"), n1),
        ("accuracy", hit, hit, hit, n0 + n1),
        ("macro avg", macro("p"), macro("r"), macro("f"), n0 + n1),
        ("weighted avg", weighted("p"), weighted("r"), weighted("f"), n0 + n1),
    ]
    names = ("precision", "recall", "f1_score")
    entries = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                *[numeric.half_even(v, digits).alias(n) for n, v in zip(names, (p, r, f))],
                support.alias("support"),
            )
            for label, p, r, f, support in rows
        ]
    )
    return classes.select(*by, F.inline(entries))


def _score_counts(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    return scored.groupBy(*by, "score").agg(
        F.count_if(F.col("Target") == 1).alias("pos"), F.count_if(F.col("Target") == 0).alias("neg")
    )


def cumulative_counts(scored: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per distinct score, positives and negatives at or above it, the totals, the next lower score's counts.

    Equal scores are one row before anything is ordered. Grouped curves are windows per group. One
    curve over everything has no group to partition by: its scores are range-partitioned, written,
    and each range is summed on its own with the ranges before it added, so no task holds them all.
    """
    counts = _score_counts(scored, by)
    if by:
        falling = Window.partitionBy(*by).orderBy(F.desc("score"))
        whole = Window.partitionBy(*by)
        return counts.withColumns(
            {
                "cum_pos": F.sum("pos").over(falling),
                "cum_neg": F.sum("neg").over(falling),
                "all_pos": F.sum("pos").over(whole),
                "all_neg": F.sum("neg").over(whole),
                "next": F.lead(F.struct("pos", "neg")).over(falling),
            }
        )
    ranged = counts.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "score-ranges")
    # One row per range; the ordering window below sees as many rows as there are partitions.
    sums = ranged.groupBy("part").agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        F.max_by(F.struct("pos", "neg"), "score").alias("_first"),
    )
    parts = Window.orderBy("part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        "part",
        F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum("_p").over(every).alias("all_pos"),
        F.sum("_n").over(every).alias("all_neg"),
        F.lead("_first").over(parts).alias("_after"),
    )
    inside = Window.partitionBy("part").orderBy(F.desc("score"))
    return (
        ranged.join(offsets, "part")
        .withColumns(
            {
                "cum_pos": F.sum("pos").over(inside) + F.col("_p0"),
                "cum_neg": F.sum("neg").over(inside) + F.col("_n0"),
                "next": F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("_after")),
            }
        )
        .drop("part", "_p0", "_n0", "_after")
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Area under the curve: ties count half. NULL when a class is absent."""
    c = cumulative_counts(scored, by)
    # Each negative beats none, ties with pos, loses to the positives above it.
    twice = F.col("neg") * (2 * F.col("cum_pos") - F.col("pos"))
    return c.groupBy(*by).agg(
        F.try_divide(F.sum(twice).cast("double"), 2.0 * F.first("all_pos") * F.first("all_neg")).alias("roc_auc")
    )


def roc_points(scored: DataFrame, by: Sequence[str] = BY, drop_collinear: bool = True, digits: int = 6) -> DataFrame:
    """(fpr, tpr) by falling threshold, starting at the origin (threshold NULL).

    Points inside a straight run of the curve, where the next step equals this one, are dropped.
    """
    c = cumulative_counts(scored, by)
    if drop_collinear:
        first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
        same_step = (F.col("next.pos") == F.col("pos")) & (F.col("next.neg") == F.col("neg"))
        c = c.where(first | F.col("next").isNull() | ~same_step)
    points = c.select(
        *by,
        F.col("score").alias("threshold"),
        numeric.half_even(numeric.safe_ratio(F.col("cum_neg"), F.col("all_neg"), None), digits).alias("fpr"),
        numeric.half_even(numeric.safe_ratio(F.col("cum_pos"), F.col("all_pos"), None), digits).alias("tpr"),
    )
    origin = scored.groupBy(*by).agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def metrics_record(scored: DataFrame, by: Sequence[str] = BY, digits: int = 4) -> DataFrame:
    """Accuracy, F1 and AUC of each group, rounded."""
    by = list(by)
    tp, errors = F.col("tp"), F.col("fp") + F.col("fn")
    rates = confusion(scored, by).select(
        *by,
        numeric.safe_ratio(F.col("tn") + tp, F.col("tn") + tp + errors).alias("accuracy"),
        numeric.safe_ratio(2 * tp, 2 * tp + errors).alias("f1_score"),
    )
    area = roc_auc(scored, by)
    joined = rates.join(area, by) if by else rates.withColumn("roc_auc", area.scalar())
    return joined.withColumns({m: numeric.half_even(F.col(m), digits) for m in ("accuracy", "f1_score", "roc_auc")})
