"""Series without the shape a rule expects: empty, short, constant, never refilled."""

import datetime as dt

import pytest
from helpers import column, ten_days
from pyspark.sql import functions as F

from dipstick.operators import features, forecast, metrics, model, profile, smote, stats, timeline
from dipstick.operators.rollforward import roll_forward

LEDGER = "station_id string, Date date, Opening_Stock bigint, Total_Sold bigint, Closing_Stock bigint, Target int"


def days(spark, rows):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame(
        [("s", start + dt.timedelta(days=i), *r) for i, r in enumerate(rows)], LEDGER
    )


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], LEDGER)
    f = features.normalise(empty)
    assert f.count() == 0 and "Days_Since_Refill" in f.columns
    assert forecast.predict_refill(f).count() == 0
    assert roll_forward(ten_days(spark).limit(0)).count() == 0
    assert stats.sales_by_weekday(empty).count() == 0


def test_one_row(spark):
    f = features.normalise(days(spark, [(12000, 4000, 8000, 0)]))
    r = f.first()
    assert (r.Lag1_Total_Sold, r.Lag2_Total_Sold, r.Lag1_Closing, r.Days_Since_Refill) == (4000, 4000, 12000, 0)
    p = forecast.predict_refill(f).first()
    # Weekdays never seen take the station's mean.
    assert p.triggered and p.days_remaining == 2


def test_one_tank_without_station_column(spark):
    f = features.normalise(days(spark, [(12000, 4000, 8000, 0)]).drop("station_id"))
    assert f.first().station_id == "tank"


def test_total_and_closing_are_derived(spark):
    raw = spark.createDataFrame(
        [("01/02/2024", "100", "7", "50", "Yes"), ("junk", "1", "1", "1", "No")],
        "DATE string, Opening_Stock string, MS_Sold string, HSD1_Sold string, Refill string",
    )
    r = features.normalise(raw).first()
    assert (r.Date, r.Total_Sold, r.Closing_Stock, r.Target) == (dt.date(2024, 2, 1), 57, 43, 1)


def test_never_refilled(spark):
    f = features.normalise(days(spark, [(12000, 10, 11990, 0), (11990, 10, 11980, 0)]))
    assert forecast.last_state(f).first().days_since == 0
    p = forecast.predict_refill(f).first()
    # Thirty days at 10 litres leave 11,680: no trigger, so the rough estimate counts from the next day.
    assert not p.triggered and p.days_remaining == 1168
    assert p.refill_date == dt.date(2024, 1, 3) + dt.timedelta(days=1168)


def test_nothing_sold(spark):
    f = features.normalise(days(spark, [(9000, 0, 9000, 0), (9000, 0, 9000, 0)]))
    p = forecast.predict_refill(f).first()
    assert not p.triggered and p.days_remaining == 3
    assert {r.Sales_Trend for r in f.collect()} == {None}


def test_zero_opening(spark):
    assert features.normalise(days(spark, [(0, 0, 0, 1)])).first().Stock_Ratio == 0


def test_constant_column_has_no_correlation(spark):
    df = days(spark, [(1, 1, 5, 0), (1, 2, 5, 1), (1, 3, 5, 0)])
    got = {r.feature: r.correlation for r in stats.correlations(df, ["Opening_Stock", "Total_Sold"]).collect()}
    assert got["Opening_Stock"] is None and got["Total_Sold"] == 0


def test_correlation_uses_complete_pairs(spark):
    df = spark.createDataFrame(
        [("s", 1.0, 1.0), ("s", 2.0, 2.0), ("s", None, 30.0), ("s", 4.0, 4.0)], "station_id string, x double, Target double"
    )
    assert stats.correlations(df, ["x"]).first().correlation == 1.0


def test_empty_first_group_keeps_absent_columns_out(spark):
    df = days(spark, [(12000, 4000, 8000, 0)]).drop("Total_Sold", "Target")
    f = features.normalise(df)
    assert "Rolling_7d_Sales" not in f.columns and "Days_Since_Refill" not in f.columns


def test_scores_of_one_class(spark):
    scored = spark.createDataFrame([("s", 1, 1, 0.9), ("s", 1, 0, 0.2)], "station_id string, Target int, prediction int, score double")
    assert metrics.roc_auc(scored).first().roc_auc is None
    r = metrics.classification_report(scored).where("label = 'No Refill'").first()
    assert (r.precision, r.recall, r.support) == (0, 0, 0)


@pytest.mark.parametrize("minority", [0, 1, 2, 7])
def test_balancing(spark, minority):
    rows = [(100 * i, i, 50 * i, int(i < minority)) for i in range(20)]
    df = days(spark, rows)
    made = smote.synthetic_rows(df, ["Opening_Stock", "Total_Sold"])
    # A class of one has no neighbour to move towards, and an empty one no row to start from.
    assert made.count() == (20 - 2 * minority if minority > 1 else 0)


def test_neighbours_by_brute_force(spark):
    import random

    rng = random.Random(3)
    points = [(rng.randrange(6), rng.randrange(6)) for _ in range(40)]
    df = days(spark, [(a, b, 0, 1) for a, b in points])
    got = {}
    for r in smote.neighbours(df, ["Opening_Stock", "Total_Sold"], 3).collect():
        got.setdefault(r.Date, {})[r["rank"]] = r.neighbour
    start = dt.date(2024, 1, 1)
    for i, (a, b) in enumerate(points):
        near = sorted((j for j in range(40) if j != i), key=lambda j: ((points[j][0] - a) ** 2 + (points[j][1] - b) ** 2, j))
        assert [got[start + dt.timedelta(days=i)][k] for k in (1, 2, 3)] == [start + dt.timedelta(days=j) for j in near[:3]]


def test_shared_multipliers(spark):
    """One table for all stations, and months without an entry count as 1."""
    f = features.normalise(roll_forward(ten_days(spark)))
    half = spark.createDataFrame([(1, 0.5), (99, 7.0)], "Month int, multiplier double")
    walked = forecast.walk(forecast.seeded_state(f, half), forecast.DRAWDOWN)
    assert column(walked, "Est_Sold", "step")[0] == 1500
    none = spark.createDataFrame([], "Month int, multiplier double")
    assert column(forecast.walk(forecast.seeded_state(f, none), forecast.DRAWDOWN), "Est_Sold", "step")[0] == 3000


def test_class_weights(spark):
    df = days(spark, [(1, 1, 1, 1), (1, 1, 1, 0), (1, 1, 1, 0), (1, 1, 1, 0)])
    assert {r.Target: r.weight for r in model.class_weights(df).collect()} == {1: 2.0, 0: 4 / 6}
    assert {r.Target: r.weight for r in model.with_class_weights(df).collect()} == {1: 2.0, 0: 4 / 6}


def test_split_of_a_short_series(spark):
    df = days(spark, [(1, 1, 1, 0)] * 4)
    assert column(timeline.chronological_split(df), "split") == ["train"] * 3 + ["test"]


def test_profile_of_one_weekday(spark):
    df = days(spark, [(9, 100, 9, 0)]).withColumn("DayOfWeek", F.weekday("Date"))
    p = {r.DayOfWeek: r for r in profile.weekday_profile(df).collect()}
    assert len(p) == 7 and p[0].ewm_avg == 100 and p[3].blended == 100 and p[3].MS_Sold == 0.12


def test_weekday_without_rows(spark):
    """Working days only: the weekend gets 0 and stays out of the mean of means."""
    df = ten_days(spark).where(F.weekday("Date") < 5)
    got = stats.sales_by_weekday(df).orderBy("DayOfWeek").collect()
    assert [r.avg_sold for r in got] == [3950, 5050, 4600, 3000, 6000, 0, 0]
    assert got[0].mean_of_means == 4520 and [r.DayOfWeek for r in got if r.is_best] == [4]


@pytest.mark.parametrize("block", [3, 7, 64])
def test_neighbours_do_not_depend_on_blocks(spark, block):
    df = days(spark, [(i * 37 % 11, i * 53 % 7, 0, 1) for i in range(30)])
    features = ["Opening_Stock", "Total_Sold"]
    whole = smote.neighbours(df, features, 4).collect()
    assert len(whole) == 30 * 4
    assert sorted(smote.neighbours(df, features, 4, block).collect()) == sorted(whole)


def test_balancing_with_rows_of_one_day(spark):
    df = days(spark, [(100 * i, i, 50 * i, int(i < 6)) for i in range(20)]).withColumn("Date", F.expr("date_add(date'2024-01-01', int(dayofmonth(Date) div 4))"))
    assert smote.synthetic_rows(df, ["Opening_Stock", "Total_Sold"]).count() == 8
    counts = {r.Target: r["count"] for r in smote.balance(df, ["Opening_Stock", "Total_Sold"]).groupBy("Target").count().collect()}
    assert counts == {0: 14, 1: 14}


def test_stations_that_cannot_be_balanced_are_named(spark):
    df = days(spark, [(100 * i, i, 50 * i, int(i < 1)) for i in range(20)])
    assert [tuple(r)[1:] for r in smote.unbalanced(df).collect()] == [(20, 1)]
    assert smote.unbalanced(days(spark, [(100 * i, i, 0, i % 2) for i in range(20)])).count() == 0
