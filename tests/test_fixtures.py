"""Hand-sized inputs with expected values written out."""

import datetime as dt

import pytest
from helpers import SOLD, column, ten_days
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dipstick.config import PREP, SERVE
from dipstick.functions import calendar, numeric, series, text
from dipstick.operators import clean, features, forecast, profile, stats, timeline
from dipstick.operators.rollforward import roll_forward
from dipstick.plans import reports
from dipstick.sources import readers, sinks

D = dt.date


@pytest.fixture(scope="module")
def ledger(spark):
    return roll_forward(ten_days(spark)).withColumn(
        "Refill_Required", F.when(F.col("Target") == 1, "Yes").otherwise("No")
    )


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr).first()[0]


def test_roll_forward(ledger):
    assert column(ledger, "Opening_Stock") == [12000, 8000, 3000, 12000, 9000, 3000, 12000, 7800, 3900, 12000]
    assert column(ledger, "Closing_Stock") == [8000, 3000, 0, 9000, 3000, 0, 7800, 3900, 0, 7300]
    assert column(ledger, "Target") == [0, 0, 1, 0, 0, 1, 0, 0, 1, 0]


def test_roll_forward_crosses_months_and_stations(spark):
    import random

    rng = random.Random(7)
    rows, expected = [], {}
    for station, days in (("a", 400), ("b", 1), ("c", 95)):
        stock = 12000
        for i in range(days):
            day, sold = D(2023, 11, 20) + dt.timedelta(days=2 * i), rng.randrange(0, 14000)
            rows.append((station, day, sold))
            closing = max(0, stock - sold)
            expected[station, day] = (stock, closing, int(closing < 2000))
            stock = 12000 if closing < 2000 else closing
    df = spark.createDataFrame(rows, "station_id string, Date date, Total_Sold bigint")
    got = {(r.station_id, r.Date): (r.Opening_Stock, r.Closing_Stock, r.Target) for r in roll_forward(df).collect()}
    assert got == expected


def test_serving_features(ledger):
    f = features.normalise(ledger)
    assert column(f, "Rolling_7d_Sales") == [4000, 4500, 4500, 4125, 4500, 4550, 4500, 4485.71, 4500, 4528.57]
    assert column(f, "Lag1_Total_Sold") == [4520, *SOLD[:-1]]
    assert column(f, "Lag2_Total_Sold") == [4520, 4520, *SOLD[:-2]]
    assert column(f, "Lag1_Closing") == [8270, 8000, 3000, 0, 9000, 3000, 0, 7800, 3900, 0]
    assert column(f, "Stock_Ratio") == [0.6667, 0.375, 0, 0.75, 0.3333, 0, 0.65, 0.5, 0, 0.6083]
    assert column(f, "Days_Since_Refill") == [0, 1, 2, 0, 1, 2, 0, 1, 2, 0]
    assert column(timeline.days_since_refill_islands(ledger), "Days_Since_Refill") == [0, 1, 2, 0, 1, 2, 0, 1, 2, 0]
    assert column(f, "DOW_Avg_Sales") == pytest.approx(
        [4000, 5000, 4500, 3000, 6000, 4800, 4200, 3977.777778, 5022.222222, 4544.444444], abs=1e-6
    )
    assert column(f, "Sales_Trend") == [0.885, 0.9956, 0.9956, 0.9126, 0.9956, 1.0066, 0.9956, 0.9924, 0.9956, 1.0019]
    assert column(f, "Prev_Closing")[:2] == [0, 8000]


def test_prepared_table(ledger):
    named = ledger.withColumns({"Day": F.date_format("Date", "EEEE"), "Date": F.date_format("Date", "dd-MM-yyyy")})
    p = features.prepare(named)
    assert column(p, "Stock_Ratio") == [0.6667, 0.25, 0, 0.75, 0.25, 0, 0.65, 0.325, 0, 0.6083]
    assert column(p, "Prev_Closing")[:2] == [12000, 8000]
    assert column(p, "Day_Num") == [0, 1, 2, 3, 4, 5, 6, 0, 1, 2]


def test_summaries(ledger):
    r = stats.describe(ledger, ["Total_Sold"]).first()
    assert (r["q25"], r["q75"], r["std"], r["mean"]) == (4050, 4950, 812.13, 4520)
    b = profile.winsor_bounds(ledger, ["Total_Sold"]).first()
    assert (b.Total_Sold_lo, b.Total_Sold_hi) == (3081, 5919)
    assert column(stats.histogram(ledger, "Total_Sold", 4), "n", "bin") == [1, 3, 5, 1]


def test_blend_and_prediction(ledger):
    f = features.normalise(ledger)
    blend = column(profile.weekday_profile(f), "blended", "DayOfWeek")
    assert blend == pytest.approx([3961.111111, 5038.888889, 4577.777778, 3000, 6000, 4800, 4200], abs=1e-6)
    p = forecast.predict_refill(f).first()
    assert (p.refill_date, p.days_remaining, p.closing_stock, p.triggered) == (D(2024, 1, 12), 2, 7300, True)
    walked = forecast.walk(forecast.seeded_state(f), forecast.PREDICT).orderBy("step").collect()
    assert [(w.Date, w.Est_Sold, w.Closing_Stock) for w in walked] == [
        (D(2024, 1, 11), 3000, 4300), (D(2024, 1, 12), 4300, 0)
    ]


def test_first_trigger_is_the_same_in_both_walks(ledger):
    state = forecast.seeded_state(features.normalise(ledger))
    first = forecast.walk(state, forecast.SIMULATE).where("triggered").collect()
    assert [r.Date for r in first] == [forecast.decide(forecast.scenarios(state, [0.0])).first().refill_date]


def test_flat_demand_under_pressure(spark):
    days = [("s", D(2024, 1, 1) + dt.timedelta(days=i), 4500, 7000, 0) for i in range(14)]
    df = spark.createDataFrame(days, "station_id string, Date date, Total_Sold bigint, Closing_Stock bigint, Target int")
    state = forecast.seeded_state(df.withColumn("DayOfWeek", F.weekday("Date")))
    assert column(forecast.walk(state, forecast.Walk(4)), "Closing_Stock", "step") == [2500, 625, 157, 40]


def test_weighted_mean(spark):
    values = F.array(*[F.lit(float(v)) for v in (1, 5, 2, 8)])
    assert one(spark, series.ewm(values, SERVE.alpha)) == pytest.approx(3.266118, abs=1e-6)
    flat = F.array_repeat(F.lit(0.1), 200)
    assert one(spark, series.ewm(flat, SERVE.alpha)) == 0.1


def test_weighted_mean_carries_across_blocks(spark):
    """The running sum restarts every few rows here and must still equal the plain recursion."""
    xs = [(7 * i * i) % 97 + 1.0 for i in range(60)]
    rows = [("s", D(2024, 1, 1) + dt.timedelta(days=7 * i), 0, x) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "station_id string, Date date, DayOfWeek int, x double")
    y, expected = None, []
    for x in xs:
        y = x if y is None else SERVE.alpha * x + (1 - SERVE.alpha) * y
        expected.append(y)
    whole = column(timeline.weekday_ewm(df, "x", SERVE.alpha, "y"), "y")
    assert whole == pytest.approx(expected, rel=1e-12)
    for block in (1, 2, 30):  # all earlier blocks are carried, however short
        cut = column(timeline.weekday_ewm(df, "x", SERVE.alpha, "y", block=block), "y")
        assert cut == pytest.approx(expected, rel=1e-12)


def test_rows_of_one_day_follow_each_other(spark):
    days = [D(2024, 1, 1), D(2024, 1, 8), D(2024, 1, 8)]
    df = spark.createDataFrame([("s", d, 0, x) for d, x in zip(days, (1000.0, 2000.0, 2000.0))], "station_id string, Date date, DayOfWeek int, x double")
    assert sorted(column(timeline.weekday_ewm(df, "x", 2 / 9, "y"), "y")) == pytest.approx([1000, 1222.22, 1395.06], abs=0.01)
    flags = spark.createDataFrame([("s", D(2024, 1, 1 + i // 2), 0) for i in range(4)], "station_id string, Date date, Target int")
    for count in (timeline.days_since_refill, timeline.days_since_refill_islands):
        assert sorted(column(count(flags), "Days_Since_Refill")) == [0, 1, 2, 3]


def test_weighted_mean_starts_at_the_first_known_value(spark):
    xs = [None, 2000.0, 3000.0, None]
    df = spark.createDataFrame([("s", D(2024, 1, 1 + 7 * i), 0, x) for i, x in enumerate(xs)], "station_id string, Date date, DayOfWeek int, x double")
    assert column(timeline.weekday_ewm(df, "x", 2 / 9, "y"), "y") == [None, pytest.approx(2000), pytest.approx(2222.2222), pytest.approx(2222.2222)]


def test_date_spellings(spark):
    spelled = [
        "05/01/24", "2024-01-05T00:00:00", "2024-01-05T00:00:00.000Z", "2024-01-05 00:00:00.000", "05-Jan-2024", "5 January 2024", "Jan 5, 2024",
        "05/01/2024 10:30", "2024.01.05", "05.01.2024", "20240105", "January 5,2024", "5 Jan 2024",
    ]
    df = spark.createDataFrame([(t,) for t in [*spelled, "soon", "", None, "2024-13-40"]], "Date string")
    assert {r.Date for r in clean.parse_dates(df).collect()} == {D(2024, 1, 5)} and clean.parse_dates(df).count() == len(spelled)
    assert {(r.value, r.n) for r in clean.unreadable_dates(df).collect()} == {("soon", 1), ("2024-13-40", 1)}


def test_station_without_sales_leaves_the_others(spark):
    rows = [(s, D(2024, m, 1), 0.0 if s == "idle" else 100.0 * m) for s in ("idle", "busy") for m in (1, 2, 3)]
    found = profile.monthly_multipliers(spark.createDataFrame(rows, "station_id string, Date date, Total_Sold double"), cap=False)
    assert {(r.station_id, r.Month): r.multiplier for r in found.collect()} == {
        **{("idle", m): 1.0 for m in (1, 2, 3)}, ("busy", 1): 0.5, ("busy", 2): 1.0, ("busy", 3): 1.5,
    }


@pytest.mark.parametrize("span", [1, 1.2, 8, 1000])
def test_weighted_mean_for_other_spans(spark, span):
    alpha = 2 / (span + 1)
    xs = [(11 * i * i) % 89 + 1.0 for i in range(700)]
    rows = [("s", D(2000, 1, 3) + dt.timedelta(days=7 * i), 0, x) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "station_id string, Date date, DayOfWeek int, x double")
    y, expected = None, []
    for x in xs:
        y = x if y is None else alpha * x + (1 - alpha) * y
        expected.append(y)
    assert column(timeline.weekday_ewm(df, "x", alpha, "y"), "y") == pytest.approx(expected, rel=1e-11)


@pytest.mark.parametrize(
    "written, expected",
    [
        ("2024-01-05", D(2024, 1, 5)), ("05/01/2024", D(2024, 1, 5)), ("5 Jan 2024", D(2024, 1, 5)),
        ("2024/01/05", D(2024, 1, 5)), ("05-01-24", D(2024, 1, 5)), ("01/13/2024", D(2024, 1, 13)),
        ("13-01-2024", D(2024, 1, 13)), ("2024-01-05 00:00:00", D(2024, 1, 5)), (" 2024-1-5 ", D(2024, 1, 5)),
        ("junk", None), ("30/02/2024", None), ("31/04/2024", None), ("13/13/2024", None), ("", None), (None, None),
    ],
)
def test_lenient_dates(spark, written, expected):
    assert one(spark, calendar.parse_date(F.lit(written).cast("string"))) == expected


def test_strict_date_raises(spark):
    df = spark.createDataFrame([("2024-01-05",)], "Date string")
    with pytest.raises(PySparkException):
        clean.parse_dates_strict(df).collect()


@pytest.mark.parametrize(
    "written, expected",
    [(" 12 ", 12), ("1e3", 1000), ("-4.5", -4.5), (".5", 0.5), ("1,200", 0), ("12d", 0), ("", 0), ("0x10", 0),
     ("1_0", 0), ("inf", 0), ("nan", 0), ("1e999", 0), (None, 0)],
)
def test_numbers(spark, written, expected):
    assert one(spark, numeric.to_number(F.lit(written).cast("string"))) == expected


def test_labels(spark):
    df = spark.createDataFrame([(v,) for v in ("Yes", "YES", "1", "No", "NO", "0", "yes", None)], "v string")
    assert [r[0] for r in df.select(text.refill_flag(F.col("v"))).collect()] == [1, 1, 1, 0, 0, 0, 0, 0]
    assert one(spark, text.says_yes(F.lit(" yes ")))


def test_half_even(spark):
    assert [one(spark, numeric.half_even(F.lit(x), 0)) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, text.litres(F.lit(1234.5))) == "1,234 L"
    assert one(spark, text.parse_litres(F.lit("1,234 L"))) == 1234


def test_describe_with_gap(spark):
    df = spark.createDataFrame([("s", v) for v in (1, 2, 3, 10, None)], "station_id string, v int")
    r = stats.describe(df, ["v"]).first()
    assert (r["count"], r["mean"], r["std"], r["q25"], r["q50"], r["q75"]) == (4, 4, 4.08, 1.75, 2.5, 4.75)


def test_last_bin_is_closed(spark):
    df = spark.createDataFrame([("s", v) for v in (1, 2, 3, 4, 5)], "station_id string, v int")
    assert column(stats.histogram(df, "v", 4), "n", "bin") == [1, 1, 1, 2]
    flat = spark.createDataFrame([("s", 3)] * 4, "station_id string, v int")
    assert column(stats.histogram(flat, "v", 4), "n", "bin") == [0, 0, 4, 0]


def _sheet(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def test_sheets(spark, tmp_path):
    day = [f"2024-01-{i:02d}" for i in range(1, 20)]
    book = str(tmp_path / "book.xlsx")
    a = [(d, "1") for d in day[:6]]
    b = [(day[0], "1", "x"), *[(d, "2", "y") for d in day[6:11]], (day[6], "2", "y")]
    c = [(d, "3") for d in day[11:16]]
    sinks.write_csv(_sheet(spark, a, (" Date", "Total_Sold")).coalesce(1), f"{book}/a.csv")
    sinks.write_csv(_sheet(spark, b, ("Dates", "Total_Sold", "Note")).coalesce(1), f"{book}/b.csv")
    sinks.write_csv(_sheet(spark, c, ("Date", "Total_Sold")).coalesce(1), f"{book}/c.csv")
    both = readers.read_sheets(spark, book)
    # Six rows of a, six distinct of b; the row equal but for its note stays, c is too small.
    assert both.count() == 12 and set(both.columns) == {"Date", "Total_Sold", "Note"}
    assert both.where("Date = '2024-01-01'").count() == 2

    single = str(tmp_path / "single.xlsx")
    sinks.write_csv(_sheet(spark, a + a, ("Date", "Total_Sold")), f"{single}/only.csv")
    assert readers.read_sheets(spark, single).count() == 12

    tiny = str(tmp_path / "tiny.xlsx")
    sinks.write_csv(_sheet(spark, c[:2], ("Date", "Total_Sold")), f"{tiny}/1.csv")
    sinks.write_csv(_sheet(spark, c[2:], ("Date", "Total_Sold")), f"{tiny}/2.csv")
    assert readers.read_source(spark, tiny).count() == 2


def test_sheet_names_with_odd_characters(spark, tmp_path):
    book = str(tmp_path / "a b+c%20.xlsx")
    rows = [(f"2024-01-{i:02d}", str(i)) for i in range(1, 9)]
    for name in ("x y.csv", "p+q.csv"):
        sinks.write_csv(_sheet(spark, [(*r, name) for r in rows], ("Date", "Total_Sold", "mark")), f"{book}/{name}")
    assert readers.list_sheets(spark, book) == ["p+q.csv", "x y.csv"]
    scanned = readers.scan_sheets(spark, book)
    assert {(r["_sheet"], r.mark) for r in scanned.collect()} == {("p+q.csv",) * 2, ("x y.csv",) * 2}
    assert readers.read_sheets(spark, book).count() == 16


def test_source_choice(spark, tmp_path):
    rows = [("2024-01-01", "1"), ("2024-01-02", "2")]
    paths = [str(tmp_path / n) for n in ("small", "first", "second")]
    for path, part, mark in zip(paths, (rows[:1], rows, rows), "sab"):
        sinks.write_csv(_sheet(spark, [(*r, mark) for r in part], ("Date", "Total_Sold", "mark")), path)
    best = readers.largest_source(spark, [str(tmp_path / "absent"), *paths])
    assert {r.mark for r in best.collect()} == {"a"}
    with pytest.raises(ValueError):
        readers.largest_source(spark, [str(tmp_path / "absent")])


@pytest.mark.parametrize(
    "closing, label, serve, prep", [(500, "No", 500, 500), (0, "No", 3000, 0), (900, "Yes", 12000, 12000)]
)
def test_seed_stock(spark, closing, label, serve, prep):
    df = spark.createDataFrame(
        [("s", D(2024, 1, 1), 100, closing, label)],
        "station_id string, Date date, Total_Sold bigint, Closing_Stock bigint, Refill_Required string",
    )
    assert forecast.last_state(df, SERVE).first().seed_stock == serve
    assert forecast.last_state(df, PREP).first().seed_stock == prep


def test_padded_label_fills_the_tank_but_is_no_refill_row(spark):
    rows = [("s", D(2024, 1, 1) + dt.timedelta(days=i), 100, 900, label) for i, label in enumerate(("YES", "No", " yes "))]
    df = spark.createDataFrame(
        rows, "station_id string, Date date, Total_Sold bigint, Closing_Stock bigint, Refill_Required string"
    )
    state = forecast.last_state(df).first()
    assert (state.seed_stock, state.days_since) == (12000, 2)


@pytest.mark.parametrize("label, stock", [("Yes", 12000), ("No", 3000)])
def test_last_closing_of_a_ledger_without_closing_stock(spark, label, stock):
    """After a refill day the lag of the closing stock starts from the full tank as well."""
    df = spark.createDataFrame([("s", D(2024, 1, 1), 100, label)], "station_id string, Date date, Total_Sold bigint, Refill_Required string")
    state = forecast.last_state(df, SERVE).first()
    assert (state.seed_stock, state.last_closing) == (stock, stock)


def test_report_rows(ledger):
    f = features.normalise(ledger)
    walked = forecast.walk(forecast.seeded_state(f), forecast.SIMULATE)
    table = reports.simulation_table(walked).orderBy("Date").collect()
    assert len(table) == 15 and table[0].Opening_Stock == "7,300 L" and table[1].Refill_Triggered
    assert sum(r.Refill_Triggered for r in table) == 1
    shown = reports.summary(forecast.predict_refill(f)).first()
    assert shown.refill_date_long == "12 January 2024 (Friday)" and shown.days_band == "danger"
