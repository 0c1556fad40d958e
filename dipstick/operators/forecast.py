"""Walking a station's stock forward day by day."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipstick.config import PRODUCTS, RUPEES_PER_LITRE, SERVE, Tank
from dipstick.functions import calendar, numeric, text
from dipstick.operators import profile, timeline

_ROW = (
    "step int, Date date, DayOfWeek int, Opening_Stock double, Est_Sold double, Closing_Stock double, "
    "triggered boolean, lag1 double, lag2 double, lag1_close double, rolling double, days_since int"
)


@dataclass(frozen=True)
class Walk:
    """How a walk-forward behaves."""

    days: int
    stop_at_trigger: bool = False  # no rows after the first trigger
    reset_at_trigger: bool = False  # refill once, on the first trigger; later ones are not marked
    scenario_last: bool = False  # blend * multiplier * factor, not blend * factor * multiplier


PREDICT = Walk(days=30, stop_at_trigger=True)
SIMULATE = Walk(days=15, reset_at_trigger=True, scenario_last=True)
DRAWDOWN = Walk(days=8)


def last_state(df: DataFrame, cfg: Tank = SERVE) -> DataFrame:
    """One row per station: last day, seed stock, last lags, recent sales, days since refill.

    Everything comes from the last seven rows and two aggregates; the history is not collected.
    A ledger without closing stock starts from ``cfg.unknown_closing``; its last closing is then the seed stock itself.
    """
    known = "Closing_Stock" in df.columns
    if not known:
        df = df.withColumn("Closing_Stock", F.lit(cfg.unknown_closing))
    # The seed trims the label, the count of days since a refill does not.
    if "Refill_Required" in df.columns:
        full, refilled = text.says_yes(F.col("Refill_Required")), text.reads_yes(F.col("Refill_Required"))
    else:
        full = refilled = F.col("Target") == 1
    numbered = df.select(
        "station_id", "Date", "Total_Sold", "Closing_Stock",
        full.alias("_full"), refilled.alias("_refilled"),
    ).withColumn("_back", F.row_number().over(timeline.latest_first()))
    recent = F.sort_array(
        F.collect_list(F.when(F.col("_back") <= 7, F.struct("Date", F.col("Total_Sold").cast("double").alias("x"))))
    )
    state = numbered.groupBy("station_id").agg(
        F.max("Date").alias("last_date"),
        F.max_by("Closing_Stock", "Date").cast("double").alias("last_closing"),
        F.max_by("_full", "Date").alias("_full"),
        recent["x"].alias("recent_sales"),
        # Rows after the last refill row; 0 when there was none.
        F.coalesce(F.min(F.when(F.col("_refilled"), F.col("_back"))) - 1, F.lit(0)).alias("days_since"),
        F.avg("Total_Sold").alias("mean_sold"),
    )
    return state.select(
        "station_id", "last_date", seed_stock(cfg).alias("seed_stock"),
        (F.col("last_closing") if known else seed_stock(cfg)).alias("last_closing"), "recent_sales",
        F.element_at("recent_sales", -1).alias("lag1"),
        F.coalesce(F.try_element_at("recent_sales", F.lit(-2)), F.element_at("recent_sales", -1)).alias("lag2"),
        "days_since", "mean_sold",
    )


def seed_stock(cfg: Tank) -> Column:
    """Full after a refill day, else the last closing; an empty tank per ``cfg.empty_seed``."""
    closing = F.coalesce(F.col("last_closing"), F.lit(0.0))
    if cfg.empty_seed is not None:
        closing = F.when(closing == 0, F.lit(float(cfg.empty_seed))).otherwise(closing)
    return F.when(F.col("_full"), F.lit(float(cfg.capacity))).otherwise(closing)


def with_profile(state: DataFrame, weekdays: DataFrame, multipliers: DataFrame | None = None) -> DataFrame:
    """Attach the weekday blend and the month multipliers as maps of at most 7 and 12 entries."""
    per_day = weekdays.groupBy("station_id").agg(
        F.map_from_entries(F.collect_list(F.struct("DayOfWeek", "blended"))).alias("blend")
    )
    return with_multipliers(state.join(per_day, "station_id"), multipliers)


def with_multipliers(df: DataFrame, multipliers: DataFrame | None = None) -> DataFrame:
    """Add ``by_month``, the month multipliers as a map.

    Multipliers per station join on the station. A table without a station column is one shared
    set of at most twelve rows, checked by its keys being months; a month listed twice is an error.
    """
    none = F.create_map().cast("map<int,double>")
    if multipliers is None:
        return df.withColumn("by_month", none)
    entries = F.map_from_entries(F.collect_list(F.struct("Month", "multiplier")))
    months = multipliers.where(F.col("Month").between(1, 12))
    if "station_id" in multipliers.columns:
        per_month = months.groupBy("station_id").agg(entries.alias("by_month"))
        return df.join(per_month, "station_id", "left").withColumn("by_month", F.coalesce("by_month", none))
    shared = months.agg(entries.alias("by_month"))
    return df.withColumn("by_month", F.coalesce(shared.scalar(), none))


def pressure_cap(demand: Column, stock: Column, cfg: Tank = SERVE) -> Column:
    """Whole litres sold of a demand: less while stock is under pressure, never more than there is."""
    held = demand * F.least(F.lit(1.0), stock / F.lit(cfg.pressure))
    return F.least(numeric.truncate(held).cast("double"), stock)


def month_multiplier(by_month: Column, date: Column) -> Column:
    """The month's multiplier; 1 for a month that is not listed."""
    return F.coalesce(by_month[F.month(date)], F.lit(1.0))


def walk(seeded: DataFrame, how: Walk, cfg: Tank = SERVE, keep: Sequence[str] = ()) -> DataFrame:
    """Fold each station's state over the coming days and return one row per day.

    The state is (stock, lags, last seven sales, done); the horizon is at most 30, so a station
    costs one short array and no shuffle.
    """
    factor = F.col("factor") if "factor" in seeded.columns else F.lit(1.0)

    def step(s: Column, i: Column) -> Column:
        date = F.date_add(F.col("last_date"), i + 1)
        dow = F.weekday(date)
        base = F.coalesce(F.col("blend")[dow], F.col("mean_sold"))
        mult = month_multiplier(F.col("by_month"), date)
        demand = base * mult * factor if how.scenario_last else base * factor * mult
        sold = pressure_cap(demand, s["stock"], cfg)
        # Bind the estimate once; every later use would otherwise evaluate it again.
        return F.transform(F.array(sold), lambda est: after(s, i, date, dow, est))[0]

    def after(s: Column, i: Column, date: Column, dow: Column, est: Column) -> Column:
        closing = F.greatest(F.lit(0.0), s["stock"] - est)
        low = closing < F.lit(float(cfg.threshold))
        trigger = low & ~s["done"] if how.reset_at_trigger else low
        row = F.struct(
            i.alias("step"), date.alias("Date"), dow.alias("DayOfWeek"),
            s["stock"].alias("Opening_Stock"), est.alias("Est_Sold"), closing.alias("Closing_Stock"),
            trigger.alias("triggered"), s["lag1"].alias("lag1"), s["lag2"].alias("lag2"),
            s["lag1_close"].alias("lag1_close"),
            (F.aggregate(s["recent"], F.lit(0.0), lambda a, x: a + x) / F.size(s["recent"])).alias("rolling"),
            (s["days_since"] + 1).alias("days_since"),
        )
        stock = F.when(trigger, F.lit(float(cfg.capacity))).otherwise(closing) if how.reset_at_trigger else closing
        longer = F.concat(s["recent"], F.array(est))
        moved = F.struct(
            stock.alias("stock"), est.alias("lag1"), s["lag1"].alias("lag2"), closing.alias("lag1_close"),
            F.slice(longer, F.greatest(F.lit(1), F.size(longer) - 6), F.lit(7)).alias("recent"),
            (s["days_since"] + 1).alias("days_since"),
            (s["done"] | low).alias("done"),
            F.concat(s["rows"], F.array(row)).alias("rows"),
        )
        return F.when(s["done"], s).otherwise(moved) if how.stop_at_trigger else moved

    start = F.struct(
        F.col("seed_stock").alias("stock"), F.col("lag1"), F.col("lag2"),
        F.col("last_closing").alias("lag1_close"), F.col("recent_sales").alias("recent"),
        F.col("days_since").cast("int").alias("days_since"), F.lit(False).alias("done"),
        F.array().cast(f"array<struct<{_ROW.replace(' ', ':').replace(',:', ',')}>>").alias("rows"),
    )
    rows = F.aggregate(F.sequence(F.lit(0), F.lit(how.days - 1)), start, step, lambda s: s["rows"])
    return seeded.select("station_id", *keep, rows.alias("_rows")).select("station_id", *keep, F.inline("_rows"))


def scenarios(df: DataFrame, percents: Sequence[float]) -> DataFrame:
    """Every row once per demand change; ``factor = 1 + pct / 100``."""
    each = F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("demand_pct")
    return df.select("*", each).withColumn("factor", demand_factor(F.col("demand_pct")))


def demand_factor(pct: Column) -> Column:
    return 1 + pct / 100


def seeded_state(features: DataFrame, multipliers: DataFrame | None = None, cfg: Tank = SERVE) -> DataFrame:
    return with_profile(last_state(features, cfg), profile.weekday_profile(features, cfg), multipliers)


def predict_refill(
    features: DataFrame,
    multipliers: DataFrame | None = None,
    cfg: Tank = SERVE,
    percents: Sequence[float] = (0.0,),
) -> DataFrame:
    """Next refill per station and scenario: date, days, seed stock, mean sales, how it was found.

    A ledger that records no sales gets the default prediction.
    """
    if "Total_Sold" not in features.columns:
        last_days = features.groupBy("station_id").agg(F.max("Date").alias("last_date"))
        return default_prediction(scenarios(last_days, percents), cfg)
    return decide(scenarios(seeded_state(features, multipliers, cfg), percents), cfg)


def simulate(
    features: DataFrame,
    multipliers: DataFrame | None = None,
    cfg: Tank = SERVE,
    days: int = SIMULATE.days,
    percents: Sequence[float] = (0.0,),
) -> DataFrame:
    """The coming ``days`` per station and scenario, with one refill at the first trigger."""
    swept = scenarios(seeded_state(features, multipliers, cfg), percents)
    return walk(swept, replace(SIMULATE, days=days), cfg, keep=["demand_pct"])


def drawdown(
    features: DataFrame, multipliers: DataFrame | None = None, cfg: Tank = SERVE, days: int = DRAWDOWN.days
) -> DataFrame:
    """The coming ``days`` per station without refill; a flat fall where the ledger records too little."""
    if {"Total_Sold", "Closing_Stock"} <= set(features.columns):
        return walk(seeded_state(features, multipliers, cfg), replace(DRAWDOWN, days=days), cfg)
    stations = features.select("station_id").distinct()
    return flat_drawdown(stations, F.lit(7000), F.lit(cfg.default_sales), days)


def decide(seeded: DataFrame, cfg: Tank = SERVE) -> DataFrame:
    """The first triggered day of each walk, else the rough estimate when there is none.

    The walk is folded into the station's own row, so no join back is needed.
    """
    seeded = seeded if "factor" in seeded.columns else scenarios(seeded, [0.0])
    keep = ["demand_pct", "last_date", "seed_stock", "mean_sold", "factor"]
    walked = walk(seeded, Walk(cfg.horizon, stop_at_trigger=True), cfg, keep)
    end = walked.groupBy("station_id", *keep).agg(
        F.min_by(F.struct("Date", "step", "Closing_Stock"), F.when(F.col("triggered"), F.col("step"))).alias("hit"),
        F.max_by("Closing_Stock", "step").alias("end_stock"),
    )
    avg = F.col("mean_sold") * F.col("factor")
    rough = F.when(
        avg > 0, F.greatest(F.lit(1), numeric.truncate(F.try_divide(F.col("end_stock"), avg)))
    ).otherwise(3).cast("int")
    days = F.coalesce(F.col("hit.step") + 1, rough)
    # A trigger counts from the last recorded day, the rough estimate from the day after it.
    date = F.coalesce("hit.Date", F.date_add("last_date", rough + 1))
    return end.select(
        "station_id",
        "demand_pct",
        date.alias("refill_date"),
        calendar.weekday_name(date).alias("refill_day"),
        days.alias("days_remaining"),
        F.col("hit").isNotNull().alias("triggered"),
        F.col("hit.Closing_Stock").alias("trigger_closing"),
        avg.alias("avg_sold"),
        F.col("seed_stock").alias("closing_stock"),
        F.lit(cfg.default_confidence).alias("confidence"),
    )


def feature_rows(walked: DataFrame, weekdays: DataFrame, cfg: Tank = SERVE) -> DataFrame:
    """The 27 model inputs of every simulated day."""
    est, closing = F.col("Est_Sold"), F.col("Closing_Stock")
    month = F.month("Date")
    shares = weekdays.select(
        "station_id", "DayOfWeek", "ewm_avg", "mean_sold", *[F.col(p).alias(f"_{p}") for p in PRODUCTS]
    )
    return walked.join(shares, ["station_id", "DayOfWeek"]).select(
        "station_id",
        "Date",
        "Opening_Stock",
        F.col("lag1_close").alias("Prev_Closing"),
        est.alias("Total_Sold"),
        *[numeric.truncate(est * F.col(f"_{p}")).alias(p) for p in PRODUCTS],
        *[numeric.truncate(est * rate).alias(p) for p, rate in RUPEES_PER_LITRE.items()],
        F.year("Date").alias("Year"),
        month.alias("Month"),
        "DayOfWeek",
        F.col("DayOfWeek").alias("Day_Num"),
        calendar.quarter_of(month).alias("Quarter"),
        calendar.is_weekend(F.col("DayOfWeek")).alias("Is_Weekend"),
        calendar.in_months(month, cfg.festival_months).alias("Is_Festival_Month"),
        # The walk counts June to August only, whichever preset trained the model.
        calendar.in_months(month, (6, 7, 8)).alias("Is_Monsoon_Month"),
        F.col("rolling").alias("Rolling_7d_Sales"),
        numeric.half_even(closing / float(cfg.capacity), 4).alias("Stock_Ratio"),
        dip_proxy(closing).alias("Dip"),
        F.col("lag1").alias("Lag1_Total_Sold"),
        F.col("lag2").alias("Lag2_Total_Sold"),
        F.col("lag1_close").alias("Lag1_Closing"),
        F.col("ewm_avg").alias("DOW_Avg_Sales"),
        numeric.half_even(numeric.safe_ratio(F.col("rolling"), F.col("mean_sold")), 4).alias("Sales_Trend"),
        F.col("days_since").alias("Days_Since_Refill"),
    )


def dip_proxy(closing: Column) -> Column:
    return F.greatest(F.lit(1), numeric.truncate(closing / 200)).cast("bigint")


def backtest(features: DataFrame, cfg: Tank = SERVE, digits: int = 4) -> DataFrame:
    """Yesterday's miss against the weekday mean known then, corrected by ``cfg.drift`` of it.

    The forward walk has no actuals, so its correction is 0; this is the active form, over history.
    """
    estimate = F.lag("DOW_Avg_Sales").over(timeline.same_weekday())
    miss = F.lag(F.col("Total_Sold") - F.col("estimate")).over(timeline.days())
    correction = F.coalesce(miss, F.lit(0.0)) * cfg.drift
    return (
        features.withColumn("estimate", F.coalesce(estimate, F.col("DOW_Avg_Sales")))
        .withColumn("drift", correction)
        .select(
            "station_id", "Date", "Total_Sold",
            numeric.half_even(F.col("estimate"), digits).alias("estimate"),
            numeric.half_even(F.col("drift"), digits).alias("drift"),
            numeric.half_even(F.col("estimate") + F.col("drift"), digits).alias("corrected"),
        )
    )


def flat_drawdown(df: DataFrame, stock: Column, per_day: Column, days: int = 8) -> DataFrame:
    """Constant demand from a known stock, one row per day for every row of ``df``.

    Shown as 7000 less 4500 a day where a ledger has no usable columns, and as the predicted stock
    less the mean sales where a prediction comes without a simulation.
    """
    start = df.select("station_id", stock.cast("double").alias("_stock"), per_day.cast("double").alias("_out"))
    day = F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day_idx")
    opening = F.greatest(F.lit(0.0), F.col("_stock") - (F.col("day_idx") - 1) * F.col("_out"))
    closing = F.greatest(F.lit(0.0), opening - F.col("_out"))
    return start.select("station_id", "_stock", "_out", day).select(
        "station_id", "day_idx", opening.alias("opening"), closing.alias("closing")
    )


def default_prediction(last_days: DataFrame, cfg: Tank = SERVE) -> DataFrame:
    """The prediction of a station without sales history; ``last_days`` has its last date and scenario."""
    factor = F.col("factor") if "factor" in last_days.columns else F.lit(1.0)
    pct = F.col("demand_pct") if "demand_pct" in last_days.columns else F.lit(0.0)
    avg = F.lit(cfg.default_sales) * factor
    rough = numeric.truncate(F.try_divide(F.lit(cfg.default_closing), avg))
    days = F.greatest(F.lit(1), F.coalesce(rough, F.lit(1))).cast("int")
    date = F.date_add("last_date", days)
    return last_days.select(
        "station_id",
        pct.alias("demand_pct"),
        date.alias("refill_date"),
        calendar.weekday_name(date).alias("refill_day"),
        days.alias("days_remaining"),
        F.lit(False).alias("triggered"),
        F.lit(None).cast("double").alias("trigger_closing"),
        avg.alias("avg_sold"),
        F.lit(cfg.default_closing).alias("closing_stock"),
        F.lit(cfg.default_confidence).alias("confidence"),
    )
