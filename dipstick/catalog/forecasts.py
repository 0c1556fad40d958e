"""F: walk-forward forecasts, decisions and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from dipstick.catalog.base import query
from dipstick.catalog.sources import scored
from dipstick.catalog.sql import DECIDED, LEDGER, LEDGER_COLUMNS, PROFILE, SCORED, STATE, over, rnd, walk
from dipstick.config import PREP, PRODUCTS, SERVE
from dipstick.functions import calendar, numeric, text
from dipstick.operators import forecast, metrics, profile, smote
from dipstick.operators.rollforward import roll_forward, roll_forward_by_pointers
from dipstick.plans import reports, training
from dipstick.sources import tables

_SWEEP = (-20.0, 0.0, 15.0)
_SWEEP_SQL = "(-20.0), (0.0), (15.0)"


@query(
    "f01_blended_estimate",
    over(PROFILE, f"SELECT station_id, DayOfWeek, {rnd('blended', 6)} AS blended, {rnd('recent_avg', 6)} AS recent_avg, {rnd('ewm_avg', 6)} AS ewm_avg FROM profile"),
)
def blended_estimate(data):
    return profile.weekday_profile(data.features).select(
        "station_id", "DayOfWeek",
        *[numeric.half_even(F.col(c), 6).alias(c) for c in ("blended", "recent_avg", "ewm_avg")],
    )


@query(
    "f02_seasonal_adjustment",
    over(
        STATE,
        f"""SELECT p.station_id, p.DayOfWeek, m."Month", {rnd('p.blended * m.multiplier', 6)} AS adjusted
        FROM profile p JOIN multipliers m ON p.station_id = m.station_id""",
    ),
)
def seasonal_adjustment(data):
    """Weekday estimates by month: the twelve multipliers ride along as a map, no pairs are joined."""
    per_month = data.multipliers.groupBy("station_id").agg(
        F.map_from_entries(F.collect_list(F.struct("Month", "multiplier"))).alias("by_month")
    )
    weekdays = profile.weekday_profile(data.features).join(per_month, "station_id")
    return weekdays.select("station_id", "DayOfWeek", "blended", F.explode("by_month").alias("Month", "m")).select(
        "station_id", "DayOfWeek", "Month", numeric.half_even(F.col("blended") * F.col("m"), 6).alias("adjusted")
    )


@query(
    "f03_demand_scenarios",
    over(
        walk(30, stop=True, percents=_SWEEP_SQL),
        'SELECT station_id, demand_pct, step, "Date", Est_Sold, Closing_Stock FROM path',
    ),
)
def demand_scenarios(data):
    swept = forecast.scenarios(data.seeded, _SWEEP)
    walked = forecast.walk(swept, forecast.PREDICT, keep=["demand_pct"])
    return walked.select("station_id", "demand_pct", "step", "Date", "Est_Sold", "Closing_Stock")


@query(
    "f04_pressure_cap",
    over(
        LEDGER,
        """SELECT station_id, "Date", CAST(least(trunc(4500.0::DOUBLE * least(1.0::DOUBLE, Opening_Stock / 6000.0::DOUBLE)), Opening_Stock) AS BIGINT) AS capped FROM ledger""",
    ),
)
def pressure_cap(data):
    """A flat demand against every day's opening stock."""
    capped = forecast.pressure_cap(F.lit(SERVE.default_sales), F.col("Opening_Stock"))
    return data.ledger.select("station_id", "Date", capped.cast("bigint").alias("capped"))


@query(
    "f05_walk_forward",
    over(
        walk(30, stop=True),
        f"""SELECT station_id, step, "Date", DayOfWeek, Opening_Stock, Est_Sold, Closing_Stock, triggered, lag1, lag2, lag1_close,
        {rnd('rolling', 6)} AS rolling, days_since FROM path""",
    ),
)
def walk_forward(data):
    walked = forecast.walk(data.seeded, forecast.PREDICT)
    return walked.withColumn("rolling", numeric.half_even(F.col("rolling"), 6))


@query(
    "f06_seed_stock",
    over(
        LEDGER,
        """SELECT station_id, rule, CASE WHEN y = 'Yes' THEN 12000.0 WHEN c = 0 AND rule = 'serve' THEN 3000.0 ELSE c END AS seed_stock
        FROM (SELECT station_id, mon, arg_max(Refill_Required, "Date") AS y, CAST(arg_max(Closing_Stock, "Date") AS DOUBLE) AS c FROM ledger GROUP BY 1, 2),
        (VALUES ('serve'), ('prep')) AS v(rule)""",
    ).replace("SELECT station_id, rule, CASE", "SELECT station_id || '-' || mon AS station_id, rule, CASE"),
)
def seed_stock(data):
    """Each station's months stand for stations of their own, so that full and partly empty ends occur."""
    parts = data.ledger.withColumn("station_id", F.concat_ws("-", "station_id", F.month("Date")))
    rules = [
        forecast.last_state(parts, cfg).select("station_id", F.lit(name).alias("rule"), "seed_stock")
        for name, cfg in (("serve", SERVE), ("prep", PREP))
    ]
    return rules[0].unionByName(rules[1])


_DECISION_COLUMNS = f"station_id, demand_pct, refill_date, dayname(refill_date) AS refill_day, days_remaining, triggered, trigger_closing, {rnd('avg_sold', 6)} AS avg_sold, closing_stock, confidence"


def _rounded(prediction):
    return prediction.withColumn("avg_sold", numeric.half_even(F.col("avg_sold"), 6))


@query("f07_refill_decision", over(walk(30, stop=True) + DECIDED, f"SELECT {_DECISION_COLUMNS} FROM decided"))
def refill_decision(data):
    return _rounded(forecast.predict_refill(data.features, data.multipliers))


# Demand so low, or none at all, that no day of the horizon triggers.
_CALM = "(-97.0), (-100.0)"


@query("f08_no_trigger_estimate", over(walk(30, stop=True, percents=_CALM) + DECIDED, f"SELECT {_DECISION_COLUMNS} FROM decided"))
def no_trigger_estimate(data):
    return _rounded(forecast.predict_refill(data.features, data.multipliers, percents=(-97.0, -100.0)))


@query(
    "f09_scenario_mean",
    over(LEDGER, f"SELECT station_id, CAST(pct AS DOUBLE) AS demand_pct, {rnd('avg(Total_Sold) * (1 + CAST(pct AS DOUBLE) / 100)', 6)} AS avg_sold FROM ledger, (VALUES {_SWEEP_SQL}) AS v(pct) GROUP BY 1, 2"),
)
def scenario_mean(data):
    means = data.ledger.groupBy("station_id").agg(F.avg("Total_Sold").alias("mean_sold"))
    return forecast.scenarios(means, _SWEEP).select(
        "station_id", "demand_pct", numeric.half_even(F.col("mean_sold") * F.col("factor"), 6).alias("avg_sold")
    )


_SHARES_CAST = ", ".join(f"CAST(trunc(Est_Sold * p.{p}) AS BIGINT) AS {p}" for p in PRODUCTS)


@query(
    "f10_feature_rows",
    over(
        walk(30, stop=True),
        f"""SELECT w.station_id, w."Date", Opening_Stock, lag1_close AS Prev_Closing, Est_Sold AS Total_Sold, {_SHARES_CAST},
          CAST(Est_Sold * 43 AS BIGINT) AS Cash, CAST(Est_Sold * 31 AS BIGINT) AS Online, CAST(Est_Sold * 21 AS BIGINT) AS Card,
          CAST(year(w."Date") AS INTEGER) AS "Year", CAST(month(w."Date") AS INTEGER) AS "Month", w.DayOfWeek, w.DayOfWeek AS Day_Num,
          CAST(quarter(w."Date") AS INTEGER) AS "Quarter", CAST(w.DayOfWeek >= 5 AS INTEGER) AS Is_Weekend,
          CAST(month(w."Date") IN (10, 11) AS INTEGER) AS Is_Festival_Month, CAST(month(w."Date") IN (6, 7, 8) AS INTEGER) AS Is_Monsoon_Month,
          {rnd('rolling', 6)} AS Rolling_7d_Sales, {rnd('Closing_Stock / 12000', 4)} AS Stock_Ratio,
          CAST(greatest(1, trunc(Closing_Stock / 200)) AS BIGINT) AS Dip, lag1 AS Lag1_Total_Sold, lag2 AS Lag2_Total_Sold, lag1_close AS Lag1_Closing,
          {rnd('p.ewm_avg', 6)} AS DOW_Avg_Sales, {rnd('rolling / p.mean_sold', 4)} AS Sales_Trend, days_since AS Days_Since_Refill
        FROM path w JOIN profile p ON p.station_id = w.station_id AND p.DayOfWeek = w.DayOfWeek""",
    ),
)
def feature_rows(data):
    walked = forecast.walk(data.seeded, forecast.PREDICT)
    rows = forecast.feature_rows(walked, profile.weekday_profile(data.features))
    return rows.withColumns({c: numeric.half_even(F.col(c), 6) for c in ("Rolling_7d_Sales", "DOW_Avg_Sales")})


@query(
    "f11_product_split",
    over(
        walk(30, stop=True),
        f"""SELECT w.station_id, w."Date", Est_Sold, {_SHARES_CAST}
        FROM path w JOIN profile p ON p.station_id = w.station_id AND p.DayOfWeek = w.DayOfWeek""",
    ),
)
def product_split(data):
    walked = forecast.walk(data.seeded, forecast.PREDICT)
    rows = forecast.feature_rows(walked, profile.weekday_profile(data.features))
    return rows.select("station_id", "Date", F.col("Total_Sold").alias("Est_Sold"), *PRODUCTS)


@query(
    "f12_payment_estimate",
    over(LEDGER, 'SELECT station_id, "Date", Total_Sold * 43 AS Cash, Total_Sold * 31 AS Online, Total_Sold * 21 AS Card FROM ledger'),
)
def payment_estimate(data):
    rates = forecast.RUPEES_PER_LITRE.items()
    return data.ledger.select(
        "station_id", "Date", *[numeric.truncate(F.col("Total_Sold") * r).alias(p) for p, r in rates]
    )


@query("f13_dip_proxy", over(LEDGER, 'SELECT station_id, "Date", CAST(greatest(1, Closing_Stock // 200) AS BIGINT) AS Dip FROM ledger'))
def dip_proxy(data):
    return data.ledger.select("station_id", "Date", forecast.dip_proxy(F.col("Closing_Stock")).alias("Dip"))


_BACKTEST = """, guessed AS (SELECT station_id, "Date", Total_Sold,
  coalesce(lag(DOW_Avg_Sales) OVER (PARTITION BY station_id, DayOfWeek ORDER BY "Date"), DOW_Avg_Sales) AS estimate {from_}),
missed AS (SELECT *, coalesce(lag(Total_Sold - estimate) OVER (PARTITION BY station_id ORDER BY "Date"), 0) * 0.4::DOUBLE AS drift FROM guessed)"""


@query(
    "f14_drift_backtest",
    over(
        PROFILE.split(", weekdays AS (")[0] + _BACKTEST.format(from_="FROM feat"),
        f"""SELECT station_id, "Date", Total_Sold, {rnd('estimate', 4)} AS estimate, {rnd('drift', 4)} AS drift, {rnd('estimate + drift', 4)} AS corrected FROM missed""",
    ),
)
def drift_backtest(data):
    return forecast.backtest(data.features)


@query(
    "f16_simulation",
    over(walk(15, reset=True, scenario_last=True, percents=_SWEEP_SQL), 'SELECT station_id, demand_pct, step, "Date", Opening_Stock, Est_Sold, Closing_Stock, triggered FROM path'),
)
def simulation(data):
    walked = forecast.simulate(data.features, data.multipliers, percents=_SWEEP)
    return walked.select("station_id", "demand_pct", "step", "Date", "Opening_Stock", "Est_Sold", "Closing_Stock", "triggered")


@query("f17_drawdown", over(walk(8), 'SELECT station_id, step, "Date", Opening_Stock, Est_Sold, Closing_Stock FROM path'))
def drawdown(data):
    return forecast.drawdown(data.features, data.multipliers).select(
        "station_id", "step", "Date", "Opening_Stock", "Est_Sold", "Closing_Stock"
    )


@query(
    "f17_flat_drawdown",
    over(
        LEDGER,
        """SELECT station_id, CAST(i AS INTEGER) AS day_idx, greatest(0.0::DOUBLE, 7000 - (i - 1) * 4500.0::DOUBLE) AS opening, greatest(0.0::DOUBLE, 7000 - i * 4500.0::DOUBLE) AS closing
        FROM (SELECT DISTINCT station_id FROM ledger), range(1, 9) AS t(i)""",
    ),
)
def flat_drawdown(data):
    return forecast.drawdown(data.ledger.drop("Total_Sold"))


@query(
    "f17_drawdown_from_prediction",
    over(
        walk(30, stop=True) + DECIDED,
        f"""SELECT station_id, CAST(i AS INTEGER) AS day_idx, {rnd('greatest(0, closing_stock - (i - 1) * avg_sold)', 4)} AS opening,
        {rnd('greatest(0, closing_stock - i * avg_sold)', 4)} AS closing FROM decided, range(1, 9) AS t(i)""",
    ),
)
def drawdown_from_prediction(data):
    """The drawdown of a report that comes without a simulation."""
    prediction = forecast.predict_refill(data.features, data.multipliers)
    path = forecast.flat_drawdown(prediction, F.col("closing_stock"), F.col("avg_sold"))
    return path.withColumns({c: numeric.half_even(F.col(c), 4) for c in ("opening", "closing")})


_ROLLED = over(LEDGER, 'SELECT station_id, "Date", Total_Sold, Opening_Stock, Closing_Stock, Target FROM ledger')


@query("f18_roll_forward", _ROLLED)
def rolled(data):
    return roll_forward(data.ledger.select("station_id", "Date", "Total_Sold"))


@query("f18_roll_forward_by_pointers", _ROLLED)
def rolled_by_pointers(data):
    """The same from running sums and doubled pointers, without an array of days."""
    return roll_forward_by_pointers(data.ledger.select("station_id", "Date", "Total_Sold"))


@query("f18_ledger_build", over(LEDGER, f"SELECT {LEDGER_COLUMNS} FROM ledger"))
def ledger_build(data):
    """The whole bridge from raw order lines, not the written ledger."""
    return tables.build_ledger(data.spark, data.folder)


@query(
    "f19_default_prediction",
    over(
        LEDGER,
        """SELECT station_id, pct::DOUBLE AS demand_pct, CAST(d + n AS DATE) AS refill_date, dayname(d + n) AS refill_day, n AS days_remaining, false AS triggered,
        CAST(NULL AS DOUBLE) AS trigger_closing, 4500.0::DOUBLE * (1 + pct::DOUBLE / 100) AS avg_sold, 3200.0::DOUBLE AS closing_stock, 0.91::DOUBLE AS confidence
        FROM (SELECT station_id, max("Date") AS d FROM ledger GROUP BY 1), (VALUES (0, 1), (-80, 3)) AS v(pct, n)""",
    ),
)
def default_prediction(data):
    """Two scenarios over a ledger that records no sales."""
    return forecast.predict_refill(data.ledger.drop("Total_Sold"), percents=(0.0, -80.0))


_RECENT = """, recent AS (SELECT station_id, avg(Total_Sold) AS m FROM (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY "Date" DESC) <= 7) GROUP BY 1),
accuracy AS (SELECT station_id, avg(CAST((score >= 0.83) = (Target = 1) AS INTEGER)) AS a FROM (SELECT station_id, Target, """ + rnd(
    "least(greatest((CAST(16500 AS DOUBLE) - Opening_Stock) / 12000, 0), 1)", 2
) + """ AS score FROM feat) GROUP BY 1)"""


@query(
    "f20_reasons",
    over(
        walk(30, stop=True) + DECIDED + _RECENT,
        f"""SELECT d.station_id, CAST(k AS INTEGER) AS position, CASE k
          WHEN 0 THEN CASE WHEN closing_stock < 4000 THEN 'critically low, ' || CAST(round_even(closing_stock / 12000 * 100, 0) AS INTEGER) || '% of capacity' ELSE 'at moderate level' END
          WHEN 1 THEN CASE WHEN r.m > avg_sold THEN 'above overall average' ELSE 'within normal range' END
          ELSE 'accuracy ' || CAST(round_even({rnd('a', 4)} * 100, 0) AS INTEGER) || '%, confidence 91%' END AS reason
        FROM decided d JOIN recent r ON r.station_id = d.station_id JOIN accuracy ON accuracy.station_id = d.station_id, range(3) AS t(k)""",
    ),
)
def reasons(data):
    prediction = forecast.predict_refill(data.features, data.multipliers)
    return reports.reasons(prediction, data.ledger, metrics.metrics_record(scored(data)))


@query(
    "f21_prediction_summary",
    over(
        walk(30, stop=True) + DECIDED,
        """SELECT station_id, strftime(refill_date, '%d %B %Y (%A)') AS refill_date_long, strftime(refill_date, '%d %b %Y') AS refill_date_short, days_remaining,
          CASE WHEN days_remaining <= 2 THEN 'danger' WHEN days_remaining <= 5 THEN 'warning' ELSE 'accent' END AS days_band,
          91.0::DOUBLE AS confidence_pct, 'good' AS confidence_band,
          format('{:,}', CAST(round_even(avg_sold, 0) AS BIGINT)) || ' L' AS avg_sold,
          format('{:,}', CAST(round_even(closing_stock, 0) AS BIGINT)) || ' L' AS closing_stock,
          CASE WHEN closing_stock < 2000 THEN 'danger' WHEN closing_stock < 4000 THEN 'warning' ELSE 'accent' END AS closing_band,
          CASE WHEN closing_stock >= 2000 THEN 'safe' ELSE 'below threshold' END AS status FROM decided""",
    ),
)
def prediction_summary(data):
    return reports.summary(forecast.predict_refill(data.features, data.multipliers))


@query(
    "f21_metric_rows",
    over(
        SCORED,
        f""", c AS (SELECT station_id, count(*) FILTER (WHERE Target = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE Target <> prediction) AS wrong, count(*) AS n FROM scored GROUP BY 1),
        auc AS (SELECT p.station_id, sum(CASE WHEN p.score > n.score THEN p.k * n.k * 2 WHEN p.score = n.score THEN p.k * n.k ELSE 0 END) / (2 * sum(p.k * n.k)) AS a
          FROM (SELECT station_id, score, count(*) AS k FROM scored WHERE Target = 1 GROUP BY 1, 2) p JOIN (SELECT station_id, score, count(*) AS k FROM scored WHERE Target = 0 GROUP BY 1, 2) n ON p.station_id = n.station_id GROUP BY 1),
        m AS (SELECT station_id, 'Accuracy' AS metric, {rnd('(n - wrong) / n', 4)} AS v FROM c UNION ALL SELECT station_id, 'F1 Score', {rnd('2 * tp / (2 * tp + wrong)', 4)} FROM c
          UNION ALL SELECT station_id, 'ROC-AUC', {rnd('a', 4)} FROM auc)
        SELECT station_id, metric, {rnd('v * 100', 1)} AS pct, CASE WHEN {rnd('v * 100', 1)} >= 90 THEN 'good' ELSE 'accent' END AS band FROM m""",
    ),
)
def metric_rows(data):
    return reports.metric_rows(metrics.metrics_record(scored(data)))


@query(
    "f22_simulation_table",
    over(
        walk(15, reset=True, scenario_last=True),
        """SELECT station_id, strftime("Date", '%Y-%m-%d') AS "Date", dayname("Date") AS "Day",
          format('{:,}', CAST(Opening_Stock AS BIGINT)) || ' L' AS Opening_Stock, format('{:,}', CAST(Est_Sold AS BIGINT)) || ' L' AS Est_Sold,
          format('{:,}', CAST(Closing_Stock AS BIGINT)) || ' L' AS Closing_Stock,
          CASE WHEN triggered THEN 'High (Refill Triggered)' ELSE 'Low' END AS Refill_Probability, triggered AS Refill_Triggered FROM path""",
    ),
)
def simulation_table(data):
    return reports.simulation_table(forecast.walk(data.seeded, forecast.SIMULATE))


@query(
    "f23_profile_report",
    over(PROFILE, f"""SELECT station_id, dayname(DATE '2024-01-01' + DayOfWeek) AS "Day", {rnd('blended', 0)} AS blended, {rnd('recent_avg', 0)} AS recent_4_weeks, {rnd('ewm_avg', 0)} AS ewm_all_time FROM profile"""),
)
def profile_report(data):
    weekdays = profile.weekday_profile(data.features)
    monday = F.lit("2024-01-01").cast("date")
    return weekdays.select(
        "station_id",
        calendar.weekday_name(F.date_add(monday, F.col("DayOfWeek"))).alias("Day"),
        *[numeric.half_even(F.col(c), 0).alias(n)
          for c, n in (("blended", "blended"), ("recent_avg", "recent_4_weeks"), ("ewm_avg", "ewm_all_time"))],
    )


@query(
    "f24_stock_path",
    over(
        walk(8),
        """SELECT station_id, CAST(step + 1 AS INTEGER) AS day_idx, strftime("Date", '%a %d-%m-%Y') AS label, CAST(Opening_Stock AS BIGINT) AS opening,
        CAST(Closing_Stock AS BIGINT) AS closing, Closing_Stock < 2000 AS below FROM path""",
    ),
)
def stock_path(data):
    return reports.stock_path(forecast.walk(data.seeded, forecast.DRAWDOWN))
