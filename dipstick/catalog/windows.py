"""W: window functions over a station's days."""

from __future__ import annotations

from pyspark.sql import functions as F

from dipstick.catalog.base import query
from dipstick.catalog.sql import FEATURES, LEDGER, LEDGER_COLUMNS, PROFILE, STATE, over, rnd, walk
from dipstick.config import SERVE
from dipstick.functions import numeric
from dipstick.operators import blocks, clean, features, forecast, profile, timeline
from dipstick.sources import readers, sinks

_W = 'PARTITION BY station_id ORDER BY "Date"'


@query(
    "w01_rolling_mean",
    over(
        LEDGER,
        f"""SELECT station_id, "Date", Total_Sold, {rnd('r', 2)} AS two_digits, {rnd('r', 0)} AS no_digits,
          {rnd('r', 1)} AS one_digit, {rnd('r', 6)} AS unrounded
        FROM (SELECT *, avg(Total_Sold) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r FROM ledger)""",
    ),
)
def rolling_mean(data):
    digits = {"two_digits": 2, "no_digits": 0, "one_digit": 1, "unrounded": 6}
    return data.ledger.select(
        "station_id", "Date", "Total_Sold",
        *[timeline.trailing_mean("Total_Sold", 7, d).alias(n) for n, d in digits.items()],
    )


@query(
    "w01_rolling_mean_by_blocks",
    over(
        LEDGER,
        f"""SELECT station_id, "Date", {rnd('r', 2)} AS rolling FROM (
          SELECT *, avg(Total_Sold) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r FROM ledger)""",
    ),
)
def rolling_mean_by_blocks(data):
    """The same with a station's days dealt into blocks of 90 days, each with the six rows before it."""
    return blocks.trailing_mean(data.ledger.select("station_id", "Date", "Total_Sold"), "Total_Sold", "rolling", 7, 2, 90).drop("Total_Sold")


_LAG_SQL = over(
    LEDGER,
    """SELECT station_id, "Date", {x} AS {name} FROM (SELECT *,
      lag({col}, {k}) OVER (PARTITION BY station_id ORDER BY "Date") AS l,
      avg({mean}) OVER (PARTITION BY station_id) AS m FROM ledger)""",
)


def _lag_sql(name: str, column: str, k: int, mean: str) -> str:
    return _LAG_SQL.format(x=rnd("coalesce(CAST(l AS DOUBLE), m)", 6), name=name, col=column, k=k, mean=mean)


@query("w02_lag1_sales", _lag_sql("Lag1_Total_Sold", "Total_Sold", 1, "Total_Sold"))
def lag1_sales(data):
    lagged = timeline.lag_or_mean("Total_Sold", 1)
    return data.ledger.select("station_id", "Date", numeric.half_even(lagged, 6).alias("Lag1_Total_Sold"))


@query("w03_lag2_sales", _lag_sql("Lag2_Total_Sold", "Total_Sold", 2, "Total_Sold"))
def lag2_sales(data):
    lagged = timeline.lag_or_mean("Total_Sold", 2)
    return data.ledger.select("station_id", "Date", numeric.half_even(lagged, 6).alias("Lag2_Total_Sold"))


@query("w04_lag1_closing", _lag_sql("Lag1_Closing", "Closing_Stock", 1, "Opening_Stock"))
def lag1_closing(data):
    lagged = timeline.lag_or_mean("Closing_Stock", 1, "Opening_Stock")
    return data.ledger.select("station_id", "Date", numeric.half_even(lagged, 6).alias("Lag1_Closing"))


@query(
    "w05_prev_closing",
    over(
        LEDGER,
        f"""SELECT station_id, "Date", CAST(lag(Closing_Stock, 1, 0) OVER ({_W}) AS DOUBLE) AS serve,
          CAST(lag(Closing_Stock, 1, 12000) OVER ({_W}) AS DOUBLE) AS prep FROM ledger""",
    ),
)
def prev_closing(data):
    return data.ledger.select(
        "station_id", "Date",
        timeline.previous("Closing_Stock", 0).alias("serve"),
        timeline.previous("Closing_Stock", 12000).alias("prep"),
    )


@query(
    "w06_ewm_weekday",
    over(FEATURES, f'SELECT station_id, "Date", DayOfWeek, {rnd("DOW_Avg_Sales", 6)} AS DOW_Avg_Sales FROM feat'),
)
def ewm_weekday(data):
    dated = features.calendar_columns(data.ledger)
    return timeline.weekday_ewm(dated, "Total_Sold", SERVE.alpha, "DOW_Avg_Sales").select(
        "station_id", "Date", "DayOfWeek", numeric.half_even(F.col("DOW_Avg_Sales"), 6).alias("DOW_Avg_Sales")
    )


@query(
    "w07_ewm_weekday_end",
    over(PROFILE, f"SELECT station_id, DayOfWeek, {rnd('ewm_avg', 6)} AS ewm_avg FROM profile"),
)
def ewm_weekday_end(data):
    return profile.weekday_profile(data.features).select(
        "station_id", "DayOfWeek", numeric.half_even(F.col("ewm_avg"), 6).alias("ewm_avg")
    )


@query(
    "w08_recent_weekday_mean",
    over(PROFILE, f"SELECT station_id, DayOfWeek, {rnd('recent_avg', 6)} AS recent_avg FROM profile"),
)
def recent_weekday_mean(data):
    return profile.weekday_profile(data.features).select(
        "station_id", "DayOfWeek", numeric.half_even(F.col("recent_avg"), 6).alias("recent_avg")
    )


# The counter as it is defined: start at 0, carry on, back to 0 after a refill row.
_COUNTER_SQL = over(
    LEDGER,
    """, counter AS (
      SELECT station_id, rn, Target, 0 AS days FROM ledger WHERE rn = 1
      UNION ALL
      SELECT l.station_id, l.rn, l.Target, CASE WHEN c.Target = 1 THEN 0 ELSE c.days + 1 END
      FROM counter c JOIN ledger l ON l.station_id = c.station_id AND l.rn = c.rn + 1
    )
    SELECT l.station_id, l."Date", CAST(c.days AS INTEGER) AS Days_Since_Refill
    FROM counter c JOIN ledger l ON l.station_id = c.station_id AND l.rn = c.rn""",
)


@query("w09_days_since_refill", _COUNTER_SQL)
def days_since_refill(data):
    return timeline.days_since_refill_islands(data.ledger).select("station_id", "Date", "Days_Since_Refill")


@query("w10_days_since_refill_by_position", _COUNTER_SQL)
def days_since_refill_by_position(data):
    return timeline.days_since_refill(data.ledger).select("station_id", "Date", "Days_Since_Refill")


@query(
    "w11_days_since_refill_at_end",
    over(
        LEDGER,
        """SELECT station_id, CAST(coalesce(max(rn) - max(CASE WHEN Target = 1 THEN rn END), 0) AS INTEGER) AS days_since
        FROM ledger GROUP BY 1""",
    ),
)
def days_since_refill_at_end(data):
    return forecast.last_state(data.ledger).select("station_id", "days_since")


@query(
    "w12_sales_trend",
    over(FEATURES, 'SELECT station_id, "Date", Rolling_7d_Sales, Sales_Trend FROM feat'),
)
def sales_trend(data):
    rolled = data.ledger.withColumn("Rolling_7d_Sales", timeline.trailing_mean("Total_Sold", 7, 2))
    return rolled.select("station_id", "Date", "Rolling_7d_Sales", features.sales_trend().alias("Sales_Trend"))


@query(
    "w13_first_and_last_row",
    over(
        LEDGER,
        f"""SELECT {LEDGER_COLUMNS}, 'last' AS edge FROM ledger
          QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY "Date" DESC) = 1
        UNION ALL SELECT {LEDGER_COLUMNS}, 'first' FROM ledger WHERE rn = 1""",
    ),
)
def first_and_last_row(data):
    columns = [c for c in data.ledger.columns if c != "station_id"]
    last = timeline.edge_rows(data.ledger, columns, "last").withColumn("edge", F.lit("last"))
    return last.unionByName(timeline.edge_rows(data.ledger, columns, "first").withColumn("edge", F.lit("first")))


@query(
    "w14_recent_sales",
    over(
        STATE,
        f"""SELECT station_id, pos AS position, recent_sales[pos] AS sold,
          {rnd('list_sum(recent_sales) / len(recent_sales)', 6)} AS recent_mean
        FROM (SELECT *, unnest(range(1, len(recent_sales) + 1)) AS pos FROM state)""",
    ),
)
def recent_sales(data):
    state = forecast.last_state(data.ledger)
    total = F.aggregate("recent_sales", F.lit(0.0), lambda a, x: a + x)
    return state.select(
        "station_id", F.posexplode("recent_sales").alias("_pos", "sold"),
        numeric.half_even(total / F.size("recent_sales"), 6).alias("recent_mean"),
    ).select("station_id", (F.col("_pos") + 1).cast("bigint").alias("position"), "sold", "recent_mean")


@query(
    "w15_last_lags",
    over(
        STATE,
        """SELECT station_id, recent_sales[-1] AS lag1, coalesce(recent_sales[-2], recent_sales[-1]) AS lag2,
        last_closing AS lag1_close FROM state""",
    ),
)
def last_lags(data):
    return forecast.last_state(data.ledger).select("station_id", "lag1", "lag2", F.col("last_closing").alias("lag1_close"))


@query(
    "w16_rolling_last_60",
    over(
        LEDGER,
        f"""SELECT station_id, "Date", Total_Sold, {rnd(f'avg(Total_Sold) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 6)} AS Rolling_7d
        FROM (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY "Date" DESC) <= 60)""",
    ),
)
def rolling_last_60(data):
    return timeline.recent_trailing_mean(data.ledger, "Total_Sold", 60).select(
        "station_id", "Date", "Total_Sold", numeric.half_even(F.col("Rolling_7d"), 6).alias("Rolling_7d")
    )


@query(
    "w17_chronological_split",
    over(
        LEDGER,
        """SELECT station_id, "Date",
          CASE WHEN rn <= floor(count(*) OVER (PARTITION BY station_id) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
        FROM ledger""",
    ),
)
def chronological_split(data):
    return timeline.chronological_split(data.ledger).select("station_id", "Date", "split")


@query(
    "w18_live_rolling_mean",
    over(
        walk(15, reset=True, scenario_last=True),
        f'SELECT station_id, "Date", Est_Sold, {rnd("rolling", 6)} AS live_rolling FROM path',
    ),
)
def live_rolling_mean(data):
    walked = forecast.walk(data.seeded, forecast.SIMULATE)
    return walked.select("station_id", "Date", "Est_Sold", numeric.half_even(F.col("rolling"), 6).alias("live_rolling"))


# A ledger with gaps: closing stock unknown on refill days, sales unknown at weekends.
GAPPY = """, gappy AS (
  SELECT station_id, "Date", rn, "Day", Opening_Stock, CASE WHEN dow >= 5 THEN NULL ELSE Total_Sold END AS Total_Sold,
    CASE WHEN Target = 1 THEN NULL ELSE Closing_Stock END AS Closing_Stock, Refill_Required FROM ledger)"""


def gappy(ledger):
    weekend = F.weekday("Date") >= 5
    return ledger.select(
        "station_id", "Date", "Day", "Opening_Stock",
        F.when(~weekend, F.col("Total_Sold")).alias("Total_Sold"),
        F.when(F.col("Target") == 0, F.col("Closing_Stock")).alias("Closing_Stock"),
        "Refill_Required",
    )


def _fill_sql(columns: str) -> str:
    return over(
        LEDGER + GAPPY,
        f'SELECT station_id, "Date", {columns} FROM gappy WINDOW w AS (PARTITION BY station_id ORDER BY "Date"'
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    )


@query("w19_last_known_by_blocks", _fill_sql("last_value(Closing_Stock IGNORE NULLS) OVER w AS Closing_Stock"))
def last_known_by_blocks(data):
    """The same with a station's days dealt into blocks of 90 days."""
    return blocks.last_known(gappy(data.ledger), ["Closing_Stock"], 90).select("station_id", "Date", "Closing_Stock")


@query("w19_last_known", _fill_sql("last_value(Closing_Stock IGNORE NULLS) OVER w AS Closing_Stock"))
def last_known(data):
    return gappy(data.ledger).select("station_id", "Date", timeline.last_known("Closing_Stock").alias("Closing_Stock"))


@query(
    "c08_forward_fill",
    _fill_sql(
        '"Day", Opening_Stock, last_value(Total_Sold IGNORE NULLS) OVER w AS Total_Sold, '
        "last_value(Closing_Stock IGNORE NULLS) OVER w AS Closing_Stock, Refill_Required"
    ),
)
def forward_fill(data):
    return clean.forward_fill(gappy(data.ledger))


_SERVED = (
    "Month", "Year", "DayOfWeek", "Is_Weekend", "Rolling_7d_Sales", "Prev_Closing", "Stock_Ratio", "Is_Festival_Month",
    "Is_Monsoon_Month", "Lag1_Total_Sold", "Lag2_Total_Sold", "Lag1_Closing", "DOW_Avg_Sales", "Sales_Trend", "Days_Since_Refill",
)
_LONG_FRACTIONS = ("Lag1_Total_Sold", "Lag2_Total_Sold", "Lag1_Closing", "DOW_Avg_Sales")


@query(
    "serving_features",
    over(
        FEATURES,
        'SELECT station_id, "Date", "Day", Target, '
        + ", ".join(f"{rnd(c, 6)} AS {c}" if c in _LONG_FRACTIONS else f'"{c}"' for c in _SERVED)
        + " FROM feat",
    ),
)
def serving_features(data):
    """The whole serving path: CSV text in, every feature out."""
    raw = sinks.write_csv(data.ledger.drop("Target", "Day"), data.path("raw"))
    table = readers.read_ledger(data.spark, raw)
    return table.select(
        "station_id", "Date", "Day", "Target",
        *[(numeric.half_even(F.col(c), 6) if c in _LONG_FRACTIONS else F.col(c)).alias(c) for c in _SERVED],
    )


@query(
    "clean_table",
    over(
        LEDGER,
        f"""SELECT {LEDGER_COLUMNS}, CAST(year("Date") AS INTEGER) AS "Year", mon AS "Month", dow AS DayOfWeek, CAST(quarter("Date") AS INTEGER) AS "Quarter",
          CAST(dow >= 5 AS INTEGER) AS Is_Weekend, dow AS Day_Num, {rnd('CAST(Closing_Stock AS DOUBLE) / 12000', 4)} AS Stock_Ratio,
          {rnd(f'avg(Total_Sold) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 0)} AS Rolling_7d_Sales,
          CAST(lag(Closing_Stock, 1, 12000) OVER ({_W}) AS DOUBLE) AS Prev_Closing,
          CAST(mon IN (10, 11) AS INTEGER) AS Is_Festival_Month, CAST(mon IN (6, 7, 8) AS INTEGER) AS Is_Monsoon_Month FROM ledger""",
    ),
)
def clean_table(data):
    """The preparation path: strict day-first dates, forward fill, calendar and business features."""
    written = data.ledger.withColumn("Date", F.date_format("Date", "dd-MM-yyyy"))
    return features.prepare(written)


@query(
    "reloaded_clean_table",
    over(
        FEATURES,
        f"""SELECT station_id, "Date", Target, Rolling_7d_Sales, {rnd('CAST(Closing_Stock AS DOUBLE) / 12000', 4)} AS Stock_Ratio,
          CAST(lag(Closing_Stock, 1, 12000) OVER ({_W}) AS DOUBLE) AS Prev_Closing, CAST(mon IN (6, 7, 8) AS INTEGER) AS Is_Monsoon_Month,
          Days_Since_Refill, Sales_Trend FROM feat""",
    ),
)
def reloaded_clean_table(data):
    """The clean table stored as CSV and served: columns it has are kept, the rolling mean is not."""
    stored = sinks.write_csv(data.prepared, data.path("clean"))
    return readers.read_ledger(data.spark, stored).select(
        "station_id", "Date", "Target", "Rolling_7d_Sales", "Stock_Ratio", "Prev_Closing", "Is_Monsoon_Month",
        "Days_Since_Refill", "Sales_Trend",
    )
