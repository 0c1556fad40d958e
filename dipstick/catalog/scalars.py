"""X: scalar functions, over all ledger days or all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from dipstick.catalog.base import query
from dipstick.catalog.sql import FEATURES, LEDGER, MULTIPLIERS, over, rnd
from dipstick.functions import calendar, numeric, text
from dipstick.operators import profile, stats, timeline


@query(
    "x01_calendar_parts",
    over(
        LEDGER,
        """SELECT station_id, "Date", CAST(year("Date") AS INTEGER) AS "Year", CAST(month("Date") AS INTEGER) AS "Month",
        CAST(quarter("Date") AS INTEGER) AS "Quarter" FROM ledger""",
    ),
)
def calendar_parts(data):
    return data.ledger.select(
        "station_id", "Date", F.year("Date").alias("Year"), F.month("Date").alias("Month"),
        F.quarter("Date").alias("Quarter"),
    )


@query("x02_weekday", over(LEDGER, 'SELECT station_id, "Date", CAST(isodow("Date") - 1 AS INTEGER) AS DayOfWeek FROM ledger'))
def weekday(data):
    return data.ledger.select("station_id", "Date", calendar.weekday(F.col("Date")).alias("DayOfWeek"))


@query("x03_weekday_name", over(LEDGER, 'SELECT station_id, "Date", dayname("Date") AS "Day" FROM ledger'))
def weekday_name(data):
    return data.ledger.select("station_id", "Date", calendar.weekday_name(F.col("Date")).alias("Day"))


@query(
    "x04_weekday_number",
    over(LEDGER, 'SELECT station_id, "Date", "Day", CAST(isodow("Date") - 1 AS INTEGER) AS Day_Num FROM ledger'),
)
def weekday_number(data):
    return data.ledger.select("station_id", "Date", "Day", calendar.weekday_number(F.col("Day")).alias("Day_Num"))


@query("x05_weekend_flag", over(LEDGER, 'SELECT station_id, "Date", CAST(dow IN (5, 6) AS INTEGER) AS Is_Weekend FROM ledger'))
def weekend_flag(data):
    return data.ledger.select(
        "station_id", "Date", calendar.is_weekend(calendar.weekday(F.col("Date"))).alias("Is_Weekend")
    )


@query("x06_quarter_of_month", over(LEDGER, 'SELECT station_id, "Date", CAST((mon - 1) // 3 + 1 AS INTEGER) AS "Quarter" FROM ledger'))
def quarter_of_month(data):
    return data.ledger.select("station_id", "Date", calendar.quarter_of(F.month("Date")).alias("Quarter"))


@query(
    "x07_add_days",
    over(LEDGER, 'SELECT station_id, "Date", CAST("Date" + 1 AS DATE) AS next_day, CAST("Date" + 30 AS DATE) AS horizon FROM ledger'),
)
def add_days(data):
    return data.ledger.select(
        "station_id", "Date", F.date_add("Date", 1).alias("next_day"), F.date_add("Date", 30).alias("horizon")
    )


@query(
    "x08_date_display",
    over(
        LEDGER,
        """SELECT station_id, "Date", strftime("Date", '%Y-%m-%d') AS iso, strftime("Date", '%d-%m-%Y') AS day_first,
        strftime("Date", '%d %b %Y') AS short, strftime("Date", '%b %Y') AS "month", strftime("Date", '%a') AS weekday,
        strftime("Date", '%d %B %Y (%A)') AS long FROM ledger""",
    ),
)
def date_display(data):
    return data.ledger.select(
        "station_id", "Date", *[calendar.display(F.col("Date"), s).alias(s) for s in calendar.DISPLAY_LAYOUTS]
    )


@query(
    "x09_short_labels",
    over(LEDGER, """SELECT station_id, "Date", strftime("Date", '%b') AS month_label, strftime("Date", '%a') AS day_label FROM ledger"""),
)
def short_labels(data):
    return data.ledger.select(
        "station_id", "Date",
        calendar.month_label(F.month("Date")).alias("month_label"),
        calendar.weekday_label(calendar.weekday(F.col("Date"))).alias("day_label"),
    )


@query(
    "x10_half_even",
    over(
        LEDGER,
        f"""SELECT station_id, "Date", {rnd('Total_Sold / 2', 0)} AS halves, {rnd('Total_Sold / 8', 2)} AS eighths,
        {rnd('Closing_Stock / 12000', 4)} AS ratio FROM ledger""",
    ),
)
def half_even(data):
    sold = F.col("Total_Sold")
    return data.ledger.select(
        "station_id", "Date",
        numeric.half_even(sold / 2, 0).alias("halves"),
        numeric.half_even(sold / 8, 2).alias("eighths"),
        numeric.half_even(F.col("Closing_Stock") / 12000, 4).alias("ratio"),
    )


@query(
    "x11_clip",
    over(
        LEDGER,
        """SELECT station_id, "Date", greatest(Opening_Stock - 2 * Total_Sold, 0) AS floored,
        least(greatest(Total_Sold, 4000), 5000) AS clipped FROM ledger""",
    ),
)
def clip(data):
    return data.ledger.select(
        "station_id", "Date",
        numeric.clip(F.col("Opening_Stock") - 2 * F.col("Total_Sold"), low=0).alias("floored"),
        numeric.clip(F.col("Total_Sold"), 4000, 5000).alias("clipped"),
    )


@query(
    "x12_truncate",
    over(
        LEDGER,
        """SELECT station_id, "Date", CAST(trunc(Total_Sold * CAST(0.38 AS DOUBLE)) AS BIGINT) AS share,
        CAST(trunc((Total_Sold - 4500) / 7) AS BIGINT) AS signed FROM ledger""",
    ),
)
def truncate(data):
    return data.ledger.select(
        "station_id", "Date",
        numeric.truncate(F.col("Total_Sold") * 0.38).alias("share"),
        numeric.truncate((F.col("Total_Sold") - 4500) / 7).alias("signed"),
    )


@query(
    "x13_safe_ratio",
    over(
        LEDGER,
        f"""SELECT station_id, "Date", {rnd('CASE WHEN Closing_Stock = 0 THEN 0.0 ELSE Total_Sold / Closing_Stock END', 6)} AS ratio
        FROM ledger""",
    ),
)
def safe_ratio(data):
    ratio = numeric.safe_ratio(F.col("Total_Sold"), F.col("Closing_Stock"))
    return data.ledger.select("station_id", "Date", numeric.half_even(ratio, 6).alias("ratio"))


@query("x14_magnitude", over(LEDGER, 'SELECT station_id, "Date", abs(Total_Sold - 4500) AS deviation FROM ledger'))
def magnitude(data):
    return data.ledger.select("station_id", "Date", F.abs(F.col("Total_Sold") - 4500).alias("deviation"))


@query(
    "x15_litres_display",
    over(
        LEDGER,
        """SELECT station_id, "Date", format('{:,}', Total_Sold) || ' L' AS sold,
        format('{:,}', CAST(round_even(Total_Sold / 2, 0) AS BIGINT)) || ' L' AS half FROM ledger""",
    ),
)
def litres_display(data):
    return data.ledger.select(
        "station_id", "Date", text.litres(F.col("Total_Sold")).alias("sold"), text.litres(F.col("Total_Sold") / 2).alias("half")
    )


@query(
    "x16_bands",
    over(
        FEATURES,
        """SELECT station_id, "Date",
          CASE WHEN Closing_Stock / 120 < 25 THEN 'danger' WHEN Closing_Stock / 120 < 50 THEN 'warning' ELSE 'success' END AS stock,
          CASE WHEN Days_Since_Refill <= 2 THEN 'danger' WHEN Days_Since_Refill <= 5 THEN 'warning' ELSE 'accent' END AS days,
          CASE WHEN Closing_Stock < 2000 THEN 'danger' WHEN Closing_Stock < 4000 THEN 'warning' ELSE 'accent' END AS closing,
          CASE WHEN Stock_Ratio * 100 >= 80 THEN 'good' ELSE 'bad' END AS confidence,
          CASE WHEN Stock_Ratio * 100 >= 90 THEN 'good' ELSE 'accent' END AS metric,
          CASE WHEN Sales_Trend - 1 < -0.1 THEN 'danger' WHEN Sales_Trend - 1 > 0.1 THEN 'success' ELSE 'neutral' END AS correlation
        FROM feat""",
    ),
)
def bands(data):
    pct = F.col("Stock_Ratio") * 100
    return data.features.select(
        "station_id", "Date",
        numeric.stock_band(F.col("Closing_Stock") / 120).alias("stock"),
        numeric.days_band(F.col("Days_Since_Refill")).alias("days"),
        numeric.closing_band(F.col("Closing_Stock")).alias("closing"),
        numeric.confidence_band(pct).alias("confidence"),
        numeric.metric_band(pct).alias("metric"),
        numeric.correlation_band(F.col("Sales_Trend") - 1).alias("correlation"),
    )


@query(
    "x17_shorten",
    over(LEDGER, """SELECT station_id, "Date", "Day"[1:3] AS three, (station_id || ' ' || "Day" || ' ledger of the station')[1:24] AS twenty_four FROM ledger"""),
)
def shorten(data):
    label = F.concat_ws(" ", F.col("station_id"), F.col("Day"), F.lit("ledger of the station"))
    return data.ledger.select(
        "station_id", "Date", text.shorten(F.col("Day"), 3).alias("three"), text.shorten(label, 24).alias("twenty_four")
    )


@query("x19_kilolitres", over(LEDGER, 'SELECT station_id, "Date", Total_Sold / 1000 AS kilolitres FROM ledger'))
def kilolitres(data):
    return data.ledger.select("station_id", "Date", (F.col("Total_Sold") / 1000).alias("kilolitres"))


@query(
    "x20_percentages",
    over(
        LEDGER,
        f"""SELECT station_id, "Date", {rnd('Total_Sold * 100.0 / sum(Total_Sold) OVER (PARTITION BY station_id)', 6)} AS pct_of_total,
        {rnd('Closing_Stock / 12000 * 100', 4)} AS pct_of_capacity FROM ledger""",
    ),
)
def percentages(data):
    total = F.sum("Total_Sold").over(timeline.station())
    return data.ledger.select(
        "station_id", "Date",
        numeric.half_even(numeric.percent(F.col("Total_Sold"), total), 6).alias("pct_of_total"),
        numeric.half_even(F.col("Closing_Stock") / 12000 * 100, 4).alias("pct_of_capacity"),
    )


@query(
    "x21_json_round_trip",
    over(MULTIPLIERS, 'SELECT station_id, CAST("Month" AS VARCHAR) AS key, multiplier AS value FROM multipliers'),
)
def json_round_trip(data):
    pairs = F.collect_list(F.struct(F.col("Month").cast("string"), F.col("multiplier")))
    encoded = data.multipliers.groupBy("station_id").agg(F.to_json(F.map_from_entries(pairs)).alias("json"))
    return encoded.select("station_id", F.explode(F.from_json("json", "map<string,double>")).alias("key", "value"))
