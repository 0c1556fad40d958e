"""C: cleaning, projection and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipstick.catalog.base import query
from dipstick.catalog.sql import FEATURES, LEDGER, LEDGER_COLUMNS, over, rnd, walk
from dipstick.config import MODEL_FEATURES, PREP, PRODUCTS, SERVE
from dipstick.functions import calendar, numeric, text
from dipstick.operators import clean, forecast, stats
from dipstick.plans import reports, training


@query("c01_trim_names", over(LEDGER, f"SELECT {LEDGER_COLUMNS} FROM ledger"))
def trim_names(data):
    padded = data.ledger.toDF(*[f"  {c} " for c in data.ledger.columns])
    return clean.trim_names(padded)


@query(
    "c02_rename_date",
    over(LEDGER, 'SELECT station_id, "Date", CAST("Date" + 1 AS DATE) AS "DATE_", Total_Sold FROM ledger').replace("DATE_", "Dates"),
)
def rename_date(data):
    # Two aliases: the first in order becomes the date, the other keeps its name.
    named = data.ledger.select(
        "station_id", F.date_add("Date", 1).alias("Dates"), F.col("Date").alias("DATE"), "Total_Sold"
    )
    return clean.rename_date(named)


@query("c03_date_column_any_case", over(LEDGER, 'SELECT station_id, "Date" AS found FROM ledger'))
def date_column_any_case(data):
    odd = data.ledger.withColumnRenamed("Date", "dAtE")
    return odd.select("station_id", F.col(clean.date_column(odd)).alias("found"))


# Each order's date written in one of nine ways, one of them unreadable.
_TEXT_DATES = """WITH written AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 9
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
    WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%d-%m-%Y')
    WHEN 4 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 5 THEN strftime(o_orderdate, '%m-%d-%Y')
    WHEN 6 THEN strftime(o_orderdate, '%d %b %Y') WHEN 7 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
    ELSE 'junk' END AS written
  FROM orders
), parsed AS (
  SELECT o_orderkey, written, CAST(CASE WHEN o_orderkey % 9 = 8 THEN NULL
    WHEN o_orderkey % 9 IN (4, 5) AND day(d) <= 12
      THEN make_date(year(d), day(d), month(d)) ELSE d END AS DATE) AS parsed FROM written
)"""
_WRITTEN = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "MM-dd-yyyy", "dd MMM yyyy", "yyyy-MM-dd HH:mm:ss")


def _written_dates(data) -> DataFrame:
    way = F.col("o_orderkey") % 9
    forms = ((way == i, F.date_format("o_orderdate", layout)) for i, layout in enumerate(_WRITTEN))
    return data.table("orders").select("o_orderkey", numeric.choose(forms, F.lit("junk")).alias("written"))


@query("c04_lenient_dates", over(_TEXT_DATES, "SELECT o_orderkey, written, parsed FROM parsed"))
def lenient_dates(data):
    return _written_dates(data).withColumn("parsed", calendar.parse_date(F.col("written")))


@query(
    "c05_strict_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "Date" FROM orders""",
)
def strict_dates(data):
    written = data.table("orders").select("o_orderkey", F.date_format("o_orderdate", "dd-MM-yyyy").alias("Date"))
    return clean.parse_dates_strict(written)


@query("c06_drop_undated", over(_TEXT_DATES, 'SELECT o_orderkey, parsed AS "Date" FROM parsed WHERE parsed IS NOT NULL'))
def drop_undated(data):
    return clean.parse_dates(_written_dates(data).withColumnRenamed("written", "Date"))


@query(
    "c07_coerce_numbers",
    """SELECT o_orderkey, CASE o_orderkey % 8
        WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 1 THEN CAST(o_custkey AS DOUBLE) WHEN 2 THEN o_custkey * 1000.0
        WHEN 7 THEN CAST(-o_custkey AS DOUBLE) ELSE 0 END AS Total_Sold FROM orders""",
)
def coerce_numbers(data):
    key = F.col("o_custkey").cast("string")
    way = F.col("o_orderkey") % 8
    shapes = [
        key, F.concat(F.lit(" "), key, F.lit(" ")), F.concat(key, F.lit("e3")), F.concat(F.lit("1,"), key),
        F.concat(key, F.lit("d")), F.lit(""), F.concat(F.lit("0x"), key), F.concat(F.lit("-"), key),
    ]
    written = numeric.choose((way == i, shape) for i, shape in enumerate(shapes))
    cells = data.table("orders").select("o_orderkey", written.alias("Total_Sold"))
    return clean.coerce_numbers(cells)


@query(
    "c09_derive_total",
    over(LEDGER, 'SELECT station_id, "Date", CAST(coalesce(CASE WHEN dow < 5 THEN MS_Sold END, 0) + HSD1_Sold + HSD2_Sold + HSD3_Sold AS BIGINT) AS Total_Sold FROM ledger'),
)
def derive_total(data):
    parts = data.ledger.select(
        "station_id", "Date", F.when(F.weekday("Date") < 5, F.col("MS_Sold")).alias("MS_Sold"), *PRODUCTS[1:]
    )
    return clean.derive_total(parts).select("station_id", "Date", "Total_Sold")


# A label column with all spellings: the case follows the day of the month.
_LABELS = """, labelled AS (SELECT station_id, "Date", Target, CASE day("Date") % 7
  WHEN 0 THEN Refill_Required WHEN 1 THEN upper(Refill_Required) WHEN 2 THEN CAST(Target AS VARCHAR)
  WHEN 3 THEN lower(Refill_Required) WHEN 4 THEN ' ' || Refill_Required || ' ' WHEN 5 THEN NULL
  ELSE 'maybe' END AS label, day("Date") % 7 AS way FROM ledger)"""


def _labelled(data) -> DataFrame:
    yes = F.col("Refill_Required")
    forms = [yes, F.upper(yes), F.col("Target").cast("string"), F.lower(yes), F.concat(F.lit(" "), yes, F.lit(" ")),
             F.lit(None).cast("string"), F.lit("maybe")]
    way = F.dayofmonth("Date") % 7
    label = numeric.choose((way == i, form) for i, form in enumerate(forms))
    return data.ledger.select("station_id", "Date", label.alias("Refill_Required"))


@query("c10_target", over(LEDGER + _LABELS, 'SELECT station_id, "Date", CAST(CASE WHEN way < 3 THEN Target ELSE 0 END AS INTEGER) AS Target FROM labelled'))
def target(data):
    return clean.derive_target(_labelled(data)).select("station_id", "Date", "Target")


@query("c11_target_strict", over(LEDGER + _LABELS, 'SELECT station_id, "Date", CAST(CASE WHEN way = 0 THEN Target ELSE 0 END AS INTEGER) AS Target FROM labelled'))
def target_strict(data):
    return _labelled(data).select(
        "station_id", "Date", text.refill_flag_strict(F.col("Refill_Required")).alias("Target")
    )


@query("c12_says_yes", over(LEDGER + _LABELS, 'SELECT station_id, "Date", way IN (0, 1, 3, 4) AND Target = 1 AS refilled FROM labelled'))
def says_yes(data):
    return _labelled(data).select("station_id", "Date", text.says_yes(F.col("Refill_Required")).alias("refilled"))


@query("c13_derive_closing", over(LEDGER, 'SELECT station_id, "Date", greatest(Opening_Stock - Total_Sold, 0) AS Closing_Stock FROM ledger'))
def derive_closing(data):
    return clean.derive_closing(data.ledger.drop("Closing_Stock")).select("station_id", "Date", "Closing_Stock")


@query("c14_ratio_of_capacity", over(LEDGER, f'SELECT station_id, "Date", {rnd("CAST(Closing_Stock AS DOUBLE) / 12000", 4)} AS Stock_Ratio FROM ledger'))
def ratio_of_capacity(data):
    return data.ledger.select("station_id", "Date", clean.stock_ratio(PREP).alias("Stock_Ratio"))


@query(
    "c15_ratio_of_opening",
    over(
        LEDGER,
        f"""SELECT station_id, "Date", {rnd('CASE WHEN o = 0 THEN 0.0 ELSE least(greatest(CAST(Closing_Stock AS DOUBLE) / o, 0), 1) END', 4)} AS Stock_Ratio
        FROM (SELECT *, CASE WHEN Target = 1 THEN 0 ELSE Opening_Stock END AS o FROM ledger)""",
    ),
)
def ratio_of_opening(data):
    # Refill days are given a zero opening, the case without a quotient.
    zeroed = data.ledger.withColumn("Opening_Stock", F.when(F.col("Target") == 1, 0).otherwise(F.col("Opening_Stock")))
    return zeroed.select("station_id", "Date", clean.stock_ratio(SERVE).alias("Stock_Ratio"))


@query("c16_festival_flag", over(LEDGER, 'SELECT station_id, "Date", CAST(mon IN (10, 11) AS INTEGER) AS Is_Festival_Month FROM ledger'))
def festival_flag(data):
    return data.ledger.select(
        "station_id", "Date", calendar.in_months(F.month("Date"), SERVE.festival_months).alias("Is_Festival_Month")
    )


@query(
    "c17_monsoon_flag",
    over(LEDGER, 'SELECT station_id, "Date", CAST(mon IN (6, 7, 8) AS INTEGER) AS prep, CAST(mon BETWEEN 6 AND 9 AS INTEGER) AS serve FROM ledger'),
)
def monsoon_flag(data):
    month = F.month("Date")
    return data.ledger.select(
        "station_id", "Date",
        calendar.in_months(month, PREP.monsoon_months).alias("prep"),
        calendar.in_months(month, SERVE.monsoon_months).alias("serve"),
    )


@query(
    "c18_fill_zero",
    over(LEDGER, 'SELECT station_id, "Date", coalesce(CASE WHEN Target = 0 THEN Closing_Stock END, 0) AS Closing_Stock, coalesce(CASE WHEN dow < 5 THEN Total_Sold END, 0) AS Total_Sold FROM ledger'),
)
def fill_zero(data):
    gaps = data.ledger.select(
        "station_id", "Date",
        F.when(F.col("Target") == 0, F.col("Closing_Stock")).alias("Closing_Stock"),
        F.when(F.weekday("Date") < 5, F.col("Total_Sold")).alias("Total_Sold"),
    )
    return gaps.fillna(0, ["Closing_Stock", "Total_Sold"])


@query(
    "c19_candidate_features",
    over(LEDGER, "SELECT station_id, Opening_Stock, Total_Sold, MS_Sold, HSD1_Sold, HSD2_Sold, HSD3_Sold, Cash, Online, Card FROM ledger"),
)
def candidate_features(data):
    return clean.candidate_features(data.ledger)


@query(
    "c20_feature_projection",
    over(
        FEATURES,
        "SELECT " + ", ".join(f"{rnd(f'CAST({f} AS DOUBLE)', 6)} AS {f}" for f in MODEL_FEATURES)
        + ", CAST(0 AS DOUBLE) AS Not_There FROM feat",
    ),
)
def feature_projection(data):
    matrix = data.features.select(clean.feature_projection(data.features, [*MODEL_FEATURES, "Not_There"]))
    return matrix.select(*[numeric.half_even(F.col(c), 6).alias(c) for c in matrix.columns])


_ASSEMBLED = (
    "Opening_Stock", "Total_Sold", "Dip", "Stock_Ratio", "Lag1_Total_Sold", "Lag2_Total_Sold", "Lag1_Closing",
    "DOW_Avg_Sales", "Sales_Trend", "Days_Since_Refill",
)


@query(
    "c21_assembled_feature_list",
    over(
        FEATURES,
        " UNION ALL ".join(
            f"SELECT station_id, CAST({i} AS INTEGER) AS position, '{f}' AS feature, {rnd(f'avg({f})', 4)} AS mean FROM feat GROUP BY 1"
            for i, f in enumerate(_ASSEMBLED)
        ),
    ),
)
def assembled_feature_list(data):
    """The model's feature list for a small selection, with each feature's mean."""
    names = training.model_features(["Opening_Stock", "Not_There", "Total_Sold", "Dip"], data.features.columns)
    means = data.features.groupBy("station_id").agg(*[F.avg(f).alias(f) for f in names])
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("m")) for f in names])
    return means.select("station_id", F.posexplode(entries).alias("position", "_e")).select(
        "station_id", "position", "_e.feature", numeric.half_even(F.col("_e.m"), 4).alias("mean")
    )


@query(
    "c22_numeric_columns",
    over(LEDGER, "SELECT " + LEDGER_COLUMNS.replace('station_id, "Date", "Day", ', "").replace(", Refill_Required", "") + " FROM ledger"),
)
def numeric_columns(data):
    return data.ledger.select(clean.numeric_columns(data.ledger))


@query("c23_parse_litres", over(LEDGER, 'SELECT station_id, "Date", CAST(Opening_Stock AS DOUBLE) AS litres FROM ledger'))
def parse_litres(data):
    shown = data.ledger.select("station_id", "Date", text.litres(F.col("Opening_Stock")).alias("shown"))
    return shown.select("station_id", "Date", text.parse_litres(F.col("shown")).alias("litres"))


@query(
    "c24_class_subsets",
    over(
        LEDGER,
        f"""SELECT station_id, {rnd('avg(Total_Sold) FILTER (WHERE Target = 0)', 4)} AS avg_no_refill,
        count(*) FILTER (WHERE Target = 0) AS n_no_refill, {rnd('avg(Total_Sold) FILTER (WHERE Target = 1)', 4)} AS avg_refill,
        count(*) FILTER (WHERE Target = 1) AS n_refill FROM ledger GROUP BY 1""",
    ),
)
def class_subsets(data):
    return stats.class_means(data.ledger)


@query(
    "c25_weekend_subsets",
    over(
        LEDGER,
        """SELECT station_id, count(*) FILTER (WHERE dow IN (5, 6)) AS weekend_days, CAST(sum(Total_Sold) FILTER (WHERE dow IN (5, 6)) AS BIGINT) AS weekend_sold,
        count(*) FILTER (WHERE dow NOT IN (5, 6)) AS weekday_days, CAST(sum(Total_Sold) FILTER (WHERE dow NOT IN (5, 6)) AS BIGINT) AS weekday_sold
        FROM ledger GROUP BY 1""",
    ),
)
def weekend_subsets(data):
    weekend = calendar.weekday(F.col("Date")).isin(5, 6)
    return data.ledger.groupBy("station_id").agg(
        F.count_if(weekend).alias("weekend_days"),
        F.sum(F.when(weekend, F.col("Total_Sold"))).alias("weekend_sold"),
        F.count_if(~weekend).alias("weekday_days"),
        F.sum(F.when(~weekend, F.col("Total_Sold"))).alias("weekday_sold"),
    )


@query(
    "c26_month_guard",
    over(LEDGER, """SELECT station_id, "Date", CASE WHEN day("Date") % 16 BETWEEN 1 AND 12 THEN strftime(make_date(2000, CAST(day("Date") % 16 AS INTEGER), 1), '%b') END AS label FROM ledger""")
)
def month_guard(data):
    # Day numbers stand in for month numbers, so that 0 and 13 to 15 occur.
    return data.ledger.select(
        "station_id", "Date", calendar.month_label(F.dayofmonth("Date") % 16).alias("label")
    )


@query(
    "c27_first_below_threshold",
    over(
        walk(8),
        """SELECT station_id, CAST(min(step + 1) FILTER (WHERE Closing_Stock < 2000) AS INTEGER) AS day_idx,
        arg_min(strftime("Date", '%a %d-%m-%Y'), step) FILTER (WHERE Closing_Stock < 2000) AS label FROM path GROUP BY 1""",
    ),
)
def first_below_threshold(data):
    return reports.first_below(reports.stock_path(forecast.walk(data.seeded, forecast.DRAWDOWN)))


@query(
    "c28_column_guards",
    over(
        LEDGER,
        """SELECT dropped, CAST(CASE WHEN dropped = 'Dip' THEN count(DISTINCT station_id) * 7 ELSE 0 END AS BIGINT) AS n_rows
        FROM ledger, (VALUES ('Date'), ('Total_Sold'), ('Dip')) AS v(dropped) GROUP BY dropped""",
    ),
)
def column_guards(data):
    """Rows of the weekday table when a column is missing: none if it is needed, all if not."""
    counts = [
        stats.sales_by_weekday(data.ledger.drop(c)).agg(F.lit(c).alias("dropped"), F.count("*").alias("n_rows"))
        for c in ("Date", "Total_Sold", "Dip")
    ]
    return reduce(DataFrame.unionAll, counts)
