"""A, T and U: aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dipstick.catalog.base import query
from dipstick.catalog.sql import FEATURES, LEDGER, LEDGER_COLUMNS, MULTIPLIERS, over, rnd
from dipstick.catalog.windows import GAPPY, gappy
from dipstick.config import EXPECTED_COLUMNS, PRODUCTS, SALES
from dipstick.functions import numeric
from dipstick.operators import profile, quantiles, stats, timeline
from dipstick.plans import training

_MONTHS = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"
_DAYS = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"

_MEANS = """, means AS (
  SELECT s.station_id, CAST(d AS INTEGER) AS DayOfWeek, m
  FROM (SELECT DISTINCT station_id FROM ledger) s, range(7) AS t(d)
    LEFT JOIN (SELECT station_id, dow, avg(Total_Sold) AS m FROM ledger GROUP BY 1, 2) a
      ON a.station_id = s.station_id AND a.dow = d)"""


def _weekday_sql(columns: str) -> str:
    return over(LEDGER + _MEANS, f"SELECT station_id, DayOfWeek, {columns} FROM means")


@query("a01_sales_by_weekday", _weekday_sql(f'{_DAYS}[DayOfWeek + 1] AS "Day", {rnd("coalesce(m, 0)", 4)} AS avg_sold'))
def sales_by_weekday(data):
    return stats.sales_by_weekday(data.ledger, 4).select("station_id", "DayOfWeek", "Day", "avg_sold")


@query("a02_best_weekday", _weekday_sql("m = max(m) OVER (PARTITION BY station_id) AS is_best"))
def best_weekday(data):
    return stats.sales_by_weekday(data.ledger).select("station_id", "DayOfWeek", "is_best")


@query(
    "a03_mean_of_means",
    over(
        LEDGER,
        f"""SELECT d.station_id, {rnd('d.m', 4)} AS weekdays, {rnd('n.m', 4)} AS months FROM
        (SELECT station_id, avg(m) AS m FROM (SELECT station_id, dow, avg(Total_Sold) AS m FROM ledger GROUP BY 1, 2) GROUP BY 1) d JOIN
        (SELECT station_id, avg(m) AS m FROM (SELECT station_id, mon, avg(Total_Sold) AS m FROM ledger GROUP BY 1, 2) GROUP BY 1) n
        ON d.station_id = n.station_id""",
    ),
)
def mean_of_means(data):
    weekdays = stats.sales_by_weekday(data.ledger, 4).groupBy("station_id").agg(
        F.first("mean_of_means").alias("weekdays")
    )
    months = stats.mean_of_month_means(data.ledger, 4).withColumnRenamed("mean_of_means", "months")
    return weekdays.join(months, "station_id")


@query(
    "a04_sales_by_month",
    over(LEDGER, f'SELECT station_id, mon AS "Month", {_MONTHS}[mon] AS label, {rnd("avg(Total_Sold)", 4)} AS avg_sold FROM ledger GROUP BY station_id, mon'),
)
def sales_by_month(data):
    return profile.label_months(stats.sales_by_month(data.ledger, 4))


@query(
    "a05_sales_by_year",
    over(LEDGER, 'SELECT station_id, CAST(year("Date") AS INTEGER) AS "Year", CAST(sum(Total_Sold) AS BIGINT) / 1000 AS kilolitres FROM ledger GROUP BY 1, 2'),
)
def sales_by_year(data):
    return stats.sales_by_year(data.ledger)


@query(
    "a06_class_counts",
    over(LEDGER, f"SELECT station_id, Target, count(*) AS n, {rnd('count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY station_id)', 1)} AS pct FROM ledger GROUP BY 1, 2"),
)
def class_counts(data):
    return stats.class_counts(data.ledger)


@query(
    "a07_refill_pivot",
    over(
        LEDGER,
        'SELECT station_id, mon AS "Month", '
        + ", ".join(
            f"coalesce({rnd(f'avg(Target) FILTER (WHERE dow = {i})', 4)}, 0) AS \"{d}\""
            for i, d in enumerate(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"))
        )
        + " FROM ledger GROUP BY 1, 2",
    ),
)
def refill_pivot(data):
    return stats.refill_pivot(data.ledger)


_HISTOGRAM = """, ranges AS (
  SELECT {by}, CAST(min({x}) AS DOUBLE) AS lo, CAST(max({x}) AS DOUBLE) AS hi FROM ledger GROUP BY {by}
), bins AS (SELECT *, CAST(b AS INTEGER) AS bin FROM ranges, range({n}) AS t(b)), counts AS (
  SELECT {by}, CAST(least(floor(({x} - lo) * {n} / (hi - lo)), {n} - 1) AS INTEGER) AS bin, count(*) AS n
  FROM ledger JOIN ranges USING ({by}) GROUP BY {by}, 3_
)
SELECT {by}, bin, round(lo + bin * ((hi - lo) / {n}), 6) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / {n}), 6) AS bin_hi,
  coalesce(n, 0) AS n FROM bins LEFT JOIN counts USING ({by}, bin)"""


def _histogram_sql(by: str, x: str, n: int) -> str:
    position = len(by.split(",")) + 1
    return over(LEDGER, _HISTOGRAM.format(by=by, x=x, n=n).replace("3_", str(position)))


def _rounded_bins(df):
    return df.withColumns({c: F.round(c, 6) for c in ("bin_lo", "bin_hi")})


@query("a08_opening_histogram", _histogram_sql("station_id", "Opening_Stock", 40))
def opening_histogram(data):
    return _rounded_bins(stats.histogram(data.ledger, "Opening_Stock", 40))


@query("a09_class_histogram", _histogram_sql("station_id, Target", "Total_Sold", 30))
def class_histogram(data):
    return _rounded_bins(stats.class_histogram(data.ledger, 30))


@query("a09_class_histogram_35", _histogram_sql("station_id, Target", "Total_Sold", 35))
def class_histogram_35(data):
    return _rounded_bins(stats.class_histogram(data.ledger, 35))


@query(
    "a10_class_means",
    over(LEDGER, f"SELECT station_id, Target, {rnd('avg(Total_Sold)', 4)} AS avg_sold, {rnd('avg(Opening_Stock)', 4)} AS avg_opening FROM ledger GROUP BY 1, 2"),
)
def class_means(data):
    return data.ledger.groupBy("station_id", "Target").agg(
        numeric.half_even(F.avg("Total_Sold"), 4).alias("avg_sold"),
        numeric.half_even(F.avg("Opening_Stock"), 4).alias("avg_opening"),
    )


_LEDGER_NUMBERS = ("Opening_Stock", "Total_Sold", *PRODUCTS, "Cash", "Online", "Card", "Dip", "Closing_Stock", "Target")


@query(
    "a11_describe",
    over(
        LEDGER,
        " UNION ALL ".join(
            f"""SELECT station_id, '{c}' AS "column", count({c}) AS "count", {rnd(f'avg({c})', 2)} AS mean,
            {rnd(f'stddev_samp({c})', 2)} AS std, {rnd(f'min({c})', 2)} AS min, {rnd(f'quantile_cont({c}, 0.25)', 2)} AS q25,
            {rnd(f'quantile_cont({c}, 0.5)', 2)} AS q50, {rnd(f'quantile_cont({c}, 0.75)', 2)} AS q75, {rnd(f'max({c})', 2)} AS max
            FROM ledger GROUP BY 1"""
            for c in _LEDGER_NUMBERS
        ),
    ),
)
def describe(data):
    return stats.describe(data.ledger)


_GAPPY_TYPES = {"Date": "date", "Day": "string", "Opening_Stock": "bigint", "Total_Sold": "bigint", "Closing_Stock": "bigint", "Refill_Required": "string"}


@query(
    "a12_column_profile",
    over(
        LEDGER + GAPPY,
        " UNION ALL ".join(
            f"""SELECT station_id, '{c}' AS "column", '{t}' AS dtype, count("{c}") AS non_null, count(*) - count("{c}") AS missing,
            {rnd(f'(count(*) - count("{c}")) * 100.0::DOUBLE / count(*)', 2)} AS pct_missing,
            CAST(arg_min("{c}", "Date") FILTER (WHERE "{c}" IS NOT NULL) AS VARCHAR) AS sample FROM gappy GROUP BY 1"""
            for c, t in _GAPPY_TYPES.items()
        ),
    ),
)
def column_profile(data):
    return stats.column_profile(gappy(data.ledger))


@query(
    "a13_missing_cells",
    over(LEDGER + GAPPY, "SELECT station_id, CAST(sum(CAST(Total_Sold IS NULL AS INTEGER) + CAST(Closing_Stock IS NULL AS INTEGER)) AS BIGINT) AS missing_cells FROM gappy GROUP BY 1"),
)
def missing_cells(data):
    return stats.missing_cells(gappy(data.ledger))


@query(
    "a14_shape",
    over(LEDGER, 'SELECT station_id, count(*) AS n_rows, CAST(16 AS INTEGER) AS n_columns, min("Date") AS first_date, max("Date") AS last_date FROM ledger GROUP BY 1'),
)
def shape(data):
    return stats.shape(data.ledger)


@query(
    "a15_kpis",
    over(
        LEDGER,
        f"""SELECT station_id, n_days, avg_daily_sales, current_stock, refills, {rnd('current_stock / 12000 * 100', 4)} AS stock_pct,
          CASE WHEN current_stock / 12000 * 100 < 25 THEN 'danger' WHEN current_stock / 12000 * 100 < 50 THEN 'warning' ELSE 'success' END AS stock_band,
          {rnd('refills * 100.0::DOUBLE / n_days', 1)} AS refill_pct
        FROM (SELECT station_id, count(*) AS n_days, {rnd('avg(Total_Sold)', 4)} AS avg_daily_sales,
          CAST(arg_max(Closing_Stock, "Date") AS DOUBLE) AS current_stock, CAST(sum(Target) AS BIGINT) AS refills FROM ledger GROUP BY 1)""",
    ),
)
def kpis(data):
    return stats.kpis(data.ledger)


_PRESENT = {"Date", "Opening_Stock", "Closing_Stock", "Total_Sold", "Target", "Refill_Required", "Day"}


@query(
    "a16_presence",
    over(
        LEDGER,
        " UNION ALL ".join(
            f"""SELECT station_id, '{c}' AS "column", 'Present' AS status, CAST(arg_min("{c}", "Date") AS VARCHAR) AS sample FROM ledger GROUP BY 1"""
            if c in _PRESENT
            else f"""SELECT DISTINCT station_id, '{c}', 'Missing', '—' FROM ledger"""
            for c in EXPECTED_COLUMNS
        ),
    ),
)
def presence(data):
    return stats.presence(data.ledger)


@query(
    "a17_weekend_uplift",
    over(
        LEDGER,
        f"""SELECT station_id, {rnd('wd', 4)} AS weekday_avg, {rnd('we', 4)} AS weekend_avg, {rnd('(we - wd) * 100 / wd', 4)} AS uplift_pct
        FROM (SELECT station_id, avg(Total_Sold) FILTER (WHERE dow < 5) AS wd, avg(Total_Sold) FILTER (WHERE dow >= 5) AS we FROM ledger GROUP BY 1)""",
    ),
)
def weekend_uplift(data):
    return stats.weekend_uplift(data.ledger)


@query(
    "a18_peak_month",
    over(
        LEDGER,
        f"""SELECT station_id, mon AS peak_month, {rnd('m', 4)} AS peak_avg FROM
        (SELECT station_id, mon, avg(Total_Sold) AS m FROM ledger GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY m DESC, mon) = 1""",
    ),
)
def peak_month(data):
    return stats.peak_month(data.ledger)


@query(
    "a19_refill_cadence",
    over(LEDGER, f"SELECT station_id, CAST(sum(Target) AS BIGINT) AS refills, count(*) AS n_days, {rnd('CASE WHEN sum(Target) = 0 THEN 0 ELSE count(*) / sum(Target) END', 4)} AS days_per_refill FROM ledger GROUP BY 1"),
)
def refill_cadence(data):
    return stats.refill_cadence(data.ledger)


@query("a20_mean_closing", over(LEDGER, f"SELECT station_id, {rnd('avg(Closing_Stock)', 4)} AS avg_closing FROM ledger GROUP BY 1"))
def mean_closing(data):
    return stats.mean_closing(data.ledger)


@query(
    "a17_a20_observations",
    over(
        LEDGER,
        f""", months AS (SELECT station_id, mon, avg(Total_Sold) AS m FROM ledger GROUP BY 1, 2),
        peak AS (SELECT * FROM months QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY m DESC, mon) = 1)
        SELECT l.station_id, {rnd('we', 4)} AS weekend_avg, {rnd('wd', 4)} AS weekday_avg, {rnd('(we - wd) * 100 / wd', 1)} AS uplift_pct,
          mon AS peak_month, {rnd('m', 4)} AS peak_avg, refills, n_days, {rnd('n_days / refills', 1)} AS days_per_refill, {rnd('c', 4)} AS avg_closing
        FROM (SELECT station_id, avg(Total_Sold) FILTER (WHERE dow < 5) AS wd, avg(Total_Sold) FILTER (WHERE dow >= 5) AS we,
          CAST(sum(Target) AS BIGINT) AS refills, count(*) AS n_days, avg(Closing_Stock) AS c FROM ledger GROUP BY 1) l
        JOIN peak ON l.station_id = peak.station_id""",
    ),
)
def observations(data):
    return stats.observations(data.ledger)


@query(
    "a21_product_shares",
    over(
        LEDGER,
        "SELECT station_id, dow AS DayOfWeek, "
        + ", ".join(f"{rnd(f'avg({p}) / avg(Total_Sold)', 6)} AS {p}" for p in PRODUCTS)
        + " FROM ledger GROUP BY 1, 2",
    ),
)
def product_shares(data):
    dated = data.ledger.withColumn("DayOfWeek", F.weekday("Date"))
    shares = profile.product_shares(dated)
    return shares.withColumns({p: numeric.half_even(F.col(p), 6) for p in PRODUCTS})


@query("a22_monthly_multipliers", over(MULTIPLIERS, "SELECT * FROM multipliers"))
def monthly_multipliers(data):
    return profile.monthly_multipliers(data.ledger)


@query(
    "a23_outlier_report",
    over(
        LEDGER,
        ", q AS (SELECT station_id, "
        + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in SALES)
        + " FROM ledger GROUP BY 1) "
        + " UNION ALL ".join(
            f"""SELECT station_id, '{c}' AS feature, {rnd(f'any_value({c}_1 - 1.5 * ({c}_3 - {c}_1))', 2)} AS lower_bound,
            {rnd(f'any_value({c}_3 + 1.5 * ({c}_3 - {c}_1))', 2)} AS upper_bound,
            count(*) FILTER (WHERE {c} < {c}_1 - 1.5 * ({c}_3 - {c}_1) OR {c} > {c}_3 + 1.5 * ({c}_3 - {c}_1)) AS outliers
            FROM ledger JOIN q USING (station_id) GROUP BY 1"""
            for c in SALES
        ),
    ),
)
def outlier_report(data):
    return stats.outlier_report(data.ledger)


_BOUNDS = ", bounds AS (SELECT station_id, " + ", ".join(
    f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in SALES
) + " FROM ledger GROUP BY 1)"


_SHARES = (0.01, 0.25, 0.5, 0.75, 0.99)


@query(
    "a24_quantiles_by_ranges",
    over(
        LEDGER,
        " UNION ALL ".join(
            f"""SELECT station_id, '{c}' AS "column", CAST({q} AS DOUBLE) AS share, {rnd(f'quantile_cont(CAST({c} AS DOUBLE), {q})', 4)} AS value FROM ledger GROUP BY 1"""
            for c in SALES
            for q in _SHARES
        ),
    ),
)
def quantiles_by_ranges(data):
    """Quartiles and capping bounds by counted ranges: the same values, and no buffer of distinct ones."""
    return quantiles.exact_quantiles(data.ledger, SALES, _SHARES).withColumn("value", numeric.half_even(F.col("value"), 4))


@query(
    "a24_winsorise",
    over(
        LEDGER + _BOUNDS,
        'SELECT station_id, "Date", '
        + ", ".join(f"{rnd(f'least(greatest(CAST({c} AS DOUBLE), {c}_lo), {c}_hi)', 4)} AS {c}" for c in SALES)
        + " FROM ledger JOIN bounds USING (station_id)",
    ),
)
def winsorise(data):
    capped = profile.winsorise(data.ledger)
    return capped.select("station_id", "Date", *[numeric.half_even(F.col(c), 4).alias(c) for c in SALES])


@query(
    "a24_capping_report",
    over(
        LEDGER + _BOUNDS,
        " UNION ALL ".join(
            f"""SELECT station_id, '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS min_before, CAST(max({c}) AS DOUBLE) AS max_before,
            {rnd(f'any_value({c}_lo)', 4)} AS min_after, {rnd(f'any_value({c}_hi)', 4)} AS max_after
            FROM ledger JOIN bounds USING (station_id) GROUP BY 1"""
            for c in SALES
        ),
    ),
)
def capping_report(data):
    return stats.capping_report(data.ledger, profile.winsorise(data.ledger))


# Station-wise features whose spread is never zero, and one that is constant.
_CORRELATED = ("Opening_Stock", "Prev_Closing", "Total_Sold", "Cash", "HSD1_Sold", "Rolling_7d_Sales", "DayOfWeek", "Lag1_Total_Sold")


def _corr_sql(feature: str, other: str = "Target") -> str:
    return rnd(f"CASE WHEN isnan(corr({feature}, {other})) THEN NULL ELSE corr({feature}, {other}) END", 6)


@query(
    "a25_correlation_with_target",
    over(
        FEATURES + ", flat AS (SELECT *, 1 AS Constant, CASE WHEN dow < 5 THEN HSD2_Sold END AS Sparse FROM feat)",
        " UNION ALL ".join(
            f"SELECT station_id, '{f}' AS feature, {_corr_sql(f)} AS correlation FROM flat GROUP BY 1"
            for f in (*_CORRELATED, "Constant", "Sparse")
        ),
    ),
)
def correlation_with_target(data):
    df = data.features.withColumns(
        {"Constant": F.lit(1), "Sparse": F.when(F.col("DayOfWeek") < 5, F.col("HSD2_Sold"))}
    )
    return stats.correlations(df, (*_CORRELATED, "Constant", "Sparse"))


_MATRIX = _CORRELATED[:6]


def _matrix_sql(keep) -> str:
    return over(
        FEATURES,
        " UNION ALL ".join(
            f"""SELECT station_id, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, '{a}' AS feature, '{b}' AS other,
            {_corr_sql(a, b) if i != j else 'CAST(1 AS DOUBLE)'} AS correlation FROM feat GROUP BY 1"""
            for i, a in enumerate(_MATRIX)
            for j, b in enumerate(_MATRIX)
            if keep(i, j)
        ),
    )


@query("a26_correlation_matrix", _matrix_sql(lambda i, j: True))
def correlation_matrix(data):
    return stats.correlation_matrix(data.features, _MATRIX)


@query("a27_lower_triangle", _matrix_sql(lambda i, j: i > j))
def lower_triangle(data):
    return stats.lower_triangle(stats.correlation_matrix(data.features, _MATRIX))


@query(
    "a28_summary",
    over(LEDGER, f"""SELECT station_id, {rnd('avg(Total_Sold)', 4)} AS mean, CAST(sum(Total_Sold) AS BIGINT) AS "sum", count(Total_Sold) AS "count", min(Total_Sold) AS "min", max(Total_Sold) AS "max" FROM ledger GROUP BY 1"""),
)
def summary(data):
    return stats.summary(data.ledger)


@query(
    "a29_split_report",
    over(
        LEDGER,
        f"""SELECT station_id, split, count(*) AS n_days, CAST(sum(Target) AS BIGINT) AS refills, {rnd('avg(Target) * 100', 1)} AS refill_pct,
          min("Date") AS first_date, max("Date") AS last_date FROM (SELECT *, CASE WHEN rn <= floor(count(*) OVER (PARTITION BY station_id)
            * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM ledger) GROUP BY 1, 2""",
    ),
)
def split_report(data):
    return stats.split_report(data.ledger)


@query("a30_weekdays_present", over(LEDGER, "SELECT DISTINCT station_id, dow AS DayOfWeek FROM ledger"))
def weekdays_present(data):
    return stats.weekdays_present(data.ledger)


@query("a31_any_correlation", over(LEDGER, "SELECT station_id, abs(corr(Opening_Stock, Target)) + abs(corr(Total_Sold, Target)) > 0 AS any_correlation FROM ledger GROUP BY 1"))
def any_correlation(data):
    return stats.any_correlation(stats.correlations(data.ledger, ["Opening_Stock", "Total_Sold"]))


@query("t01_sort_by_date", over(LEDGER, f'SELECT {LEDGER_COLUMNS}, CAST(rn - 1 AS INTEGER) AS position FROM ledger ORDER BY station_id, "Date"'))
def sort_by_date(data):
    position = (F.row_number().over(timeline.days()) - 1).cast("int")
    return data.ledger.withColumn("position", position).orderBy("station_id", "Date")


_RANKED = ("Opening_Stock", "Total_Sold", *PRODUCTS, "Cash", "Online", "Card", "Year", "Month", "DayOfWeek", "Quarter",
           "Is_Weekend", "Day_Num", "Rolling_7d_Sales", "Prev_Closing", "Is_Festival_Month", "Is_Monsoon_Month")
_PREPARED = FEATURES + f""", prepared AS (SELECT station_id, Target, Opening_Stock, Total_Sold, MS_Sold, HSD1_Sold, HSD2_Sold, HSD3_Sold,
  Cash, Online, Card, "Year", "Month", DayOfWeek, quarter("Date") AS "Quarter", Is_Weekend, DayOfWeek AS Day_Num,
  {rnd('avg(Total_Sold) OVER (PARTITION BY station_id ORDER BY "Date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 0)} AS Rolling_7d_Sales,
  lag(Closing_Stock, 1, 12000) OVER (PARTITION BY station_id ORDER BY "Date") AS Prev_Closing,
  Is_Festival_Month, CAST(mon BETWEEN 6 AND 8 AS INTEGER) AS Is_Monsoon_Month FROM feat)"""


@query(
    "t02_correlation_ranking",
    over(
        _PREPARED,
        " UNION ALL ".join(
            f"SELECT station_id, '{f}' AS feature, {_corr_sql(f)} AS correlation FROM prepared GROUP BY 1" for f in _RANKED
        ),
    ),
)
def correlation_ranking(data):
    return training.correlation_ranking(data.prepared)


@query("t04_tails", over(
    LEDGER,
    """SELECT station_id, "Date", Total_Sold, 'last 7' AS part FROM ledger
      QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY "Date" DESC) <= 7
    UNION ALL SELECT station_id, "Date", Total_Sold, 'last 60' FROM ledger
      QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY "Date" DESC) <= 60
    UNION ALL SELECT station_id, "Date", Total_Sold, 'weekday 4' FROM ledger
      QUALIFY row_number() OVER (PARTITION BY station_id, dow ORDER BY "Date" DESC) <= 4""",
))
def tails(data):
    days = data.ledger.select("station_id", "Date", "Total_Sold")
    same_day = timeline.same_weekday().orderBy(F.desc("Date"))
    per_weekday = (
        days.withColumn("DayOfWeek", F.weekday("Date"))
        .withColumn("_back", F.row_number().over(same_day))
        .where(F.col("_back") <= 4)
        .select("station_id", "Date", "Total_Sold", F.lit("weekday 4").alias("part"))
    )
    last = [timeline.tail(days, k).withColumn("part", F.lit(f"last {k}")) for k in (7, 60)]
    return last[0].unionByName(last[1]).unionByName(per_weekday)
