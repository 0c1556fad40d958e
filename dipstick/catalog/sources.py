"""S: scans, sources and sinks. Files are written from the ledger and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipstick.catalog.base import query
from dipstick.catalog.sql import FEATURES, LEDGER, LEDGER_COLUMNS, MULTIPLIERS, SCORED, over, rnd
from dipstick.config import MODEL_FEATURES, SALES
from dipstick.functions import numeric
from dipstick.operators import clean, features, metrics, model, stats
from dipstick.sources import artefacts, readers, sinks, synthetic

_TYPED = 'station_id, "Date", CAST(Opening_Stock AS DOUBLE) AS Opening_Stock, CAST(Total_Sold AS DOUBLE) AS Total_Sold, CAST(Closing_Stock AS DOUBLE) AS Closing_Stock, Refill_Required'


def _typed(text: DataFrame) -> DataFrame:
    return clean.coerce_numbers(clean.parse_dates(text)).select(
        "station_id", "Date", "Opening_Stock", "Total_Sold", "Closing_Stock", "Refill_Required"
    )


@query("s01_csv_scan", over(LEDGER, f"SELECT {_TYPED} FROM ledger"))
def csv_scan(data):
    return _typed(readers.read_csv(data.spark, data.ledger_csv, data.ledger.columns))


@query("s02_csv_scan_dated", over(LEDGER, 'SELECT station_id, "Date", CAST(Total_Sold AS VARCHAR) AS Total_Sold FROM ledger'))
def csv_scan_dated(data):
    return readers.read_csv_dated(data.spark, data.ledger_csv).select("station_id", "Date", "Total_Sold")


def _workbook(data) -> str:
    """The ledger as a workbook: a sheet per year, the first ones with more columns or another date name.

    One row of the second year is repeated, and a last sheet holds only a legend of five rows.
    """
    root = data.path("workbook")
    year = F.year("Date")
    plain = data.ledger.select("station_id", "Date", "Total_Sold")
    first = data.ledger.agg(F.min(F.year("Date"))).first()[0]
    sinks.write_csv(
        data.ledger.where(year == first).select("station_id", F.col("Date").alias(" Date "), "Total_Sold", "Dip"),
        f"{root}/{first}.csv",
    )
    rest = plain.where(year > first)
    repeated = rest.where(year == first + 1)
    sinks.write_csv(repeated.unionAll(repeated).withColumnRenamed("Date", "DATE"), f"{root}/{first + 1}.csv")
    sinks.write_csv(rest.where(year > first + 1), f"{root}/later.csv")
    legend = plain.groupBy("station_id").agg(F.min("Date").alias("Date"), F.lit(-1).alias("Total_Sold"))
    sinks.write_csv(legend, f"{root}/legend.csv")
    return root


_SHEETS = """, sheets AS (
  SELECT station_id, "Date", CAST(Total_Sold AS VARCHAR) AS Total_Sold,
    CASE WHEN year("Date") = y THEN CAST(Dip AS VARCHAR) END AS Dip,
    CASE WHEN year("Date") = y THEN CAST(y AS VARCHAR) || '.csv' WHEN year("Date") = y + 1 THEN CAST(y + 1 AS VARCHAR) || '.csv' ELSE 'later.csv' END AS sheet
  FROM ledger, (SELECT min(year("Date")) AS y FROM ledger)
), scanned AS (
  SELECT * FROM sheets
  UNION ALL SELECT * FROM sheets WHERE sheet = (SELECT CAST(min(year("Date")) + 1 AS VARCHAR) || '.csv' FROM ledger)
  UNION ALL SELECT station_id, min("Date"), '-1', NULL, 'legend.csv' FROM ledger GROUP BY 1
)"""


@query("s03_all_sheets", over(LEDGER + _SHEETS, 'SELECT station_id, "Date", Total_Sold, Dip FROM sheets'))
def all_sheets(data):
    return readers.read_sheets(data.spark, _workbook(data))


@query(
    "s03_sheet_scan",
    over(LEDGER + _SHEETS, 'SELECT station_id, CAST("Date" AS VARCHAR) AS "Date", Total_Sold, Dip, sheet AS _sheet FROM scanned'),
)
def sheet_scan(data):
    return readers.scan_sheets(data.spark, _workbook(data))


@query(
    "s04_first_sheet",
    over(LEDGER + _SHEETS, 'SELECT station_id, CAST("Date" AS VARCHAR) AS "Date", Total_Sold, Dip FROM sheets WHERE Dip IS NOT NULL'),
)
def first_sheet(data):
    return readers.read_first_sheet(data.spark, _workbook(data))


@query(
    "s05_tiny_sheets_dropped",
    over(LEDGER + _SHEETS, "SELECT sheet AS _sheet, count(*) AS n_rows FROM scanned GROUP BY 1 HAVING count(*) > 5"),
)
def tiny_sheets_dropped(data):
    return readers.sheet_sizes(readers.qualifying_rows(readers.scan_sheets(data.spark, _workbook(data))))


@query(
    "s06_single_sheet_as_is",
    over(LEDGER, """SELECT 'one' AS kind, station_id, CAST("Date" AS VARCHAR) AS "Date" FROM ledger WHERE Target = 1
      UNION ALL SELECT 'one', station_id, CAST("Date" AS VARCHAR) FROM ledger WHERE Target = 1
      UNION ALL SELECT 'none', station_id, CAST(max("Date") AS VARCHAR) FROM ledger GROUP BY station_id"""),
)
def single_sheet_as_is(data):
    """A workbook with one sheet that is large enough keeps its duplicates; one without any gives its first."""
    refills = data.ledger.where(F.col("Target") == 1).select("station_id", "Date")
    ends = data.ledger.groupBy("station_id").agg(F.max("Date").alias("Date"))
    one, none = data.path("workbook"), data.path("workbook")
    sinks.write_csv(refills.unionAll(refills), f"{one}/b.csv")
    sinks.write_csv(ends, f"{one}/a.csv")
    sinks.write_csv(ends, f"{none}/a.csv")
    kinds = [readers.read_sheets(data.spark, p).withColumn("kind", F.lit(k)) for k, p in (("one", one), ("none", none))]
    return kinds[0].unionByName(kinds[1])


def _candidates(data) -> list[str]:
    """Three sources: refill days, the whole ledger, the whole ledger again under another name."""
    paths = [data.path("source") for _ in range(3)]
    marked = [
        data.ledger.where(F.col("Target") == 1).withColumn("source", F.lit("refills")),
        data.ledger.withColumn("source", F.lit("all")),
        data.ledger.withColumn("source", F.lit("copy")),
    ]
    for df, path in zip(marked, paths):
        sinks.write_csv(df.select("station_id", "Date", "source"), path)
    return paths


@query("s07_largest_source", over(LEDGER, """SELECT station_id, CAST("Date" AS VARCHAR) AS "Date", 'all' AS source FROM ledger"""))
def largest_source(data):
    return readers.largest_source(data.spark, _candidates(data))


@query("s08_missing_source_skipped", over(LEDGER, """SELECT station_id, CAST("Date" AS VARCHAR) AS "Date", 'refills' AS source FROM ledger WHERE Target = 1"""))
def missing_source_skipped(data):
    return readers.largest_source(data.spark, [data.path("absent"), _candidates(data)[0]])


@query(
    "s09_suffix_dispatch",
    over(LEDGER, "SELECT 'csv' AS kind, count(*) AS n_rows FROM ledger UNION ALL SELECT 'sheets', count(*) FROM ledger"),
)
def suffix_dispatch(data):
    """The same rows through a CSV path and, with a repeat, through a workbook path that removes it."""
    book = data.path("ledger") + ".XLSX"
    plain = data.ledger.select("station_id", "Date", "Total_Sold")
    for sheet in ("a.csv", "b.csv"):
        sinks.write_csv(plain, f"{book}/{sheet}")
    paths = (data.ledger_csv, book)
    counts = [
        readers.read_source(data.spark, p).agg(F.lit(readers.source_kind(p)).alias("kind"), F.count("*").alias("n_rows"))
        for p in paths
    ]
    return reduce(DataFrame.unionAll, counts)


@query(
    "s10_row_count_check",
    over(LEDGER, "SELECT station_id, count(*) AS n_rows, count(*) < 1700 AS low FROM ledger GROUP BY 1"),
)
def row_count_check(data):
    return readers.row_count_check(data.ledger, 1700)


# One shared table of multipliers: month means over the mean of all stations' days.
_SHARED = over(LEDGER, f""", m AS (SELECT mon, {rnd('avg(Total_Sold) / (SELECT avg(Total_Sold) FROM ledger)', 4)} AS multiplier FROM ledger GROUP BY 1)""")


def _shared_multipliers(data) -> DataFrame:
    overall = data.ledger.agg(F.avg("Total_Sold")).scalar()
    return data.ledger.groupBy(F.month("Date").alias("Month")).agg(F.avg("Total_Sold").alias("m")).select(
        "Month", numeric.half_even(F.col("m") / overall, 4).alias("multiplier")
    )


@query("s11_read_multipliers", over(_SHARED, 'SELECT mon AS "Month", multiplier FROM m'))
def read_multipliers(data):
    path = sinks.write_json_object(_shared_multipliers(data), "Month", "multiplier", data.path("multipliers"))
    absent = artefacts.read_multipliers(data.spark, data.path("absent"))
    return artefacts.read_multipliers(data.spark, path).unionByName(absent)


def _strong(data) -> DataFrame:
    """Sales columns in order of their litres over all days."""
    sums = data.ledger.agg(*[F.sum(c).alias(c) for c in SALES])
    listed = sums.select(F.inline(F.sort_array(
        F.array(*[F.struct((-F.col(c)).alias("minus"), F.lit(c).alias("Feature")) for c in SALES])
    )))
    return listed


@query(
    "s12_read_features",
    over(
        LEDGER,
        "SELECT CAST(row_number() OVER (ORDER BY s DESC) - 1 AS INTEGER) AS position, f AS Feature FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS f, sum({c}) AS s FROM ledger" for c in SALES)
        + ")",
    ),
)
def read_features(data):
    path = sinks.write_json_list(_strong(data), "minus", "Feature", data.path("features"))
    return artefacts.read_features(data.spark, path)


def scored(data) -> DataFrame:
    """A deterministic rule in place of a model, so that metrics can be checked exactly."""
    level = numeric.clip((F.lit(16500.0) - F.col("Opening_Stock")) / 12000, 0.0, 1.0)
    score = numeric.half_even(level, 2)
    return data.ledger.select(
        "station_id", "Date", "Target", score.alias("score"), (score >= 0.83).cast("int").alias("prediction")
    )


@query(
    "s13_read_metrics",
    over(
        SCORED,
        f"""SELECT station_id, {rnd('avg(CAST(Target = prediction AS INTEGER))', 4)} AS accuracy, CAST(0.96 AS DOUBLE) AS f1_score, CAST(0.99 AS DOUBLE) AS roc_auc
        FROM scored GROUP BY 1""",
    ),
)
def read_metrics(data):
    """Stored metrics without F1 and AUC: these take their defaults."""
    stored = metrics.metrics_record(scored(data)).select("station_id", "accuracy")
    return artefacts.read_metrics(data.spark, sinks.write_records(stored, data.path("metrics")))


@query(
    "s14_importance_table",
    over(
        LEDGER,
        f""", listed AS (SELECT unnest(['Opening_Stock', 'Total_Sold', 'Not_There']) AS Feature,
          unnest([sum(Opening_Stock), sum(Total_Sold), sum(Closing_Stock)]) / sum(Opening_Stock + Total_Sold + Closing_Stock) AS Importance FROM ledger),
        found AS (SELECT station_id, unnest(['Opening_Stock', 'Total_Sold']) AS Feature,
          unnest([corr(Opening_Stock, Target), corr(Total_Sold, Target)]) AS c FROM ledger GROUP BY 1)
        SELECT s.station_id, t.Feature, {rnd('t.Importance', 6)} AS Importance, {rnd('coalesce(c, 0)', 6)} AS Correlation_with_Target
        FROM (SELECT DISTINCT station_id FROM ledger) s CROSS JOIN listed t LEFT JOIN found f ON f.station_id = s.station_id AND f.Feature = t.Feature""",
    ),
)
def importance_table(data):
    """A stored table of importances (shares of litres stand for them), one for a feature that the ledger has not."""
    columns = {"Opening_Stock": "Opening_Stock", "Total_Sold": "Total_Sold", "Not_There": "Closing_Stock"}
    sums = data.ledger.agg(*[F.sum(F.col(c).cast("double")).alias(f) for f, c in columns.items()])
    whole = sum((F.col(f) for f in columns), F.lit(0.0))
    entries = [F.struct(F.lit(f).alias("Feature"), numeric.half_even(F.col(f) / whole, 6).alias("Importance")) for f in columns]
    path = sinks.write_csv(sums.select(F.inline(F.array(*entries))), data.path("importances"))
    return artefacts.read_importances(data.spark, path, data.ledger)


@query(
    "s15_model_load",
    over(LEDGER, "SELECT station_id, count(*) AS n_days, count(*) AS same FROM ledger GROUP BY 1"),
)
def model_load(data):
    """Days on which a stored and reloaded model scores as the fitted one does."""
    fitted = data.trained.model
    path = artefacts.save_model(fitted, data.path("model"))
    both = [model.score(m, data.features).select("station_id", "Date", F.col("score").alias(n))
            for m, n in ((fitted, "fitted"), (artefacts.load_model(path), "loaded"))]
    return both[0].join(both[1], ["station_id", "Date"]).groupBy("station_id").agg(
        F.count("*").alias("n_days"), F.count_if(F.col("fitted") == F.col("loaded")).alias("same")
    )


@query(
    "s18_model_sink",
    over(
        FEATURES,
        "SELECT station_id, CAST(i AS INTEGER) AS position, f AS Feature, count(*) AS n_days FROM feat, (VALUES "
        + ", ".join(f"({i}, '{f}')" for i, f in enumerate(MODEL_FEATURES))
        + ") AS t(i, f) GROUP BY 1, 2, 3",
    ),
)
def model_sink(data):
    """The ordered feature contract of a stored model, and on how many days each station can meet it."""
    path = artefacts.save_model(data.trained.model, data.path("model"))
    names = artefacts.load_model(path).stages[0].getInputCols()
    filled = data.features.groupBy("station_id").agg(*[F.count(f).alias(f) for f in names])
    entries = [F.struct(F.lit(i).alias("position"), F.lit(f).alias("Feature"), F.col(f).alias("n_days")) for i, f in enumerate(names)]
    return filled.select("station_id", F.inline(F.array(*entries)))


@query("s16_csv_sink", over(LEDGER, f"SELECT {_TYPED} FROM ledger"))
def csv_sink(data):
    path = sinks.write_csv(data.ledger, data.path("clean"), ("station_id",))
    return _typed(readers.read_csv(data.spark, path))


@query("s17_json_sinks", over(_SHARED, "SELECT 'multipliers' AS artefact, count(*) AS entries FROM m UNION ALL SELECT 'features', 5 UNION ALL SELECT 'metrics', (SELECT count(DISTINCT station_id) FROM ledger)"))
def json_sinks(data):
    spark = data.spark
    multipliers = sinks.write_json_object(_shared_multipliers(data), "Month", "multiplier", data.path("multipliers"))
    listed = sinks.write_json_list(_strong(data), "minus", "Feature", data.path("features"))
    record = sinks.write_records(metrics.metrics_record(scored(data)), data.path("metrics"))
    back = {
        "multipliers": artefacts.read_multipliers(spark, multipliers),
        "features": artefacts.read_features(spark, listed),
        "metrics": artefacts.read_metrics(spark, record),
    }
    counts = [df.agg(F.lit(n).alias("artefact"), F.count("*").alias("entries")) for n, df in back.items()]
    return reduce(DataFrame.unionAll, counts)


@query(
    "s20_date_spine",
    """SELECT station_id, CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS DATE) AS "Date"
    FROM (SELECT DISTINCT c_mktsegment AS station_id FROM customer), range(365) AS t(i)""",
)
def date_spine(data):
    stations = data.table("customer").select(F.col("c_mktsegment").alias("station_id")).distinct()
    return synthetic.date_spine(stations, "2024-01-01", 365)


@query("s21_preview", over(LEDGER, f'SELECT {LEDGER_COLUMNS} FROM ledger ORDER BY "Date", station_id LIMIT 5'))
def preview(data):
    return readers.preview(data.ledger)


@query("t05_head_per_station", over(LEDGER, 'SELECT station_id, "Date", Total_Sold FROM ledger QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY "Date") <= 8'))
def head_per_station(data):
    first = F.row_number().over(stats.timeline.days())
    return data.ledger.select("station_id", "Date", "Total_Sold").withColumn("_at", first).where(F.col("_at") <= 8).drop("_at")


@query("u01_union_by_name", over(LEDGER + _SHEETS, 'SELECT station_id, CAST("Date" AS VARCHAR) AS "Date", Total_Sold, Dip FROM scanned'))
def union_by_name(data):
    return readers.scan_sheets(data.spark, _workbook(data)).drop("_sheet")


@query("u02_exact_duplicates", over(LEDGER, 'SELECT DISTINCT station_id, "Date", t.v AS Total_Sold FROM ledger, (SELECT unnest([0, 1]) AS k) s, LATERAL (SELECT CASE WHEN k = 1 AND Target = 1 THEN NULL ELSE Total_Sold END AS v) t'))
def exact_duplicates(data):
    """The ledger and a copy whose sales are unknown on refill days: only equal rows merge."""
    days = data.ledger.select("station_id", "Date", "Total_Sold")
    unknown = data.ledger.select(
        "station_id", "Date", F.when(F.col("Target") == 0, F.col("Total_Sold")).alias("Total_Sold")
    )
    return readers.combine_sheets(days.unionAll(unknown).unionAll(unknown))


@query(
    "u03_list_operations",
    over(
        LEDGER,
        """, m AS (SELECT station_id, mon, bool_or(Target = 1 AND day("Date") = 1) AS first_day FROM ledger GROUP BY 1, 2)
        SELECT station_id, CASE WHEN first_day THEN 'both' ELSE 'difference' END AS kind, mon AS "Month" FROM m""",
    ),
)
def list_operations(data):
    """A station's months against those with a refill on their first day: difference and intersection."""
    opened = (F.col("Target") == 1) & (F.dayofmonth("Date") == 1)
    sets = data.ledger.groupBy("station_id").agg(
        F.collect_set(F.month("Date")).alias("months"),
        F.collect_set(F.when(opened, F.month("Date"))).alias("opened"),
    )
    parts = [
        sets.select("station_id", F.lit(kind).alias("kind"), F.explode(fn("months", "opened")).alias("Month"))
        for kind, fn in (("difference", F.array_except), ("both", F.array_intersect))
    ]
    return parts[0].unionAll(parts[1])
