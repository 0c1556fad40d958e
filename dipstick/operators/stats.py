"""Aggregates behind every chart, card and report; all per station, all partially aggregated."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipstick.config import EXPECTED_COLUMNS, PRODUCTS, SALES, SERVE, WEEKDAYS, Tank
from dipstick.functions import calendar, numeric, text
from dipstick.operators import clean, timeline


def _long(df: DataFrame, rows: dict[str, Sequence[Column]], names: Sequence[str], key: str = "column") -> DataFrame:
    """One row per entry of ``rows`` from a wide one-row-per-station aggregate."""
    entries = F.array(
        *[F.struct(F.lit(k).alias(key), *[v.alias(n) for n, v in zip(names, vs)]) for k, vs in rows.items()]
    )
    return df.select("station_id", F.inline(entries))


def sales_by_weekday(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Mean sales for all seven weekdays in calendar order, 0 for a weekday without rows.

    Carries the mark of the best day and the mean of the seven means. The means come out of one
    aggregate as a map of at most seven entries, so no dimension join is needed.
    """
    guard = clean.empty_unless(
        df, ["station_id", "Date", "Total_Sold"],
        "station_id string, DayOfWeek int, Day string, avg_sold double, is_best boolean, mean_of_means double",
    )
    if guard is not None:
        return guard
    dow = calendar.weekday(F.col("Date"))
    means = (
        df.groupBy("station_id", dow.alias("_dow"))
        .agg(F.avg("Total_Sold").alias("_mean"))
        .groupBy("station_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("_dow", "_mean"))).alias("_means"))
    )
    known = F.map_values("_means")
    mean_of_means = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    mean = F.coalesce(F.col("_means")[F.col("DayOfWeek")], F.lit(0.0))
    return means.select(
        "station_id",
        F.explode(F.sequence(F.lit(0), F.lit(6))).alias("DayOfWeek"),
        "_means",
        F.array_max(known).alias("_best"),
        mean_of_means.alias("_mean_of_means"),
    ).select(
        "station_id",
        "DayOfWeek",
        F.get(names, F.col("DayOfWeek")).alias("Day"),
        numeric.half_even(mean, digits).alias("avg_sold"),
        (mean == F.col("_best")).alias("is_best"),
        numeric.half_even(F.col("_mean_of_means"), digits).alias("mean_of_means"),
    )


def sales_by_month(df: DataFrame, digits: int | None = None) -> DataFrame:
    return df.groupBy("station_id", F.month("Date").alias("Month")).agg(
        numeric.half_even(F.avg("Total_Sold"), digits).alias("avg_sold")
    )


def mean_of_month_means(df: DataFrame, digits: int | None = None) -> DataFrame:
    """The reference line of the month chart: the mean of the monthly means."""
    return sales_by_month(df).groupBy("station_id").agg(
        numeric.half_even(F.avg("avg_sold"), digits).alias("mean_of_means")
    )


def sales_by_year(df: DataFrame) -> DataFrame:
    """Total per year in kilolitres."""
    return df.groupBy("station_id", F.year("Date").alias("Year")).agg((F.sum("Total_Sold") / 1000).alias("kilolitres"))


def class_counts(df: DataFrame, digits: int = 1) -> DataFrame:
    counts = df.groupBy("station_id", "Target").agg(F.count("*").alias("n"))
    total = F.sum("n").over(timeline.station())
    return counts.withColumn("pct", numeric.half_even(F.col("n") * 100.0 / total, digits))


def class_means(df: DataFrame, column: str = "Total_Sold", digits: int = 4) -> DataFrame:
    """Mean on days without and with refill, and how many there are, in one pass."""
    return df.groupBy("station_id").agg(
        *[
            e
            for value, name in ((0, "no_refill"), (1, "refill"))
            for e in (
                numeric.half_even(F.avg(F.when(F.col("Target") == value, F.col(column))), digits).alias(f"avg_{name}"),
                F.count_if(F.col("Target") == value).alias(f"n_{name}"),
            )
        ]
    )


def refill_pivot(df: DataFrame, fill: float | None = 0.0, digits: int = 4) -> DataFrame:
    """Refill rate by month (rows) and weekday (columns)."""
    names = [n[:3] for n in WEEKDAYS]
    wide = (
        df.withColumns({"Month": F.month("Date"), "_dow": calendar.weekday(F.col("Date"))})
        .groupBy("station_id", "Month")
        .pivot("_dow", list(range(7)))
        .agg(numeric.half_even(F.avg("Target"), digits))
        .toDF("station_id", "Month", *names)
    )
    return wide if fill is None else wide.fillna(fill, names)


def histogram(df: DataFrame, column: str, bins: int = 40, by: Sequence[str] = ("station_id",)) -> DataFrame:
    """Equal-width bins from min to max, last bin closed; empty bins are listed with 0.

    Ranges and counts are two aggregates; the counts per group are at most ``bins`` rows.
    """
    by = list(by)
    ranges = df.groupBy(*by).agg(
        F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")
    )
    x, lo, hi = F.col(column).cast("double"), F.col("lo"), F.col("hi")
    # A constant column has the range lo - 0.5 .. lo + 0.5, so its values fall in the middle bin.
    flat = lo == hi
    ranges = ranges.select(*by, F.when(flat, lo - 0.5).otherwise(lo).alias("lo"), F.when(flat, hi + 0.5).otherwise(hi).alias("hi"))
    at = F.least(F.floor((x - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = (
        df.where(F.col(column).isNotNull())
        .join(ranges, by)
        .groupBy(*by, at.alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    every = ranges.select(*by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (hi - lo) / bins
    return every.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (lo + F.col("bin") * width).alias("bin_lo"),
        (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def class_histogram(df: DataFrame, bins: int = 30, column: str = "Total_Sold") -> DataFrame:
    """A histogram per refill class, each over its own range."""
    return histogram(df, column, bins, ("station_id", "Target"))


def _unpivot(df: DataFrame, keep: Sequence[str], columns: Sequence[str], key: str) -> DataFrame:
    """One row per station, row and column: (keep..., key, value). Narrow aggregates over this compile
    to tight loops, where dozens of wide ones would not; map-side sums undo the extra rows at once."""
    values = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return values.unpivot(list(keep), list(columns), key, "value")


def describe(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per numeric column, in one pass."""
    columns = list(columns or clean.numeric_columns(df))
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    # Generated row by row, which keeps the partitioning by station; unpivot would lose it.
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    found = df.select("station_id", F.inline(cells)).groupBy("station_id", "column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), quartiles, F.max("value").alias("max"),
    )
    values = {"mean": F.col("mean"), "std": F.col("std"), "min": F.col("min")}
    values |= {name: F.col("q")[i] for i, name in enumerate(("q25", "q50", "q75"))} | {"max": F.col("max")}
    return found.select("station_id", "column", "count", *[numeric.half_even(v, digits).alias(n) for n, v in values.items()])


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type, filled and missing cells and the first filled value by date, per column."""
    columns = [c for c in (columns or df.columns) if c != "station_id"]
    wide = df.groupBy("station_id").agg(
        F.count("*").alias("_rows"),
        *[
            e
            for c in columns
            for e in (
                F.count(c).alias(f"{c}_n"),
                F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col("Date"))).alias(f"{c}_v"),
            )
        ],
    )
    rows = {}
    for c in columns:
        missing = F.col("_rows") - F.col(f"{c}_n")
        rows[c] = [
            F.lit(df.schema[c].dataType.simpleString()),
            F.col(f"{c}_n"),
            missing,
            numeric.half_even(numeric.percent(missing, F.col("_rows")), 2),
            F.coalesce(F.col(f"{c}_v"), F.lit("—")),
        ]
    return _long(wide, rows, ["dtype", "non_null", "missing", "pct_missing", "sample"])


def presence(df: DataFrame, expected: Sequence[str] = EXPECTED_COLUMNS) -> DataFrame:
    """Which expected columns a ledger has, with a sample value cut to 30 characters."""
    there = [c for c in expected if c in df.columns]
    wide = df.groupBy("station_id").agg(
        *[
            F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col("Date"))).alias(c)
            for c in there
        ]
    )
    rows = {
        c: [F.lit("Present" if c in there else "Missing"),
            text.shorten(F.coalesce(F.col(c), F.lit("—")), 30) if c in there else F.lit("—")]
        for c in expected
    }
    return _long(wide, rows, ["status", "sample"])


def missing_cells(df: DataFrame) -> DataFrame:
    columns = [c for c in df.columns if c != "station_id"]
    gaps = reduce(lambda a, b: a + b, [F.count("*") - F.count(c) for c in columns])
    return df.groupBy("station_id").agg(gaps.alias("missing_cells"))


def shape(df: DataFrame) -> DataFrame:
    return df.groupBy("station_id").agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
    )


def kpis(df: DataFrame, cfg: Tank = SERVE) -> DataFrame:
    """The key-figure row: days, mean sales, current stock, share of capacity, refills."""
    pct = F.col("current_stock") / cfg.capacity * 100
    return (
        df.groupBy("station_id")
        .agg(
            F.count("*").alias("n_days"),
            numeric.half_even(F.avg("Total_Sold"), 4).alias("avg_daily_sales"),
            F.max_by("Closing_Stock", "Date").cast("double").alias("current_stock"),
            F.sum("Target").alias("refills"),
        )
        .withColumns(
            {
                "stock_pct": numeric.half_even(pct, 4),
                "stock_band": numeric.stock_band(pct),
                "refill_pct": numeric.half_even(numeric.percent(F.col("refills"), F.col("n_days")), 1),
            }
        )
    )


def weekend_uplift(df: DataFrame, digits: int = 4) -> DataFrame:
    weekend = calendar.weekday(F.col("Date")).isin(5, 6)
    return (
        df.groupBy("station_id")
        .agg(
            F.avg(F.when(~weekend, F.col("Total_Sold"))).alias("weekday_avg"),
            F.avg(F.when(weekend, F.col("Total_Sold"))).alias("weekend_avg"),
        )
        .withColumn(
            "uplift_pct", numeric.percent(F.col("weekend_avg") - F.col("weekday_avg"), F.col("weekday_avg"))
        )
        .withColumns({c: numeric.half_even(F.col(c), digits) for c in ("weekday_avg", "weekend_avg", "uplift_pct")})
    )


def peak_month(df: DataFrame, digits: int = 4) -> DataFrame:
    """The month with the highest mean, the first one on ties."""
    means = sales_by_month(df)
    order = F.struct(F.col("avg_sold"), -F.col("Month"))
    return means.groupBy("station_id").agg(
        F.max_by("Month", order).alias("peak_month"),
        numeric.half_even(F.max("avg_sold"), digits).alias("peak_avg"),
    )


def refill_cadence(df: DataFrame, digits: int = 4) -> DataFrame:
    """Days per refill, 0 without refills."""
    return df.groupBy("station_id").agg(
        F.sum("Target").alias("refills"),
        F.count("*").alias("n_days"),
        numeric.half_even(numeric.safe_ratio(F.count("*"), F.sum("Target")), digits).alias("days_per_refill"),
    )


def mean_closing(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.groupBy("station_id").agg(numeric.half_even(F.avg("Closing_Stock"), digits).alias("avg_closing"))


def summary(df: DataFrame, column: str = "Total_Sold") -> DataFrame:
    return df.groupBy("station_id").agg(
        numeric.half_even(F.avg(column), 4).alias("mean"),
        F.sum(column).alias("sum"),
        F.count(column).alias("count"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )


def outlier_report(df: DataFrame, columns: Sequence[str] = SALES) -> DataFrame:
    """Rows outside the quartiles by more than 1.5 interquartile ranges, per column."""
    quartiles = F.array(F.lit(0.25), F.lit(0.75))
    fences = df.groupBy("station_id").agg(*[F.percentile(c, quartiles).alias(f"{c}_q") for c in columns])

    def fence(c: str, side: int) -> Column:
        q1, q3 = F.col(f"{c}_q")[0], F.col(f"{c}_q")[1]
        return q3 + 1.5 * (q3 - q1) if side else q1 - 1.5 * (q3 - q1)

    bounds = fences.select(
        "station_id", *[fence(c, s).alias(f"{c}_{n}") for c in columns for s, n in ((0, "lo"), (1, "hi"))]
    )
    wide = (
        df.select("station_id", *columns)
        .join(bounds, "station_id")
        .groupBy("station_id")
        .agg(
            *[
                e
                for c in columns
                for e in (
                    F.first(f"{c}_lo").alias(f"{c}_lo"),
                    F.first(f"{c}_hi").alias(f"{c}_hi"),
                    F.count_if((F.col(c) < F.col(f"{c}_lo")) | (F.col(c) > F.col(f"{c}_hi"))).alias(f"{c}_n"),
                )
            ]
        )
    )
    rows = {
        c: [numeric.half_even(F.col(f"{c}_lo"), 2), numeric.half_even(F.col(f"{c}_hi"), 2), F.col(f"{c}_n")]
        for c in columns
    }
    return _long(wide, rows, ["lower_bound", "upper_bound", "outliers"], "feature")


def capping_report(before: DataFrame, after: DataFrame, columns: Sequence[str] = SALES) -> DataFrame:
    """Extremes per column before and after capping, in one pass over both."""
    marked = before.select("station_id", F.lit(0).alias("_after"), *[F.col(c).cast("double") for c in columns]).unionByName(
        after.select("station_id", F.lit(1).alias("_after"), *[F.col(c).cast("double") for c in columns])
    )
    wide = marked.groupBy("station_id").agg(
        *[
            fn(F.when(F.col("_after") == side, F.col(c))).alias(f"{c}_{side}_{name}")
            for c in columns
            for side in (0, 1)
            for fn, name in ((F.min, "min"), (F.max, "max"))
        ]
    )
    rows = {
        c: [numeric.half_even(F.col(f"{c}_{side}_{name}"), 4) for side in (0, 1) for name in ("min", "max")]
        for c in columns
    }
    return _long(wide, rows, ["min_before", "max_before", "min_after", "max_after"], "feature")


def correlations(df: DataFrame, features: Sequence[str], target: str = "Target", digits: int = 6) -> DataFrame:
    """Pearson correlation of every feature with the target."""
    return (
        _unpivot(df.withColumn("_y", F.col(target).cast("double")), ["station_id", "_y"], features, "feature")
        .groupBy("station_id", "feature")
        .agg(numeric.half_even(numeric.pearson(F.col("value"), F.col("_y")), digits).alias("correlation"))
    )


def _cross_products(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per station and pattern of known features: count, sums, products, least and largest values.

    The products of all pairs of a row are added in one buffer, so a row stays one row, and every task
    sends one buffer a station. Values are taken from those of some row: sums near zero keep their digits.
    """
    xs = [F.col(f).cast("double") for f in features]
    origin = df.select(F.struct(*[x.alias(f"x{i}") for i, x in enumerate(xs)])).limit(1).scalar()
    moved = [F.coalesce(x - F.coalesce(origin[f"x{i}"], F.lit(0.0)), F.lit(0.0)).alias(f"x{i}") for i, x in enumerate(xs)]
    known = F.array(*[x.isNotNull() for x in xs]).alias("known")
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1)]
    return df.select("station_id", known, *moved).groupBy("station_id", "known").agg(
        F.count("*").cast("double").alias("n"),
        *[f(f"x{i}").alias(f"{name}{i}") for f, name in ((F.sum, "s"), (F.min, "lo"), (F.max, "hi")) for i in range(len(features))],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs],
    )


def correlation_matrix(df: DataFrame, features: Sequence[str], digits: int = 6) -> DataFrame:
    """Long-form matrix over complete pairs; each pair of features is computed once, the mirror half comes from it."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1)]
    at = {pair: n for n, pair in enumerate(pairs)}
    packed = _cross_products(df, features).select(
        "station_id", "known", "n",
        *[F.array(*[f"{name}{i}" for i in range(len(features))]).alias(name) for name in ("s", "lo", "hi")],
        F.array(*[f"p{i}_{j}" for i, j in pairs]).alias("p"),
        F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("i", "j", "xx", "yy", "xy"), (i, j, at[i, i], at[j, j], at[i, j]))]) for i, j in pairs])).alias("at"),
    )
    i, j = F.col("at.i"), F.col("at.j")
    # Patterns that lack one of the two take no part, but leave a row of the pair.
    spread = packed.select(
        "station_id", i.alias("i"), j.alias("j"), (F.get("known", i) & F.get("known", j)).alias("both"), "n",
        F.get("s", i).alias("x"), F.get("s", j).alias("y"), *[F.get("p", F.col(f"at.{c}")).alias(c) for c in ("xx", "yy", "xy")],
        *[F.get(end, k).alias(f"{end}_{v}") for end in ("lo", "hi") for v, k in (("x", i), ("y", j))],
    )
    found = spread.groupBy("station_id", "i", "j").agg(
        *[F.sum(F.when(F.col("both"), F.col(c))).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")],
        *[f(F.when(F.col("both"), F.col(f"{name}_{v}"))).alias(f"{name}_{v}") for f, name in ((F.min, "lo"), (F.max, "hi")) for v in "xy"],
    )
    n = F.col("n")
    shared = F.col("xy") - F.col("x") * F.col("y") / n
    own = F.sqrt(F.col("xx") - F.col("x") * F.col("x") / n) * F.sqrt(F.col("yy") - F.col("y") * F.col("y") / n)
    varies = (F.col("lo_x") < F.col("hi_x")) & (F.col("lo_y") < F.col("hi_y"))
    value = F.when(varies, F.try_divide(shared, own))
    lower = found.select("station_id", "i", "j", numeric.half_even(value, digits).alias("correlation"))
    here, there = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    sides = F.when(F.col("i") == F.col("j"), F.array(here)).otherwise(F.array(here, there))
    name = F.array(*[F.lit(f) for f in features])
    return lower.select("station_id", "correlation", F.explode(sides).alias("_at")).select(
        "station_id", "_at.i", "_at.j",
        F.get(name, F.col("_at.i")).alias("feature"), F.get(name, F.col("_at.j")).alias("other"),
        "correlation",
    )


def lower_triangle(matrix: DataFrame) -> DataFrame:
    return matrix.where(F.col("i") > F.col("j"))


def any_correlation(table: DataFrame) -> DataFrame:
    """Whether any correlation is there to be shown."""
    return table.groupBy("station_id").agg((F.sum(F.abs("correlation")) > 0).alias("any_correlation"))


def split_report(df: DataFrame, share: float = 0.8) -> DataFrame:
    return (
        timeline.chronological_split(df, share)
        .groupBy("station_id", "split")
        .agg(
            F.count("*").alias("n_days"),
            F.sum("Target").alias("refills"),
            numeric.half_even(F.avg("Target") * 100, 1).alias("refill_pct"),
            F.min("Date").alias("first_date"),
            F.max("Date").alias("last_date"),
        )
    )


def weekdays_present(df: DataFrame) -> DataFrame:
    return df.select("station_id", calendar.weekday(F.col("Date")).alias("DayOfWeek")).distinct()


def observations(df: DataFrame) -> DataFrame:
    """The four key observations of a station in one row.

    Weekday, month and total figures all come out of sums per station, month and weekend flag, so
    the ledger is aggregated once.
    """
    weekend = calendar.weekday(F.col("Date")).isin(5, 6)
    cells = df.groupBy("station_id", F.month("Date").alias("Month"), weekend.alias("_we")).agg(
        F.sum("Total_Sold").alias("_sold"), F.count("*").alias("_n"),
        F.sum("Target").alias("_refills"), F.sum("Closing_Stock").alias("_closing"),
    )
    months = cells.groupBy("station_id", "Month").agg(
        *[F.sum(c).alias(c) for c in ("_sold", "_n", "_refills", "_closing")],
        *[F.sum(F.when(F.col("_we") == flag, F.col(c))).alias(f"{c}_{flag}")
          for c in ("_sold", "_n") for flag in (True, False)],
    ).withColumn("_mean", F.col("_sold") / F.col("_n"))
    best = F.struct(F.col("_mean"), -F.col("Month"))
    return (
        months.groupBy("station_id")
        .agg(
            F.try_divide(F.sum("_sold_True"), F.sum("_n_True")).alias("weekend_avg"),
            F.try_divide(F.sum("_sold_False"), F.sum("_n_False")).alias("weekday_avg"),
            F.max_by("Month", best).alias("peak_month"),
            F.max("_mean").alias("peak_avg"),
            F.sum("_refills").alias("refills"),
            F.sum("_n").alias("n_days"),
            F.sum("_closing").alias("_closing"),
        )
        .select(
            "station_id",
            numeric.half_even(F.col("weekend_avg"), 4).alias("weekend_avg"),
            numeric.half_even(F.col("weekday_avg"), 4).alias("weekday_avg"),
            numeric.half_even(numeric.percent(F.col("weekend_avg") - F.col("weekday_avg"), F.col("weekday_avg")), 1).alias("uplift_pct"),
            "peak_month",
            numeric.half_even(F.col("peak_avg"), 4).alias("peak_avg"),
            "refills",
            "n_days",
            numeric.half_even(numeric.safe_ratio(F.col("n_days"), F.col("refills")), 1).alias("days_per_refill"),
            numeric.half_even(F.col("_closing") / F.col("n_days"), 4).alias("avg_closing"),
        )
    )
