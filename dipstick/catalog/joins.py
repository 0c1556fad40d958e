"""J: lookups and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipstick.catalog.base import query
from dipstick.catalog.sql import LEDGER, MULTIPLIERS, PROFILE, over, rnd
from dipstick.config import PRODUCTS
from dipstick.functions import numeric
from dipstick.operators import forecast, profile, smote, stats
from dipstick.session import materialise
from dipstick.sources import artefacts, readers


@query(
    "j01_month_multiplier",
    over(
        MULTIPLIERS,
        """SELECT l.station_id, l."Date", coalesce(m.multiplier, 1.0) AS multiplier FROM ledger l
        LEFT JOIN (SELECT * FROM multipliers WHERE multiplier > 1) m ON m.station_id = l.station_id AND m."Month" = l.mon""",
    ),
)
def month_multiplier(data):
    """The lookup lists months above the average only; days of the others take the default."""
    known = data.multipliers.where(F.col("multiplier") > 1)
    days = data.ledger.select("station_id", "Date")
    listed = forecast.with_multipliers(days, known)
    return listed.select("station_id", "Date", forecast.month_multiplier(F.col("by_month"), F.col("Date")).alias("multiplier"))


@query(
    "j02_weekday_lookup",
    over(
        PROFILE,
        f"""SELECT f.station_id, f."Date", {rnd('p.ewm_avg', 6)} AS ewm_avg, {rnd('p.blended', 6)} AS blended, {rnd('p.MS_Sold', 6)} AS MS_share
        FROM feat f JOIN profile p ON p.station_id = f.station_id AND p.DayOfWeek = f.DayOfWeek""",
    ),
)
def weekday_lookup(data):
    lookup = profile.weekday_profile(data.features).select("station_id", "DayOfWeek", "ewm_avg", "blended", "MS_Sold")
    days = data.ledger.select("station_id", "Date", F.weekday("Date").alias("DayOfWeek"))
    return days.join(lookup, ["station_id", "DayOfWeek"], "left").select(
        "station_id", "Date",
        *[numeric.half_even(F.col(c), 6).alias(n)
          for c, n in (("ewm_avg", "ewm_avg"), ("blended", "blended"), ("MS_Sold", "MS_share"))],
    )


@query(
    "j03_feature_correlation",
    over(
        LEDGER,
        f""", listed AS (SELECT unnest(['Cash', 'Unknown']) AS Feature,
          unnest([count(*) FILTER (WHERE Target = 1), count(*) FILTER (WHERE Target = 0)]) / count(*) AS Importance FROM ledger),
        found AS (SELECT station_id, 'Cash' AS Feature, corr(Cash, Target) AS c FROM ledger GROUP BY 1)
        SELECT s.station_id, t.Feature, {rnd('t.Importance', 6)} AS Importance, {rnd('coalesce(c, 0)', 6)} AS Correlation_with_Target
        FROM (SELECT DISTINCT station_id FROM ledger) s CROSS JOIN listed t LEFT JOIN found f ON f.station_id = s.station_id AND f.Feature = t.Feature""",
    ),
)
def feature_correlation(data):
    """A listed feature that the ledger has and one that it has not; shares of refill days stand for importances."""
    refills = F.count_if(F.col("Target") == 1) / F.count("*")
    shares = data.ledger.agg(F.array(refills, 1 - refills).alias("s"))
    named = F.array(*[F.struct(F.lit(n).alias("Feature"), numeric.half_even(F.col("s")[i], 6).alias("Importance")) for i, n in enumerate(("Cash", "Unknown"))])
    return artefacts.with_correlations(shares.select(F.inline(named)), data.ledger)


@query(
    "j04_aligned_ratio",
    over(
        LEDGER,
        "SELECT a.station_id, a.dow AS DayOfWeek, " + rnd("num / den", 6) + """ AS ratio FROM
        (SELECT station_id, dow, avg(HSD1_Sold) AS num FROM ledger GROUP BY 1, 2) a JOIN
        (SELECT station_id, dow, avg(Total_Sold) AS den FROM ledger GROUP BY 1, 2) b ON a.station_id = b.station_id AND a.dow = b.dow""",
    ),
)
def aligned_ratio(data):
    """Two grouped means divided key by key: one aggregate, no join."""
    dated = data.ledger.withColumn("DayOfWeek", F.weekday("Date"))
    return profile.product_shares(dated).select(
        "station_id", "DayOfWeek", numeric.half_even(F.col(PRODUCTS[1]), 6).alias("ratio")
    )


@query(
    "j05_all_weekdays",
    over(
        LEDGER,
        f""", months AS (SELECT *, station_id || strftime("Date", ' %Y-%m') AS station_month FROM ledger)
        SELECT s.station_month AS station_id, CAST(d AS INTEGER) AS DayOfWeek, {rnd('coalesce(avg(l.Total_Sold), 0)', 4)} AS avg_sold
        FROM (SELECT DISTINCT station_month FROM months) s, range(7) AS t(d)
        LEFT JOIN months l ON l.station_month = s.station_month AND l.dow = d GROUP BY 1, 2""",
    ),
)
def all_weekdays(data):
    """Seven rows for every station's month, whichever weekdays it has."""
    month = F.concat("station_id", F.date_format("Date", " yyyy-MM"))
    return stats.sales_by_weekday(data.ledger.withColumn("station_id", month), 4).select(
        "station_id", "DayOfWeek", "avg_sold"
    )


_NEIGHBOUR_FEATURES = ("Opening_Stock", "Total_Sold", "MS_Sold", "HSD1_Sold", "HSD2_Sold", "HSD3_Sold")

_DISTANCE = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in _NEIGHBOUR_FEATURES)
_NEAREST = LEDGER + f""", part AS (SELECT *, CASE WHEN rn <= floor(count(*) OVER (PARTITION BY station_id) * CAST(0.8 AS DOUBLE)) THEN 1 ELSE 0 END AS train FROM ledger),
    minority AS MATERIALIZED (SELECT p.* FROM part p JOIN (
      SELECT station_id, CASE WHEN count(*) FILTER (WHERE Target = 1) <= count(*) FILTER (WHERE Target = 0) THEN 1 ELSE 0 END AS c
      FROM part WHERE train = 1 GROUP BY 1) s ON p.station_id = s.station_id AND p.Target = s.c WHERE train = 1),
    nearest AS MATERIALIZED (SELECT a.station_id, a."Date", b."Date" AS neighbour, {rnd(f'sqrt(CAST({_DISTANCE} AS DOUBLE))', 6)} AS distance,
      CAST(row_number() OVER (PARTITION BY a.station_id, a."Date" ORDER BY {_DISTANCE}, b."Date") AS INTEGER) AS rank
    FROM minority a JOIN minority b ON a.station_id = b.station_id AND a."Date" <> b."Date"
    QUALIFY rank <= 5)"""


def _neighbours(data) -> DataFrame:
    split = stats.timeline.chronological_split(data.ledger)
    minority = smote.minority_rows(split.where(F.col("split") == "train"))
    return smote.neighbours(minority, _NEIGHBOUR_FEATURES)


@query("m04_neighbours", over(_NEAREST, "SELECT * FROM nearest"))
def minority_neighbours(data):
    return _neighbours(data).select("station_id", "Date", "rank", "neighbour", numeric.half_even(F.col("distance"), 6).alias("distance"))


@query(
    "j07_neighbour_join",
    over(
        _NEAREST,
        """SELECT a.station_id, a."Date", a.rank, a.neighbour, b.rank AS rank_back, a.distance
        FROM nearest a JOIN nearest b ON a.station_id = b.station_id AND a."Date" = b.neighbour AND a.neighbour = b."Date" WHERE a."Date" < a.neighbour""",
    ),
)
def neighbour_join(data):
    """Pairs of refill days each of which is among the other's nearest: the neighbour table joined with itself."""
    return smote.mutual_neighbours(materialise(_neighbours(data), "near")).withColumn("distance", numeric.half_even(F.col("distance"), 6))


@query(
    "j08_qualifying_sheets",
    over(
        LEDGER,
        """SELECT station_id || strftime("Date", ' %Y-%m') AS _sheet, "Date", Total_Sold FROM ledger
        QUALIFY count(*) OVER (PARTITION BY station_id, strftime("Date", ' %Y-%m')) > 5""",
    ),
)
def qualifying_sheets(data):
    """Every station's month as a sheet; months of at most five days are dropped."""
    sheet = F.concat("station_id", F.date_format("Date", " yyyy-MM"))
    return readers.qualifying_rows(data.ledger.select(sheet.alias("_sheet"), "Date", "Total_Sold"))
