"""SQL building blocks of the oracles: common table expressions put in front of a query."""

from __future__ import annotations

_PRODUCTS = {
    "MS_Sold": "('PROMO')",
    "HSD1_Sold": "('ECONOMY', 'LARGE')",
    "HSD2_Sold": "('MEDIUM', 'SMALL')",
    "HSD3_Sold": "('STANDARD')",
}
_PAYMENTS = {
    "Cash": "('1-URGENT', '2-HIGH')",
    "Online": "('3-MEDIUM', '4-NOT SPECIFIED')",
    "Card": "('5-LOW')",
}

_raw_products = ",\n    ".join(
    f"CAST(sum(CASE WHEN p_type IN {types} THEN l_quantity ELSE 0 END) AS BIGINT) AS {name}"
    for name, types in _PRODUCTS.items()
)
_raw_payments = ",\n    ".join(
    f"CAST(sum(CASE WHEN o_orderpriority IN {keys} THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END)"
    f" AS BIGINT) AS {name}"
    for name, keys in _PAYMENTS.items()
)


def _scaled(column: str, name: str) -> str:
    return (
        f"CAST(({column} * 4500 * count(*) OVER (PARTITION BY station_id))"
        f" // CAST(sum(q) OVER (PARTITION BY station_id) AS BIGINT) AS BIGINT) AS {name}"
    )


LEDGER = f"""WITH RECURSIVE raw_days AS (
  SELECT c_mktsegment AS station_id, CAST(o_orderdate AS DATE) AS "Date",
    CAST(sum(l_quantity) AS BIGINT) AS q,
    {_raw_products},
    {_raw_payments}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2
), sales AS MATERIALIZED (
  SELECT station_id, "Date", row_number() OVER (PARTITION BY station_id ORDER BY "Date") AS rn,
    {_scaled('q', 'Total_Sold')},
    {", ".join(_scaled(p, p) for p in _PRODUCTS)},
    Cash, Online, Card
  FROM raw_days
), stock AS (
  SELECT station_id, rn, CAST(12000 AS BIGINT) AS opening, greatest(0, 12000 - Total_Sold) AS closing
  FROM sales WHERE rn = 1
  UNION ALL
  SELECT s.station_id, s.rn, CASE WHEN k.closing < 2000 THEN 12000 ELSE k.closing END,
    greatest(0, CASE WHEN k.closing < 2000 THEN 12000 ELSE k.closing END - s.Total_Sold)
  FROM stock k JOIN sales s ON s.station_id = k.station_id AND s.rn = k.rn + 1
), ledger AS MATERIALIZED (
  SELECT s.station_id, s."Date", dayname(s."Date") AS "Day", k.opening AS Opening_Stock, s.Total_Sold,
    s.MS_Sold, s.HSD1_Sold, s.HSD2_Sold, s.HSD3_Sold, s.Cash, s.Online, s.Card,
    CAST(greatest(1, k.closing // 200) AS BIGINT) AS Dip, k.closing AS Closing_Stock,
    CAST(k.closing < 2000 AS INTEGER) AS Target,
    CASE WHEN k.closing < 2000 THEN 'Yes' ELSE 'No' END AS Refill_Required, s.rn,
    CAST(isodow(s."Date") - 1 AS INTEGER) AS dow, CAST(month(s."Date") AS INTEGER) AS mon
  FROM sales s JOIN stock k ON s.station_id = k.station_id AND s.rn = k.rn
)"""

LEDGER_COLUMNS = (
    'station_id, "Date", "Day", Opening_Stock, Total_Sold, MS_Sold, HSD1_Sold, HSD2_Sold, HSD3_Sold, '
    "Cash, Online, Card, Dip, Closing_Stock, Target, Refill_Required"
)

A, B = "CAST(0.2222222222222222 AS DOUBLE)", "CAST(0.7777777777777778 AS DOUBLE)"


def rnd(x: str, digits: int) -> str:
    """Half-even rounding by scaling, the rule of array libraries."""
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


FEATURES = LEDGER + f""", ewm AS (
  SELECT station_id, "Date" AS d, list_reduce(
      list(CAST(Total_Sold AS DOUBLE)) OVER (PARTITION BY station_id, dow ORDER BY "Date"
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      lambda y, x: CASE WHEN y = x THEN y ELSE y * {B} + x * {A} END) AS y
  FROM ledger
), windows AS (
  SELECT *,
    avg(Total_Sold) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling,
    avg(Total_Sold) OVER (PARTITION BY station_id) AS mean_sold,
    avg(Opening_Stock) OVER (PARTITION BY station_id) AS mean_open,
    lag(Total_Sold, 1) OVER w AS l1, lag(Total_Sold, 2) OVER w AS l2, lag(Closing_Stock, 1) OVER w AS lc,
    rn - coalesce(max(CASE WHEN prev_target = 1 THEN rn END) OVER w, 1) AS since
  FROM (SELECT *, lag(Target) OVER (PARTITION BY station_id ORDER BY "Date") AS prev_target FROM ledger)
  WINDOW w AS (PARTITION BY station_id ORDER BY "Date")
), feat AS MATERIALIZED (
  SELECT {", ".join(f"windows.{c.strip()}" for c in LEDGER_COLUMNS.split(","))}, rn, dow, mon, mean_sold, prev_target,
    mon AS "Month", CAST(year("Date") AS INTEGER) AS "Year", dow AS DayOfWeek,
    CAST(dow >= 5 AS INTEGER) AS Is_Weekend,
    {rnd('rolling', 2)} AS Rolling_7d_Sales,
    CAST(coalesce(lc, 0) AS DOUBLE) AS Prev_Closing,
    {rnd('CASE WHEN Opening_Stock = 0 THEN 0.0 ELSE least(greatest(CAST(Closing_Stock AS DOUBLE) / Opening_Stock, 0), 1) END', 4)} AS Stock_Ratio,
    CAST(mon IN (10, 11) AS INTEGER) AS Is_Festival_Month, CAST(mon IN (6, 7, 8, 9) AS INTEGER) AS Is_Monsoon_Month,
    coalesce(CAST(l1 AS DOUBLE), mean_sold) AS Lag1_Total_Sold,
    coalesce(CAST(l2 AS DOUBLE), mean_sold) AS Lag2_Total_Sold,
    coalesce(CAST(lc AS DOUBLE), mean_open) AS Lag1_Closing,
    ewm.y AS DOW_Avg_Sales,
    {rnd(rnd('rolling', 2) + ' / mean_sold', 4)} AS Sales_Trend,
    CAST(since AS INTEGER) AS Days_Since_Refill
  FROM windows JOIN ewm ON windows.station_id = ewm.station_id AND windows."Date" = ewm.d
)"""

PROFILE = FEATURES + """, weekdays AS (
  SELECT * FROM (SELECT DISTINCT station_id, mean_sold FROM feat), range(7) AS t(d)
), per_day AS (
  SELECT station_id, dow, arg_max(DOW_Avg_Sales, "Date") AS ewm_avg,
    avg(Total_Sold) FILTER (WHERE back <= 4) AS recent_avg,
    avg(MS_Sold) / avg(Total_Sold) AS MS_Sold, avg(HSD1_Sold) / avg(Total_Sold) AS HSD1_Sold,
    avg(HSD2_Sold) / avg(Total_Sold) AS HSD2_Sold, avg(HSD3_Sold) / avg(Total_Sold) AS HSD3_Sold
  FROM (SELECT *, row_number() OVER (PARTITION BY station_id, dow ORDER BY "Date" DESC) AS back FROM feat)
  GROUP BY 1, 2
), profile AS MATERIALIZED (
  SELECT w.station_id, CAST(w.d AS INTEGER) AS DayOfWeek, w.mean_sold,
    coalesce(recent_avg, mean_sold) AS recent_avg, coalesce(ewm_avg, mean_sold) AS ewm_avg,
    CAST(0.6 AS DOUBLE) * coalesce(recent_avg, mean_sold) + CAST(0.4 AS DOUBLE) * coalesce(ewm_avg, mean_sold) AS blended,
    coalesce(MS_Sold, 0.12) AS MS_Sold, coalesce(HSD1_Sold, 0.38) AS HSD1_Sold,
    coalesce(HSD2_Sold, 0.30) AS HSD2_Sold, coalesce(HSD3_Sold, 0.20) AS HSD3_Sold
  FROM weekdays w LEFT JOIN per_day p ON w.station_id = p.station_id AND w.d = p.dow
)"""

_CAPPED = """caps AS (
  SELECT station_id, quantile_cont(Total_Sold, 0.01) AS lo, quantile_cont(Total_Sold, 0.99) AS hi
  FROM ledger GROUP BY 1
), capped AS (
  SELECT l.station_id, l.mon, least(greatest(CAST(Total_Sold AS DOUBLE), lo), hi) AS sold
  FROM ledger l JOIN caps c ON l.station_id = c.station_id
), multipliers AS (
  SELECT station_id, mon AS "Month", """ + rnd("avg(sold) / any_value(overall)", 4) + """ AS multiplier
  FROM (SELECT *, avg(sold) OVER (PARTITION BY station_id) AS overall FROM capped) GROUP BY 1, 2
)"""

MULTIPLIERS = LEDGER + ", " + _CAPPED

STATE = PROFILE + ", " + _CAPPED + """, state AS MATERIALIZED (
  SELECT station_id, max("Date") AS last_date,
    CASE WHEN arg_max(Refill_Required, "Date") = 'Yes' THEN 12000.0
      WHEN arg_max(Closing_Stock, "Date") = 0 THEN 3000.0
      ELSE CAST(arg_max(Closing_Stock, "Date") AS DOUBLE) END AS seed_stock,
    CAST(arg_max(Closing_Stock, "Date") AS DOUBLE) AS last_closing,
    list(CAST(Total_Sold AS DOUBLE) ORDER BY "Date") FILTER (WHERE back <= 7) AS recent_sales,
    CAST(coalesce(min(back) FILTER (WHERE Target = 1) - 1, 0) AS INTEGER) AS days_since,
    any_value(mean_sold) AS mean_sold
  FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY "Date" DESC) AS back FROM feat)
  GROUP BY 1
)"""


def walk(days: int, stop: bool = False, reset: bool = False, scenario_last: bool = False, percents: str = "(0.0)") -> str:
    """The walk-forward as a recursive query ending in the table ``path``."""
    demand = (
        "p.blended * coalesce(m.multiplier, 1.0) * f.factor" if scenario_last
        else "p.blended * f.factor * coalesce(m.multiplier, 1.0)"
    )
    trigger = "(closing < 2000 AND NOT done)" if reset else "(closing < 2000)"
    next_stock = f"CASE WHEN {trigger} THEN 12000.0 ELSE closing END" if reset else "closing"
    going = "WHERE NOT w.done" if stop else ""
    return STATE + f""", factors AS (
  SELECT CAST(pct AS DOUBLE) AS demand_pct, CAST(1 AS DOUBLE) + CAST(pct AS DOUBLE) / 100 AS factor
  FROM (VALUES {percents}) AS v(pct)
), calendar AS MATERIALIZED (
  SELECT s.station_id, f.demand_pct, f.factor, CAST(i AS INTEGER) AS step,
    CAST(s.last_date + CAST(i + 1 AS INTEGER) AS DATE) AS d,
    CAST(isodow(s.last_date + CAST(i + 1 AS INTEGER)) - 1 AS INTEGER) AS dow, {demand} AS demand
  FROM state s, factors f, range({days}) AS t(i)
    JOIN profile p ON p.station_id = s.station_id AND p.DayOfWeek = isodow(s.last_date + CAST(i + 1 AS INTEGER)) - 1
    LEFT JOIN multipliers m ON m.station_id = s.station_id AND m."Month" = month(s.last_date + CAST(i + 1 AS INTEGER))
), walked AS (
  SELECT station_id, demand_pct, -1 AS step, CAST(NULL AS DATE) AS d, CAST(NULL AS INTEGER) AS dow,
    CAST(0 AS DOUBLE) AS opening, CAST(0 AS DOUBLE) AS est, CAST(0 AS DOUBLE) AS closing,
    false AS triggered, false AS done, seed_stock AS stock,
    recent_sales[-1] AS lag1, coalesce(recent_sales[-2], recent_sales[-1]) AS lag2, last_closing AS lag1_close,
    recent_sales AS recent, days_since,
    CAST(0 AS DOUBLE) AS r_lag1, CAST(0 AS DOUBLE) AS r_lag2, CAST(0 AS DOUBLE) AS r_close, CAST(0 AS DOUBLE) AS rolling
  FROM state, factors
  UNION ALL
  SELECT station_id, demand_pct, step, d, dow, opening, est, closing, {trigger}, done OR closing < 2000,
    {next_stock}, est, lag1, closing, list_append(recent[-6:], est), days_since + 1,
    lag1, lag2, lag1_close, list_sum(recent) / len(recent)
  FROM (
    SELECT *, greatest(CAST(0 AS DOUBLE), opening - est) AS closing FROM (
      SELECT w.station_id, w.demand_pct, c.step, c.d, c.dow, w.stock AS opening,
        least(trunc(c.demand * least(CAST(1 AS DOUBLE), w.stock / CAST(6000 AS DOUBLE))), w.stock) AS est,
        w.done, w.lag1, w.lag2, w.lag1_close, w.recent, w.days_since
      FROM walked w JOIN calendar c
        ON c.station_id = w.station_id AND c.demand_pct = w.demand_pct AND c.step = w.step + 1
      {going}
    )
  )
), path AS (
  SELECT station_id, demand_pct, step, d AS "Date", dow AS DayOfWeek, opening AS Opening_Stock, est AS Est_Sold,
    closing AS Closing_Stock, triggered, r_lag1 AS lag1, r_lag2 AS lag2, r_close AS lag1_close, rolling, days_since
  FROM walked WHERE step >= 0
)"""


# The decision taken from the table ``path``.
DECIDED = """, ends AS (
  SELECT p.station_id, p.demand_pct, f.factor, any_value(s.seed_stock) AS seed_stock, any_value(s.mean_sold) AS mean_sold, any_value(s.last_date) AS last_date,
    min(step) FILTER (WHERE triggered) AS hit, arg_max(Closing_Stock, step) AS end_stock,
    arg_min(Closing_Stock, step) FILTER (WHERE triggered) AS hit_closing
  FROM path p JOIN state s USING (station_id) JOIN factors f ON f.demand_pct = p.demand_pct GROUP BY 1, 2, 3
), decided AS (
  SELECT station_id, demand_pct, hit IS NOT NULL AS triggered, hit_closing AS trigger_closing, mean_sold * factor AS avg_sold,
    seed_stock AS closing_stock, CAST(0.91 AS DOUBLE) AS confidence,
    CAST(coalesce(hit + 1, CASE WHEN mean_sold * factor > 0 THEN greatest(1, trunc(end_stock / (mean_sold * factor))) ELSE 3 END) AS INTEGER) AS days_remaining,
    CAST(last_date + CAST(coalesce(hit + 1, 1 + CASE WHEN mean_sold * factor > 0 THEN greatest(1, trunc(end_stock / (mean_sold * factor))) ELSE 3 END) AS INTEGER) AS DATE) AS refill_date
  FROM ends
)"""

SCORED = LEDGER + ", scored AS (SELECT station_id, \"Date\", Target, " + rnd(
    "least(greatest((CAST(16500 AS DOUBLE) - Opening_Stock) / 12000, 0), 1)", 2
) + " AS score, CAST(" + rnd(
    "least(greatest((CAST(16500 AS DOUBLE) - Opening_Stock) / 12000, 0), 1)", 2
) + " >= 0.83 AS INTEGER) AS prediction FROM ledger)"


def over(prelude: str, body: str) -> str:
    return f"{prelude}\n{body}"
