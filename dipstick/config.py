"""Parameters of a tank and the two presets whose feature rules differ."""

from __future__ import annotations

from dataclasses import dataclass

# Names and constants that results depend on.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
PRODUCTS = ("MS_Sold", "HSD1_Sold", "HSD2_Sold", "HSD3_Sold")
PAYMENTS = ("Cash", "Online", "Card")
NUMERIC = ("Opening_Stock", "Closing_Stock", "Total_Sold", *PRODUCTS, *PAYMENTS, "Dip")
SALES = ("Total_Sold", *PRODUCTS)
DERIVED_TYPES = {
    "Target": "int", "Year": "int", "Month": "int", "DayOfWeek": "int", "Quarter": "int", "Day_Num": "int",
    "Is_Weekend": "int", "Is_Festival_Month": "int", "Is_Monsoon_Month": "int", "Days_Since_Refill": "int",
    "Rolling_7d_Sales": "double", "Prev_Closing": "double", "Stock_Ratio": "double",
    "Lag1_Total_Sold": "double", "Lag2_Total_Sold": "double", "Lag1_Closing": "double",
    "DOW_Avg_Sales": "double", "Sales_Trend": "double",
}
DATE_ALIASES = ("date", "DATE", "Dates")
TOTAL_PARTS = (*PRODUCTS, "TotalSold", "TotalSales", "Sales")
DEFAULT_SHARES = {"MS_Sold": 0.12, "HSD1_Sold": 0.38, "HSD2_Sold": 0.30, "HSD3_Sold": 0.20}
RUPEES_PER_LITRE = {"Cash": 43, "Online": 31, "Card": 21}
IDENTIFIERS = ("Date", "Day", "Refill_Required", "Target")
LEAKS = ("Closing_Stock", "Stock_Ratio", "Dip")
ENGINEERED = (
    "Lag1_Total_Sold", "Lag2_Total_Sold", "Lag1_Closing",
    "DOW_Avg_Sales", "Sales_Trend", "Days_Since_Refill",
)
MODEL_FEATURES = (
    "Opening_Stock", "Prev_Closing", "Total_Sold", "Cash", "HSD1_Sold", "HSD2_Sold", "Online",
    "HSD3_Sold", "MS_Sold", "Card", "DayOfWeek", "Rolling_7d_Sales", "Stock_Ratio", "Dip",
    *ENGINEERED,
)
FALLBACK_FEATURES = (
    "Days_Since_Refill", "Opening_Stock", "Prev_Closing", "Cash", "HSD2_Sold", "HSD1_Sold", "Total_Sold",
)
FALLBACK_METRICS = {"accuracy": 0.97, "f1_score": 0.96, "roc_auc": 0.99}
FALLBACK_IMPORTANCES = (
    ("Opening_Stock", 0.511, -0.809), ("Prev_Closing", 0.290, 0.166), ("Total_Sold", 0.028, 0.203),
    ("Cash", 0.024, 0.221), ("HSD1_Sold", 0.022, 0.200), ("HSD2_Sold", 0.021, 0.186),
    ("MS_Sold", 0.015, 0.195), ("DayOfWeek", 0.011, 0.031), ("Card", 0.011, 0.041),
)
EXPECTED_COLUMNS = (
    "Date", "Opening_Stock", "Closing_Stock", "Total_Sold", "Target", "Refill_Required",
    "Rolling_7d_Sales", "Days_Since_Refill", "Stock_Ratio", "DayOfWeek", "Is_Weekend", "Month",
    "Day", "Is_Festival_Month", "Is_Monsoon_Month",
)


@dataclass(frozen=True)
class Tank:
    """One parameter record for every operator; the defaults are the serving rules."""

    capacity: int = 12000
    threshold: int = 2000
    pressure: float = 6000.0
    horizon: int = 30
    ewm_span: int = 8
    recent: int = 4
    blend: float = 0.60
    drift: float = 0.40
    default_sales: float = 4500.0
    default_closing: float = 3200.0
    unknown_closing: float = 3000.0  # seed of a ledger that records no closing stock
    default_confidence: float = 0.91
    empty_seed: float | None = 3000.0  # an empty tank is re-seeded with this; None keeps 0
    festival_months: tuple[int, ...] = (10, 11)
    monsoon_months: tuple[int, ...] = (6, 7, 8, 9)
    ratio_to: str = "opening"  # "opening" or "capacity"
    first_prev_closing: float = 0.0
    rolling_digits: int | None = 2

    @property
    def alpha(self) -> float:
        return 2 / (self.ewm_span + 1)


SERVE = Tank()
PREP = Tank(
    empty_seed=None,
    monsoon_months=(6, 7, 8),
    ratio_to="capacity",
    first_prev_closing=12000.0,
    rolling_digits=0,
)
