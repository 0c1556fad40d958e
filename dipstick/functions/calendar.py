"""Column expressions on dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dipstick.config import MONTHS, WEEKDAYS
from dipstick.functions.numeric import choose

# Accepted date layouts by the shape of the text, after a time of day is cut off. The shapes
# exclude each other: with two numbers in front, the second is the month where it can be one, else the first is.
_MONTH = "(0?[1-9]|1[0-2])"
_TIME = r"[T ]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"
_NAME = "(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_FULL = "(?i:january|february|march|april|june|july|august|september|october|november|december)"
DATE_LAYOUTS = (
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{4}\.\d{1,2}\.\d{1,2}", "yyyy.M.d"),
    (r"\d{8}", "yyyyMMdd"),
    *(
        (rf"\d{{1,2}}[{sep}]{month}[{sep}]{digits}", layout.replace("/", sep))
        for sep in "/.-"
        for digits, year in ((r"\d{4}", "yyyy"), (r"\d{2}", "yy"))
        for month, layout in ((_MONTH, f"d/M/{year}"), (r"\d{1,2}", f"M/d/{year}"))
    ),
    *((rf"\d{{1,2}}{sep}{name}{sep}\d{{4}}", f"d{sep}{m}{sep}yyyy") for sep in " -" for name, m in ((_NAME, "MMM"), (_FULL, "MMMM"))),
    *((rf"{name} \d{{1,2}}, ?\d{{4}}", f"{m} d, yyyy") for name, m in ((_NAME, "MMM"), (_FULL, "MMMM"))),
)
# The display layouts reports use.
DISPLAY_LAYOUTS = {
    "iso": "yyyy-MM-dd",
    "day_first": "dd-MM-yyyy",
    "short": "dd MMM yyyy",
    "month": "MMM yyyy",
    "weekday": "EEE",
    "long": "dd MMMM yyyy (EEEE)",
}


def parse_date(text: Column) -> Column:
    """Lenient day-first date; NULL where no layout fits. A time of day and its zone are cut off.

    The shape picks the one layout to try: a failed attempt costs an exception per row.
    """
    bare = F.regexp_replace(F.trim(text), _TIME, "")
    named = F.initcap(F.regexp_replace(bare, r",(\d)", ", $1"))
    return choose((bare.rlike(f"^{shape}$"), F.try_to_date(named, layout)) for shape, layout in DATE_LAYOUTS)


def parse_date_strict(text: Column, layout: str = "dd-MM-yyyy") -> Column:
    """One layout only; a cell that does not fit is an error."""
    return F.to_date(text, layout)


def weekday(d: Column) -> Column:
    """Monday = 0."""
    return F.weekday(d)


def weekday_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def _position(value: Column, names, first: int) -> Column:
    at = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(at > 0, (at - 1 + first).cast("int"))


def weekday_number(name: Column) -> Column:
    """Full weekday name to its number, NULL for other text."""
    return _position(name, WEEKDAYS, 0)


def weekday_label(number: Column) -> Column:
    return F.get(F.array(*[F.lit(n[:3]) for n in WEEKDAYS]), number)


def month_label(number: Column) -> Column:
    return F.when(number.between(1, 12), F.get(F.array(*[F.lit(n) for n in MONTHS]), number - 1))


def is_weekend(dow: Column) -> Column:
    return (dow >= 5).cast("int")


def in_months(month: Column, months) -> Column:
    return month.isin(*months).cast("int")


def quarter_of(month: Column) -> Column:
    return (F.floor((month - 1) / 3) + 1).cast("int")


def display(d: Column, style: str) -> Column:
    return F.date_format(d, DISPLAY_LAYOUTS[style])
