"""Small ledgers with values worked out by hand, and result comparison."""

from __future__ import annotations

import datetime as dt
import math

SOLD = (4000, 5000, 4500, 3000, 6000, 4800, 4200, 3900, 5100, 4700)


def ten_days(spark, station: str = "one"):
    rows = [(station, dt.date(2024, 1, 1) + dt.timedelta(days=i), s) for i, s in enumerate(SOLD)]
    return spark.createDataFrame(rows, "station_id string, Date date, Total_Sold bigint")


def column(df, name: str, order: str = "Date") -> list:
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def plain(value):
    """A value in a form equal in both engines: numbers as doubles, NaN as NULL, dates as text."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return repr(float(value) + 0.0)
    if isinstance(value, dt.datetime):
        return str(value.date()) if value.time() == dt.time() else str(value)
    return str(value)


def rows_of(records, names, order) -> list[tuple]:
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in records), key=str)
