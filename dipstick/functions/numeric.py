"""Column expressions on numbers."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a plain decimal number in a text cell.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def half_even(x: Column, digits: int | None) -> Column:
    """Round half to even the way array libraries do: scale, ``rint``, unscale."""
    if digits is None:
        return x
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def clip(x: Column, low=None, high=None) -> Column:
    """Clamp to [low, high]; a missing bound is open and a NULL value stays NULL."""
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), out)


def truncate(x: Column) -> Column:
    """Integer part, towards zero."""
    return x.cast("bigint")


def safe_ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """``a / b`` where a zero or NULL denominator gives ``default``."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def percent(part: Column, whole: Column) -> Column:
    return safe_ratio(part * 100.0, whole)


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a finite plain number becomes 0."""
    value = F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
    finite = F.abs(value) < F.lit(float("inf"))
    return F.when(finite, value).otherwise(F.lit(0.0))


def row_total(columns: Sequence[Column]) -> Column:
    """Sum across columns of a row, NULL counted as 0."""
    total = F.coalesce(columns[0], F.lit(0))
    for c in columns[1:]:
        total = total + F.coalesce(c, F.lit(0))
    return total


def choose(branches: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first condition that holds, else ``default``."""
    first, *rest = branches
    out = F.when(*first)
    for condition, value in rest:
        out = out.when(condition, value)
    return out if default is None else out.otherwise(default)


def bands(x: Column, cuts: Sequence[tuple[str, float, str]], otherwise: str) -> Column:
    """First matching band of ``(comparison, bound, label)``, e.g. ``("<", 25, "danger")``."""
    compare = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
    return choose(((compare[sign](x, bound), F.lit(label)) for sign, bound, label in cuts), F.lit(otherwise))


def stock_band(pct: Column) -> Column:
    return bands(pct, [("<", 25, "danger"), ("<", 50, "warning")], "success")


def days_band(days: Column) -> Column:
    return bands(days, [("<=", 2, "danger"), ("<=", 5, "warning")], "accent")


def closing_band(closing: Column) -> Column:
    return bands(closing, [("<", 2000, "danger"), ("<", 4000, "warning")], "accent")


def confidence_band(pct: Column) -> Column:
    return bands(pct, [(">=", 80, "good")], "bad")


def metric_band(pct: Column) -> Column:
    return bands(pct, [(">=", 90, "good")], "accent")


def correlation_band(corr: Column) -> Column:
    return bands(corr, [("<", -0.1, "danger"), (">", 0.1, "success")], "neutral")


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: Pearson correlation over complete pairs; NULL, not an error, for a constant."""
    x = F.when(b.isNotNull(), a.cast("double"))
    y = F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
