"""Column expressions on text: labels in, display strings out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def litres(x: Column) -> Column:
    """``1234.5`` to ``"1,234 L"``, half to even."""
    return F.concat(F.format_number(x.cast("double"), 0), F.lit(" L"))


def parse_litres(text: Column) -> Column:
    """``"1,234 L"`` back to a number."""
    return F.regexp_replace(text, "[, L]", "").cast("double")


def shorten(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def refill_flag(label: Column) -> Column:
    """Yes/YES/1 to 1, everything else to 0."""
    return F.when(label.cast("string").isin("Yes", "YES", "1"), 1).otherwise(0)


def refill_flag_strict(label: Column) -> Column:
    """Exactly ``Yes`` to 1."""
    return F.coalesce((label == "Yes").cast("int"), F.lit(0))


def says_yes(label: Column) -> Column:
    """Trimmed and case-blind test for yes."""
    return F.coalesce(F.lower(F.trim(label.cast("string"))) == "yes", F.lit(False))


def reads_yes(label: Column) -> Column:
    """Case-blind test for yes that does not trim."""
    return F.coalesce(F.lower(label.cast("string")) == "yes", F.lit(False))
