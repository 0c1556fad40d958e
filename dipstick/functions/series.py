"""Exponentially weighted means over ordered arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ewm_depth(alpha: float, tail: float = 1e-16) -> int:
    """Rows after which the weight left in the tail is below ``tail``."""
    return 1 if alpha >= 1 else max(1, math.ceil(math.log(tail) / math.log(1 - alpha)))


def ewm(values: Column, alpha: float) -> Column:
    """Last value of ``y = a*x + (1-a)*y`` started at the first element of ``values``.

    Equal neighbours leave ``y`` as it is, so a constant series stays exactly constant.
    """
    keep, take = F.lit(1 - alpha), F.lit(alpha)
    return F.aggregate(
        values,
        F.lit(None).cast("double"),
        lambda y, x: F.when(y.isNull() | (y == x), x).otherwise(y * keep + x * take),
    )
