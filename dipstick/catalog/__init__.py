"""Every registered query, one module per family."""

from dipstick.catalog import (  # noqa: F401  importing a family registers its queries
    aggregates,
    cleaning,
    forecasts,
    joins,
    modelling,
    scalars,
    sources,
    windows,
)
from dipstick.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
