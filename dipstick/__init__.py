"""Daily stock-ledger analytics on Spark: cleaning, features, statistics, models, refill forecasts."""

from dipstick.config import PREP, SERVE, Tank

__all__ = ["PREP", "SERVE", "Tank"]
