"""Registry of named queries, their inputs and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from dipstick.operators import features, forecast, forest, model, profile
from dipstick.plans import training
from dipstick.session import fresh_path, materialise_by
from dipstick.sources import sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Tables a query starts from. The daily ledger is written once per session and folder.

    The other members are plans over it, kept so that they are analysed once; nothing is held in memory.
    """

    _open: dict[tuple[str, str], "Inputs"] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> "Inputs":
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._open:
            cls._open[key] = cls(spark, folder)
        return cls._open[key]

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.folder, name)

    def path(self, name: str) -> str:
        return fresh_path(self.spark, name)

    @cached_property
    def ledger(self) -> DataFrame:
        return materialise_by(tables.build_ledger(self.spark, self.folder), "ledger", "station_id", "Date")

    @cached_property
    def features(self) -> DataFrame:
        return features.normalise(self.ledger)

    @cached_property
    def prepared(self) -> DataFrame:
        return features.prepare(self.ledger)

    @cached_property
    def multipliers(self) -> DataFrame:
        return profile.monthly_multipliers(self.ledger)

    @cached_property
    def seeded(self) -> DataFrame:
        return forecast.seeded_state(self.features, self.multipliers)

    @cached_property
    def ranking(self) -> PipelineModel:
        """The full-size ranking forest, fitted once per session."""
        return training.ranking_forest(self.prepared)

    @cached_property
    def ranked(self) -> DataFrame:
        """Its feature importances."""
        return model.importance_table(self.ranking)

    @cached_property
    def trained(self) -> training.Trained:
        """The classifier, fitted once per session."""
        return training.train(self.prepared)

    @cached_property
    def nodes(self) -> DataFrame:
        """The classifier's trees as a table of nodes."""
        return forest.node_table(self.trained.model)

    @cached_property
    def ledger_csv(self) -> str:
        return sinks.write_csv(self.ledger, self.path("ledger-csv"))


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Inputs` under ``name``, with its SQL where there is one."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs.of(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
