"""From a clean table to a fitted, evaluated and stored classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipstick.config import ENGINEERED, MODEL_FEATURES, PREP, Tank
from dipstick.operators import clean, features, metrics, model, profile, smote, stats, timeline
from dipstick.session import materialise


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    features: list[str]
    unseen: DataFrame
    scored: DataFrame
    metrics: DataFrame
    multipliers: DataFrame


def ranking_forest(prepared: DataFrame, trees: int = 100, depth: int = 30) -> PipelineModel:
    """The forest over all candidate columns."""
    names = clean.numeric_columns(clean.candidate_features(prepared))
    return model.fit_importance_forest(prepared, names, trees, depth)


def rank_features(prepared: DataFrame, trees: int = 100, depth: int = 30) -> DataFrame:
    """Importance table of the candidate columns."""
    return model.importance_table(ranking_forest(prepared, trees, depth))


def select_features(prepared: DataFrame, least: float = 0.01) -> DataFrame:
    """Candidates whose importance passes the threshold."""
    return model.select_features(rank_features(prepared), least)


def correlation_ranking(prepared: DataFrame) -> DataFrame:
    """Candidates by falling strength of correlation with the target."""
    names = clean.numeric_columns(clean.candidate_features(prepared))
    table = stats.correlations(prepared, names)
    return table.orderBy("station_id", F.desc(F.abs("correlation")), "feature")


def model_features(selected: list[str], columns: list[str]) -> list[str]:
    """Selected columns, then the two stock readings and the engineered columns."""
    extra = [c for c in ("Stock_Ratio", "Dip") if c in columns]
    return clean.assemble_feature_list(selected, columns, [*extra, *ENGINEERED])


def training_table(prepared: DataFrame, cfg: Tank = PREP) -> DataFrame:
    """Features first, then capped sales, then the split: lags and means see uncapped sales."""
    engineered = features.training_features(prepared, cfg)
    return timeline.chronological_split(profile.winsorise(engineered))


def train(
    prepared: DataFrame, selected: list[str] | None = None, cfg: Tank = PREP, trees: int = 200, depth: int = 12
) -> Trained:
    """Fit on the balanced first part of every station's days, evaluate on the rest."""
    names = model_features(selected, prepared.columns) if selected else list(MODEL_FEATURES)
    table = materialise(training_table(prepared, cfg), "training")
    known, unseen = table.where(F.col("split") == "train"), table.where(F.col("split") == "test")
    balanced = materialise(smote.balance(known, names), "balanced")
    fitted = model.fit_forest(balanced, names, trees, depth)
    scored = model.score(fitted, unseen)
    return Trained(
        model=fitted,
        features=names,
        unseen=unseen,
        scored=scored,
        metrics=metrics.metrics_record(scored),
        multipliers=profile.monthly_multipliers(table, cap=False),
    )
