"""Batch scoring: contract, guard, model, band and confidence as column operators over a whole table.

The same functions serve a stream, because none of them keeps state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, Transformer
from pyspark.sql import DataFrame, functions as F

from lynceus.functions import scalar as sc
from lynceus.operators.derive import FeatureGroups
from lynceus.operators.models import FeaturePrep, logreg, score
from lynceus.operators.quality import contract_reasons
from lynceus.plans.config import FeatureConfig


@dataclass(frozen=True)
class Scorer:
    model: Transformer
    bounds: dict[str, tuple[float, float]]
    threshold: float = 0.5


def fit_scorer(train: DataFrame, groups: FeatureGroups, cfg: FeatureConfig, y: str = "y",
               bounds: dict[str, tuple[float, float]] | None = None) -> Scorer:
    model = Pipeline(stages=[FeaturePrep(groups, y, cfg), logreg(1.0, y)]).fit(train)
    return Scorer(model, bounds or {})


def score_batch(df: DataFrame, scorer: Scorer, id_col: str = "id") -> DataFrame:
    """One row per input row: rejected rows carry their reasons and no score."""
    checked = df.withColumn("reasons", contract_reasons(scorer.bounds)) if scorer.bounds else df.withColumn("reasons", F.array().cast("array<string>"))
    scored = score(scorer.model, checked, [id_col, "reasons"])
    ok = F.size("reasons") == 0
    p = F.when(ok, F.round("proba", 4))
    return scored.select(
        id_col, F.concat_ws(",", "reasons").alias("reasons"), p.alias("proba"),
        F.when(ok, F.when(F.col("proba") >= scorer.threshold, 1).otherwise(0)).alias("predicted"),
        F.when(ok, sc.risk_band(F.col("proba"))).alias("band"),
        F.when(ok, F.round(sc.confidence(F.col("proba"), scorer.threshold), 4)).alias("confidence"),
    )
