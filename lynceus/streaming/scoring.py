"""Continuous scoring: the batch path over a stream.

Contract, guard, model and band are stateless column operators, so there is no state to bound and a
restart resumes from the checkpointed source offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from lynceus.operators.quality import ood_guard
from lynceus.plans.scoring import Scorer, score_batch

VITALS = ("ap_hi", "ap_lo", "age_years", "height", "weight")


def score_stream(stream: DataFrame, scorer: Scorer, id_col: str = "id") -> DataFrame:
    """Validate, guard, score and band every arriving row; works on batch and streaming tables alike."""
    if not set(VITALS) <= set(stream.columns):
        return score_batch(stream, scorer, id_col)
    guarded = ood_guard(stream)
    scored = score_batch(guarded.withColumn("_key", F.struct(id_col, "similarity", "verdict")), scorer, "_key")
    return scored.select(f"_key.{id_col}", "_key.similarity", "_key.verdict", *[c for c in scored.columns if c != "_key"])


def start_scoring(stream: DataFrame, scorer: Scorer, out: str, checkpoint: str, drain: bool = False, id_col: str = "id") -> StreamingQuery:
    """Appends scored rows to a parquet table; ``drain`` processes what is there and stops."""
    writer = score_stream(stream, scorer, id_col).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start(out)
