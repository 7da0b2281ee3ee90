"""ST1: continuous scoring drained over a table and compared with the batch path."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.catalog import query
from lynceus.catalog.quality import VITALS_SQL, vitals
from lynceus.operators.derive import FeatureGroups
from lynceus.plans.config import FeatureConfig
from lynceus.plans.scoring import fit_scorer
from lynceus.session import new_table_path
from lynceus.streaming.scoring import score_stream, start_scoring

COLS = ("ap_hi", "ap_lo", "age_years", "height", "weight")
BOUNDS = {"ap_hi": (60, 300), "ap_lo": (30, 200), "age_years": (1, 120), "height": (100, 250), "weight": (20, 300)}
GROUPS = FeatureGroups(continuous=COLS)
CFG = FeatureConfig(selector="f_classif", k_best=5, n_components=2)


def drained(spark, sf):
    """(scored stream, scored batch) of the same rows."""
    source = new_table_path(spark, "arrivals")
    rows = vitals(spark, sf)
    rows.write.parquet(source)
    stored = spark.read.parquet(source)
    scorer = fit_scorer(stored, GROUPS, CFG, bounds=BOUNDS)
    out, state = new_table_path(spark, "scored"), new_table_path(spark, "offsets")
    stream = spark.readStream.schema(stored.schema).parquet(source)
    start_scoring(stream, scorer, out, state, drain=True).awaitTermination()
    return spark.read.parquet(out), score_stream(stored, scorer)


@query("st1_score_stream", f"""
WITH {VITALS_SQL}, r AS (SELECT *, ap_hi IS NULL OR ap_hi < 60 OR ap_hi > 300 OR ap_lo IS NULL OR ap_lo < 30 OR ap_lo > 200 OR age_years IS NULL OR age_years < 1 OR age_years > 120
  OR height < 100 OR height > 250 OR weight IS NULL OR weight < 20 OR weight > 300 AS bad FROM vitals)
SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count_if(bad)::BIGINT AS n_rejected, 0::BIGINT AS n_differ FROM r""")
def st1(spark, sf):
    stream, batch = drained(spark, sf)
    names = stream.columns
    differ = stream.join(batch.select(*[F.col(c).alias(f"b_{c}") for c in names]), F.col("id") == F.col("b_id"), "full_outer")
    unequal = F.lit(False)
    for c in names:
        unequal = unequal | ~F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return differ.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"),
        F.sum((F.col("reasons") != "").cast("long")).alias("n_rejected"), F.sum(unequal.cast("long")).alias("n_differ"))


@query("st1_stream_rows")
def st1r(spark, sf):
    return drained(spark, sf)[0]
