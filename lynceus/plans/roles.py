"""Roles the operators work on, expressed over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Largest event value a score of 1.0 stands for (fixed scale of the derived score).
VALUE_SCALE = 600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its customer: id, label, numeric, ordinal and nominal features.

    ``known_bal`` is the balance with negative values taken as unknown, so it holds nulls.
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("acctbal"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("known_bal"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
        F.datediff(F.col("o_orderdate"), F.to_date(F.lit("1992-01-01"))).alias("order_day"),
    )


COHORT_SQL = """cohort AS (
  SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice AS price, c_acctbal AS acctbal,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS known_bal,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, c_mktsegment AS segment, c_nationkey AS nation,
         CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS order_day
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def scores_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: id, stage, fold, y and three model scores (b is heavily tied, c blends both)."""
    scored = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 5).cast("int").alias("fold"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("user_id") % 3 + 1).cast("int")).alias("stage"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("y"),
        F.least(F.lit(1.0), F.round(F.col("value") / VALUE_SCALE, 6)).alias("a"),
        ((F.get_json_object("props", "$.k").cast("double") + 0.5) / 100.0).alias("b"),
    )
    return scored.withColumn("c", F.round(F.col("a") * 0.6 + F.col("b") * 0.4, 6))


MODELS = ("a", "b", "c")


def scores_long(spark: SparkSession, sf_dir: str, models: tuple[str, ...] = MODELS) -> DataFrame:
    return to_long(scores_wide(spark, sf_dir), list(models))


def to_long(wide: DataFrame, models: list[str], keep: tuple[str, ...] = ("id", "stage", "fold", "y")) -> DataFrame:
    """Wide score columns to ``(keep, model, proba)`` without a shuffle."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("proba")) for m in models])
    return wide.select(*keep, F.inline(pairs))


SCORES_SQL = """base_scores AS (
  SELECT event_id AS id, CAST(user_id % 5 AS INTEGER) AS fold, CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS stage,
         CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS y,
         least(1.0, round(value / 600.0, 6)) AS a,
         (CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.5) / 100.0 AS b
  FROM events),
scores AS (SELECT *, round(a * 0.6::DOUBLE + b * 0.4::DOUBLE, 6) AS c FROM base_scores),
long AS (SELECT id, stage, fold, y, 'a' AS model, a AS proba FROM scores
         UNION ALL SELECT id, stage, fold, y, 'b', b FROM scores UNION ALL SELECT id, stage, fold, y, 'c', c FROM scores)"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id")


DOCS_SQL = """docs AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


VECTORS_SQL = "vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
