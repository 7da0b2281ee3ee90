"""K1-K6: similarity kernels over the embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.catalog import query
from lynceus.catalog.evaluation import round_all
from lynceus.operators import kernels as kn
from lynceus.operators.sampling import subsample
from lynceus.plans.roles import VECTORS_SQL, vectors

ALL_SQL = f"""{VECTORS_SQL}, kern AS (
  SELECT a.id AS ia, b.id AS ib, b.label, list_dot_product(a.vec, b.vec) ** 2 AS k FROM vecs a, vecs b)"""


@query("k1_kernel_row_means", f"WITH {ALL_SQL} SELECT ia AS id, round(avg(k), 6) AS k_mean FROM kern GROUP BY ia")
def k1(spark, sf):
    return round_all(kn.kernel_row_means(vectors(spark, sf)), "k_mean")


@query("k1_kernel_label_sums", f"""
WITH {ALL_SQL} SELECT ia AS id, round(sum(k) FILTER (label < 5), 6) AS k_low, round(sum(k) FILTER (label >= 5), 6) AS k_high FROM kern GROUP BY ia""")
def k1l(spark, sf):
    v = vectors(spark, sf).withColumn("low", (F.col("label") < 5).cast("int")).withColumn("high", (F.col("label") >= 5).cast("int"))
    out = kn.kernel_product(kn.kernel_product(v, v, "low", "k_low"), v, "high", "k_high")
    return round_all(out.select("id", "k_low", "k_high"), "k_low", "k_high")


@query("k2_kernel_tiles", f"""
WITH {ALL_SQL} SELECT count(*) AS n, round(sum(k), 4) AS total, round(min(k), 9) AS smallest, round(max(k), 6) AS largest FROM kern""")
def k2(spark, sf):
    t = kn.kernel_tile_stats(vectors(spark, sf), block_rows=200)
    return t.agg(
        F.sum("n").alias("n"), F.round(F.sum("s"), 4).alias("total"), F.round(F.min("mn"), 9).alias("smallest"), F.round(F.max("mx"), 6).alias("largest")
    )


N_LANDMARKS = 16
LAND_SQL = f"land AS (SELECT * FROM vecs ORDER BY CAST('0x' || substr(md5('42:' || id), 1, 8) AS BIGINT), id LIMIT {N_LANDMARKS})"


@query("k3_kernel_landmarks", f"""
WITH {VECTORS_SQL}, {LAND_SQL} SELECT v.id, l.id AS landmark, round(list_dot_product(v.vec, l.vec) ** 2, 6) AS k FROM vecs v, land l""")
def k3(spark, sf):
    v = vectors(spark, sf)
    land = subsample(v, "id", N_LANDMARKS, 42)
    ids, _ = kn.collect_landmarks(land)
    out = kn.kernel_landmarks(v, land).select("id", F.posexplode("k").alias("pos", "k"))
    return out.select("id", F.element_at(F.array(*[F.lit(i).cast("long") for i in ids]), F.col("pos") + 1).alias("landmark"), F.round("k", 6).alias("k"))


@query("k4_kernel_diagnostics", f"""
WITH {ALL_SQL}
SELECT count(*) AS n_entries, round(min(k), 9) AS min_value, round(max(k), 6) AS max_value, round(avg(k), 6) AS mean_value, true AS is_symmetric,
  round(avg(k) FILTER (ia = ib), 6) AS diagonal_mean, round(max(abs(k - 1)) FILTER (ia = ib), 6) AS diagonal_max_dev,
  round(avg(k) FILTER (ia <> ib), 6) AS offdiag_mean, round(stddev_pop(k) FILTER (ia <> ib), 6) AS offdiag_std,
  min(k) >= -1e-6 AND max(k) <= 1 + 1e-6 AS in_unit_range FROM kern""")
def k4(spark, sf):
    d = kn.kernel_diagnostics(vectors(spark, sf), block_rows=500)
    d = round_all(d, "min_value", digits=9)
    return round_all(d, "max_value", "mean_value", "diagonal_mean", "diagonal_max_dev", "offdiag_mean", "offdiag_std")


@query("k5_neighbors", f"""
WITH {ALL_SQL}, r AS (SELECT ia, ib, label, round(k, 9) AS k FROM kern WHERE ia <> ib),
o AS (SELECT *, row_number() OVER (PARTITION BY ia ORDER BY k DESC, ib) AS rank FROM r)
SELECT ia AS id, CAST(rank AS INTEGER) AS rank, ib AS neighbor, label, round(k, 6) AS k FROM o WHERE rank <= 5""")
def k5(spark, sf):
    v = vectors(spark, sf)
    return round_all(kn.neighbors(v, v, 5, exclude_self=True), "k")


@query("k6_pair_budget", f"""
WITH {VECTORS_SQL} SELECT count(*) AS n_rows, count(*) * (count(*) - 1) // 2 AS n_pairs, count(*) > 400 AS over_budget, least(count(*), 400) AS advised_rows FROM vecs""")
def k6(spark, sf):
    n = F.count(F.lit(1))
    return vectors(spark, sf).agg(
        n.alias("n_rows"), F.floor(n * (n - 1) / 2).alias("n_pairs"), (n > 400).alias("over_budget"), F.least(n, F.lit(400).cast("long")).alias("advised_rows")
    )

