"""IO1-IO10: sources and sinks, exercised by writing tables to the shared folder and reading them back."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F, types as T

from lynceus.catalog import query
from lynceus.catalog.derive import AS_OF_YEAR, FLAT_SQL, order_bundles
from lynceus.catalog.evaluation import SCORES_SQL, rank_sql, round_all, scores_long
from lynceus.catalog.features import train_test
from lynceus.catalog.learning import CFG, GROUPS
from lynceus.catalog.quality import FLAGGED_SQL, RATE_SQL, SUMMARY_SQL, RULES, flagged_cohort
from lynceus.operators import evaluate as ev, models as ml, quality as dq
from lynceus.operators.sampling import id_fingerprint, seeded_draws
from lynceus.plans.roles import COHORT_SQL, cohort, table
from lynceus.session import new_table_path
from lynceus.sources import io

FLAT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("known_bal", T.DoubleType()),
    T.StructField("priority", T.IntegerType()), T.StructField("segment", T.StringType()),
])
FLAT_COLS = [f.name for f in FLAT_SCHEMA]
_FLAT = f"SELECT {', '.join(FLAT_COLS)} FROM cohort"


def flat_cohort(spark, sf):
    return cohort(spark, sf).select(*FLAT_COLS)


@query("io1_read_headerless", f"WITH {COHORT_SQL} {_FLAT}")
def io1(spark, sf):
    path = new_table_path(spark, "headerless")
    flat_cohort(spark, sf).write.option("nullValue", "?").csv(path)
    return io.read_headerless(spark, path, FLAT_SCHEMA)


@query("io2_read_delimited", f"WITH {COHORT_SQL} {_FLAT}")
def io2(spark, sf):
    path = new_table_path(spark, "delimited")
    flat_cohort(spark, sf).select(*reversed(FLAT_COLS)).write.option("sep", ";").option("header", True).csv(path)
    return io.read_delimited(spark, path, ";", FLAT_SCHEMA)


@query("io3_read_sites", f"WITH {COHORT_SQL} {_FLAT.replace(' FROM', ', CASE WHEN nation < 13 THEN ' + chr(39) + 'west' + chr(39) + ' ELSE ' + chr(39) + 'east' + chr(39) + ' END AS site FROM')}")
def io3(spark, sf):
    sites = {}
    for site, cond in {"west": "nation < 13", "east": "nation >= 13"}.items():
        sites[site] = new_table_path(spark, site)
        cohort(spark, sf).filter(cond).select(*FLAT_COLS).write.option("nullValue", "?").csv(sites[site])
    return io.read_sites(spark, sites, FLAT_SCHEMA)


@query("io4_read_bundles", f"""
WITH {FLAT_SQL} SELECT count(*) AS n, round(avg(age_years), 6) AS age_years, round(avg(height), 6) AS height, round(avg(ap_hi), 6) AS ap_hi,
  round(avg(ap_lo), 6) AS ap_lo, sum(cholesterol)::BIGINT AS cholesterol, sum(gluc)::BIGINT AS gluc, sum(gender_male)::BIGINT AS gender_male FROM flat""")
def io4(spark, sf):
    path = new_table_path(spark, "bundles")
    order_bundles(spark, sf).select("bundle").write.text(path)
    flat = io.read_bundles(spark, path, AS_OF_YEAR)
    return flat.agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("age_years", "height", "ap_hi", "ap_lo")],
        *[F.sum(c).alias(c) for c in ("cholesterol", "gluc", "gender_male")])


@query("io5_write_table", f"WITH {SCORES_SQL}, {rank_sql('m', 'stage, model')} SELECT stage, model, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM m")
def io5(spark, sf):
    path = new_table_path(spark, "metrics")
    m = round_all(ev.ranking_metrics(scores_long(spark, sf), ["stage", "model"]), "roc_auc", "pr_auc")
    io.write_table(m, path, "csv")
    return spark.read.schema(m.schema).option("header", True).csv(path)


@query("io6_write_report", f"""
WITH {FLAGGED_SQL}
SELECT 'summary' AS section, any_flag_count::DOUBLE AS value FROM ({SUMMARY_SQL}) UNION ALL SELECT 'rate', target_rate FROM ({RATE_SQL})""")
def io6(spark, sf):
    path = new_table_path(spark, "report")
    flagged = flagged_cohort(spark, sf)
    doc = io.report_document({"summary": dq.flag_summary(flagged, list(RULES)), "rate": dq.target_rate_by_flag(flagged, "y")})
    io.write_report(doc, path)
    back = spark.read.schema("section string, body string").json(path)
    value = F.when(F.col("section") == "summary", F.get_json_object("body", "$.any_flag_count")).otherwise(F.get_json_object("body", "$.target_rate"))
    return back.select("section", value.cast("double").alias("value"))


@query("io7_read_scores", f"WITH {SCORES_SQL} SELECT model, count(*) AS n, round(avg(proba), 6) AS mean_proba FROM long GROUP BY model")
def io7(spark, sf):
    path = new_table_path(spark, "scores")
    s = scores_long(spark, sf)
    io.write_table(s, path)
    expected = id_fingerprint(table(spark, sf, "events").select(F.col("event_id").alias("id")), "id").first()["fingerprint"]
    back = io.read_scores(spark, path, expected)
    return back.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("proba"), 6).alias("mean_proba"))


@query("io8_saved_model", "SELECT 1::BIGINT AS n_models, true AS same_scores")
def io8(spark, sf):
    path = new_table_path(spark, "model")
    train, data = train_test(spark, sf)
    model = Pipeline(stages=[ml.FeaturePrep(GROUPS, "y", CFG), ml.logreg()]).fit(train)
    io.save_model(model, path, io.manifest_of(config=CFG, groups=GROUPS, version="1"))
    loaded, manifest = io.load_model(path)
    gap = dq.closeness(ml.score(model, data, ["id"]), ml.score(loaded, data, ["id"]), "id", ["proba"])
    return gap.agg(F.lit(int(manifest["version"])).cast("long").alias("n_models"), (F.sum(F.col("n_apart") + F.col("n_unmatched")) == 0).alias("same_scores"))


DRAWS_SQL = f"""{COHORT_SQL},
l AS (SELECT id, y, CAST(s AS INTEGER) AS seed, count(*) OVER () // 3 AS n_all FROM cohort, unnest([7, 11, 42]) t(s)),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, y ORDER BY CAST('0x' || substr(md5(seed || ':' || id), 1, 8) AS BIGINT), id) AS r, count(*) OVER (PARTITION BY seed, y) AS nc FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY (CAST(r AS DOUBLE) - 0.5) / CAST(nc AS DOUBLE), y) AS nr FROM r)"""


@query("io9_run_missing", f"WITH {DRAWS_SQL} SELECT seed, count(*) AS n, sum(id)::BIGINT AS id_sum FROM n WHERE nr <= n_all // 5 GROUP BY seed")
def io9(spark, sf):
    path = new_table_path(spark, "runs")
    c = cohort(spark, sf).select("id", "y")
    n = c.count() // 5
    draw = lambda seed: seeded_draws(c, "id", "y", n, [seed]).drop("seed")
    io.run_missing([7, 11], path, draw)  # a run that stopped before its last seed
    out = io.run_missing([7, 11, 42], path, draw, valid=lambda part: part.count() == n)
    return out.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query("io10_cached", f"WITH {FLAGGED_SQL} SELECT any_flag, target_rate, n, false AS first_hit, true AS second_hit FROM ({RATE_SQL})")
def io10(spark, sf):
    path = new_table_path(spark, "cache")
    flagged = flagged_cohort(spark, sf)
    source = table(spark, sf, "orders")
    rate = dq.target_rate_by_flag(flagged, "y")
    _, first = io.cached(rate, [source], {"operator": "rate"}, path)
    again, second = io.cached(rate, [source], {"operator": "rate"}, path)
    return again.withColumns({"first_hit": F.lit(first), "second_hit": F.lit(second)})
