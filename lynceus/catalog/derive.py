"""PR1-PR15: row projections and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.catalog import query
from lynceus.catalog.quality import VITALS_SQL, vitals
from lynceus.functions import scalar as sc
from lynceus.operators import derive as pr
from lynceus.plans.roles import COHORT_SQL, SCORES_SQL, VECTORS_SQL, cohort, scores_wide, table, vectors


@query("pr1_binary_target", f"""
WITH {COHORT_SQL} SELECT id, priority - 1 AS grade, CAST(priority - 1 > 0 AS INTEGER) AS target FROM cohort""")
def pr1(spark, sf):
    c = cohort(spark, sf).select("id", (F.col("priority") - 1).alias("grade"))
    return c.withColumn("target", sc.binary_target(F.col("grade")))


@query("pr2_derive_features", f"""
WITH {COHORT_SQL}
SELECT id, round(order_day / 365.25::DOUBLE, 6) AS age_years, CAST(priority = 2 AS INTEGER) AS gender_male, y AS target FROM cohort""")
def pr2(spark, sf):
    c = cohort(spark, sf)
    return pr.derive_features(c, "order_day", "priority", "y").select("id", F.round("age_years", 6).alias("age_years"), "gender_male", "target")


@query("pr3_engineer_features", f"""
WITH {VITALS_SQL}
SELECT id, round(weight / ((height / 100.0::DOUBLE) ** 2), 6) AS bmi, round(ap_hi - ap_lo, 6) AS pulse_pressure,
       round(ap_lo + (ap_hi - ap_lo) / 3.0::DOUBLE, 6) AS mean_arterial_pressure, round(age_years * level, 6) AS age_x_cholesterol FROM vitals""")
def pr3(spark, sf):
    v = pr.engineer_features(vitals(spark, sf).withColumn("cholesterol", F.col("level")))
    return v.select("id", *[F.round(c, 6).alias(c) for c in ("bmi", "pulse_pressure", "mean_arterial_pressure", "age_x_cholesterol")])


@query("pr4_risk_band", f"""
WITH {SCORES_SQL} SELECT id, CASE WHEN b >= 0.66 THEN 'HIGH' WHEN b >= 0.33 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM scores""")
def pr4(spark, sf):
    return scores_wide(spark, sf).select("id", sc.risk_band(F.col("b")).alias("band"))


@query("pr5_confidence", f"WITH {SCORES_SQL} SELECT id, round(least(1.0, abs(a - 0.5) / 0.5), 6) AS confidence FROM scores")
def pr5(spark, sf):
    return scores_wide(spark, sf).select("id", F.round(sc.confidence(F.col("a")), 6).alias("confidence"))


OUTCOME_SQL = "CASE WHEN {p} >= 0.5 AND y = 1 THEN 'TP' WHEN {p} >= 0.5 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END"


@query("pr6_outcome_class", f"WITH {SCORES_SQL} SELECT id, {OUTCOME_SQL.format(p='b')} AS outcome FROM scores")
def pr6(spark, sf):
    return scores_wide(spark, sf).select("id", sc.outcome_class(F.col("y"), F.col("b")).alias("outcome"))


@query("pr7_margin_residual", f"""
WITH {SCORES_SQL} SELECT id, round(abs(a - 0.5), 6) AS margin, round(y - a, 6) AS residual FROM scores""")
def pr7(spark, sf):
    return scores_wide(spark, sf).select(
        "id", F.round(sc.margin(F.col("a")), 6).alias("margin"), F.round(sc.residual(F.col("y"), F.col("a")), 6).alias("residual")
    )


@query("pr8_sigmoid", f"""
WITH {COHORT_SQL}
SELECT id, round(1.0 / (1.0 + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, acctbal / 100.0)))), 6) AS p FROM cohort""")
def pr8(spark, sf):
    return cohort(spark, sf).select("id", F.round(sc.sigmoid(F.col("acctbal") / 100.0), 6).alias("p"))


@query("pr9_fit_width", f"""
WITH {VECTORS_SQL}
SELECT id, len(vec[1:6]) AS n_cut, round(list_sum(vec[1:6]), 6) AS sum_cut, 80::BIGINT AS n_padded,
       round(list_sum(list_concat(vec, list_resize([0.0::DOUBLE], 16, 0.0))), 6) AS sum_padded FROM vecs""")
def pr9(spark, sf):
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    cut, padded = sc.fit_width(F.col("vec"), 6), sc.fit_width(F.col("vec"), 80)
    return vectors(spark, sf).select(
        "id", F.size(cut).cast("long").alias("n_cut"), F.round(total(cut), 6).alias("sum_cut"),
        F.size(padded).cast("long").alias("n_padded"), F.round(total(padded), 6).alias("sum_padded"),
    )


AS_OF_YEAR = 2025


def order_bundles(spark, sf):
    """One nested bundle per order: a patient and seven observations, some zero, some without codes."""
    c = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))

    def obs(value, text=None, code=None):
        coding = (
            F.array(F.struct(F.lit("http://loinc.org").alias("system"), F.lit(code).alias("code"))) if code
            else F.lit(None).cast("array<struct<system:string,code:string>>")
        )
        return F.struct(F.struct(
            F.lit("Observation").alias("resourceType"), F.lit(None).cast("string").alias("gender"), F.lit(None).cast("string").alias("birthDate"),
            F.struct(F.lit(text).cast("string").alias("text"), coding.alias("coding")).alias("code"),
            F.struct(value.cast("double").alias("value")).alias("valueQuantity"),
        ).alias("resource"))

    patient = F.struct(F.struct(
        F.lit("Patient").alias("resourceType"),
        F.when(F.col("c_nationkey") % 3 == 0, "Male").when(F.col("c_nationkey") % 3 == 1, "F").cast("string").alias("gender"),
        F.when(F.col("c_acctbal") >= 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("unknown")).alias("birthDate"),
        F.lit(None).cast("struct<text:string,coding:array<struct<system:string,code:string>>>").alias("code"),
        F.lit(None).cast("struct<value:double>").alias("valueQuantity"),
    ).alias("resource"))
    price, bal = F.col("o_totalprice"), F.col("c_acctbal")
    entries = F.array(
        patient,
        obs(price / 2000.0, code="8480-6"),
        obs(F.when(F.col("o_orderstatus") == "F", price / 3000.0).otherwise(0), text="Systolic blood pressure", code="55284-4"),
        obs(F.when(bal >= 0, bal / 50.0), text="DIASTOLIC pressure"),
        obs(price / 1500.0, text="Total Cholesterol", code="2093-3"),
        obs(F.abs(bal) / 30.0, code="15074-8"),
        obs(F.col("c_nationkey") * 5.0 + 110.0, text="Body height"),
        obs(F.abs(bal) / 40.0, text="body weight", code="8302-2"),
    )
    return c.select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), entries.alias("entry"))).alias("bundle"))


FLAT_SQL = """flat AS (
  SELECT o_orderkey AS id,
    CASE WHEN c_acctbal >= 0 THEN greatest(18, least(100, 2025 - year(o_orderdate)))::DOUBLE ELSE 52.0::DOUBLE END AS age_years,
    CASE WHEN abs(c_acctbal) / 40.0 <> 0 THEN greatest(120.0::DOUBLE, least(220.0::DOUBLE, abs(c_acctbal) / 40.0))
         ELSE greatest(120.0::DOUBLE, least(220.0::DOUBLE, c_nationkey * 5.0 + 110.0)) END AS height,
    78.5::DOUBLE AS weight,
    greatest(70.0::DOUBLE, least(240.0::DOUBLE, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 3000.0 ELSE o_totalprice / 2000.0 END)) AS ap_hi,
    CASE WHEN c_acctbal > 0 THEN greatest(40.0::DOUBLE, least(150.0::DOUBLE, c_acctbal / 50.0)) ELSE 85.0::DOUBLE END AS ap_lo,
    CASE WHEN o_totalprice / 1500.0 > 240 THEN 3 WHEN o_totalprice / 1500.0 > 200 THEN 2 ELSE 1 END AS cholesterol,
    CASE WHEN abs(c_acctbal) / 30.0 > 180 THEN 3 WHEN abs(c_acctbal) / 30.0 > 120 THEN 2 ELSE 1 END AS gluc,
    CASE WHEN c_nationkey % 3 = 1 THEN 0 ELSE 1 END AS gender_male, 0 AS smoke, 0 AS alco, 1 AS active
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("pr10_flatten_bundle", f"""
WITH {FLAT_SQL}
SELECT id, age_years, round(height, 6) AS height, weight, round(ap_hi, 6) AS ap_hi, round(ap_lo, 6) AS ap_lo,
       cholesterol, gluc, gender_male, smoke, alco, active FROM flat""")
def pr10(spark, sf):
    flat = pr.flatten_bundle(order_bundles(spark, sf), "bundle", AS_OF_YEAR)
    return flat.withColumns({c: F.round(c, 6) for c in ("height", "ap_hi", "ap_lo")})


RISK_SQL = "least(greatest(0.12::DOUBLE + ({p} - 90.0) / 100.0 * 0.45 + ({a} - 30.0) / 50.0 * 0.25 + (coalesce({l}, 1) - 1) / 2.0::DOUBLE * 0.15, 0.05::DOUBLE), 0.95::DOUBLE)"
BAND_SQL = "CASE WHEN {p} >= 0.66 THEN 'HIGH' WHEN {p} >= 0.33 THEN 'MEDIUM' ELSE 'LOW' END"
SCENARIOS = {"lower_pressure": {"ap_hi": -20.0}, "younger": {"age_years": -10.0}, "both": {"ap_hi": -20.0, "age_years": -10.0}}


@query("pr11_what_if", f"""
WITH {VITALS_SQL},
p AS (SELECT id, scenario, round({RISK_SQL.format(p='ap_hi', a='age_years', l='level')}, 4) AS base_proba,
  round({RISK_SQL.format(p='(ap_hi + dp)', a='(age_years + da)', l='level')}, 4) AS modified_proba
  FROM vitals, (VALUES ('lower_pressure', -20.0::DOUBLE, 0.0::DOUBLE), ('younger', 0.0, -10.0), ('both', -20.0, -10.0)) s(scenario, dp, da))
SELECT id, scenario, base_proba, modified_proba, {BAND_SQL.format(p='base_proba')} AS base_band, {BAND_SQL.format(p='modified_proba')} AS modified_band,
       round((modified_proba - base_proba) * 100, 2) AS delta_percent, modified_proba - base_proba < 0 AS reduced FROM p""")
def pr11(spark, sf):
    v = vitals(spark, sf).select("id", "ap_hi", "age_years", "level")
    return pr.what_if(v, "id", SCENARIOS, lambda d: pr.linear_risk(d, "ap_hi", "age_years", "level"))


@query("pr12_band_counts", f"""
WITH {VITALS_SQL}, p AS (SELECT {RISK_SQL.format(p='ap_hi', a='age_years', l='level')} AS proba FROM vitals)
SELECT count(*) AS total, count_if(proba >= 0.6)::BIGINT AS high, count_if(proba >= 0.3 AND proba < 0.6)::BIGINT AS medium,
       count_if(proba < 0.3)::BIGINT AS low, round(avg(proba), 3) AS avg_proba FROM p""")
def pr12(spark, sf):
    return pr.band_counts(pr.linear_risk(vitals(spark, sf), "ap_hi", "age_years", "level"))


@query("pr12_linear_risk", f"""
WITH {VITALS_SQL}, p AS (SELECT id, {RISK_SQL.format(p='ap_hi', a='age_years', l='level')} AS proba FROM vitals)
SELECT id, round(proba, 6) AS proba, CASE WHEN proba >= 0.6 THEN 'HIGH' WHEN proba >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM p""")
def pr12r(spark, sf):
    return pr.linear_risk(vitals(spark, sf), "ap_hi", "age_years", "level").select("id", F.round("proba", 6).alias("proba"), "band")


@query("pr13_composite_indices", f"""
WITH {VITALS_SQL}
SELECT id, round(level * 15.0::DOUBLE + {RISK_SQL.format(p='ap_hi', a='age_years', l='level')} * 40.0, 6) AS metabolic_index,
       round((ap_hi - ap_lo) * 0.85, 6) AS stiffness_index FROM vitals""")
def pr13(spark, sf):
    scored = pr.linear_risk(vitals(spark, sf), "ap_hi", "age_years", "level")
    return pr.composite_indices(scored, "level", "proba", "ap_hi", "ap_lo").select(
        "id", F.round("metabolic_index", 6).alias("metabolic_index"), F.round("stiffness_index", 6).alias("stiffness_index")
    )


@query("pr14_search", f"""
WITH {COHORT_SQL} SELECT id, segment, order_day FROM cohort
WHERE contains(lower(segment), 'ch') OR contains(CAST(id AS VARCHAR), 'ch') OR contains(CAST(order_day AS VARCHAR), 'ch')""")
def pr14(spark, sf):
    return pr.search(cohort(spark, sf), "Ch", ["segment", "id", "order_day"]).select("id", "segment", "order_day")


@query("pr15_feature_set", f"WITH {COHORT_SQL} SELECT id, price, acctbal, priority FROM cohort")
def pr15(spark, sf):
    groups = pr.FeatureGroups(continuous=("price", "acctbal"), ordinal=("priority",), nominal=("segment", "nation"))
    return cohort(spark, sf).select("id", *pr.feature_set(groups, "screening", late=("segment", "nation")).all)
