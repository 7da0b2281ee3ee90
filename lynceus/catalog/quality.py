"""DQ1-DQ26: audits, reports, flags, guards and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.catalog import query
from lynceus.operators import quality as dq
from lynceus.plans.roles import COHORT_SQL, DOCS_SQL, SCORES_SQL, cohort, labelled_documents, scores_wide, table, to_long

ORDER_SPEC = dq.TableSpec(
    columns=("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_shippriority", "o_orderstatus"),
    target="o_orderstatus",
)


@query("dq1_validate_structure", """
SELECT * FROM (
  SELECT 'missing_column' AS check_name, 'o_shippriority' AS column_name, CAST(1 AS BIGINT) AS n_bad
  UNION ALL SELECT 'unexpected_column', 'o_orderdate', 1
  UNION ALL SELECT 'not_numeric', 'o_orderpriority', count_if(o_orderpriority IS NOT NULL AND TRY_CAST(o_orderpriority AS DOUBLE) IS NULL)::BIGINT FROM orders
  UNION ALL SELECT 'null_target', 'o_orderstatus', count_if(o_orderstatus IS NULL)::BIGINT FROM orders
  UNION ALL SELECT 'single_class', 'o_orderstatus', CAST(count(DISTINCT o_orderstatus) < 2 AS BIGINT) FROM orders) WHERE n_bad > 0""")
def dq1(spark, sf):
    return dq.validate_structure(table(spark, sf, "orders"), ORDER_SPEC)


COHORT_COLS = ("id", "y", "price", "acctbal", "known_bal", "priority", "segment", "nation", "order_day")
FEATURES = ("price", "acctbal", "known_bal", "priority", "nation", "order_day")


def _union(rows):
    return "\nUNION ALL ".join(rows)


MISSING_SQL = _union(
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL)::BIGINT AS n_missing, round(count_if({c} IS NULL) * 100.0::DOUBLE / count(*), 2) AS pct_missing FROM cohort"
    for c in COHORT_COLS
)


@query("dq2_missing_report", f"WITH {COHORT_SQL} {MISSING_SQL}")
def dq2(spark, sf):
    return dq.missing_report(cohort(spark, sf))


@query("dq3_duplicate_rows", """
WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang, n_chars) AS first_id FROM documents)
SELECT doc_id, first_id FROM d WHERE doc_id > first_id""")
def dq3(spark, sf):
    return dq.duplicate_rows(table(spark, sf, "documents"), ["text", "lang", "n_chars"], "doc_id")


@query("dq3_duplicate_count", """
SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates, count_if(n > 1)::BIGINT AS n_repeated
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def dq3c(spark, sf):
    return dq.duplicate_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq4_duplicate_summary", """
SELECT (SELECT count(*) - count(DISTINCT (ts, user_id, event_type, value, props)) FROM events) AS n_duplicate_rows,
       (SELECT count(*) - count(DISTINCT event_id) FROM events) AS n_duplicate_ids""")
def dq4(spark, sf):
    return dq.duplicate_summary(table(spark, sf, "events"), "event_id")


NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query("dq5_numeric_summary", _union(
    f"""SELECT '{c}' AS column_name, round(min({c})::DOUBLE, 3) AS min, round(max({c})::DOUBLE, 3) AS max, round(avg({c}), 3) AS mean,
        round(quantile_cont({c}::DOUBLE, 0.5), 3) AS median, round(stddev_samp({c}), 3) AS std, count(DISTINCT {c}) AS n_unique FROM lineitem"""
    for c in NUM))
def dq5(spark, sf):
    return dq.numeric_summary(table(spark, sf, "lineitem"), list(NUM))


def quartile_sql(cols, source):
    return _union(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        round(min({c})::DOUBLE, 6) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50,
        round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, round(max({c})::DOUBLE, 6) AS max FROM {source}"""
        for c in cols)


@query("dq6_describe_quartiles", f"WITH {COHORT_SQL} {quartile_sql(FEATURES, 'cohort')}")
def dq6(spark, sf):
    return dq.describe_quartiles(cohort(spark, sf), list(FEATURES))


CATS = ("segment", "priority", "nation")
COUNTS_SQL = _union(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM cohort WHERE {c} IS NOT NULL GROUP BY {c}" for c in CATS)


@query("dq7_value_counts", f"WITH {COHORT_SQL} {COUNTS_SQL}")
def dq7(spark, sf):
    return dq.value_counts(cohort(spark, sf), list(CATS))


DOMAINS = {"segment": ("AUTOMOBILE", "BUILDING", "HOUSEHOLD"), "priority": (1, 2, 3, 4)}
DOMAIN_SQL = """SELECT column_name, value, n FROM (
  SELECT 'segment' AS column_name, segment AS value, count(*) AS n FROM cohort WHERE segment NOT IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD') GROUP BY segment
  UNION ALL SELECT 'priority', CAST(priority AS VARCHAR), count(*) FROM cohort WHERE priority NOT IN (1, 2, 3, 4) GROUP BY priority)"""


@query("dq8_domain_violations", f"WITH {COHORT_SQL} {DOMAIN_SQL}")
def dq8(spark, sf):
    return dq.domain_violations(cohort(spark, sf), DOMAINS)


@query("dq9_sentinel_counts", _union(
    f"SELECT '{c}' AS column_name, count_if({c} = 0)::BIGINT AS n_sentinel FROM lineitem" for c in ("l_discount", "l_tax")))
def dq9(spark, sf):
    return dq.sentinel_counts(table(spark, sf, "lineitem"), ["l_discount", "l_tax"])


@query("dq10_apply_sentinels", """
SELECT count(*) AS n, count(nullif(l_discount, 0)) AS n_discount, count(nullif(l_tax, 0)) AS n_tax,
       round(avg(nullif(l_discount, 0)), 6) AS avg_discount, round(avg(nullif(l_tax, 0)), 6) AS avg_tax FROM lineitem""")
def dq10(spark, sf):
    clean = dq.apply_sentinels(table(spark, sf, "lineitem"), {"l_discount": [0.0], "l_tax": [0.0]})
    return clean.agg(
        F.count(F.lit(1)).alias("n"), F.count("l_discount").alias("n_discount"), F.count("l_tax").alias("n_tax"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.round(F.avg("l_tax"), 6).alias("avg_tax"),
    )


RANGES = {"price": (1000.0, 400000.0), "known_bal": (500.0, 9500.0), "order_day": (0.0, 3000.0)}
RANGE_SQL = _union(
    f"SELECT '{c}' AS column_name, count_if({c} < {lo} OR {c} > {hi})::BIGINT AS n_out FROM cohort" for c, (lo, hi) in RANGES.items())


@query("dq11_out_of_range", f"WITH {COHORT_SQL} {RANGE_SQL}")
def dq11(spark, sf):
    return dq.out_of_range(cohort(spark, sf), RANGES)


@query("dq12_zero_variance", f"""
WITH {COHORT_SQL}, wide AS (SELECT *, 1 AS site FROM cohort)
SELECT column_name FROM ({_union(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS d FROM wide" for c in FEATURES + ('site',))}) WHERE d <= 1""")
def dq12(spark, sf):
    return dq.zero_variance(cohort(spark, sf).withColumn("site", F.lit(1)), [*FEATURES, "site"])


DIST_SQL = """
raw AS (SELECT CAST(priority - 1 AS DOUBLE) AS value, count(*) AS n FROM cohort GROUP BY 1),
both_kinds AS (SELECT 'raw' AS kind, value, n FROM raw
         UNION ALL SELECT 'binary', CAST(value > 0 AS INTEGER)::DOUBLE, sum(n)::BIGINT FROM raw GROUP BY 2)"""


@query("dq13_target_distribution", f"""
WITH {COHORT_SQL}, {DIST_SQL}
SELECT kind, value, n, round(n / sum(n) OVER (PARTITION BY kind), 6) AS share,
       kind = 'binary' AND min(n) OVER (PARTITION BY kind) / sum(n) OVER (PARTITION BY kind) < 0.2 AS minority_alarm
FROM both_kinds""")
def dq13(spark, sf):
    return dq.target_distribution(cohort(spark, sf).withColumn("grade", F.col("priority") - 1), "grade")


QUALITY_SPEC = dq.TableSpec(
    columns=COHORT_COLS, target="y", numeric=FEATURES, categorical=CATS, domains=DOMAINS, ranges=RANGES,
    zero_sentinels=("acctbal", "order_day"),
)
_REST = "y, price, acctbal, known_bal, priority, segment, nation, order_day"


@query("dq14_quality_report", f"""
WITH {COHORT_SQL}
SELECT 'missing' AS check_name, column_name, n_missing::DOUBLE AS value, 'info' AS severity FROM ({MISSING_SQL})
UNION ALL SELECT 'duplicates', '*', d::DOUBLE, CASE WHEN d > 0 THEN 'warning' ELSE 'info' END
  FROM (SELECT sum(n - 1)::BIGINT AS d FROM (SELECT count(*) AS n FROM cohort GROUP BY {_REST}))
UNION ALL SELECT 'domain', column_name || '=' || value, n::DOUBLE, 'warning' FROM ({DOMAIN_SQL})
UNION ALL SELECT 'zero_sentinel', column_name, n::DOUBLE, CASE WHEN n > 0 THEN 'warning' ELSE 'info' END FROM (
  SELECT 'acctbal' AS column_name, count_if(acctbal = 0)::BIGINT AS n FROM cohort UNION ALL SELECT 'order_day', count_if(order_day = 0)::BIGINT FROM cohort)
UNION ALL SELECT 'out_of_range', column_name, n_out::DOUBLE, CASE WHEN n_out > 0 THEN 'warning' ELSE 'info' END FROM ({RANGE_SQL})
UNION ALL SELECT 'zero_variance', column_name, 1::DOUBLE, 'warning' FROM (
  {_union(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS d FROM cohort" for c in COHORT_COLS if c not in ('id', 'y'))}) WHERE d <= 1
UNION ALL SELECT 'target_share', 'y=' || y, round(n / sum(n) OVER (), 6), CASE WHEN min(n) OVER () / sum(n) OVER () < 0.2 THEN 'warning' ELSE 'info' END
  FROM (SELECT y, count(*) AS n FROM cohort GROUP BY y)""")
def dq14(spark, sf):
    return dq.quality_report(cohort(spark, sf), QUALITY_SPEC, "id")


def cohort_rules():
    return {
        "negative_balance": F.col("acctbal") < 0,
        "price_implausible": dq.range_rule("price", 1000.0, 400000.0),
        "priority_balance_conflict": (F.col("priority") == 5) & (F.col("known_bal") > 9000),
    }


RULES = ("negative_balance", "price_implausible", "priority_balance_conflict")
FLAGGED_SQL = f"""{COHORT_SQL},
rules AS (SELECT *, acctbal < 0 AS negative_balance, price < 1000.0 OR price > 400000.0 AS price_implausible,
                 coalesce(priority = 5 AND known_bal > 9000, false) AS priority_balance_conflict FROM cohort),
flagged AS (SELECT *, negative_balance OR price_implausible OR priority_balance_conflict AS any_flag FROM rules)"""
SUMMARY_SQL = f"""SELECT count(*) AS n_total, {', '.join(f'count_if({r})::BIGINT AS {r}' for r in RULES)}, count_if(any_flag)::BIGINT AS any_flag_count,
  round(avg(any_flag::INTEGER) * 100, 6) AS any_flag_percent, count_if(NOT any_flag)::BIGINT AS clean_count,
  round(100 - avg(any_flag::INTEGER) * 100, 6) AS clean_percent FROM flagged"""
RATE_SQL = "SELECT any_flag, round(avg(y), 6) AS target_rate, count(*) AS n FROM flagged GROUP BY any_flag"


def flagged_cohort(spark, sf):
    return dq.plausibility_flags(cohort(spark, sf), cohort_rules())


def _melt(section, item, source, cols, alias=None):
    return [
        f"SELECT '{section}' AS section, {item} AS item, '{(alias or {}).get(c, c)}' AS metric, ({c})::DOUBLE AS value FROM ({source})" for c in cols
    ]


@query("dq15_audit", f"""
WITH {FLAGGED_SQL}
{_union(
    _melt('shape', "'table'", "SELECT count(*) AS rows, 9 AS columns FROM cohort", ['rows', 'columns'])
    + _melt('missing', 'column_name', f"SELECT * FROM ({MISSING_SQL}) WHERE n_missing > 0", ['n_missing'], {'n_missing': 'n'})
    + _melt('duplicates', "'table'", f"SELECT count(*) - count(DISTINCT ({_REST})) AS rows, count(*) - count(DISTINCT id) AS ids FROM cohort", ['rows', 'ids'])
    + _melt('target', 'CAST(y AS VARCHAR)', "SELECT y, count(*) AS n FROM cohort GROUP BY y", ['n'])
    + _melt('numeric', 'column_name', quartile_sql(FEATURES, 'cohort'), ['n', 'mean', 'std', 'min', 'q25', 'q50', 'q75', 'max'])
    + _melt('categorical', "column_name || '=' || value", COUNTS_SQL, ['n'])
    + _melt('flags', "'table'", SUMMARY_SQL, ['n_total', *RULES, 'any_flag_count', 'any_flag_percent', 'clean_count', 'clean_percent'])
    + _melt('rate_by_flag', "CASE WHEN any_flag THEN 'flagged' ELSE 'clean' END", RATE_SQL, ['target_rate', 'n'], {'target_rate': 'rate'}))}""")
def dq15(spark, sf):
    return dq.audit(cohort(spark, sf), QUALITY_SPEC, "id", cohort_rules())


@query("dq16_plausibility_flags", f"WITH {FLAGGED_SQL} SELECT id, {', '.join(RULES)}, any_flag FROM flagged")
def dq16(spark, sf):
    return flagged_cohort(spark, sf).select("id", *RULES, "any_flag")


@query("dq17_flag_summary", f"WITH {FLAGGED_SQL} {SUMMARY_SQL}")
def dq17(spark, sf):
    return dq.flag_summary(flagged_cohort(spark, sf), list(RULES))


@query("dq18_target_rate_by_flag", f"WITH {FLAGGED_SQL} {RATE_SQL}")
def dq18(spark, sf):
    return dq.target_rate_by_flag(flagged_cohort(spark, sf), "y")


@query("dq19_split_clean", f"""
WITH {FLAGGED_SQL} SELECT CASE WHEN any_flag THEN 'excluded' ELSE 'modelling' END AS part, count(*) AS n, sum(y)::BIGINT AS n_positive
FROM flagged GROUP BY 1""")
def dq19(spark, sf):
    model, excluded = dq.split_clean(flagged_cohort(spark, sf))
    both = model.select("y", F.lit("modelling").alias("part")).unionByName(excluded.select("y", F.lit("excluded").alias("part")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_positive"))


@query("dq20_matrix_violations", f"""
WITH {COHORT_SQL}
{_union(f"SELECT '{c}' AS column_name, count_if({c} IS NULL)::BIGINT AS n_missing, 0::BIGINT AS n_infinite, count_if({c} < 0 - 1e-8 OR {c} > 9000 + 1e-8)::BIGINT AS n_outside FROM cohort" for c in ('acctbal', 'known_bal', 'order_day'))}
UNION ALL SELECT 'y', count_if(y IS NULL)::BIGINT, 0::BIGINT, count_if(y NOT IN (0, 1))::BIGINT FROM cohort""")
def dq20(spark, sf):
    return dq.matrix_violations(cohort(spark, sf), ["acctbal", "known_bal", "order_day"], 0, 9000, label="y")


@query("dq21_closeness", f"""
WITH {SCORES_SQL}, l AS (SELECT id, a, b FROM scores), r AS (SELECT id, round(a, 3) AS a, b FROM scores WHERE stage <> 'C'),
j AS (SELECT l.id AS lid, r.id AS rid, l.a AS la, r.a AS ra, l.b AS lb, r.b AS rb FROM l FULL JOIN r ON l.id = r.id)
SELECT 'a' AS column_name, count_if(lid IS NULL OR rid IS NULL)::BIGINT AS n_unmatched, round(max(abs(la - ra)), 9) AS max_abs_diff,
       count_if(coalesce(abs(la - ra) > 1e-10 + 1e-8 * abs(ra), false) OR ((la IS NULL) <> (ra IS NULL)))::BIGINT AS n_apart FROM j
UNION ALL SELECT 'b', count_if(lid IS NULL OR rid IS NULL)::BIGINT, round(max(abs(lb - rb)), 9),
       count_if(coalesce(abs(lb - rb) > 1e-10 + 1e-8 * abs(rb), false) OR ((lb IS NULL) <> (rb IS NULL)))::BIGINT FROM j""")
def dq21(spark, sf):
    s = scores_wide(spark, sf)
    other = s.filter("stage <> 'C'").select("id", F.round("a", 3).alias("a"), "b")
    return dq.closeness(s, other, "id", ["a", "b"])


REQUIRED = {"id": "bigint", "price": "double", "known_bal": "double", "priority": "double", "weight": "double"}


@query("dq22_scoring_readiness", f"""
WITH {COHORT_SQL}
SELECT c AS column_name, c <> 'weight' AS present, c NOT IN ('weight', 'priority') AS type_ok,
       CASE c WHEN 'id' THEN count_if(id IS NULL) WHEN 'price' THEN count_if(price IS NULL) WHEN 'known_bal' THEN count_if(known_bal IS NULL)
              WHEN 'priority' THEN count_if(priority IS NULL) END::BIGINT AS n_missing,
       count(*) AS n_records, false AS table_valid
FROM cohort, (VALUES ('id'), ('price'), ('known_bal'), ('priority'), ('weight')) t(c) GROUP BY c""")
def dq22(spark, sf):
    return dq.scoring_readiness(cohort(spark, sf), REQUIRED)


@query("dq23_quarantine", f"""
WITH {COHORT_SQL},
r AS (SELECT id, concat_ws(',', CASE WHEN price IS NULL OR price < 1000 OR price > 400000 THEN 'price' END,
  CASE WHEN known_bal IS NULL OR known_bal < 0 OR known_bal > 9000 THEN 'known_bal' END,
  CASE WHEN priority IS NULL OR priority < 1 OR priority > 4 THEN 'priority' END) AS reasons FROM cohort)
SELECT id, CASE WHEN reasons = '' THEN 'accepted' ELSE 'rejected' END AS part, reasons FROM r""")
def dq23(spark, sf):
    ok, bad = dq.quarantine(
        cohort(spark, sf).select("id", "price", "known_bal", "priority"),
        {"price": (1000, 400000), "known_bal": (0, 9000), "priority": (1, 4)},
    )
    return ok.select("id", F.lit("accepted").alias("part"), F.lit("").alias("reasons")).unionByName(
        bad.select("id", F.lit("rejected").alias("part"), F.concat_ws(",", "reasons").alias("reasons"))
    )


def vitals(spark, sf):
    """Cohort columns rescaled into the ranges of vital signs."""
    return cohort(spark, sf).select(
        "id", "y",
        (F.col("price") / 2111.0).alias("ap_hi"),
        (F.col("acctbal") / 70.0 + 40.0).alias("ap_lo"),
        (F.col("order_day") / 31.0).alias("age_years"),
        (F.col("nation") * 3.0 + 120.0).alias("height"),
        (F.col("known_bal") / 90.0 + 40.0).alias("weight"),
        ((F.col("priority") + 1) / 2).cast("int").alias("level"),
    )


VITALS_SQL = f"""{COHORT_SQL},
vitals AS (SELECT id, y, price / 2111.0 AS ap_hi, acctbal / 70.0 + 40.0 AS ap_lo, order_day / 31.0::DOUBLE AS age_years, nation * 3.0::DOUBLE + 120.0 AS height,
                  known_bal / 90.0 + 40.0 AS weight, CAST(floor((priority + 1) / 2.0) AS INTEGER) AS level FROM cohort)"""


@query("dq16_vital_flags", f"""
WITH {VITALS_SQL}, f AS (SELECT *, coalesce(ap_hi < 60 OR ap_hi > 250, false) AS ap_hi_implausible, coalesce(ap_lo < 40 OR ap_lo > 200, false) AS ap_lo_implausible,
  coalesce(height < 100 OR height > 220, false) AS height_implausible, coalesce(weight < 30, false) AS weight_implausible, coalesce(ap_hi < ap_lo, false) AS ap_hi_below_ap_lo FROM vitals),
flagged AS (SELECT *, ap_hi_implausible OR ap_lo_implausible OR height_implausible OR weight_implausible OR ap_hi_below_ap_lo AS any_flag FROM f)
SELECT ap_hi_implausible, ap_lo_implausible, height_implausible, weight_implausible, ap_hi_below_ap_lo, any_flag, count(*) AS n, round(avg(y), 6) AS target_rate
FROM flagged GROUP BY ALL""")
def dq16v(spark, sf):
    rules = dq.vital_rules()
    flagged = dq.plausibility_flags(vitals(spark, sf), rules)
    return flagged.groupBy(*rules, "any_flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("target_rate"))


GUARD_SQL = f"""{VITALS_SQL},
g AS (SELECT id, y, ap_hi, ap_lo, age_years AS age, height, coalesce(weight, 78) AS weight, coalesce(weight, 78) / ((height / 100.0::DOUBLE) ** 2) AS bmi FROM vitals),
d AS (SELECT *, ((ap_hi - 120) / 30) ** 2 + ((ap_lo - 80) / 20) ** 2 + ((age - 50) / 20) ** 2 + ((bmi - 25) / 10) ** 2 AS d2 FROM g),
w AS (SELECT *, round(sqrt(d2), 3) AS distance, round(exp(-0.1::DOUBLE * d2), 4) AS similarity FROM d),
guard AS (SELECT *, concat_ws(',', CASE WHEN ap_hi > 220 OR ap_hi < 70 THEN 'extreme_systolic' END, CASE WHEN ap_lo > 140 OR ap_lo < 40 THEN 'extreme_diastolic' END,
  CASE WHEN ap_hi <= ap_lo THEN 'inverted_pressure' END, CASE WHEN age > 110 OR age < 10 THEN 'age_out_of_bounds' END,
  CASE WHEN bmi > 65 OR bmi < 12 THEN 'extreme_bmi' END, CASE WHEN similarity < 0.40 THEN 'low_similarity' END) AS warnings FROM w)"""


@query("dq24_ood_guard", f"""
WITH {GUARD_SQL}
SELECT id, distance, similarity, warnings, warnings <> '' AS is_ood,
       CASE WHEN warnings = '' THEN 'in_distribution' WHEN contains(warnings, ',') THEN 'high_outlier' ELSE 'moderate_deviation' END AS verdict FROM guard""")
def dq24(spark, sf):
    return dq.ood_guard(vitals(spark, sf)).select(
        "id", "distance", "similarity", F.concat_ws(",", "warnings").alias("warnings"), "is_ood", "verdict"
    )


@query("dq25_runs_consistent", f"""
WITH {SCORES_SQL}, runs AS (SELECT id, y, model AS run, proba FROM long WHERE model <> 'c' UNION ALL SELECT id, y, 'c', a FROM scores WHERE stage <> 'B'),
per_id AS (SELECT id, count(DISTINCT run) AS r, max(k) AS k, min(y0) AS y0, max(y1) AS y1, sum(bad) AS bad FROM (
  SELECT id, run, count(*) AS k, min(y) AS y0, max(y) AS y1, count_if(NOT coalesce(proba BETWEEN 0 AND 1, false)) AS bad FROM runs GROUP BY id, run) GROUP BY id),
s AS (SELECT count_if(r <> 3)::BIGINT AS n_ids_missing, count_if(k > 1)::BIGINT AS n_ids_repeated, count_if(y0 <> y1)::BIGINT AS n_label_conflicts, sum(bad)::BIGINT AS n_bad_proba FROM per_id)
SELECT *, n_ids_missing + n_ids_repeated + n_label_conflicts + n_bad_proba = 0 AS consistent FROM s""")
def dq25(spark, sf):
    s = scores_wide(spark, sf)
    runs = to_long(s, ["a", "b"]).withColumnRenamed("model", "run").drop("stage", "fold")
    third = s.filter("stage <> 'B'").select("id", "y", F.lit("c").alias("run"), F.col("a").alias("proba"))
    return dq.runs_consistent(runs.unionByName(third))


def _slice(dim, expr):
    return f"""SELECT '{dim}' AS dim, {expr} AS level, count(*) AS n, count_if(quality = 1 AND pred = 1) AS tp, count_if(quality = 1 AND pred = 0) AS fn,
      count_if(quality = 0 AND pred = 0) AS tn, count_if(quality = 0 AND pred = 1) AS fp FROM p GROUP BY 2"""


@query("dq26_subgroup_metrics", f"""
WITH {DOCS_SQL}, p AS (SELECT *, CAST(n_chars >= 2000 AS INTEGER) AS pred,
  CASE WHEN n_chars < 500 THEN '<500' WHEN n_chars < 5000 THEN '500-4999' ELSE '>=5000' END AS band FROM docs),
s AS ({_slice('all', "'all'")} UNION ALL {_slice('source', 'source')} UNION ALL {_slice('lang', 'lang')} UNION ALL {_slice('band', 'band')}),
m AS (SELECT dim, level, n, tp / nullif(tp + fn, 0) AS sens, tn / nullif(tn + fp, 0) AS spec FROM s),
o AS (SELECT sens AS os, spec AS ot FROM m WHERE dim = 'all')
SELECT dim, level, n, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity,
       coalesce(abs(sens - os) > 0.1, false) OR coalesce(abs(spec - ot) > 0.1, false) AS disparity FROM m, o""")
def dq26(spark, sf):
    n = F.col("n_chars")
    d = labelled_documents(spark, sf).withColumns({
        "pred": (n >= 2000).cast("int"),
        "band": F.when(n < 500, "<500").when(n < 5000, "500-4999").otherwise(">=5000"),
    })
    return dq.subgroup_metrics(d, ["source", "lang", "band"], y="quality")
