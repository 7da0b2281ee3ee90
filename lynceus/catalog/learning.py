"""ML1-ML20: training, tuning, stacking, scoring and explanation on the cohort.

Fitted models have no SQL counterpart: their queries are checked by row count and by unit tests, and
everything around them that is plain aggregation has its own SQL.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from lynceus.catalog import query
from lynceus.catalog.evaluation import SCORES_SQL, delong_sql, holm_sql, rank_sql, round_all
from lynceus.catalog.features import SPLIT_SQL, noise_sql, train_test
from lynceus.catalog.quality import VITALS_SQL, vitals
from lynceus.catalog.sampling import H, RANKED_SQL
from lynceus.operators import evaluate as ev, gate, models as ml, staged
from lynceus.operators.derive import FeatureGroups
from lynceus.operators.sampling import assign_folds
from lynceus.plans.config import FeatureConfig
from lynceus.plans.roles import COHORT_SQL, cohort, scores_long, scores_wide, vectors
from lynceus.session import new_table_path, stored

GROUPS = FeatureGroups(continuous=("price", "known_bal", "order_day"), ordinal=("priority",), nominal=("segment",))
CFG = FeatureConfig(selector="f_classif", k_best=6)
K = 5
SEEDS = gate.STABILITY_SEEDS


def prep(space: str = "classical") -> ml.FeaturePrep:
    return ml.FeaturePrep(GROUPS, "y", CFG, space)


def folded(spark, sf):
    return assign_folds(cohort(spark, sf), "id", "y", K, 42)


def _fit_logreg():
    return ml.LogisticLearner(prep())


def _fit_boosted():
    """The frozen setting: 300 trees of depth 4."""
    return lambda t: Pipeline(stages=[prep(), ml.boosted(**ml.BOOSTED_FROZEN).over_cells()]).fit(t)


def _holdout_scores(spark, sf, estimator):
    train, data = train_test(spark, sf)
    model = Pipeline(stages=[prep(), estimator(train)]).fit(train)
    return round_all(ml.score(model, data.filter("split = 'test'"), ["id", "y"]), "proba")


@query("ml1_logreg")
def ml1(spark, sf):
    return _holdout_scores(spark, sf, lambda t: ml.logreg(1.0))


@query("ml2_forest")
def ml2(spark, sf):
    """The point of the forest grid with most trees, depth 5."""
    return _holdout_scores(spark, sf, lambda t: ml.forest(300, 5))


@query("ml3_boosted")
def ml3(spark, sf):
    return _holdout_scores(spark, sf, lambda t: ml.boosted(**ml.BOOSTED_FROZEN))


@query("ml3_staged")
def ml3s(spark, sf):
    """Held-out metrics of the frozen setting after both numbers of trees of the grid, from one ensemble."""
    train, data = train_test(spark, sf)
    stage = prep().fit(train)
    trees = staged.trees_of(spark, ml.boosted(**ml.BOOSTED_FROZEN).fit(stage.transform(train)))
    held = stage.transform(data.filter("split = 'test'")).select("id", "y", "features")
    return round_all(staged.staged_metrics(held, trees, ml.BOOSTED_GRID["trees"]), *ml.CV_METRICS, "brier")


def rbf_svm():
    return ml.RbfSvm(GROUPS, ml.SVM_GRID["C"], ml.SVM_GRID["gamma"], cfg=CFG, k=K)


def landmark_classifier():
    return ml.LandmarkClassifier(64, ml.KERNEL_GRID["C"], k=K)


def labelled_vectors(spark, sf):
    return assign_folds(vectors(spark, sf).withColumn("y", (F.col("label") < 5).cast("int")), "id", "y", K, 42)


@query("ml4_rbf_svm")
def ml4(spark, sf):
    """Held-out probabilities of the best of 16 points, searched over five folds of the training rows."""
    train, data = train_test(spark, sf)
    return round_all(ml.score(rbf_svm().fit(train), data.filter("split = 'test'"), ["id", "y"]), "proba")


@query("ml4_grid")
def ml4g(spark, sf):
    return round_all(rbf_svm().search(folded(spark, sf)).table, "mean", "std", "ci_low", "ci_high")


def calibration_sql(ranked):
    """Mean of the smoothed labels a sigmoid is fitted on, without each fold (and without none, numbered K)."""
    return f"""
WITH {ranked}, f AS (SELECT y, CAST((r - 1) % {K} AS INTEGER) AS fold FROM ranked),
c AS (SELECT CAST(h.without AS INTEGER) AS without, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM f JOIN range({K + 1}) h(without) ON f.fold <> h.without GROUP BY ALL)
SELECT without, (n1 + n0)::BIGINT AS n, round((n1 * (n1 + 1) / (n1 + 2) + n0 / (n0 + 2)) / (n1 + n0), 6) AS mean_proba FROM c"""


def mean_calibrated(found):
    """A sigmoid has a free shift, so its mean over the margins it was fitted on is the mean of their smoothed labels."""
    c = found.calibration
    by_fit = [*c.crossed, c.final]
    scored = type(c)(by_fit, c.final, c.rows).probabilities(c.rows, "fit")
    return round_all(scored.groupBy(F.col("fit").alias("without")).agg(F.count(F.lit(1)).alias("n"), F.avg("proba").alias("mean_proba")), "mean_proba")


@query("ml4_calibration", calibration_sql(RANKED_SQL))
def ml4c(spark, sf):
    return mean_calibrated(rbf_svm().search(folded(spark, sf)))


@query("ml5_landmark_classifier")
def ml5(spark, sf):
    v = labelled_vectors(spark, sf)
    model = landmark_classifier().fit(v.filter("fold <> 0"))
    return round_all(ml.score(model, v.filter("fold = 0"), ["id", "y"]), "proba")


@query("ml5_grid")
def ml5g(spark, sf):
    return round_all(landmark_classifier().search(labelled_vectors(spark, sf)).table, "mean", "std", "ci_low", "ci_high")


@query("ml6_grid_search")
def ml6(spark, sf):
    df = folded(spark, sf)
    found = ml.logistic_search(df, ml.LOGREG_GRID["C"], K, prep())
    return round_all(found.table, "mean", "std", "ci_low", "ci_high")


@query("ml1_optimality", f"""
WITH {RANKED_SQL}, f AS (SELECT y, CAST((r - 1) % {K} AS INTEGER) AS fold FROM ranked)
SELECT h.fold, p.C, count(*) AS n, round(avg(y), 6) AS mean_score FROM f JOIN (SELECT DISTINCT fold FROM f) h ON f.fold <> h.fold,
  unnest({ml.LOGREG_GRID['C']}::DOUBLE[]) p(C) GROUP BY ALL""")
def ml1o(spark, sf):
    """All points and folds of the grid: at the optimum the mean training score is the label rate."""
    Cs = ml.LOGREG_GRID["C"]
    return round_all(ml.training_means(ml.logistic_folds([folded(spark, sf)], prep(), K, Cs), Cs), "mean_score")


@query("ml7_class_weights", f"""
WITH {COHORT_SQL} SELECT id, y, round(count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY y)), 9) AS weight FROM cohort""")
def ml7(spark, sf):
    return round_all(ml.class_weights(cohort(spark, sf).select("id", "y")), "weight", digits=9)


@query("ml7_compare_weighting")
def ml7c(spark, sf):
    return round_all(ml.compare_weighting(folded(spark, sf), prep(), 1.0, K), "value")


def _oof(spark, sf):
    df = folded(spark, sf)
    compact = ml.LogisticLearner(prep("compact"))
    return ml.oof_scores(df, {"base": _fit_boosted(), "aux": compact, "control": _fit_logreg()}, K)


@query("ml8_oof_scores")
def ml8(spark, sf):
    return round_all(_oof(spark, sf), "proba")


@query("ml8_oof_coverage", f"""
WITH {RANKED_SQL}, f AS (SELECT id, y, CAST((r - 1) % {K} AS INTEGER) AS fold FROM ranked)
SELECT fold, count(*) AS n_rows, count(DISTINCT id) AS n_ids, sum(y)::BIGINT AS n_positive, 0::BIGINT AS n_bad FROM f GROUP BY fold""")
def ml8c(spark, sf):
    df = folded(spark, sf)
    oof = ml.oof_scores(df, {"base": _fit_logreg()}, K)
    per_id = oof.groupBy("id", "fold").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y"), F.sum((~F.col("proba").between(0, 1)).cast("long")).alias("bad"))
    return per_id.groupBy("fold").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"), F.sum("y").alias("n_positive"), F.sum("bad").alias("n_bad"))


@query("ml9_stack_cv")
def ml9(spark, sf):
    wide = stored(ml.oof_wide(_oof(spark, sf), ["base", "aux", "control"]))
    stacked = ml.stack_cv(wide, "p_base", "p_aux", "p_control", K)
    return round_all(ev.ranking_metrics(stacked, ["fold", "model"]), "roc_auc", "pr_auc")


@query("ml9_final_stack", f"""
WITH {SPLIT_SQL} SELECT split, count(*) AS n_rows, count(DISTINCT id) AS n_ids, sum(y)::BIGINT AS n_positive, 0::BIGINT AS n_bad FROM data GROUP BY split""")
def ml9f(spark, sf):
    """Coverage of the final stack, fitted on the training rows and applied to the whole table."""
    train, data = train_test(spark, sf)
    stack = ml.fit_stack(assign_folds(train, "id", "y", K, 42), {"base": _fit_boosted(), "aux": _fit_logreg()}, K)
    bad = (~F.coalesce(F.col("proba").between(0, 1), F.lit(False))).cast("long")
    return ml.score(stack, data, ["id", "y", "split"]).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.sum("y").alias("n_positive"), F.sum(bad).alias("n_bad"))


@query("ml10_residual_fusion")
def ml10(spark, sf):
    df = folded(spark, sf)
    wide = ml.oof_wide(ml.oof_scores(df, {"base": _fit_logreg()}, K), ["base"])
    unit = df.select("id", (F.col("price") / 500000.0).alias("price"), (F.col("acctbal") / 10000.0).alias("acctbal"))
    return round_all(ml.residual_fusion(stored(wide.join(unit, "id")), ["price", "acctbal"], "p_base", width=6), "proba")


@query("ml11_compare_candidates")
def ml11(spark, sf):
    df = folded(spark, sf)
    rich = df.withColumn("price_per_day", F.col("price") / (F.col("order_day") + 1))
    wider = FeatureGroups(continuous=(*GROUPS.continuous, "price_per_day"), ordinal=GROUPS.ordinal, nominal=GROUPS.nominal)
    engineered = ml.LogisticLearner(ml.FeaturePrep(wider, "y", CFG))
    candidates = {"logreg": _fit_logreg(), "boosted": _fit_boosted(), "engineered": engineered}
    return round_all(ml.compare_candidates(rich, candidates, K), "mean", "std", "ci_low", "ci_high")


@query("ml12_seed_stability")
def ml12(spark, sf):
    return round_all(ml.logistic_stability(cohort(spark, sf), prep(), 1.0, K, SEEDS), "mean", "std", "min", "max")


@query("ml13_score_table")
def ml13(spark, sf):
    from lynceus.plans.scoring import fit_scorer, score_batch

    train, data = train_test(spark, sf)
    return score_batch(data, fit_scorer(train, GROUPS, CFG))


@query("ml14_explain_global")
def ml14(spark, sf):
    from lynceus.operators.features import fit_features

    train, _ = train_test(spark, sf)
    fitted = fit_features(train, GROUPS, "y", CFG)
    model = ml.forest(10, 4).fit(fitted.model().transform(train))
    return round_all(ml.explain_global(spark, model, fitted.selected), "value")


#: Linear weights of the additive screening score per unit of pressure, age and level.
WEIGHTS = {"ap_hi": 0.0045, "age_years": 0.005, "level": 0.075}
CONTRIB_SQL = f"""{VITALS_SQL}, m AS (SELECT avg(ap_hi) AS a, avg(age_years) AS b, avg(level) AS c FROM vitals),
contrib AS (SELECT id, 'ap_hi' AS feature, 0.0045::DOUBLE * (ap_hi - a) AS contribution FROM vitals, m
  UNION ALL SELECT id, 'age_years', 0.005::DOUBLE * (age_years - b) FROM vitals, m UNION ALL SELECT id, 'level', 0.075::DOUBLE * (level - c) FROM vitals, m)"""


@query("ml15_explain_rows", f"""
WITH {CONTRIB_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, feature) AS rank FROM contrib)
SELECT id, CAST(rank AS INTEGER) AS rank, feature, round(contribution, 6) AS contribution FROM r WHERE rank <= 2""")
def ml15(spark, sf):
    v = vitals(spark, sf)
    return round_all(ml.explain_rows(v, WEIGHTS, ml.column_means(v, list(WEIGHTS)), 2), "contribution")


@query("ml16_permutation_importance")
def ml16(spark, sf):
    train, data = train_test(spark, sf)
    held = data.filter("split = 'test'").drop("split")
    return round_all(ml.permutation_importance(held, _fit_boosted()(train), ["price", "known_bal", "order_day"]), "importance", "std")


@query("ml16_permuted_values", f"""
WITH {SPLIT_SQL}, t AS (SELECT id, price, known_bal, row_number() OVER (ORDER BY {H}, id) AS r, count(*) OVER () AS n FROM data WHERE split = 'test'),
s AS (SELECT CAST(k AS INTEGER) AS repeat, 1 + CAST('0x' || substr(md5('42:' || k), 1, 8) AS BIGINT) % (n - 1) AS shift FROM range(10) x(k), (SELECT max(n) AS n FROM t))
SELECT a.id, s.repeat, round(b.price, 4) AS price, round(b.known_bal, 4) AS known_bal FROM t a CROSS JOIN s JOIN t b ON b.r = (a.r - 1 + s.shift) % a.n + 1""")
def ml16v(spark, sf):
    """The values every held-out row takes in each of ten permutations."""
    _, data = train_test(spark, sf)
    held = ml.permuted_values(data.filter("split = 'test'").select("id", "price", "known_bal"), ["price", "known_bal"], 10, 42)
    return round_all(held.select("id", F.inline("donated")), "price", "known_bal", digits=4)


_PARTIAL = lambda x: f"(corr(y, {x}) - corr(y, a) * corr({x}, a)) / sqrt((1 - corr(y, a) * corr(y, a)) * (1 - corr({x}, a) * corr({x}, a)))"


@query("ml17_acceptance_gate", f"""
WITH {SCORES_SQL}, cv AS (SELECT * FROM scores WHERE stage <> 'C'),
seeded AS (SELECT l.id, l.y, l.model, l.proba, seed, CAST('0x' || substr(md5(seed || ':' || id), 1, 8) AS BIGINT) % {K} AS fold
  FROM long l, unnest({SEEDS}) t(seed) WHERE stage <> 'C'),
{rank_sql('m', 'seed, fold, model', 'seeded')},
p AS (SELECT seed, fold, max(roc_auc) FILTER (model = 'a') AS b, max(roc_auc) FILTER (model = 'c') AS s, max(roc_auc) FILTER (model = 'b') AS c FROM m GROUP BY seed, fold),
g AS (SELECT seed, avg(b) AS base_mean, avg(s) AS stack_mean, avg(c) AS control_mean, stddev_pop(b) AS base_std, count_if(s > b)::BIGINT AS folds_won, count(*) AS n_folds FROM p GROUP BY seed),
q AS (SELECT *, stack_mean > base_mean AS beats_base, folds_won >= n_folds - 1 AS fold_consistent, stack_mean > control_mean AS beats_control,
  stack_mean > base_mean + base_std AS material_gain, stack_mean - base_mean AS delta_base, stack_mean - control_mean AS delta_control FROM g),
gates AS (SELECT *, beats_base AND fold_consistent AND beats_control AND material_gain AS gate_passed FROM q),
st AS (SELECT count_if(gate_passed)::BIGINT AS seeds_passed, bool_and(gate_passed) AS earned FROM gates),
gap AS (SELECT {_PARTIAL('c')} - {_PARTIAL('b')} AS partial_gap FROM cv),
pairs AS (SELECT 1 AS one, o.model, o.id, o.y, o.proba AS pa, r.proba AS pb FROM long o JOIN long r ON o.id = r.id WHERE o.stage = 'C' AND o.model <> 'c' AND r.model = 'c'),
{delong_sql('one, model', 'pairs')}, {holm_sql('h', 'delong', 'p_value', 'model')},
held AS (SELECT bool_and(delta < 0) AND bool_or(model = 'a' AND significant) AS confirmed FROM h),
d AS (SELECT * EXCLUDE (confirmed), CASE WHEN earned THEN confirmed END AS confirmed FROM gates, st, gap, held WHERE seed = {SEEDS[0]})
SELECT {', '.join(f'round({c}, 6) AS {c}' for c in ('base_mean', 'stack_mean', 'control_mean', 'base_std', 'delta_base', 'delta_control', 'partial_gap'))},
  folds_won, n_folds, beats_base, fold_consistent, beats_control, material_gain, gate_passed, seeds_passed, confirmed,
  CASE WHEN earned AND confirmed THEN 'demonstrated' WHEN gate_passed THEN 'no_contribution' WHEN delta_base > 0.001 OR partial_gap > 0.01 THEN 'complementary_only' ELSE 'no_contribution' END AS decision FROM d""")
def ml17(spark, sf):
    """Score a as base, c as stack and auxiliary score, b as control; the rows of stage C are the sealed hold-out."""
    long, wide = stored(scores_long(spark, sf)), scores_wide(spark, sf)
    seal = gate.HoldoutSeal(spark, new_table_path(spark, "seal"))
    out = gate.accept(long.filter("stage <> 'C'"), long.filter("stage = 'C'"), wide.filter("stage <> 'C'"), "a", "c", "b", "c", seal, SEEDS, K)
    return round_all(out, "base_mean", "stack_mean", "control_mean", "base_std", "delta_base", "delta_control", "partial_gap")


@query("ml18_learning_curve")
def ml18(spark, sf):
    train, data = train_test(spark, sf)
    n = train.count()
    curve = ml.learning_curve(train, data.filter("split = 'test'"), [n // 4, n // 2, n], _fit_logreg(), 42)
    return round_all(curve, *ml.CV_METRICS, "brier")


@query("ml18_cross_site")
def ml18s(spark, sf):
    c = cohort(spark, sf).withColumn("site", F.when(F.col("nation") < 13, "west").otherwise("east"))
    return round_all(ml.cross_site(c, "site", "west", _fit_logreg()), *ml.CV_METRICS, "brier")


@query("ml19_noise_sweep")
def ml19(spark, sf):
    train, data = train_test(spark, sf)
    cols = ["price", "known_bal"]
    std = {r["column_name"]: r["std"] for r in _std(train, cols)}
    noisy = ml.with_noise(data.filter("split = 'test'"), cols, std, [0.0, 0.01, 0.05, 0.1, 0.2], 42)
    return round_all(ml.perturbation_sweep(noisy, _fit_logreg()(train)), *ml.CV_METRICS, "brier")


def _std(train, cols):
    from lynceus.operators.quality import column_moments

    return column_moments(train, cols).collect()


@query("ml19_mask_sweep")
def ml19m(spark, sf):
    train, data = train_test(spark, sf)
    masked = ml.with_mask(data.filter("split = 'test'"), ["price", "known_bal"], [0.05, 0.1, 0.2, 0.3], 42)
    return round_all(ml.perturbation_sweep(masked, _fit_logreg()(train)), *ml.CV_METRICS, "brier")


def _mask_sql(col, j):
    return f"count_if({col} IS NULL OR (CAST('0x' || substr(md5('42:{j}:' || id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE < level)::BIGINT AS {col}_missing"


@query("ml19_mask_counts", f"""
WITH {SPLIT_SQL}
SELECT level, count(*) AS n, {_mask_sql('price', 0)}, {_mask_sql('known_bal', 1)} FROM data, unnest([0.05, 0.1, 0.2, 0.3]::DOUBLE[]) t(level) WHERE split = 'test' GROUP BY level""")
def ml19c(spark, sf):
    _, data = train_test(spark, sf)
    masked = ml.with_mask(data.filter("split = 'test'"), ["price", "known_bal"], [0.05, 0.1, 0.2, 0.3], 42)
    missing = lambda c: F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_missing")
    return masked.groupBy("level").agg(F.count(F.lit(1)).alias("n"), missing("price"), missing("known_bal"))


@query("ml19_noise_values", f"""
WITH {SPLIT_SQL}, s AS (SELECT stddev_samp(price) AS sp FROM train)
SELECT id, level, round(price + level * sp * {noise_sql(42, 0)}, 4) AS price FROM data, s, unnest([0.0, 0.1]::DOUBLE[]) t(level) WHERE split = 'test'""")
def ml19v(spark, sf):
    train, data = train_test(spark, sf)
    std = {r["column_name"]: r["std"] for r in _std(train, ["price"])}
    noisy = ml.with_noise(data.filter("split = 'test'"), ["price"], std, [0.0, 0.1], 42)
    return noisy.select("id", "level", F.round("price", 4).alias("price"))


@query("ml20_contribution_summary", f"""
WITH {CONTRIB_SQL} SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs FROM contrib GROUP BY feature""")
def ml20(spark, sf):
    v = vitals(spark, sf)
    return round_all(ml.contribution_summary(v, WEIGHTS, ml.column_means(v, list(WEIGHTS))), "mean_abs")
