"""EV1-EV34: metrics, statistics and decisions over scored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.catalog import query
from lynceus.functions.draws import FIRST, MARGIN, SECOND, SPAN, STEP
from lynceus.functions.stats import T_975
from lynceus.operators import bootstrap as bs, compare as cp, evaluate as ev
from lynceus.operators.sampling import seeded_draws
from lynceus.plans.roles import (
    COHORT_SQL, SCORES_SQL, VECTORS_SQL, cohort, scores_long, scores_wide, table, to_long, vectors,
)

# ---- SQL building blocks ------------------------------------------------------------------------


def confusion_sql(keys: str, source: str = "long") -> str:
    return f"""SELECT {keys}, count_if(y = 1 AND proba >= 0.5)::BIGINT AS tp, count_if(y = 0 AND proba >= 0.5)::BIGINT AS fp,
      count_if(y = 0 AND proba < 0.5)::BIGINT AS tn, count_if(y = 1 AND proba < 0.5)::BIGINT AS fn FROM {source} GROUP BY {keys}"""


def label_sql(keys: str, source: str) -> str:
    """Label metrics of a relation holding tp, fp, tn, fn."""
    return f"""SELECT *, coalesce(2 * precision * sensitivity / nullif(precision + sensitivity, 0), 0) AS f1 FROM (
      SELECT {keys}, tp, fp, tn, fn, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
             coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity FROM {source})"""


def rank_sql(name: str, keys: str, source: str = "long", p: str = "proba", w: str = "1") -> str:
    """CTEs {name}_cum (running counts per distinct score) and {name} (roc_auc, pr_auc)."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{name}_pts AS (SELECT {k}{p} AS s, sum(y * {w}) AS pos, sum((1 - y) * {w}) AS neg FROM {source} GROUP BY {k}{p}),
{name}_cum AS (SELECT *, sum(pos) OVER w - pos AS pos_before, sum(neg) OVER w - neg AS neg_before,
  sum(pos) OVER ({part}) AS pt, sum(neg) OVER ({part}) AS nt FROM {name}_pts WINDOW w AS ({part}ORDER BY s ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT {k}sum(pos * (neg_before + neg / 2.0::DOUBLE)) / (max(pt) * max(nt)) AS roc_auc,
  sum(pos * ((pt - pos_before) / ((pt - pos_before) + (nt - neg_before)))) / max(pt) AS pr_auc FROM {name}_cum WHERE pt > 0 AND nt > 0 {group})"""


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def round_all(df, *cols, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


LABELS = ("accuracy", "precision", "sensitivity", "specificity", "f1")


@query("ev1_label_metrics", f"""
WITH {SCORES_SQL}, conf AS ({confusion_sql('stage, model')})
SELECT stage, model, tp, fp, tn, fn, {r6(*LABELS)} FROM ({label_sql('stage, model', 'conf')})""")
def ev1(spark, sf):
    return round_all(ev.label_metrics(scores_long(spark, sf), ["stage", "model"]), *LABELS)


@query("ev2_label_metrics_ext", f"""
WITH {SCORES_SQL}, conf AS ({confusion_sql('model')})
SELECT model, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS npv,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy,
  round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM conf""")
def ev2(spark, sf):
    return round_all(ev.label_metrics_ext(scores_long(spark, sf), ["model"]), "npv", "balanced_accuracy", "mcc")


@query("ev3_brier", f"WITH {SCORES_SQL} SELECT model, round(avg((proba - y) ** 2), 6) AS brier FROM long GROUP BY model")
def ev3(spark, sf):
    return round_all(ev.brier(scores_long(spark, sf), ["model"]), "brier")


@query("ev4_roc_auc", f"WITH {SCORES_SQL}, {rank_sql('m', 'stage, model')} SELECT stage, model, {r6('roc_auc')} FROM m")
def ev4(spark, sf):
    return round_all(ev.roc_auc(scores_long(spark, sf), ["stage", "model"]), "roc_auc")


@query("ev5_average_precision", f"WITH {SCORES_SQL}, {rank_sql('m', 'model')} SELECT model, {r6('pr_auc')} FROM m")
def ev5(spark, sf):
    return round_all(ev.average_precision(scores_long(spark, sf), ["model"]), "pr_auc")


@query("ev6_roc_curve", f"""
WITH {SCORES_SQL}, {rank_sql('m', 'model')}
SELECT model, s AS threshold, round((nt - neg_before) / nt, 6) AS fpr, round((pt - pos_before) / pt, 6) AS tpr FROM m_cum
UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM m_cum""")
def ev6(spark, sf):
    return round_all(ev.roc_curve(scores_long(spark, sf), ["model"]), "fpr", "tpr")


@query("ev6_pr_curve", f"""
WITH {SCORES_SQL}, {rank_sql('m', 'model')}
SELECT model, s AS threshold, round((pt - pos_before) / ((pt - pos_before) + (nt - neg_before)), 6) AS precision,
       round((pt - pos_before) / pt, 6) AS recall FROM m_cum UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1::DOUBLE, 0::DOUBLE FROM m_cum""")
def ev6p(spark, sf):
    return round_all(ev.pr_curve(scores_long(spark, sf), ["model"]), "precision", "recall")


@query("ev7_calibration_width", f"""
WITH {SCORES_SQL}
SELECT model, CAST(least(floor(proba * 5), 4) AS INTEGER) AS bin, count(*) AS n, round(avg(proba), 6) AS mean_predicted, round(avg(y), 6) AS fraction_positive
FROM long GROUP BY ALL""")
def ev7(spark, sf):
    return round_all(ev.calibration_width(scores_long(spark, sf), ["model"], 5), "mean_predicted", "fraction_positive")


@query("ev8_calibration_quantile", f"""
WITH {SCORES_SQL},
edges AS (SELECT model, quantile_cont(proba, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM long GROUP BY model),
b AS (SELECT model, y, proba, len(list_filter(e, lambda x: x < proba))::INTEGER AS bin FROM long JOIN edges USING (model))
SELECT model, bin, count(*) AS n, round(avg(proba), 6) AS mean_predicted, round(avg(y), 6) AS fraction_positive FROM b GROUP BY model, bin""")
def ev8(spark, sf):
    return round_all(ev.calibration_quantile(scores_long(spark, sf), ["model"], 8), "mean_predicted", "fraction_positive")


def fold_metrics(spark, sf):
    """Long (fold, model, metric, value)."""
    m = ev.all_metrics(scores_long(spark, sf), ["fold", "model"])
    return ev.metrics_long(m, ["fold", "model"], ["roc_auc", "pr_auc", *LABELS])


FOLD_SQL = f"""{SCORES_SQL}, {rank_sql('m', 'fold, model')}, conf AS ({confusion_sql('fold, model')}), lab AS ({label_sql('fold, model', 'conf')}),
fold_metrics AS (SELECT fold, model, metric, value FROM (
  SELECT fold, model, roc_auc, pr_auc, accuracy, precision, sensitivity, specificity, f1 FROM m JOIN lab USING (fold, model))
  UNPIVOT (value FOR metric IN (roc_auc, pr_auc, accuracy, precision, sensitivity, specificity, f1)))"""


@query("ev9_cv_summary", f"""
WITH {FOLD_SQL},
s AS (SELECT model, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS n_folds FROM fold_metrics GROUP BY model, metric),
t AS (SELECT *, CASE WHEN n_folds > 1 AND std > 0 THEN {T_975}[n_folds - 1] * std / sqrt(n_folds) ELSE 0 END AS half FROM s)
SELECT model, metric, round(mean, 6) AS mean, round(std, 6) AS std, n_folds, round(mean - half, 6) AS ci_low, round(mean + half, 6) AS ci_high FROM t""")
def ev9(spark, sf):
    return round_all(ev.cv_summary(fold_metrics(spark, sf), ["model", "metric"]), "mean", "std", "ci_low", "ci_high")


# ---- bootstrap ----------------------------------------------------------------------------------

INTERVAL_DRAWS, PAIRED_DRAWS, SEED = 1000, 2000, 42
SCORE_KEY_SQL = lambda p: f"CAST(CAST(round({p} * 1e15) AS DECIMAL(38, 0)) AS VARCHAR)"


def resample_sql(name: str, cells: str, keys: list[str], resamples: int) -> str:
    """CTE ``name``: cells x resamples with weight w, the inverse Poisson distribution of the cell's count at a mixed word."""
    word = lambda x: f"(({x}) & 4294967295::UBIGINT)"
    step = lambda of, to, shift, factor: f"{name}_{to} AS (SELECT * REPLACE ({word(f'xor(x, x >> {shift}) * {factor}')} AS x) FROM {name}_{of})"
    low = f"greatest(0, cnt - floor({SPAN} * sqrt(cnt))::BIGINT - {MARGIN})"
    return f"""{name}_c AS (SELECT *, md5({" || ':' || ".join([f"'{SEED}'", *keys])}) AS h FROM {cells}),
{name}_k AS (SELECT cnt, {low} AS lo, unnest(range({low}, cnt + floor({SPAN} * sqrt(cnt))::BIGINT + {MARGIN} + 1)) AS k FROM (SELECT DISTINCT cnt FROM {cells})),
{name}_p AS (SELECT cnt, lo, floor(sum(exp(k * ln(cnt) - cnt - lgamma(k + 1))) OVER (PARTITION BY cnt ORDER BY k) * 4294967296) AS t FROM {name}_k),
{name}_t AS (SELECT cnt, any_value(lo) AS lo, list(t::UBIGINT ORDER BY t) FILTER (t < 4294967296) AS ts FROM {name}_p GROUP BY cnt),
{name}_0 AS (SELECT * EXCLUDE (h), CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS w1, {word(f"CAST('0x' || substr(h, 1, 8) AS UBIGINT) + r::UBIGINT * {STEP}")} AS x
  FROM {name}_c JOIN {name}_t USING (cnt), range({resamples}) draws(r)),
{step(0, 1, 16, FIRST)}, {step(1, 2, 13, SECOND)}, {name}_3 AS (SELECT * REPLACE (xor(xor(x, x >> 16), w1) AS x) FROM {name}_2),
{step(3, 4, 16, FIRST)}, {step(4, 5, 13, SECOND)}, {name}_6 AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM {name}_5),
{name}_7 AS (SELECT * EXCLUDE (x, w1, lo, ts), lo + len(list_filter(ts, lambda t: t <= x)) AS w FROM {name}_6),
{name} AS (SELECT * FROM {name}_7 WHERE w > 0)"""


def boot_rank_sql(resamples: int) -> str:
    return f"""
cells AS (SELECT model, y, proba, {SCORE_KEY_SQL('proba')} AS pk, count(*) AS cnt FROM long GROUP BY ALL),
{resample_sql('drawn', 'cells', ['model', 'y', 'pk'], resamples)},
{rank_sql('boot', 'model, r', 'drawn', 'proba', 'w')}"""


def _ci_sql(metric: str, source: str, keys: str = "model") -> str:
    return f"""SELECT {keys}, '{metric}' AS metric, quantile_cont({metric}, 0.025) AS ci_low, quantile_cont({metric}, 0.975) AS ci_high, count(*) AS n_resamples
      FROM {source} GROUP BY {keys}"""


@query("ev10_bootstrap_ci", f"""
WITH {SCORES_SQL}, {boot_rank_sql(INTERVAL_DRAWS)}, {rank_sql('pt', 'model')}
SELECT model, metric, round(roc_auc, 6) AS point, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n_resamples, 'poisson_cells' AS method
FROM pt JOIN ({_ci_sql('roc_auc', 'boot')}) USING (model)""")
def ev10(spark, sf):
    return round_all(bs.bootstrap_ci(scores_long(spark, sf), ["model"], "roc_auc", INTERVAL_DRAWS, SEED), "point", "ci_low", "ci_high")


def paired_boot_sql(keys: str, source: str) -> str:
    """CTE paired(keys, metric, delta, ci_low, ci_high, p_value, includes_zero, n_resamples) from (keys, y, pa, pb)."""
    return f"""pcells AS (SELECT {keys}, y, pa, pb, {SCORE_KEY_SQL('pa')} AS ka, {SCORE_KEY_SQL('pb')} AS kb, count(*) AS cnt FROM {source} GROUP BY ALL),
{resample_sql('pdrawn', 'pcells', [*keys.split(', '), 'y', 'ka', 'kb'], PAIRED_DRAWS)},
sides AS (SELECT {keys}, r, y, w, 'a' AS side, pa AS k FROM pdrawn UNION ALL SELECT {keys}, r, y, w, 'b', pb FROM pdrawn
  UNION ALL SELECT {keys}, -1, y, cnt, 'a', pa FROM pcells UNION ALL SELECT {keys}, -1, y, cnt, 'b', pb FROM pcells),
{rank_sql('pm', keys + ', r, side', 'sides', 'k', 'w')},
diffs AS (SELECT {keys}, r, sum(CASE side WHEN 'a' THEN roc_auc ELSE -roc_auc END) AS roc_auc, sum(CASE side WHEN 'a' THEN pr_auc ELSE -pr_auc END) AS pr_auc FROM pm GROUP BY {keys}, r),
dl AS (SELECT {keys}, r, metric, d FROM diffs UNPIVOT (d FOR metric IN (roc_auc, pr_auc))),
ps AS (SELECT {keys}, metric, max(d) FILTER (r < 0) AS delta, quantile_cont(d, 0.025) FILTER (r >= 0) AS ci_low, quantile_cont(d, 0.975) FILTER (r >= 0) AS ci_high,
  avg((d <= 0)::INTEGER) FILTER (r >= 0) AS le, avg((d >= 0)::INTEGER) FILTER (r >= 0) AS ge, count(*) FILTER (r >= 0) AS n_resamples FROM dl GROUP BY {keys}, metric),
paired AS (SELECT {keys}, metric, delta, ci_low, ci_high, n_resamples, ci_low <= 0 AND ci_high >= 0 AS includes_zero, least(1.0, 2 * CASE WHEN delta >= 0 THEN le ELSE ge END) AS p_value FROM ps)"""


@query("ev11_paired_bootstrap", f"""
WITH {SCORES_SQL}, src AS (SELECT stage, y, a AS pa, b AS pb FROM scores), {paired_boot_sql('stage', 'src')}
SELECT stage, metric, round(delta, 6) AS delta, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n_resamples, includes_zero, round(p_value, 6) AS p_value FROM paired""")
def ev11(spark, sf):
    pairs = cp.wide_pair(scores_wide(spark, sf), "a", "b", ["stage"])
    return round_all(bs.paired_bootstrap(pairs, ["stage"], PAIRED_DRAWS, SEED), "delta", "ci_low", "ci_high", "p_value")


# ---- paired tests -------------------------------------------------------------------------------


def phi_sql(z: str) -> str:
    """2 (1 - Phi(|z|)) by the same rational approximation."""
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    poly = f"({t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE)))))"
    return f"least(1.0::DOUBLE, 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {poly})"


def delong_sql(keys: str, source: str) -> str:
    """CTE delong(keys, auc_a, auc_b, delta, var_delta, z, ci_low, ci_high, p_value) from (keys, y, pa, pb)."""
    eq = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    return f"""{rank_sql('da', keys, source, 'pa')}, {rank_sql('db', keys, source, 'pb')},
comp AS (SELECT {', '.join(f'x.{k}' for k in keys.split(', '))}, x.y,
   CASE WHEN x.y = 1 THEN (a.neg_before + a.neg / 2) / a.nt ELSE 1 - (a.pos_before + a.pos / 2) / a.pt END AS va,
   CASE WHEN x.y = 1 THEN (b.neg_before + b.neg / 2) / b.nt ELSE 1 - (b.pos_before + b.pos / 2) / b.pt END AS vb
   FROM {source} x JOIN da_cum a ON {eq('x', 'a')} AND x.pa = a.s JOIN db_cum b ON {eq('x', 'b')} AND x.pb = b.s),
dv AS (SELECT {keys}, avg(va) FILTER (y = 1) AS auc_a, avg(vb) FILTER (y = 1) AS auc_b,
   var_samp(va - vb) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(va - vb) FILTER (y = 0) / count(*) FILTER (y = 0) AS var_delta FROM comp GROUP BY {keys}),
dz AS (SELECT *, auc_a - auc_b AS delta, CASE WHEN var_delta > 1e-18 THEN (auc_a - auc_b) / sqrt(var_delta) ELSE 0 END AS z FROM dv),
delong AS (SELECT *, CASE WHEN var_delta > 1e-18 THEN delta - 1.959963984540054 * sqrt(var_delta) ELSE 0 END AS ci_low,
   CASE WHEN var_delta > 1e-18 THEN delta + 1.959963984540054 * sqrt(var_delta) ELSE 0 END AS ci_high,
   CASE WHEN var_delta > 1e-18 THEN {phi_sql('z')} ELSE 1 END AS p_value FROM dz)"""


DELONG_COLS = ("auc_a", "auc_b", "delta", "z", "ci_low", "ci_high", "p_value")
PAIRS_SQL = """pairs AS (SELECT o.stage, o.model, o.id, o.y, o.proba AS pa, r.proba AS pb FROM long o JOIN long r ON o.id = r.id AND o.stage = r.stage
  WHERE o.model <> 'b' AND r.model = 'b')"""


def ref_pairs(spark, sf):
    return cp.pair_with_reference(scores_long(spark, sf), "b", ["stage"])


@query("ev12_delong", f"""
WITH {SCORES_SQL}, {PAIRS_SQL}, {delong_sql('stage, model', 'pairs')}
SELECT stage, model, {r6(*DELONG_COLS)}, round(var_delta, 9) AS var_delta FROM delong""")
def ev12(spark, sf):
    return round_all(round_all(cp.delong(ref_pairs(spark, sf), ["stage", "model"]), *DELONG_COLS), "var_delta", digits=9)


def mcnemar_sql(keys: str, source: str) -> str:
    """CTE mcn: table of correct decisions and the exact binomial p."""
    ra, rb = "((pa >= 0.5)::INTEGER = y)", "((pb >= 0.5)::INTEGER = y)"
    return f"""mc0 AS (SELECT {keys}, count_if({ra} AND {rb})::BIGINT AS both_correct, count_if({ra} AND NOT {rb})::BIGINT AS a_only,
   count_if(NOT {ra} AND {rb})::BIGINT AS b_only, count_if(NOT {ra} AND NOT {rb})::BIGINT AS both_wrong FROM {source} GROUP BY {keys}),
mc1 AS (SELECT *, a_only + b_only AS n_discordant, least(a_only, b_only) AS low FROM mc0),
mcn AS (SELECT * EXCLUDE (low), CASE WHEN n_discordant = 0 OR a_only = b_only THEN 1 ELSE least(1.0, 2 * list_sum(list_transform(range(0, low + 1),
   lambda i: exp(lgamma(n_discordant + 1) - lgamma(i + 1) - lgamma(n_discordant - i + 1) - n_discordant * ln(2))))) END AS p_value FROM mc1)"""


@query("ev13_mcnemar", f"""
WITH {SCORES_SQL}, {PAIRS_SQL}, {mcnemar_sql('stage, model', 'pairs')}
SELECT stage, model, both_correct, a_only, b_only, both_wrong, n_discordant, round(p_value, 6) AS p_value FROM mcn""")
def ev13(spark, sf):
    return round_all(cp.mcnemar(ref_pairs(spark, sf), ["stage", "model"]), "p_value")


def holm_sql(name: str, source: str, p: str, order: str, out: str = "p_holm", flag: str = "significant") -> str:
    return f"""{name}_s AS (SELECT *, row_number() OVER (ORDER BY {p}, {order}) AS step, {p} * (count(*) OVER () - row_number() OVER (ORDER BY {p}, {order}) + 1) AS scaled FROM {source}),
{name}_m AS (SELECT * EXCLUDE (step, scaled), least(1.0::DOUBLE, max(scaled) OVER (ORDER BY step)) AS {out} FROM {name}_s),
{name} AS (SELECT *, {out} < 0.05 AS {flag} FROM {name}_m)"""


@query("ev14_holm", f"""
WITH {SCORES_SQL}, {PAIRS_SQL}, {mcnemar_sql('stage, model', 'pairs')}, {holm_sql('h', 'mcn', 'p_value', 'stage, model')}
SELECT stage, model, round(p_value, 6) AS p_value, round(p_holm, 6) AS p_holm, significant FROM h""")
def ev14(spark, sf):
    p = cp.mcnemar(ref_pairs(spark, sf), ["stage", "model"]).select("stage", "model", "p_value")
    return round_all(cp.holm(p, "p_value", ["stage", "model"]), "p_value", "p_holm")


@query("ev15_extend_family", f"""
WITH {SCORES_SQL}, {PAIRS_SQL}, {delong_sql('stage, model', 'pairs')},
fam AS (SELECT stage, model, p_value, CASE WHEN stage = 'C' THEN 'new' ELSE 'old' END AS origin FROM delong), {holm_sql('h', 'fam', 'p_value', 'stage, model, origin')}
SELECT stage, model, origin, round(p_value, 6) AS p_value, round(p_holm, 6) AS p_holm, significant FROM h""")
def ev15(spark, sf):
    d = cp.delong(ref_pairs(spark, sf), ["stage", "model"]).select("stage", "model", "p_value")
    out = cp.extend_family(d.filter("stage <> 'C'"), d.filter("stage = 'C'"), "p_value", ["stage", "model"])
    return round_all(out, "p_value", "p_holm")


LABEL_BOOT_SQL = f"""
conf AS ({confusion_sql('model')}),
lcells AS (SELECT model, cell, cnt FROM conf UNPIVOT (cnt FOR cell IN (tp, fp, tn, fn)) WHERE cnt > 0),
{resample_sql('ldrawn', 'lcells', ['model', 'cell'], PAIRED_DRAWS)},
lconf AS (SELECT model, r, coalesce(sum(w) FILTER (cell = 'tp'), 0) AS tp, coalesce(sum(w) FILTER (cell = 'fp'), 0) AS fp,
  coalesce(sum(w) FILTER (cell = 'tn'), 0) AS tn, coalesce(sum(w) FILTER (cell = 'fn'), 0) AS fn FROM ldrawn GROUP BY model, r),
lboot AS ({label_sql('model, r', '(SELECT * FROM lconf WHERE tp + fn > 0 AND tn + fp > 0)')}),
lab AS ({label_sql('model', 'conf')})"""
_LABEL_CI = " UNION ALL ".join(
    f"SELECT model, metric, {m} AS point, ci_low, ci_high, n_resamples FROM lab JOIN ({_ci_sql(m, 'lboot')}) USING (model)" for m in LABELS)
_RANK_CI = " UNION ALL ".join(
    f"SELECT model, metric, {m} AS point, ci_low, ci_high, n_resamples FROM pt JOIN ({_ci_sql(m, 'boot')}) USING (model)" for m in ("roc_auc", "pr_auc"))


@query("ev16_metric_ci_table", f"""
WITH {SCORES_SQL}, {boot_rank_sql(PAIRED_DRAWS)}, {rank_sql('pt', 'model')}, {LABEL_BOOT_SQL}
SELECT model, metric, round(point, 6) AS point, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n_resamples, 'poisson_cells' AS method
FROM ({_RANK_CI} UNION ALL {_LABEL_CI})""")
def ev16(spark, sf):
    return round_all(bs.metric_ci_table(scores_long(spark, sf), ["model"], PAIRED_DRAWS, SEED), "point", "ci_low", "ci_high")


BOARD = ["roc_auc", "pr_auc", "accuracy", "sensitivity", "specificity", "precision", "f1"]


@query("ev17_leaderboard", f"""
WITH {SCORES_SQL}, {rank_sql('m', 'model')}, conf AS ({confusion_sql('model')}), lab AS ({label_sql('model', 'conf')})
SELECT CAST(row_number() OVER (ORDER BY roc_auc DESC, model) AS INTEGER) AS rank, model, {', '.join(f'round({c}, 4) AS {c}' for c in BOARD)} FROM m JOIN lab USING (model)""")
def ev17(spark, sf):
    m = ev.all_metrics(scores_long(spark, sf), ["model"])
    return ev.leaderboard(ev.metrics_long(m, ["model"], BOARD), BOARD)


@query("ev17_cv_table", f"""
WITH {FOLD_SQL}
SELECT model, {', '.join(f"round(avg(value) FILTER (metric = '{c}'), 4) AS {c}_mean, round(stddev_samp(value) FILTER (metric = '{c}'), 4) AS {c}_std" for c in ('roc_auc', 'pr_auc', 'accuracy'))}
FROM fold_metrics GROUP BY model""")
def ev17c(spark, sf):
    s = ev.cv_summary(fold_metrics(spark, sf), ["model", "metric"])
    wide = s.groupBy("model").pivot("metric", ["roc_auc", "pr_auc", "accuracy"]).agg(
        F.round(F.first("mean"), 4).alias("mean"), F.round(F.first("std"), 4).alias("std"))
    return wide


@query("ev18_compare_all", f"""
WITH {SCORES_SQL}, {PAIRS_SQL}, {delong_sql('stage, model', 'pairs')}, {mcnemar_sql('stage, model', 'pairs')}, {paired_boot_sql('stage, model', 'pairs')},
pw AS (SELECT stage, model, max(delta) FILTER (metric = 'roc_auc') AS boot_delta, max(ci_low) FILTER (metric = 'roc_auc') AS boot_ci_low,
  max(ci_high) FILTER (metric = 'roc_auc') AS boot_ci_high, max(p_value) FILTER (metric = 'roc_auc') AS boot_p,
  max(delta) FILTER (metric = 'pr_auc') AS boot_pr_delta, max(p_value) FILTER (metric = 'pr_auc') AS boot_pr_p FROM paired GROUP BY stage, model),
allc AS (SELECT d.*, pw.* EXCLUDE (stage, model), m.p_value AS mcnemar_p, m.n_discordant FROM delong d JOIN pw USING (stage, model) JOIN mcn m USING (stage, model)),
{holm_sql('h1', 'allc', 'p_value', 'stage, model')}, {holm_sql('h2', 'h1', 'boot_p', 'stage, model', 'boot_p_holm', 'boot_significant')}
SELECT stage, model, {r6('auc_a', 'auc_b', 'delta', 'p_value', 'p_holm', 'boot_delta', 'boot_ci_low', 'boot_ci_high', 'boot_p', 'boot_pr_delta', 'boot_pr_p', 'boot_p_holm', 'mcnemar_p')},
  n_discordant, significant, boot_significant,
  CASE WHEN p_holm < 0.05 AND delta > 0 THEN 'significantly better' WHEN p_holm < 0.05 AND delta < 0 THEN 'significantly worse' ELSE 'no significant difference' END AS verdict FROM h2""")
def ev18(spark, sf):
    out = bs.compare_all(scores_long(spark, sf), "b", ["stage"], PAIRED_DRAWS, SEED)
    cols = ("auc_a", "auc_b", "delta", "p_value", "p_holm", "boot_delta", "boot_ci_low", "boot_ci_high", "boot_p", "boot_pr_delta", "boot_pr_p", "boot_p_holm", "mcnemar_p")
    return round_all(out, *cols).select("stage", "model", *cols, "n_discordant", "significant", "boot_significant", "verdict")


@query("ev19_gap_analysis", f"""
WITH {SCORES_SQL}, {rank_sql('m', 'stage, model')},
g AS (SELECT stage, max(roc_auc) FILTER (model = 'b') AS ref_auc, max(roc_auc) FILTER (model <> 'b') AS best_auc,
  arg_max(model, (roc_auc, model)) FILTER (model <> 'b') AS best_model FROM m GROUP BY stage),
h AS (SELECT *, best_auc - ref_auc AS gap, lag(best_auc - ref_auc) OVER (ORDER BY stage) AS prev FROM g)
SELECT stage, best_model, {r6('ref_auc', 'best_auc', 'gap')}, round(100.0 * (prev - gap) / nullif(prev, 0), 4) AS gap_reduction_pct FROM h""")
def ev19(spark, sf):
    g = ev.gap_analysis(ev.roc_auc(scores_long(spark, sf), ["stage", "model"]), "stage", "b")
    return round_all(round_all(g, "ref_auc", "best_auc", "gap"), "gap_reduction_pct", digits=4)


SCALE = ["roc_auc", "pr_auc", "sensitivity", "specificity", "accuracy", "f1"]


@query("ev20_scale_comparison", f"""
WITH {SCORES_SQL}, part AS (SELECT * FROM long WHERE stage = 'A'), {rank_sql('ms', 'model', 'part')}, {rank_sql('mf', 'model')},
cs AS ({confusion_sql('model', 'part')}), cf AS ({confusion_sql('model')}), ls AS ({label_sql('model', 'cs')}), lf AS ({label_sql('model', 'cf')}),
s AS (SELECT * FROM ms JOIN ls USING (model)), f AS (SELECT * FROM mf JOIN lf USING (model))
SELECT s.model, {', '.join(f'round(s.{c}, 6) AS small_{c}, round(f.{c}, 6) AS full_{c}, round(f.{c} - s.{c}, 6) AS delta_{c}' for c in SCALE)} FROM s JOIN f ON s.model = f.model""")
def ev20(spark, sf):
    s = scores_long(spark, sf)
    out = ev.scale_comparison(ev.all_metrics(s.filter("stage = 'A'"), ["model"]), ev.all_metrics(s, ["model"]), "model", SCALE)
    return round_all(out, *[f"{k}_{c}" for c in SCALE for k in ("small", "full", "delta")])


@query("ev21_confidence_by_outcome", f"""
WITH {SCORES_SQL}, o AS (SELECT model, proba, CASE WHEN proba >= 0.5 AND y = 1 THEN 'TP' WHEN proba >= 0.5 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM long)
SELECT model, outcome, count(*) AS n, round(avg(proba), 6) AS mean_proba, round(stddev_pop(proba), 6) AS std_proba FROM o GROUP BY ALL""")
def ev21(spark, sf):
    return round_all(ev.confidence_by_outcome(scores_long(spark, sf), ["model"]), "mean_proba", "std_proba")


@query("ev22_error_profile", f"""
WITH {SCORES_SQL}, {COHORT_SQL}, o AS (SELECT id, CASE WHEN b >= 0.5 AND y = 1 THEN 'TP' WHEN b >= 0.5 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM scores)
SELECT outcome, count(*) AS n, round(avg(price), 3) AS price, round(avg(known_bal), 3) AS known_bal, round(avg(priority), 3) AS priority
FROM o LEFT JOIN cohort USING (id) GROUP BY outcome""")
def ev22(spark, sf):
    s = to_long(scores_wide(spark, sf), ["b"])
    return ev.error_profile(s, cohort(spark, sf), "id", ["price", "known_bal", "priority"])


@query("ev23_threshold_zones", f"""
WITH {SCORES_SQL}, w AS (SELECT model, abs(proba - 0.5) AS d, CAST((proba >= 0.5)::INTEGER <> y AS INTEGER) AS wrong FROM long)
SELECT model, count_if(d < 0.1)::BIGINT AS near_n, round(avg(wrong) FILTER (d < 0.1), 6) AS near_error_rate,
       count_if(d >= 0.3)::BIGINT AS far_n, round(avg(wrong) FILTER (d >= 0.3), 6) AS far_error_rate FROM w GROUP BY model""")
def ev23(spark, sf):
    return round_all(ev.threshold_zones(scores_long(spark, sf), ["model"]), "near_error_rate", "far_error_rate")


@query("ev24_score_corr", f"""
WITH {SCORES_SQL},
rk AS (SELECT stage, a, b, rank() OVER (PARTITION BY stage ORDER BY a) + (count(*) OVER (PARTITION BY stage, a) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY stage ORDER BY b) + (count(*) OVER (PARTITION BY stage, b) - 1) / 2 AS rb FROM scores)
SELECT stage, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM rk GROUP BY stage""")
def ev24(spark, sf):
    return round_all(cp.score_corr(cp.wide_pair(scores_wide(spark, sf), "a", "b", ["stage"]), ["stage"]), "pearson", "spearman")


@query("ev25_partial_corr", f"""
WITH {SCORES_SQL}, k AS (SELECT stage, corr(y, c) AS xy, corr(y, a) AS xz, corr(c, a) AS yz FROM scores GROUP BY stage)
SELECT stage, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial_corr FROM k""")
def ev25(spark, sf):
    s = scores_wide(spark, sf).withColumn("y", F.col("y").cast("double"))
    return round_all(cp.partial_corr(s, ["stage"], "y", "c", "a"), "partial_corr")


@query("ev26_disagreement", f"""
WITH {SCORES_SQL}, {PAIRS_SQL} SELECT stage, model, round(avg(((pa >= 0.5) <> (pb >= 0.5))::INTEGER), 6) AS disagreement_rate FROM pairs GROUP BY stage, model""")
def ev26(spark, sf):
    return round_all(cp.disagreement(ref_pairs(spark, sf), ["stage", "model"]), "disagreement_rate")


SEEDS = [7, 11, 42, 101, 2024]
SEED_AUC_SQL = f"""{SCORES_SQL},
sl AS (SELECT s.*, CAST(seed AS INTEGER) AS seed, count(*) OVER () // {len(SEEDS)} AS n_all FROM scores s, unnest({SEEDS}) t(seed)),
sr AS (SELECT *, row_number() OVER (PARTITION BY seed, y ORDER BY CAST('0x' || substr(md5(seed || ':' || id), 1, 8) AS BIGINT), id) AS r, count(*) OVER (PARTITION BY seed, y) AS nc FROM sl),
sn AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY (CAST(r AS DOUBLE) - 0.5) / CAST(nc AS DOUBLE), y) AS nr FROM sr),
draws AS (SELECT seed, y, a, b, c FROM sn WHERE nr <= n_all // 4),
dlong AS (SELECT seed, y, 'a' AS model, a AS proba FROM draws UNION ALL SELECT seed, y, 'b', b FROM draws UNION ALL SELECT seed, y, 'c', c FROM draws),
{rank_sql('sm', 'seed, model', 'dlong')}"""


def seed_auc(spark, sf):
    s = scores_wide(spark, sf)
    draws = seeded_draws(s, "id", "y", s.count() // 4, SEEDS)
    return ev.roc_auc(to_long(draws, ["a", "b", "c"], keep=("seed", "id", "y")), ["seed", "model"])


def seed_deltas(spark, sf):
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("roc_auc")))
    return seed_auc(spark, sf).groupBy("seed").agg((pick("c") - pick("a")).alias("delta"))


SEED_DELTA_SQL = f"{SEED_AUC_SQL}, deltas AS (SELECT seed, max(roc_auc) FILTER (model = 'c') - max(roc_auc) FILTER (model = 'a') AS delta FROM sm GROUP BY seed)"


@query("ev27_direction_summary", f"""
WITH {SEED_DELTA_SQL}
SELECT round(avg(delta), 6) AS mean, round(median(delta), 6) AS median, round(stddev_samp(delta), 6) AS std, round(min(delta), 6) AS min, round(max(delta), 6) AS max,
       count_if(delta > 0)::BIGINT AS n_better, count_if(delta < 0)::BIGINT AS n_worse, count(*) AS n_runs FROM deltas""")
def ev27(spark, sf):
    return round_all(ev.direction_summary(seed_deltas(spark, sf)), "mean", "median", "std", "min", "max")


GRID = [round(0.05 * i, 2) for i in range(1, 20)]


@query("ev28_threshold_sweep", f"""
WITH {SCORES_SQL}
SELECT model, t AS threshold, round(count_if(y = 1 AND proba >= t) / sum(y), 6) AS sensitivity, round(1 - count_if(y = 0 AND proba >= t) / sum(1 - y), 6) AS specificity,
  CASE WHEN t < 0.40 THEN 'high_sensitivity' WHEN t > 0.60 THEN 'high_specificity' ELSE 'balanced' END AS triage_mode
FROM long, unnest({GRID}::DOUBLE[]) g(t) GROUP BY model, t""")
def ev28(spark, sf):
    return round_all(ev.threshold_sweep(scores_long(spark, sf), ["model"], GRID), "sensitivity", "specificity")


@query("ev28_sensitivity_threshold", f"""
WITH {SCORES_SQL}, tr AS (SELECT * FROM long WHERE fold <> 0), {rank_sql('m', 'model', 'tr')}
SELECT model, min(s) AS smallest_threshold, max(s) AS largest_threshold FROM m_cum WHERE pt - pos_before >= 0.9 * pt GROUP BY model""")
def ev28s(spark, sf):
    return ev.sensitivity_threshold(scores_long(spark, sf).filter("fold <> 0"), ["model"])


@query("ev29_verdict", f"""
WITH {SCORES_SQL}, {PAIRS_SQL}, {delong_sql('stage, model', 'pairs')}
SELECT stage, model, CASE WHEN p_value < 0.05 AND delta > 0 THEN 'significantly better' WHEN p_value < 0.05 AND delta < 0 THEN 'significantly worse' ELSE 'no significant difference' END AS verdict FROM delong""")
def ev29(spark, sf):
    d = cp.delong(ref_pairs(spark, sf), ["stage", "model"])
    return d.select("stage", "model", cp.verdict(F.col("p_value"), F.col("delta")).alias("verdict"))


@query("ev30_gen_gap", f"""
WITH {SCORES_SQL}, sp AS (SELECT *, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split FROM long), {rank_sql('m', 'model, split', 'sp')},
g AS (SELECT model, max(roc_auc) FILTER (split = 'train') AS train, max(roc_auc) FILTER (split = 'test') AS test FROM m GROUP BY model)
SELECT model, {r6('train', 'test')}, round(train - test, 6) AS gap, train - test > 0.1 AS overfit FROM g""")
def ev30(spark, sf):
    s = scores_long(spark, sf).withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train"))
    return round_all(ev.gen_gap(ev.roc_auc(s, ["model", "split"]), ["model"]), "train", "test", "gap")


@query("ev31_deviation", f"""
WITH {VECTORS_SQL}, m AS (SELECT id, unnest(range(0, 64)) AS pos, unnest(vec) AS ideal FROM vecs), d AS (SELECT id, pos, floor(ideal * 50) / 50 - ideal AS d FROM m)
SELECT level, item, n, {r6('mean_abs', 'max_abs', 'rmse')} FROM (
  SELECT 'all' AS level, NULL::BIGINT AS item, count(*) AS n, avg(abs(d)) AS mean_abs, max(abs(d)) AS max_abs, sqrt(avg(d * d)) AS rmse FROM d
  UNION ALL SELECT 'column', pos, count(*), avg(abs(d)), max(abs(d)), sqrt(avg(d * d)) FROM d GROUP BY pos
  UNION ALL SELECT 'row', id, count(*), avg(abs(d)), max(abs(d)), sqrt(avg(d * d)) FROM d GROUP BY id)""")
def ev31(spark, sf):
    long = vectors(spark, sf).select("id", F.posexplode("vec").alias("pos", "ideal"))
    paired = long.withColumn("measured", F.floor(F.col("ideal") * 50) / 50.0)
    return round_all(ev.deviation(paired, "id", "pos", "ideal", "measured"), "mean_abs", "max_abs", "rmse")


@query("ev32_bit_expectations", """
WITH c AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 16 AS k FROM events)
SELECT user_id, """ + ", ".join(f"round(sum(1 - 2 * ((k // {2 ** i}) % 2)) / count(*), 6) AS z{i}" for i in range(4)) + " FROM c GROUP BY user_id")
def ev32(spark, sf):
    bits = F.lpad(F.bin(F.get_json_object("props", "$.k").cast("long") % 16), 4, "0")
    counts = table(spark, sf, "events").groupBy("user_id", bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    # 16 bitstrings exist, so a map holds at most 16 entries
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("bits", "n"))).alias("counts"))
    out = ev.bit_expectations(maps, "counts", 4).drop("counts")
    return round_all(out, "z0", "z1", "z2", "z3")


@query("ev33_decide", f"""
WITH {SEED_DELTA_SQL.replace(SCORES_SQL, SCORES_SQL + f''', pr AS (SELECT stage, 'control' AS comparison, y, c AS pa, a AS pb FROM scores UNION ALL SELECT stage, 'baseline', y, c, b FROM scores)''')},
{delong_sql('stage, comparison', 'pr')}, {holm_sql('h', 'delong', 'p_value', 'stage, comparison')},
b AS (SELECT *, p_holm < 0.05 AND NOT (ci_low <= 0 AND ci_high >= 0) AND delta > 0 AS beats, p_holm < 0.05 AND NOT (ci_low <= 0 AND ci_high >= 0) AS sup FROM h),
o AS (SELECT stage, bool_or(beats) FILTER (comparison = 'control') AS beats_control, bool_or(beats) FILTER (comparison = 'baseline') AS beats_baseline,
  max(delta) FILTER (comparison = 'control') AS delta_control, max(delta) FILTER (comparison = 'baseline') AS delta_baseline FROM b GROUP BY stage)
SELECT stage, beats_control, beats_baseline, {r6('delta_control', 'delta_baseline')}, (SELECT stddev_samp(delta) > 0.03 FROM deltas) AS seed_unstable,
  CASE WHEN beats_control AND beats_baseline THEN 'A' WHEN beats_control THEN 'B' ELSE 'C' END AS outcome FROM o""")
def ev33(spark, sf):
    s = scores_wide(spark, sf)
    pairs = cp.wide_pair(s, "c", "a", ["stage"]).withColumn("comparison", F.lit("control")).unionByName(
        cp.wide_pair(s, "c", "b", ["stage"]).withColumn("comparison", F.lit("baseline")))
    by = ["stage", "comparison"]
    tested = cp.holm(cp.delong(pairs, by), "p_value", by)
    std = ev.direction_summary(seed_deltas(spark, sf)).select("std").scalar()
    return round_all(cp.decide(tested.withColumn("seed_std", std), ["stage"], "control", "baseline", std="seed_std"), "delta_control", "delta_baseline")


@query("ev33_decide_pair", f"""
WITH {SCORES_SQL}, {PAIRS_SQL}, {delong_sql('stage, model', 'pairs')}, {holm_sql('h', 'delong', 'p_value', 'stage, model')},
s AS (SELECT *, p_holm < 0.05 AND NOT (ci_low <= 0 AND ci_high >= 0) AS sup FROM h)
SELECT stage, model, sup AS supported, CASE WHEN delta > 0 AND sup THEN 'A' WHEN delta > 0 THEN 'B' WHEN sup THEN 'C' ELSE 'D' END AS outcome FROM s""")
def ev33p(spark, sf):
    t = cp.holm(cp.delong(ref_pairs(spark, sf), ["stage", "model"]), "p_value", ["stage", "model"])
    t = t.withColumn("supported", cp.supported(F.col("delta"), F.col("p_holm"), F.col("ci_low"), F.col("ci_high")))
    return t.select("stage", "model", "supported", cp.decide_pair(F.col("delta"), F.col("supported")).alias("outcome"))


@query("ev34_ranking_change", f"""
WITH {SCORES_SQL}, {rank_sql('m', 'stage, model')},
k AS (SELECT stage, model, roc_auc, CAST(row_number() OVER (PARTITION BY stage ORDER BY roc_auc DESC, model) AS INTEGER) AS rank FROM m)
SELECT stage, model, {r6('roc_auc')}, rank, (SELECT count(DISTINCT model) > 1 FROM k WHERE rank = 1) AS winner_changed FROM k""")
def ev34(spark, sf):
    return round_all(ev.ranking_change(ev.roc_auc(scores_long(spark, sf), ["stage", "model"]), "stage"), "roc_auc")
