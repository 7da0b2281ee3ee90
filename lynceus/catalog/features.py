"""FT1-FT23: train-fitted transforms and feature rankings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lynceus.catalog import query
from lynceus.catalog.evaluation import round_all
from lynceus.catalog.sampling import RANKED_SQL, quota_sql
from lynceus.operators import features as ft
from lynceus.operators.derive import FeatureGroups
from lynceus.operators.sampling import stratified_split
from lynceus.plans.config import FeatureConfig
from lynceus.plans.roles import COHORT_SQL, cohort
from lynceus.session import stored

NUM = ["price", "acctbal", "known_bal", "priority", "nation", "order_day"]
GROUPS = FeatureGroups(continuous=("price", "known_bal", "order_day"), ordinal=("priority",), nominal=("segment",))

SPLIT_SQL = f"""{RANKED_SQL}, {quota_sql('quota', 'ceil(t * 0.2)')},
data AS (SELECT c.*, CASE WHEN r <= q THEN 'test' ELSE 'train' END AS split FROM cohort c JOIN ranked USING (id, y) JOIN quota USING (y)),
train AS (SELECT * FROM data WHERE split = 'train')"""


def split_cohort(spark, sf):
    return stratified_split(cohort(spark, sf), "id", "y", 0.2, 42)


def train_test(spark, sf):
    """(training rows, all rows): the split is dealt once and stored, as every fit reads it several times."""
    s = stored(split_cohort(spark, sf))
    return s.filter("split = 'train'"), s


@query("ft1_median_impute", f"""
WITH {SPLIT_SQL} SELECT id, split, round(coalesce(known_bal, (SELECT quantile_cont(known_bal, 0.5) FROM train)), 6) AS known_bal FROM data""")
def ft1(spark, sf):
    train, data = train_test(spark, sf)
    return round_all(ft.fit_median(train, ["known_bal"]).transform(data, keep=["id", "split"]), "known_bal")


@query("ft2_mode_impute", f"""
WITH {SPLIT_SQL}, holes AS (SELECT id, CASE WHEN acctbal >= 0 THEN segment END AS segment, CASE WHEN acctbal >= 0 THEN priority END AS priority FROM data),
th AS (SELECT h.* FROM holes h JOIN train USING (id)),
ms AS (SELECT segment AS v FROM th WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1),
mp AS (SELECT priority AS v FROM th WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)
SELECT id, coalesce(segment, (SELECT v FROM ms)) AS segment, coalesce(priority, (SELECT v FROM mp))::DOUBLE AS priority FROM holes""")
def ft2(spark, sf):
    holes = split_cohort(spark, sf).select(
        "id", "split", F.when(F.col("acctbal") >= 0, F.col("segment")).alias("segment"), F.when(F.col("acctbal") >= 0, F.col("priority")).alias("priority"))
    return ft.fit_mode(holes.filter("split = 'train'"), ["segment", "priority"]).transform(holes, keep=["id"])


def _scale_query(name, fit, shift, scale):
    cols = ("price", "acctbal")
    exprs = ", ".join(f"round(({c} - (SELECT {shift.format(c=c)} FROM train)) / (SELECT {scale.format(c=c)} FROM train), 6) AS {c}" for c in cols)

    @query(name, f"WITH {SPLIT_SQL} SELECT id, {exprs} FROM data")
    def run(spark, sf):
        train, data = train_test(spark, sf)
        return round_all(fit(train, list(cols)).transform(data, keep=["id"]), *cols)

    return run


_scale_query("ft3_standard_scale", ft.fit_standard, "avg({c})", "stddev_pop({c})")
_scale_query("ft4_minmax_scale", ft.fit_minmax, "min({c})", "max({c}) - min({c})")
_scale_query("ft5_robust_scale", ft.fit_robust, "quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")

SEGMENTS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ONEHOT = ", ".join(f"CAST(segment = '{s}' AS INTEGER)::DOUBLE AS \"segment_{s}\"" for s in SEGMENTS)


@query("ft6_onehot", f"WITH {COHORT_SQL} SELECT id, {ONEHOT} FROM cohort")
def ft6(spark, sf):
    c = cohort(spark, sf)
    return ft.fit_onehot(c, ["segment"]).transform(c, keep=["id"])


LEVEL_COLS = ["segment", "nation", "order_key"]
LEVELS_SQL = f"""{COHORT_SQL}, wide AS (SELECT *, id AS order_key FROM cohort),
lv AS ({' UNION ALL '.join(f"SELECT {i} AS c, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, {c} = (SELECT min({c}) FROM wide) AS least, id FROM wide" for i, c in enumerate(LEVEL_COLS))}),
counts AS (SELECT c, column_name, value, least, count(*) AS n FROM lv GROUP BY ALL),
dict AS (SELECT column_name, value, n, CASE WHEN NOT least THEN CAST(row_number() OVER (PARTITION BY least
    ORDER BY c, CAST('0x' || substr(md5(value), 1, 8) AS BIGINT) % {ft.LEVEL_BUCKETS}, value) - 1 AS BIGINT) END AS place FROM counts)"""


def levelled(spark, sf):
    """Two columns with few levels and one with a level per row."""
    return cohort(spark, sf).withColumn("order_key", F.col("id"))


@query("ft6_level_dictionary", f"WITH {LEVELS_SQL} SELECT column_name, value, n, place FROM dict")
def ft6d(spark, sf):
    return ft.level_dictionary(levelled(spark, sf), LEVEL_COLS)


@query("ft6_sparse_levels", f"""
WITH {LEVELS_SQL}, e AS (SELECT lv.id, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS places FROM lv JOIN dict USING (column_name, value) GROUP BY lv.id)
SELECT id, coalesce(places, '') AS places FROM cohort LEFT JOIN e USING (id)""")
def ft6s(spark, sf):
    c = stored(levelled(spark, sf))
    places = ft.encode_levels(c, LEVEL_COLS, stored(ft.level_dictionary(c, LEVEL_COLS)), c.count())
    return places.select("id", F.array_join("places", ",").alias("places"))


PREP_SQL = f"""{SPLIT_SQL},
med AS (SELECT quantile_cont(price, 0.5) AS price, quantile_cont(known_bal, 0.5) AS known_bal, quantile_cont(order_day::DOUBLE, 0.5) AS order_day FROM train),
filled AS (SELECT id, y, split, coalesce(d.price, med.price) AS price, coalesce(d.known_bal, med.known_bal) AS known_bal,
  coalesce(d.order_day, med.order_day)::DOUBLE AS order_day, priority::DOUBLE AS priority, segment FROM data d, med),
tr AS (SELECT * FROM filled WHERE split = 'train'),
prep AS (SELECT id, y, split, {', '.join(f'({c} - (SELECT avg({c}) FROM tr)) / (SELECT stddev_pop({c}) FROM tr) AS {c}' for c in ('price', 'known_bal', 'order_day', 'priority'))}, {ONEHOT} FROM filled)"""
PREP_COLS = ["price", "known_bal", "order_day", "priority"]


@query("ft7_preprocessor", f"""
WITH {PREP_SQL} SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in PREP_COLS)}, {', '.join(f'"segment_{s}"' for s in SEGMENTS)} FROM prep""")
def ft7(spark, sf):
    train, data = train_test(spark, sf)
    return round_all(ft.fit_preprocessor(train, GROUPS).transform(data, keep=["id"]), *PREP_COLS)


def anova_sql(cols, source):
    return " UNION ALL ".join(f"""SELECT '{c}' AS feature, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score FROM (
      SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM {source}) AS g FROM {source} GROUP BY y)""" for c in cols)


@query("ft8_anova_f", f"WITH {COHORT_SQL}, f AS ({anova_sql(NUM, 'cohort')}) SELECT feature, round(f_score, 6) AS f_score FROM f")
def ft8(spark, sf):
    return round_all(ft.anova_f(cohort(spark, sf), NUM, "y"), "f_score")


@query("ft8_select_k_f", f"""
WITH {SPLIT_SQL}, f AS ({anova_sql(NUM, 'train')}), k AS (SELECT feature FROM f ORDER BY round(f_score, 9) DESC, feature LIMIT 3)
SELECT id, feature, round(CASE feature {' '.join(f"WHEN '{c}' THEN {c}::DOUBLE" for c in NUM)} END, 6) AS value FROM data, k""")
def ft8s(spark, sf):
    train, data = train_test(spark, sf)
    picked = ft.select_k_f(train, NUM, "y", 3)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in picked])
    return data.select("id", F.inline(pairs))


def bins_sql(cols, source, q=4):
    """CTE binned: right-closed quantile bins of ``cols`` with repeated edges dropped, next to id, y, segment."""
    probs = [i / q for i in range(q + 1)]
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont({c}::DOUBLE, {probs}))) AS {c}" for c in cols)
    codes = ", ".join(
        f"CASE WHEN c.{c} IS NOT NULL THEN len(list_filter(e.{c}[2:len(e.{c}) - 1], lambda x: x < c.{c}))::INTEGER END AS {c}_bin" for c in cols)
    return f"edges AS (SELECT {edges} FROM {source}), binned AS (SELECT c.id, c.y, c.segment, {codes} FROM cohort c, edges e)"


BIN_COLS = ["price", "known_bal", "priority", "nation", "order_day"]


@query("ft14_quantile_bins", f"WITH {COHORT_SQL}, {bins_sql(BIN_COLS, 'cohort')} SELECT id, {', '.join(f'{c}_bin' for c in BIN_COLS)} FROM binned")
def ft14(spark, sf):
    c = cohort(spark, sf)
    return ft.fit_quantile_bins(c, BIN_COLS).transform(c, keep=["id"])


def binned_cohort(spark, sf, keep=("y",)):
    c = cohort(spark, sf)
    fitted = ft.fit_quantile_bins(c, BIN_COLS)
    return fitted.transform(c, keep=list(keep)), fitted.names


def mi_sql(x: str, y: str, source: str, keys: str = "") -> str:
    """Plug-in mutual information of two code columns."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    comma = f"PARTITION BY {keys}, " if keys else "PARTITION BY "
    return f"""SELECT {k}sum(n / t * ln(n * t / (px * py))) AS mi FROM (
      SELECT {k}n::DOUBLE AS n, sum(n) OVER ({part})::DOUBLE AS t, sum(n) OVER ({comma}x)::DOUBLE AS px, sum(n) OVER ({comma}y)::DOUBLE AS py FROM (
        SELECT {k}{x} AS x, {y} AS y, count(*) AS n FROM {source} GROUP BY ALL)) {f'GROUP BY {keys}' if keys else ''}"""


MARGINAL_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, mi FROM ({mi_sql(f'{c}_bin', 'y', f'(SELECT * FROM binned WHERE {c}_bin IS NOT NULL)')})" for c in BIN_COLS)


@query("ft15_marginal_mi", f"WITH {COHORT_SQL}, {bins_sql(BIN_COLS, 'cohort')} SELECT feature, round(mi, 9) AS mi FROM ({MARGINAL_SQL})")
def ft15(spark, sf):
    b, names = binned_cohort(spark, sf)
    return round_all(ft.marginal_mi(b, names, "y"), "mi", digits=9)


@query("ft9_select_k_mi", f"""
WITH {COHORT_SQL}, {bins_sql(BIN_COLS, 'cohort')}, m AS ({MARGINAL_SQL}),
k AS (SELECT feature FROM m ORDER BY round(mi, 9) DESC, feature LIMIT 3)
SELECT id, feature, round(CASE feature {' '.join(f"WHEN '{c}' THEN {c}::DOUBLE" for c in BIN_COLS)} END, 6) AS value FROM cohort, k""")
def ft9(spark, sf):
    c = cohort(spark, sf)
    picked = ft.select_k_mi(c, BIN_COLS, "y", 3)
    pairs = F.array(*[F.struct(F.lit(x).alias("feature"), F.round(F.col(x).cast("double"), 6).alias("value")) for x in picked])
    return c.select("id", F.inline(pairs))


PAIRS = [(a, b) for i, a in enumerate(BIN_COLS) for b in BIN_COLS[i + 1:]]


def _pair_source(a, b):
    return f"(SELECT * FROM binned WHERE {a}_bin IS NOT NULL AND {b}_bin IS NOT NULL)"


def synergy_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    join = lambda t: f"JOIN ({t}) USING ({keys})" if keys else f", ({t})"
    rows = []
    for a, b in PAIRS:
        src = _pair_source(a, b)
        j = f"SELECT {k}mi AS jm FROM ({mi_sql(f'({a}_bin, {b}_bin)', 'y', src, keys)})"
        ia = f"SELECT {k}mi AS am FROM ({mi_sql(f'{a}_bin', 'y', src, keys)})"
        ib = f"SELECT {k}mi AS bm FROM ({mi_sql(f'{b}_bin', 'y', src, keys)})"
        rows.append(f"SELECT {k}'{a}' AS i, '{b}' AS j, jm - am - bm AS synergy FROM ({j}) {join(ia)} {join(ib)}")
    return " UNION ALL ".join(rows)


@query("ft16_pair_synergy", f"WITH {COHORT_SQL}, {bins_sql(BIN_COLS, 'cohort')} SELECT i, j, round(synergy, 9) AS synergy FROM ({synergy_sql()})")
def ft16(spark, sf):
    b, names = binned_cohort(spark, sf)
    return round_all(ft.pair_synergy(b, names, "y"), "synergy", digits=9)


PAIR_MI_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, mi FROM ({mi_sql(f'{a}_bin', f'{b}_bin', _pair_source(a, b))})" for a, b in PAIRS)


@query("ft17_pairwise_mi", f"""
WITH {COHORT_SQL}, {bins_sql(BIN_COLS, 'cohort')}, h AS ({PAIR_MI_SQL})
SELECT i, j, round(mi, 9) AS mi FROM h UNION ALL SELECT j, i, round(mi, 9) FROM h""")
def ft17(spark, sf):
    b, names = binned_cohort(spark, sf)
    return round_all(ft.pairwise_mi(b, names), "mi", digits=9)


@query("ft18_top_pairs", f"""
WITH {COHORT_SQL}, {bins_sql(BIN_COLS, 'cohort')} SELECT i, j, round(synergy, 9) AS synergy FROM ({synergy_sql()}) ORDER BY round(synergy, 9) DESC, i, j LIMIT 3""")
def ft18(spark, sf):
    b, names = binned_cohort(spark, sf)
    return ft.top_pairs(ft.pair_synergy(b, names, "y"), "synergy", 3)


@query("ft19_pair_frequency", f"""
WITH {COHORT_SQL}, {bins_sql(BIN_COLS, 'cohort')}, s AS ({synergy_sql('segment')}),
k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY round(synergy, 9) DESC, i, j) AS r FROM s)
SELECT i, j, count(*) AS n_selected FROM k WHERE r <= 3 GROUP BY i, j""")
def ft19(spark, sf):
    b, names = binned_cohort(spark, sf, keep=("y", "segment"))
    chosen = ft.top_pairs(ft.pair_synergy(b, names, "y", ["segment"]), "synergy", 3, ["segment"])
    return ft.pair_frequency(chosen)


@query("ft10_rank_features")
def ft10(spark, sf):
    return ft.rank_features(cohort(spark, sf), NUM, "y", trees=20, depth=4)


@query("ft10_mi_f_scores", f"""
WITH {COHORT_SQL}, {bins_sql(BIN_COLS, 'cohort')}, m AS ({MARGINAL_SQL}), f AS ({anova_sql(BIN_COLS, 'cohort')}),
c AS (SELECT feature, round(mi / (max(mi) OVER () + 1e-9) * 0.4 + f_score / (max(f_score) OVER () + 1e-9) * 0.3 + 0.3 * 1 / (1 + 1e-9), 9) AS composite, mi, f_score FROM m JOIN f USING (feature))
SELECT feature, round(mi, 9) AS mi, round(f_score, 6) AS f_score, round(composite, 6) AS composite, CAST(row_number() OVER (ORDER BY composite DESC, feature) AS INTEGER) AS rank FROM c""")
def ft10s(spark, sf):
    c = cohort(spark, sf)
    fitted = ft.fit_quantile_bins(c, BIN_COLS)
    mi = ft.marginal_mi(fitted.transform(c, keep=["y"]), fitted.names, "y")
    f = ft.anova_f(c, BIN_COLS, "y")
    even = mi.select("feature", F.lit(1.0).alias("rf_importance"))
    out = ft.composite_ranking(mi, f, even).drop("rf_importance")
    return round_all(round_all(out, "f_score", "composite"), "mi", digits=9)


PCA_COLS = ["price", "acctbal", "priority", "order_day"]
COV = [(a, b) for i, a in enumerate(PCA_COLS) for b in PCA_COLS[i:]]
ZED = "zed AS (SELECT id, y, " + ", ".join(
    f"({c} - (SELECT avg({c}) FROM cohort)) / (SELECT stddev_pop({c}) FROM cohort) AS {c}" for c in PCA_COLS) + " FROM cohort)"


def standardised(spark, sf):
    c = cohort(spark, sf)
    return ft.fit_standard(c, PCA_COLS).transform(c, keep=["id", "y"])


@query("ft11_covariance", f"""
WITH {COHORT_SQL}, {ZED} {' UNION ALL '.join(f"SELECT '{a}' AS i, '{b}' AS j, round(covar_samp({a}, {b}), 6) AS cov FROM zed" for a, b in COV)}""")
def ft11(spark, sf):
    return round_all(ft.covariance(standardised(spark, sf), PCA_COLS), "cov")


@query("ft11_pca_variance", f"""
WITH {COHORT_SQL}, {ZED} SELECT round({' + '.join(f'var_samp({c})' for c in PCA_COLS)}, 6) AS total_variance, 1.0::DOUBLE AS explained FROM zed""")
def ft11v(spark, sf):
    z = standardised(spark, sf)
    pca = ft.fit_pca(z, PCA_COLS, 4)
    comps = pca.transform(z, keep=["id"])
    total = sum((F.var_samp(n) for n in pca.names[1:]), F.var_samp(pca.names[0]))
    return comps.agg(F.round(total, 6).alias("total_variance"), F.lit(round(sum(pca.stats["explained"]), 6)).alias("explained"))


@query("ft11_pca")
def ft11p(spark, sf):
    z = standardised(spark, sf)
    return ft.fit_pca(z, PCA_COLS, 3).transform(z, keep=["id"])


@query("ft12_range_map", f"""
WITH {SPLIT_SQL}, s AS (SELECT {', '.join(f'min({c}) AS {c}_lo, max({c}) AS {c}_hi' for c in ('price', 'acctbal'))} FROM train)
SELECT id, {', '.join(f'round(least(pi(), greatest(0::DOUBLE, ({c} - {c}_lo) / ({c}_hi - {c}_lo) * pi())), 6) AS {c}' for c in ('price', 'acctbal'))} FROM data, s""")
def ft12(spark, sf):
    train, data = train_test(spark, sf)
    return round_all(ft.fit_range(train, ["price", "acctbal"]).transform(data, keep=["id"]), "price", "acctbal")


@query("ft13_fit_and_apply")
def ft13(spark, sf):
    train, data = train_test(spark, sf)
    fitted = ft.fit_features(train, GROUPS, "y", FeatureConfig(k_best=5, n_components=3))
    return round_all(fitted.compact(data, keep=["id", "split"]), "pc1", "pc2", "pc3")


RFF_COLS = ["price", "acctbal", "priority"]
_UNIT = {"price": 500000.0, "acctbal": 10000.0, "priority": 5.0}


def unit_cohort(spark, sf):
    return cohort(spark, sf).select("id", "y", *[(F.col(c) / v).alias(c) for c, v in _UNIT.items()])


UNIT_SQL = f"{COHORT_SQL}, u AS (SELECT id, " + ", ".join(f"{c} / {v} AS {c}" for c, v in _UNIT.items()) + " FROM cohort)"
_RFF, _PROJ = ft.rff(RFF_COLS, 4, 42), ft.random_projection(RFF_COLS, 4, 42)


def _dot(w, j):
    return " + ".join(f"{w[i][j]!r}::DOUBLE * {c}" for i, c in enumerate(RFF_COLS))


@query("ft20_rff", f"WITH {UNIT_SQL} SELECT id, {', '.join(f'round(cos({_dot(_RFF.stats['w'], j)} + {_RFF.stats['b'][j]!r}), 6) AS rff{j + 1}' for j in range(4))} FROM u")
def ft20(spark, sf):
    return round_all(_RFF.transform(unit_cohort(spark, sf), keep=["id"]), *_RFF.names)


@query("ft21_random_projection", f"WITH {UNIT_SQL} SELECT id, {', '.join(f'round({_dot(_PROJ.stats['w'], j)}, 6) AS proj{j + 1}' for j in range(4))} FROM u")
def ft21(spark, sf):
    return round_all(_PROJ.transform(unit_cohort(spark, sf), keep=["id"]), *_PROJ.names)


def noise_sql(seed, j, id_col="id"):
    u = lambda w: f"((CAST('0x' || substr(md5('{seed}:{j}:' || {id_col}), {1 + 8 * w}, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"
    return f"sqrt(-2 * ln({u(0)})) * cos({2 * math.pi!r} * {u(1)})"


@query("ft22_noise_features", f"WITH {COHORT_SQL} SELECT id, {', '.join(f'round({noise_sql(42, j)}, 6) AS noise{j + 1}' for j in range(4))} FROM cohort")
def ft22(spark, sf):
    n = ft.noise_features(cohort(spark, sf).select("id"), "id", 4, 42)
    return round_all(n, "noise1", "noise2", "noise3", "noise4")


@query("ft23_loading_map")
def ft23(spark, sf):
    return ft.loading_map(spark, ft.fit_pca(standardised(spark, sf), PCA_COLS, 3))
