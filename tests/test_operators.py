"""Hand-worked frames and properties."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.functions import scalar as sc
from lynceus.functions.stats import binomial_two_sided_p, normal_two_sided_p, t_quantile_975
from lynceus.operators import bootstrap as bs, compare as cp, derive as pr, evaluate as ev, features as ft
from lynceus.operators import kernels as kn, quality as dq, ranking as rk, sampling as sp
from lynceus.plans.config import FeatureConfig
from lynceus.plans.roles import cohort, scores_long, scores_wide, vectors
from lynceus.session import new_table_path
from lynceus.sources import io

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# ---- metrics ------------------------------------------------------------------------------------


def test_confusion_example(spark):
    y = [1, 1, 1, 1, 1, 0, 0, 0, 0, 0]
    p = [0.9, 0.8, 0.7, 0.1, 0.2, 0.1, 0.2, 0.3, 0.4, 0.5]
    df = spark.createDataFrame([("m", a, b) for a, b in zip(y, p)], "model string, y int, proba double")
    r = ev.label_metrics(df, ["model"]).first()
    assert (r.tp, r.fn, r.tn, r.fp) == (3, 2, 4, 1)
    assert (r.accuracy, r.precision, r.sensitivity, r.specificity) == (0.7, 0.75, 0.6, 0.8)
    one_pass = ev.all_metrics(df, ["model"]).first()
    assert all(one_pass[c] == r[c] for c in ("tp", "fp", "tn", "fn", *ev.LABEL_METRICS))
    assert one_pass.brier == pytest.approx(np.mean((np.array(p) - np.array(y)) ** 2))


def auc_brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_auc_and_delong_against_pairs(spark):
    rng = np.random.RandomState(0)
    y = rng.randint(0, 2, 120)
    a, b = np.round(rng.rand(120) * 0.6 + 0.3 * y, 1), np.round(rng.rand(120), 1)
    df = spark.createDataFrame([("s", int(v), float(q), float(r)) for v, q, r in zip(y, a, b)], "g string, y int, pa double, pb double")
    r = cp.delong(df, ["g"]).first()
    assert r.auc_a == pytest.approx(auc_brute(y, a)) and r.auc_b == pytest.approx(auc_brute(y, b))
    psi = lambda p: np.where(p[y == 1][:, None] > p[y == 0][None], 1.0, np.where(p[y == 1][:, None] == p[y == 0][None], 0.5, 0.0))
    d = psi(a) - psi(b)
    var = d.mean(1).var(ddof=1) / (y == 1).sum() + d.mean(0).var(ddof=1) / (y == 0).sum()
    assert r.var_delta == pytest.approx(var)
    swapped = cp.delong(df.select("g", "y", F.col("pb").alias("pa"), F.col("pa").alias("pb")), ["g"]).first()
    assert swapped.delta == pytest.approx(-r.delta) and swapped.p_value == pytest.approx(r.p_value)
    same = cp.delong(df.select("g", "y", "pa", F.col("pa").alias("pb")), ["g"]).first()
    assert (same.delta, same.p_value, same.ci_low) == (0, 1, 0)


def test_delong_needs_two_per_class(spark):
    df = spark.createDataFrame([("s", 1, 0.5, 0.4), ("s", 0, 0.2, 0.1), ("s", 0, 0.3, 0.1)], "g string, y int, pa double, pb double")
    with pytest.raises(Exception, match="two rows of each class"):
        cp.delong(df, ["g"]).collect()


def test_holm_example(spark):
    df = spark.createDataFrame([("a", 0.04), ("b", 0.01), ("c", 0.03), ("d", 0.02)], "name string, p double")
    r = {x.name: (round(x.p_holm, 6), x.significant) for x in cp.holm(df, "p", ["name"]).collect()}
    assert r == {"b": (0.04, True), "d": (0.06, False), "c": (0.06, False), "a": (0.06, False)}


def test_mcnemar_identical_and_exact(spark):
    df = spark.createDataFrame([("s", 1, 0.9, 0.9), ("s", 0, 0.9, 0.9)], "g string, y int, pa double, pb double")
    r = cp.mcnemar(df, ["g"]).first()
    assert (r.n_discordant, r.p_value) == (0, 1)
    p = spark.createDataFrame([(2, 9), (5, 5), (400, 300)], "b long, c long").select(binomial_two_sided_p(F.col("b"), F.col("c")).alias("p"))
    exact = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
    assert [x.p for x in p.collect()] == pytest.approx([exact(2, 9), 1.0, exact(400, 300)], rel=1e-9)


def test_normal_and_t(spark):
    z = spark.createDataFrame([(0.5, 4), (1.959963984540054, 30), (3.0, 200)], "z double, df long")
    r = z.select(normal_two_sided_p(F.col("z")).alias("p"), t_quantile_975(F.col("df")).alias("t")).collect()
    assert [x.p for x in r] == pytest.approx([math.erfc(v / math.sqrt(2)) for v in (0.5, 1.959963984540054, 3.0)], abs=2e-7)
    assert [x.t for x in r] == pytest.approx([2.776445, 2.042272, 1.971896], abs=1e-5)


def test_bootstrap_moments(spark):
    """The interval of accuracy has the binomial width, and draws do not depend on partitioning."""
    s = scores_long(spark, SF)
    r = bs.metric_ci_table(s, ["model"], resamples=400, metrics=["accuracy", "roc_auc"]).collect()
    n = s.filter("model = 'a'").count()
    for x in r:
        assert x.ci_low < x.point < x.ci_high and x.n_resamples == 400
        if x.metric == "accuracy":
            assert x.ci_high - x.ci_low == pytest.approx(2 * 1.96 * math.sqrt(x.point * (1 - x.point) / n), rel=0.25)
    again = bs.metric_ci_table(s.repartition(13), ["model"], resamples=400, metrics=["accuracy", "roc_auc"])
    assert rows(again, "model", "metric") == sorted((tuple(x) for x in r), key=lambda t: t[:2])


def boot_by_hand(cells, resamples, side):
    """Both ranking metrics per draw (column 0: the table itself) of (score, y, count, w0, w1) cells, one score after the other."""
    from lynceus.functions.draws import poisson

    c, y = np.array([x[2] for x in cells]), np.array([x[1] for x in cells])
    w = np.column_stack([c, poisson(c, np.array([x[3] for x in cells]), np.array([x[4] for x in cells]), resamples)])
    score = np.array([x[0][side] for x in cells])
    tp = fp = np.zeros(resamples + 1)
    area = ap = np.zeros(resamples + 1)
    for s in np.unique(score)[::-1]:
        p, n = w[(score == s) & (y == 1)].sum(0), w[(score == s) & (y == 0)].sum(0)
        area = area + n * (tp + p / 2)
        tp, fp = tp + p, fp + n
        ap = ap + p * tp / np.maximum(tp + fp, 1)
    ok = (tp > 0) & (fp > 0)
    return {int(r) - 1: (area[r] / (tp[r] * fp[r]), ap[r] / tp[r]) for r in np.flatnonzero(ok)}


@pytest.mark.parametrize("hot, rows", [(100_000, 256), (3, 5)])
def test_resampled_ranking_equals_numpy(spark, monkeypatch, hot, rows):
    """2000 draws over tied, hot and close scores, with a null group and groups of one class."""
    monkeypatch.setattr(bs, "HOT", hot)
    monkeypatch.setattr(bs, "ROWS", rows)
    rng = np.random.default_rng(5)
    data = [(g, int(rng.random() < 0.4), float(rng.choice([0.5, 0.25, 0.1 + 1e-16, round(rng.random(), 3)])), float(round(rng.random(), 1)), int(rng.choice([1, 1, 2, 40, 3000])))
            for g in (None, "a", "b") for _ in range(60)] + [("one", 1, 0.5, 0.5, 3)]
    pairs = spark.createDataFrame(data, "g string, y int, pa double, pb double, cnt long")
    got = bs.paired_draws(pairs, ["g"], 2000, 7)
    cells = pairs.groupBy("g", "y", "pa", "pb").agg(F.sum("cnt").alias("cnt"))
    words = [bs.hash_word(F.lit(7), F.col("g"), F.col("y"), bs.score_key(F.col("pa")), bs.score_key(F.col("pb")), word=i).alias(f"w{i}") for i in (0, 1)]
    found = {}
    for r in got.collect():
        found.setdefault(r.g, {})[r.r] = (r.roc_auc, r.pr_auc)
    rows = cells.select("*", *words).collect()
    assert "one" not in found and len(found) == 3
    for g in (None, "a", "b"):
        of = [((r.pa, r.pb), r.y, r.cnt, r.w0, r.w1) for r in rows if r.g == g]
        a, b = boot_by_hand(of, 2000, 0), boot_by_hand(of, 2000, 1)
        assert set(found[g]) == set(a)
        for r in a:
            assert found[g][r] == pytest.approx((a[r][0] - b[r][0], a[r][1] - b[r][1]), abs=1e-12)


def test_poisson_draws_follow_one_formula():
    from lynceus.functions.draws import poisson, poisson_table

    for n in (1, 2, 30, 31, 1000, 10**6, 10**9):
        low, limits = poisson_table(n)
        assert np.all(np.diff(limits.astype(np.int64)) >= 0)
        x = poisson(np.array([n]), np.array([12345]), np.array([n % 2**32]), 20_000)[0]
        assert abs(x.mean() - n) < 5 * np.sqrt(n / 20_000) and abs(x.var() / n - 1) < 0.06
    assert poisson_table(1)[1][:3].tolist() == [int(2**32 * np.exp(-1)), int(2**32 * 2 * np.exp(-1)), int(2**32 * 2.5 * np.exp(-1))]


def test_few_words_are_searched_among_the_thresholds(monkeypatch):
    """Top bits settle most draws of small counts; the numbers are those of a search for every word."""
    from lynceus.functions import draws

    searched, plain = [], np.searchsorted
    rng = np.random.default_rng(3)
    counts, w0, w1 = rng.choice([1, 2, 60, 5000], 40), rng.integers(0, 2**32, 40), rng.integers(0, 2**32, 40)
    words = draws.words(w0, w1, 500)
    want = [low + plain(limits, word, "right") for (low, limits), word in zip(map(draws.poisson_table, counts.tolist()), words)]
    for n in set(counts.tolist()):
        draws.poisson_table(n), draws.poisson_guide(n)
    monkeypatch.setattr(draws.np, "searchsorted", lambda a, v, side: searched.append(np.size(v)) or plain(a, v, side))
    assert np.array_equal(draws.poisson(counts, w0, w1, 500), want)
    assert 0 < sum(searched) < words.size / 4


def test_ranks_shuffle_the_rows_once(spark):
    from lynceus.operators.ranking import hash_rank

    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = spark.range(100).withColumn("y", F.when(F.col("id") % 3 > 0, F.col("id") % 3)).withColumn("pay", F.lit("load").substr(F.lit(1), F.col("id").cast("int")))
        plan = hash_rank(df, "id", ["y"], 7)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    lines = plan.split("\n")
    moved = [line for at, line in enumerate(lines) if "Exchange" in line and "pay#" in lines[at + 1]]
    assert len(moved) == 1


def test_paired_bootstrap_identical(spark):
    p = cp.wide_pair(scores_wide(spark, SF), "a", "a", ["stage"])
    for r in bs.paired_bootstrap(p, ["stage"], 50).collect():
        assert (r.delta, r.ci_low, r.ci_high, r.p_value, r.includes_zero) == (0, 0, 0, 1, True)


def test_gate_truth_table(spark):
    base = [0.70, 0.71, 0.72, 0.73, 0.74]
    cases = {True: [0.05] * 5, False: [0.05, 0.05, 0.05, -0.01, -0.01]}
    for want, gains in cases.items():
        data = [(i, m, v) for i, b in enumerate(base) for m, v in (("b", b), ("s", b + gains[i]), ("c", b - 0.01))]
        r = cp.acceptance_gate(spark.createDataFrame(data, "fold int, model string, roc_auc double"), "b", "s", "c").first()
        assert r.gate_passed is want and r.fold_consistent is want


# ---- sampling -----------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 16])
def test_splits_ignore_partitioning(spark, parts):
    c = cohort(spark, SF).select("id", "y")
    want = rows(sp.stratified_split(c, "id", "y", 0.2, 7), "id")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows(sp.stratified_split(c.repartition(parts), "id", "y", 0.2, 7), "id") == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_sampling_invariants(spark):
    c = cohort(spark, SF).select("id", "y")
    parts = sp.fixed_split(c, "id", "y", 200, 20, 42)
    sp.assert_disjoint(parts.filter("part = 'pool'"), parts.filter("part <> 'pool'"), "id")
    with pytest.raises(sp.LeakageError):
        sp.assert_disjoint(parts, parts.filter("part = 'test'"), "id")
    samples = sp.nested_samples(c, "id", "y", [100, 400], 1)
    assert all(r.nested for r in sp.verify_nesting(samples, "id").collect())
    share = c.agg(F.avg("y")).first()[0]
    for r in samples.groupBy("size").agg(F.count("id").alias("n"), F.sum("y").alias("p")).collect():
        assert r.n == r.size and abs(r.p - r.size * share) <= 1
    with pytest.raises(ValueError):
        sp.nested_samples(c, "id", "y", [10**9], 1)
    drawn = sp.balanced_draw(c, parts.filter("part <> 'pool'"), "id", "y", 51, 3)
    assert rows(drawn.groupBy("y").count(), "y") == [(0, 26), (1, 25)]
    tiny = sp.bounded_subsample(c.filter("y = 0").limit(50).unionByName(c.filter("y = 1").limit(1)), "id", "y", 10, 3)
    assert tiny.filter("y = 1").count() == 1


def test_one_class_with_most_rows_is_spread(spark):
    """A stratum with all rows is ranked in many window groups, and ranks are still 1..n."""
    df = spark.range(5000).withColumn("y", F.lit(1))
    r = rk.hash_rank(df, "id", ["y"], 1)
    assert [x[0] for x in r.select("rank").orderBy("rank").collect()] == list(range(1, 5001))


def test_null_groups_keep_their_rows(spark):
    """A null label is a stratum, a null model a group: no row and no group vanishes."""
    df = spark.range(100).withColumn("y", F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") % 2).cast("int")))
    assert sp.assign_folds(df, "id", "y", 5, 42).count() == 100
    split = sp.stratified_split(df, "id", "y", 0.2, 42)
    counts = {r.y: r.n for r in split.filter("split = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert split.count() == 100 and counts == {None: 5, 0: 5, 1: 10}
    scores = spark.range(60).select(
        F.when(F.col("id") < 30, "m").alias("model"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 60).alias("proba"))
    assert {r.model for r in ev.roc_auc(scores, ["model"]).collect()} == {"m", None}
    pairs = scores.select("model", "y", F.col("proba").alias("pa"), (F.col("proba") * F.col("proba")).alias("pb"))
    assert {r.model for r in cp.delong(pairs, ["model"]).collect()} == {"m", None}
    assert {r.model for r in cp.score_corr(pairs, ["model"]).collect()} == {"m", None}


@pytest.mark.parametrize("b,c", [(0, 0), (3, 9), (10, 10), (500, 620), (40_000, 41_000), (3_000_000, 3_004_000)])
def test_sign_test_is_one_formula_at_every_size(spark, b, c):
    low, n = min(b, c), b + c
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(max(0, low - 60_000), low + 1)]
    want = 1.0 if b == c else min(1.0, 2 * math.fsum(map(math.exp, logs)))
    got = spark.createDataFrame([(b, c)], "b long, c long").select(binomial_two_sided_p(F.col("b"), F.col("c"))).first()[0]
    assert got == pytest.approx(want, rel=1e-6)


def test_fit_names_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, gone double")
    for fit in (ft.fit_median, ft.fit_mean, ft.fit_mode, ft.fit_standard):
        with pytest.raises(dq.ValidationError, match="gone"):
            fit(df, ["x", "gone"])


def test_quantiles_exact(spark):
    x = np.random.RandomState(3).exponential(size=997)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}
    want = np.quantile(x, list(probs.values()))
    lazy = rk.exact_quantiles(df, ["x"], probs).first()
    assert [lazy[p] for p in probs] == pytest.approx(want, rel=1e-12)
    assert list(rk.fitted_quantiles(df, ["x"], probs)["x"].values()) == pytest.approx(want, rel=1e-12)


def test_digests(spark):
    c = cohort(spark, SF)
    assert sp.table_digest(c).first() == sp.table_digest(c.repartition(7)).first()
    assert sp.table_digest(c).first() != sp.table_digest(c.filter("id > 3")).first()
    # a repeated pair of rows cancels in xor alone
    assert sp.table_digest(c).first() != sp.table_digest(c.unionByName(c.limit(2)).unionByName(c.limit(2))).first()
    assert sp.split_id(1500, 0.2, 42, True) == sp.split_id_of(spark.range(1500), 0.2, 42, True).first()["split_id"]


# ---- quality ------------------------------------------------------------------------------------


def test_plausibility_and_guard(spark):
    df = spark.createDataFrame(
        [(120.0, 80.0, 170.0, 70.0, 50.0), (30.0, 80.0, 170.0, 70.0, 50.0), (None, 500.0, 90.0, 20.0, 50.0)],
        "ap_hi double, ap_lo double, height double, weight double, age_years double")
    flagged = dq.plausibility_flags(df, dq.vital_rules())
    assert [r.any_flag for r in flagged.collect()] == [False, True, True]
    clean, out = dq.split_clean(flagged)
    assert (clean.count(), out.count()) == (1, 2)
    verdicts = [r.verdict for r in dq.ood_guard(df).collect()]
    assert verdicts[0] == "in_distribution" and verdicts[1] == "high_outlier"
    plain = dq.ood_guard(spark.createDataFrame([(120.0, 80.0, 100.0, 25.0, 50.0)], df.schema)).first()
    assert (plain.distance, plain.similarity) == (0.0, 1.0)


def test_runs_consistency_fails_on_tampering(spark):
    good = [(1, 0, "a", 0.1), (2, 1, "a", 0.9), (1, 0, "b", 0.2), (2, 1, "b", 0.8)]
    schema = "id long, y int, run string, proba double"
    dq.assert_runs_consistent(spark.createDataFrame(good, schema))
    for bad in ([*good[:3], (4, 1, "b", 0.8)], [*good[:3], (2, 0, "b", 0.8)], [*good[:3], (2, 1, "b", 1.8)], [*good, good[0]]):
        with pytest.raises(dq.ValidationError):
            dq.assert_runs_consistent(spark.createDataFrame(bad, schema))


def test_matrix_assertions(spark):
    df = spark.createDataFrame([(1.0, 0), (float("nan"), 1), (9.0, 2)], "x double, y int")
    dq.assert_matrix(df.limit(1), ["x"], lo=0, hi=2, label="y", expected_cols=1, expected_rows=1)
    with pytest.raises(dq.ValidationError, match="1 missing"):
        dq.assert_matrix(df, ["x"])
    with pytest.raises(dq.ValidationError, match="y: .*1 outside"):
        dq.assert_matrix(df.filter("x = 9"), ["x"], label="y")
    with pytest.raises(dq.ValidationError):
        dq.assert_close(df.withColumn("id", F.lit(1)).limit(1), df.withColumn("id", F.lit(1)).withColumn("x", F.col("x") + 1).limit(1), "id", ["x"])


# ---- features -----------------------------------------------------------------------------------


def test_engineered_vitals(spark):
    df = spark.createDataFrame([(80.0, 160.0, 140.0, 90.0, 50.0, 2)], "weight double, height double, ap_hi double, ap_lo double, age_years double, cholesterol int")
    r = pr.engineer_features(df).first()
    assert [r.bmi, r.pulse_pressure, r.mean_arterial_pressure, r.age_x_cholesterol] == pytest.approx([31.25, 50.0, 106.6667, 100.0], abs=1e-4)


def test_synergy_finds_xor(spark):
    rng = np.random.RandomState(1)
    a, b, n = rng.randint(0, 2, 600), rng.randint(0, 2, 600), rng.randint(0, 4, 600)
    df = spark.createDataFrame([(int(x), int(z), int(w), int(x ^ z)) for x, z, w in zip(a, b, n)], "a_bin int, b_bin int, n_bin int, y int")
    top = ft.top_pairs(ft.pair_synergy(df, ["a_bin", "b_bin", "n_bin"], "y"), "synergy", 1).first()
    assert (top.i, top.j) == ("a", "b") and top.synergy > 0.6
    both = ft.top_pairs(ft.pairwise_mi(df, ["a_bin", "b_bin", "n_bin"]), "mi", 9)
    assert both.count() == 3


def test_quantile_bins_drop_repeated_edges(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0)], "x double")
    fitted = ft.fit_quantile_bins(df, ["x"], 4)
    assert fitted.stats["edges"]["x"] == [1.0, 1.5, 3.25, 5.0]
    assert [r.x_bin for r in fitted.transform(df, keep=[]).collect()] == [0, 0, 0, 0, 1, 1, 2, 2]


GROUPS = pr.FeatureGroups(continuous=("price", "known_bal"), ordinal=("priority",), nominal=("segment",))


def numbers(fitted):
    """Every number a fit holds, in order. Sums of doubles differ in their last digits with the order of the rows."""
    return [float(x) for x in re.findall(r"(?<![A-Za-z_0-9])-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?", repr(fitted))]


def test_fit_ignores_rows_it_is_not_given(spark):
    """Extreme held-out rows do not move anything fitted, and nothing fitted leaves the range."""
    s = sp.stratified_split(cohort(spark, SF), "id", "y", 0.2, 42)
    cfg = FeatureConfig(k_best=4, n_components=2)
    wild = s.withColumn("price", F.when(F.col("split") == "test", F.lit(1e12)).otherwise(F.col("price")))
    one, two = (ft.fit_features(d.filter("split = 'train'"), GROUPS, "y", cfg) for d in (s, wild))
    assert one.selected == two.selected
    assert numbers(one) == pytest.approx(numbers(two), rel=1e-9)
    out = one.compact(wild, keep=["id"])
    dq.assert_matrix(out, ["pc1", "pc2"], lo=0.0, hi=math.pi, expected_rows=s.count())
    moved = ft.fit_features(wild, GROUPS, "y", cfg)
    assert numbers(moved) != pytest.approx(numbers(one), rel=1e-9)


def test_pca_matches_numpy(spark):
    x = np.random.RandomState(2).normal(size=(200, 3)) @ np.diag([3, 2, 1])
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    fitted = ft.fit_pca(df, ["a", "b", "c"], 2)
    val, vec = np.linalg.eigh(np.cov(x.T))
    top = vec[:, ::-1][:, :2]
    top = top * np.sign(top[np.abs(top).argmax(0), range(2)])
    got = np.array(fitted.transform(df, keep=[]).collect())
    assert got == pytest.approx((x - x.mean(0)) @ top, abs=1e-8)
    assert fitted.stats["explained"] == pytest.approx((val[::-1] / val.sum())[:2])


def test_noise_is_normal(spark):
    r = ft.noise_features(spark.range(20000), "id", 1, 5).agg(F.avg("noise1"), F.stddev("noise1")).first()
    assert abs(r[0]) < 0.03 and abs(r[1] - 1) < 0.03


def test_bundle_rules(spark):
    docs = [
        '{"resourceType":"Patient","gender":"Female","birthDate":"2020-01-01"}',
        '{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Observation","code":{"text":"Systolic"},"valueQuantity":{"value":300}}},'
        '{"resource":{"resourceType":"Observation","code":{"coding":[{"code":"8480-6"}]},"valueQuantity":{"value":0}}},'
        '{"resource":{"resourceType":"Observation","code":{"coding":[{"code":"2093-3"}]},"valueQuantity":{"value":201}}}]}',
        "not json",
    ]
    flat = pr.flatten_bundle(spark.createDataFrame(list(enumerate(docs)), "id int, j string"), "j", 2025).orderBy("id").collect()
    assert (flat[0].gender_male, flat[0].age_years, flat[0].ap_hi) == (0, 18.0, 130.0)
    assert (flat[1].ap_hi, flat[1].cholesterol, flat[1].gender_male, flat[1].weight) == (240.0, 2, 1, 78.5)
    assert (flat[2].age_years, flat[2].ap_lo) == (52.0, 85.0)


def test_binary_target_rejects_null(spark):
    df = spark.createDataFrame([(0,), (3,), (None,)], "num int").withColumn("y", sc.binary_target(F.col("num")))
    with pytest.raises(Exception, match="graded label is null"):
        df.collect()


# ---- kernels ------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [60, 1000])
def test_kernel_tiles_equal_brute_force(spark, block):
    v = vectors(spark, SF)
    pdf = v.toPandas()
    x = np.stack(pdf.vec)
    k, pos = (x @ x.T) ** 2, {i: n for n, i in enumerate(pdf.id)}
    got = np.full(k.shape, np.nan)
    for r in kn.kernel_cross(v, v, block_rows=block).collect():
        got[pos[r.id], [pos[j] for j in r.ids]] = r.k
    assert np.abs(got - k).max() < 1e-12
    cross = kn.kernel_cross(v.limit(7), v, block_rows=block).select(F.explode("k").alias("k")).agg(F.count("k"), F.sum("k")).first()
    assert cross[0] == 7 * len(pdf)


# ---- sources ------------------------------------------------------------------------------------


def test_headerless_and_delimited(spark):
    path = new_table_path(spark, "t")
    spark.createDataFrame([("63.0,1.0,1.0,145.0,233.0,1.0,2.0,150.0,0.0,2.3,3.0,?,6.0,0",)], "v string").write.text(path)
    r = io.read_headerless(spark, path).first()
    assert (r.age, r.ca, r.num) == (63.0, None, 0.0)
    wrong = new_table_path(spark, "t")
    spark.createDataFrame([(1, 2)], "id int, age int").write.option("sep", ";").option("header", True).csv(wrong)
    with pytest.raises(io.SchemaError):
        io.read_delimited(spark, wrong)


def test_guarded_scores_and_resume(spark):
    path = new_table_path(spark, "t")
    s = scores_wide(spark, SF).select("id", "a")
    io.write_table(s, path)
    fp = sp.id_fingerprint(s, "id").first()["fingerprint"]
    assert io.read_scores(spark, path, fp).count() == s.count()
    with pytest.raises(io.FingerprintError):
        io.read_scores(spark, path, "0" * 16)
    calls = []
    run = lambda k: calls.append(k) or spark.range(k)
    base = new_table_path(spark, "t")
    io.run_missing([1, 2], base, run)
    out = io.run_missing([1, 2, 3], base, run, valid=lambda part: part.count() != 2)
    assert calls == [1, 2, 2, 3] and out.count() == 6
