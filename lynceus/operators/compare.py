"""Paired comparisons of two models on the same rows, and decisions drawn from them.

Rows are first reduced to counts of identical ``(score a, score b, label)``: every statistic here is
a weighted statistic of those counts, so a hot score costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lynceus.functions.stats import Z_975, binomial_two_sided_p, normal_two_sided_p
from lynceus.operators.evaluate import score_points
from lynceus.operators.quality import count_where
from lynceus.operators.ranking import join_groups, running_sums
from lynceus.session import stored

ALPHA = 0.05


def pair_with_reference(scores: DataFrame, ref: str, keys: list[str], id_col: str = "id") -> DataFrame:
    """``(keys, model, id, y, pa, pb)``: every other model's score next to the reference's, by id. Null keys are groups like any other."""
    other = scores.filter(F.col("model") != ref).select(*keys, id_col, "y", "model", F.col("proba").alias("pa"))
    base = scores.filter(F.col("model") == ref).select(*keys, id_col, F.col("proba").alias("pb"))
    return join_groups(other, base, [*keys, id_col])


def wide_pair(scores: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    return scores.select(*keys, "y", F.col(a).alias("pa"), F.col(b).alias("pb"))


def pair_weight(pairs: DataFrame) -> Column:
    """Rows a line stands for: ``cnt`` where pairs were already counted, else one."""
    return F.col("cnt") if "cnt" in pairs.columns else F.lit(1).cast("long")


def pair_cells(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys, "y", "pa", "pb").agg(F.sum(pair_weight(pairs)).alias("cnt"))


def _side(cells: DataFrame, keys: list[str], p: str, build) -> DataFrame:
    """Adds per distinct score of one side the columns ``build`` derives from its running counts."""
    pts = score_points(cells, keys, p, weight="cnt")
    run = running_sums(pts, keys, p, ["pos", "neg"])
    return run.select(*keys, p, *[c.alias(n) for n, c in build().items()])


def delong(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """DeLong test of AUC(a) - AUC(b) per group, in O(n log n) from running counts.

    A positive's component is the share of negatives below it (ties one half), a negative's the share
    of positives above it. Only the difference of the two models' components enters the variance. A
    group with fewer than two rows of a class stops the job. The cells are read once per side and pass,
    so they are stored instead of joining the pairs again for each.
    """
    cells = pairs if "cnt" in pairs.columns else stored(pair_cells(pairs, keys))

    def parts(tag: str):
        v10 = (F.col("neg_before") + F.col("neg") / 2.0) / F.col("neg_total")
        v01 = 1.0 - (F.col("pos_before") + F.col("pos") / 2.0) / F.col("pos_total")
        return lambda: {f"v10{tag}": v10, f"v01{tag}": v01}

    joined = join_groups(cells, _side(cells, keys, "pa", parts("a")), [*keys, "pa"])
    joined = join_groups(joined, _side(cells, keys, "pb", parts("b")), [*keys, "pb"])
    pos, c = F.col("y") == 1, F.col("cnt").cast("double")
    d10, d01 = F.col("v10a") - F.col("v10b"), F.col("v01a") - F.col("v01b")
    when_pos, when_neg = lambda e: F.sum(F.when(pos, e)), lambda e: F.sum(F.when(~pos, e))
    agg = joined.groupBy(*keys).agg(
        F.coalesce(when_pos(c), F.lit(0.0)).alias("n1"), F.coalesce(when_neg(c), F.lit(0.0)).alias("n0"),
        when_pos(c * F.col("v10a")).alias("sa"), when_pos(c * F.col("v10b")).alias("sb"),
        when_pos(c * d10).alias("s1"), when_pos(c * d10 * d10).alias("q1"),
        when_neg(c * d01).alias("s0"), when_neg(c * d01 * d01).alias("q0"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    few = (n1 < 2) | (n0 < 2)
    var_of = lambda s, q, n: F.greatest(F.lit(0.0), F.col(q) - F.col(s) * F.col(s) / n) / (n - 1) / n
    var = F.when(few, F.raise_error(F.lit("the test needs two rows of each class")).cast("double")).otherwise(
        var_of("s1", "q1", n1) + var_of("s0", "q0", n0)
    )
    base = agg.select(
        *keys, (F.col("sa") / n1).alias("auc_a"), (F.col("sb") / n1).alias("auc_b"), (F.col("s1") / n1).alias("delta"), var.alias("var_delta")
    )
    live = F.col("var_delta") > 1e-18
    se = F.sqrt("var_delta")
    z = F.when(live, F.col("delta") / se).otherwise(F.lit(0.0))
    half = F.lit(Z_975) * se
    return base.withColumn("z", z).withColumns({
        "ci_low": F.when(live, F.col("delta") - half).otherwise(F.lit(0.0)),
        "ci_high": F.when(live, F.col("delta") + half).otherwise(F.lit(0.0)),
        "p_value": F.when(live, normal_two_sided_p(F.col("z"))).otherwise(F.lit(1.0)),
    })


def mcnemar(pairs: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """2x2 table of correct label decisions and the exact two-sided binomial p."""
    y = F.col("y")
    right_a = (F.col("pa") >= threshold).cast("int") == y
    right_b = (F.col("pb") >= threshold).cast("int") == y
    rows = lambda cond: F.coalesce(F.sum(F.when(cond, pair_weight(pairs))), F.lit(0).cast("long"))
    agg = pairs.groupBy(*keys).agg(
        rows(right_a & right_b).alias("both_correct"), rows(right_a & ~right_b).alias("a_only"),
        rows(~right_a & right_b).alias("b_only"), rows(~right_a & ~right_b).alias("both_wrong"),
    )
    return agg.withColumns({
        "n_discordant": F.col("a_only") + F.col("b_only"), "p_value": binomial_two_sided_p(F.col("a_only"), F.col("b_only")),
    })


def holm(pvalues: DataFrame, p: str, order: list[str], family: list[str] | None = None, alpha: float = ALPHA,
         out: str = "p_holm", flag: str = "significant") -> DataFrame:
    """Holm step-down over each family: a family is a declared list of hypotheses, so it is small.

    ``order`` breaks ties between equal p-values; rows keep their identity columns.
    """
    w = Window.partitionBy(*(family or [F.lit(0)]))
    step = w.orderBy(p, *order)
    scaled = F.col(p) * (F.count(F.lit(1)).over(w) - F.row_number().over(step) + 1)
    return (
        pvalues.withColumn("_s", scaled)
        .withColumn(out, F.least(F.lit(1.0), F.max("_s").over(step.rowsBetween(Window.unboundedPreceding, 0))))
        .withColumn(flag, F.col(out) < alpha)
        .drop("_s")
    )


def extend_family(old: DataFrame, new: DataFrame, p: str, order: list[str], **kw) -> DataFrame:
    """Corrects old and new comparisons together, once; earlier corrections are not reused."""
    keep = [c for c in new.columns if c in old.columns]
    both = old.select(*keep).withColumn("origin", F.lit("old")).unionByName(new.select(*keep).withColumn("origin", F.lit("new")))
    return holm(both, p, [*order, "origin"], **kw)


def score_corr(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson and Spearman correlation of two scores; ranks of ties are averaged."""
    cells = pairs.groupBy(*keys, "pa", "pb").agg(F.count(F.lit(1)).alias("cnt"))

    def side(p: str, tag: str) -> DataFrame:
        pts = cells.groupBy(*keys, p).agg(F.sum("cnt").alias("n"))
        run = running_sums(pts, keys, p, ["n"])
        # centred average rank: the mean rank of n rows is (n + 1) / 2
        r = F.col("n_before") + (F.col("n") + 1) / 2.0 - (F.col("n_total") + 1) / 2.0
        return run.select(*keys, p, r.alias(f"r{tag}"))

    j = join_groups(join_groups(cells, side("pa", "a"), [*keys, "pa"]), side("pb", "b"), [*keys, "pb"])
    c, ra, rb = F.col("cnt"), F.col("ra"), F.col("rb")
    spearman = j.groupBy(*keys).agg(
        F.try_divide(F.sum(c * ra * rb), F.sqrt(F.sum(c * ra * ra) * F.sum(c * rb * rb))).alias("spearman")
    )
    pearson = pairs.groupBy(*keys).agg(F.corr("pa", "pb").alias("pearson"), F.count(F.lit(1)).alias("n"))
    if keys:
        return join_groups(pearson, spearman, keys)
    return pearson.withColumn("spearman", spearman.scalar())


def partial_corr(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """Correlation of x and y after removing what z explains linearly; 0 when y is a function of z."""
    agg = df.groupBy(*keys).agg(F.corr(x, y).alias("_xy"), F.corr(x, z).alias("_xz"), F.corr(y, z).alias("_yz"))
    xz, yz = F.col("_xz"), F.col("_yz")
    rest = (1 - xz * xz) * (1 - yz * yz)
    value = F.when(rest > 1e-12, (F.col("_xy") - xz * yz) / F.sqrt(rest)).otherwise(F.lit(0.0))
    return agg.select(*keys, value.alias("partial_corr"))


def disagreement(pairs: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    differ = ((F.col("pa") >= threshold) != (F.col("pb") >= threshold)).cast("double")
    return pairs.groupBy(*keys).agg(F.avg(differ).alias("disagreement_rate"))


def verdict(p: Column, delta: Column, alpha: float = ALPHA) -> Column:
    """One of three fixed strings, chosen by the test and the sign only."""
    return (
        F.when((p < alpha) & (delta > 0), "significantly better")
        .when((p < alpha) & (delta < 0), "significantly worse")
        .otherwise("no significant difference")
    )


def supported(delta: Column, p_holm: Column, ci_low: Column, ci_high: Column, alpha: float = ALPHA) -> Column:
    """A corrected significant difference whose interval excludes zero."""
    return (p_holm < alpha) & ~((ci_low <= 0) & (ci_high >= 0))


def decide_pair(delta: Column, is_supported: Column) -> Column:
    """A: better and supported, B: better only numerically, C: not better and supported, D: open."""
    return (
        F.when((delta > 0) & is_supported, "A").when(delta > 0, "B").when(is_supported, "C").otherwise("D")
    )


def decide(comparisons: DataFrame, keys: list[str], control: str, baseline: str, std: str | None = None,
           name: str = "comparison", max_std: float = 0.03) -> DataFrame:
    """Letters from two comparisons of one candidate: A beats both, B the control only, C not the control.

    ``comparisons`` holds one row per name with delta, p_holm, ci_low, ci_high (and optionally a
    seed deviation column ``std``, flagged above ``max_std``).
    """
    beats = supported(F.col("delta"), F.col("p_holm"), F.col("ci_low"), F.col("ci_high")) & (F.col("delta") > 0)
    pick = lambda n, v: F.max(F.when(F.col(name) == n, v))
    aggs = [
        pick(control, beats).alias("beats_control"), pick(baseline, beats).alias("beats_baseline"),
        pick(control, F.col("delta")).alias("delta_control"), pick(baseline, F.col("delta")).alias("delta_baseline"),
    ]
    if std:
        aggs.append((F.max(std) > max_std).alias("seed_unstable"))
    letter = (
        F.when(F.col("beats_control") & F.col("beats_baseline"), "A").when(F.col("beats_control"), "B").otherwise("C")
    )
    return comparisons.groupBy(*keys).agg(*aggs).withColumn("outcome", letter)


def acceptance_gate(fold_auc: DataFrame, base: str, stack: str, control: str, fold: str = "fold",
                    model: str = "model", value: str = "roc_auc", keys: list[str] = ()) -> DataFrame:
    """Four criteria of a stacked candidate against its base and a control, from fold metrics; one row per ``keys``.

    Better mean than the base, better than the control, a win on all folds but one, and a gain above
    one (population) deviation of the base over folds.
    """
    pick = lambda m: F.max(F.when(F.col(model) == m, F.col(value)))
    per_fold = fold_auc.groupBy(*keys, fold).agg(pick(base).alias("b"), pick(stack).alias("s"), pick(control).alias("c"))
    agg = per_fold.groupBy(*keys).agg(
        F.avg("b").alias("base_mean"), F.avg("s").alias("stack_mean"), F.avg("c").alias("control_mean"),
        F.stddev_pop("b").alias("base_std"), count_where(F.col("s") > F.col("b")).alias("folds_won"),
        F.count(F.lit(1)).alias("n_folds"),
    )
    s, b = F.col("stack_mean"), F.col("base_mean")
    out = agg.withColumns({
        "beats_base": s > b,
        "fold_consistent": F.col("folds_won") >= F.col("n_folds") - 1,
        "beats_control": s > F.col("control_mean"),
        "material_gain": s > b + F.col("base_std"),
    })
    passed = F.col("beats_base") & F.col("fold_consistent") & F.col("beats_control") & F.col("material_gain")
    return out.withColumns({"delta_base": s - b, "delta_control": s - F.col("control_mean"), "gate_passed": passed})


#: Fixed floors below which an edge counts as noise.
MIN_AUC_GAIN, MIN_PARTIAL_CORR_GAP = 0.001, 0.01


def gate_decision(passed: Column, confirmed: Column, auc_gain: Column, partial_gap: Column, stable: Column | None = None) -> Column:
    """Three outcomes: demonstrated, complementary_only (an edge above the floors), no_contribution.

    A passed gate must be confirmed on the held-out rows (null counts as not confirmed) and stable.
    """
    stable = F.lit(True) if stable is None else stable
    edge = (auc_gain > MIN_AUC_GAIN) | (partial_gap > MIN_PARTIAL_CORR_GAP)
    yes = F.coalesce(confirmed, F.lit(False))
    return (
        F.when(passed & stable & yes, "demonstrated")
        .when(passed, "no_contribution")
        .when(edge, "complementary_only")
        .otherwise("no_contribution")
    )
