"""Metrics of scored tables ``scores(id, y, model, proba, ...)``.

Every operator takes grouping keys, so all models, stages and folds go through one job. Anything that
needs the score order works on distinct scores with running counts (see ``ranking.running_sums``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lynceus.functions import scalar as sc
from lynceus.functions.stats import t_quantile_975
from lynceus.operators.quality import count_where
from lynceus.operators.ranking import running_sums

LABEL_METRICS = ("accuracy", "precision", "sensitivity", "specificity", "f1")
RANK_METRICS = ("roc_auc", "pr_auc")


def ratio0(a: Column, b: Column) -> Column:
    """a / b, 0 where undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def label_ratios(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    precision, sensitivity = ratio0(tp, tp + fp), ratio0(tp, tp + fn)
    return {
        "accuracy": ratio0(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "sensitivity": sensitivity,
        "specificity": ratio0(tn, tn + fp),
        "f1": ratio0(2.0 * precision * sensitivity, precision + sensitivity),
    }


def confusion(scores: DataFrame, keys: list[str], threshold: float = 0.5, y: str = "y", p: str = "proba") -> DataFrame:
    pos, pred = F.col(y) == 1, F.col(p) >= threshold
    return scores.groupBy(*keys).agg(
        count_where(pos & pred).alias("tp"), count_where(~pos & pred).alias("fp"),
        count_where(~pos & ~pred).alias("tn"), count_where(pos & ~pred).alias("fn"),
    )


def label_metrics(scores: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Confusion counts and the metrics at one threshold (>=); undefined ratios are 0."""
    c = confusion(scores, keys, threshold)
    return c.withColumns(label_ratios(*(F.col(x) for x in ("tp", "fp", "tn", "fn"))))


def label_metrics_ext(scores: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Negative predictive value, balanced accuracy and Matthews correlation."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return confusion(scores, keys, threshold).select(
        *keys,
        ratio0(tn, tn + fn).alias("npv"),
        ((ratio0(tp, tp + fn) + ratio0(tn, tn + fp)) / 2.0).alias("balanced_accuracy"),
        ratio0(tp * tn - fp * fn, root).alias("mcc"),
    )


def brier(scores: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.col("proba") - F.col("y")
    return scores.groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def score_points(scores: DataFrame, keys: list[str], p: str = "proba", weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    return scores.groupBy(*keys, p).agg(
        F.sum(F.col("y") * w).cast("long").alias("pos"), F.sum((1 - F.col("y")) * w).cast("long").alias("neg")
    )


def running_points(scores: DataFrame, keys: list[str], p: str = "proba") -> DataFrame:
    return running_sums(score_points(scores, keys, p), keys, p, ["pos", "neg"])


def rank_aggregates() -> dict[str, Column]:
    """ROC-AUC (ties one half) and average precision from running counts, as aggregates."""
    pos, neg = F.col("pos"), F.col("neg")
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    area = F.sum(pos * (F.col("neg_before") + neg / 2.0))
    return {
        "roc_auc": F.try_divide(area, (F.max("pos_total") * F.max("neg_total")).cast("double")),
        "pr_auc": F.try_divide(F.sum(pos * (tp / (tp + fp))), F.max("pos_total").cast("double")),
    }


def ranking_metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Exact ROC-AUC and average precision of every group in one ordered pass."""
    return running_points(scores, keys).groupBy(*keys).agg(*[c.alias(m) for m, c in rank_aggregates().items()])


def roc_auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    return ranking_metrics(scores, keys).select(*keys, "roc_auc")


def average_precision(scores: DataFrame, keys: list[str]) -> DataFrame:
    return ranking_metrics(scores, keys).select(*keys, "pr_auc")


def all_metrics(scores: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """The full metric suite per group: counts, label metrics, ROC-AUC, average precision, Brier.

    All of them are sums over distinct scores, so the rows are read for one ordered pass only.
    """
    hit, p = F.col("proba") >= threshold, F.col("proba")
    over = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    gap = F.col("pos") * (p - 1) * (p - 1) + F.col("neg") * p * p
    agg = running_points(scores, keys).groupBy(*keys).agg(
        over("pos", hit).alias("tp"), over("neg", hit).alias("fp"), over("neg", ~hit).alias("tn"), over("pos", ~hit).alias("fn"),
        *[c.alias(m) for m, c in rank_aggregates().items()],
        (F.sum(gap) / F.sum(F.col("pos") + F.col("neg"))).alias("brier"),
    )
    return agg.withColumns(label_ratios(*(F.col(x) for x in ("tp", "fp", "tn", "fn"))))


def metrics_long(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    return metrics.select(*keys, F.inline(pairs))


def _end_point(scores: DataFrame, keys: list[str], **values: float) -> DataFrame:
    """The point of every group that no threshold reaches."""
    groups = scores.select(*keys).distinct() if keys else scores.select().limit(1)
    return groups.select(*keys, F.lit(None).cast("double").alias("threshold"), *[F.lit(v).alias(k) for k, v in values.items()])


def roc_curve(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One point per distinct threshold, and (0, 0) with a null threshold: no score is that high."""
    pts = running_points(scores, keys)
    curve = pts.select(
        *keys, F.col("proba").alias("threshold"),
        F.try_divide(F.col("neg_total") - F.col("neg_before"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("pos_total") - F.col("pos_before"), F.col("pos_total")).alias("tpr"),
    )
    return curve.unionByName(_end_point(scores, keys, fpr=0.0, tpr=0.0))


def pr_curve(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One point per distinct threshold, and (recall 0, precision 1) with a null threshold."""
    pts = running_points(scores, keys)
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    curve = pts.select(
        *keys, F.col("proba").alias("threshold"), (tp / (tp + fp)).alias("precision"),
        F.try_divide(tp, F.col("pos_total")).alias("recall"),
    )
    return curve.unionByName(_end_point(scores, keys, precision=1.0, recall=0.0))


def calibration_width(scores: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """Equal-width bins, left-closed; a score of 1 falls in the last bin."""
    b = F.least(F.floor(F.col("proba") * n_bins), F.lit(n_bins - 1)).cast("int")
    return scores.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("proba").alias("mean_predicted"), F.avg(F.col("y").cast("double")).alias("fraction_positive")
    )


def quantile_bin(before: Column, total: Column, n_bins: int) -> Column:
    """Quantile bin of a value from its rank alone: the number of interior edges below it.

    The edge of quantile q lies between the values at ranks floor and ceil of q(n-1), and reaches the
    upper one only if both are equal. A value is above the edge exactly when its first rank exceeds
    floor(q(n-1)), so no edge has to be looked up.
    """
    out = F.lit(0)
    for i in range(1, n_bins):
        out = out + (before > F.floor(F.lit(i / n_bins) * (total - 1))).cast("int")
    return out


def calibration_quantile(scores: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """Quantile bins over each group's scores; empty bins do not appear."""
    pts = score_points(scores, keys).withColumn("cnt", F.col("pos") + F.col("neg"))
    run = running_sums(pts, keys, "proba", ["cnt"])
    binned = run.withColumn("bin", quantile_bin(F.col("cnt_before"), F.col("cnt_total"), n_bins))
    n = F.sum("cnt")
    return binned.groupBy(*keys, "bin").agg(
        n.alias("n"), (F.sum(F.col("proba") * F.col("cnt")) / n).alias("mean_predicted"),
        (F.sum("pos") / n).alias("fraction_positive"),
    )


def cv_summary(fold_metrics: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation and 95 % t interval over folds."""
    agg = fold_metrics.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n_folds")
    )
    half = F.when(
        (F.col("n_folds") > 1) & (F.col("std") > 0),
        t_quantile_975(F.col("n_folds") - 1) * F.col("std") / F.sqrt(F.col("n_folds").cast("double")),
    ).otherwise(F.lit(0.0))
    return agg.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def leaderboard(metrics_long_df: DataFrame, names: list[str], model: str = "model", order: str = "roc_auc") -> DataFrame:
    """One row per model, one column per metric, 4 decimals, ranked by ``order``."""
    wide = metrics_long_df.groupBy(model).pivot("metric", names).agg(F.first("value"))
    top = Window.partitionBy(F.lit(0)).orderBy(F.desc(order), model)  # one row per model
    return wide.select(
        F.row_number().over(top).alias("rank"), model, *[F.round(n, 4).alias(n) for n in names]
    )


def gap_analysis(auc: DataFrame, stage: str, ref: str, model: str = "model", value: str = "roc_auc") -> DataFrame:
    """Per stage: the best model other than ``ref``, its lead over ``ref`` and how the lead shrinks."""
    rival = F.col(model) != ref
    per = auc.groupBy(stage).agg(
        F.max(F.when(~rival, F.col(value))).alias("ref_auc"),
        F.max_by(F.when(rival, F.col(model)), F.when(rival, F.struct(F.col(value), F.col(model)))).alias("best_model"),
        F.max(F.when(rival, F.col(value))).alias("best_auc"),
    )
    gap = per.withColumn("gap", F.col("best_auc") - F.col("ref_auc"))
    prev = F.lag("gap").over(Window.partitionBy(F.lit(0)).orderBy(stage))  # one row per stage
    return gap.withColumn("gap_reduction_pct", F.try_divide(100.0 * (prev - F.col("gap")), prev))


def scale_comparison(small: DataFrame, full: DataFrame, model: str, names: list[str]) -> DataFrame:
    """Metrics of the same models at two scales side by side, with differences."""
    a = small.select(model, *[F.col(n).alias(f"small_{n}") for n in names])
    b = full.select(model, *[F.col(n).alias(f"full_{n}") for n in names])
    return a.join(b, model).withColumns({f"delta_{n}": F.col(f"full_{n}") - F.col(f"small_{n}") for n in names})


def confidence_by_outcome(scores: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    tagged = scores.withColumn("outcome", sc.outcome_class(F.col("y"), F.col("proba"), threshold))
    return tagged.groupBy(*keys, "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.avg("proba").alias("mean_proba"), F.stddev_pop("proba").alias("std_proba")
    )


def error_profile(scores: DataFrame, features: DataFrame, id_col: str, cols: list[str], threshold: float = 0.5) -> DataFrame:
    """Mean features per outcome class; scores without features keep their row."""
    tagged = scores.select(id_col, sc.outcome_class(F.col("y"), F.col("proba"), threshold).alias("outcome"))
    return tagged.join(features.select(id_col, *cols), id_col, "left").groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in cols]
    )


def threshold_zones(scores: DataFrame, keys: list[str], near: float = 0.1, far: float = 0.3, t: float = 0.5) -> DataFrame:
    """Error rate close to the threshold and far from it."""
    wrong = ((F.col("proba") >= t).cast("int") != F.col("y")).cast("double")
    is_near, is_far = F.abs(F.col("proba") - t) < near, F.abs(F.col("proba") - t) >= far
    return scores.groupBy(*keys).agg(
        count_where(is_near).alias("near_n"), F.avg(F.when(is_near, wrong)).alias("near_error_rate"),
        count_where(is_far).alias("far_n"), F.avg(F.when(is_far, wrong)).alias("far_error_rate"),
    )


def direction_summary(deltas: DataFrame, value: str = "delta", p: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Centre, spread and sign counts of a difference over repeated runs; one row per run is few rows."""
    d = F.col(value)
    aggs = [
        F.avg(d).alias("mean"), F.percentile(d, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std"),
        F.min(d).alias("min"), F.max(d).alias("max"), count_where(d > 0).alias("n_better"), count_where(d < 0).alias("n_worse"),
        F.count(d).alias("n_runs"),
    ]
    if p:
        aggs.append(count_where(F.col(p) < alpha).alias("n_significant"))
    return deltas.agg(*aggs)


def threshold_sweep(scores: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """Measured sensitivity and specificity at every threshold of a grid, and the triage mode.

    A row is counted once, under the number of thresholds it reaches; running sums over that small
    table answer every threshold.
    """
    grid = sorted(grid)
    idx = F.lit(0)
    for t in grid:
        idx = idx + (F.col("proba") >= t).cast("int")
    counts = scores.groupBy(*keys, idx.alias("_i")).agg(
        F.sum("y").cast("long").alias("_p"), F.sum(1 - F.col("y")).cast("long").alias("_n")
    )
    rows = F.array(*[F.struct(F.lit(i + 1).alias("_t"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    reach = counts.select("*", F.inline(rows))  # at most (grid + 1) * grid rows per group
    hit = F.col("_i") >= F.col("_t")
    agg = reach.groupBy(*keys, "threshold").agg(
        F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("_n")).otherwise(0)).alias("fp"),
        F.sum("_p").alias("_pt"), F.sum("_n").alias("_nt"),
    )
    mode = F.when(F.col("threshold") < 0.40, "high_sensitivity").when(F.col("threshold") > 0.60, "high_specificity").otherwise("balanced")
    return agg.select(
        *keys, "threshold", F.try_divide("tp", "_pt").alias("sensitivity"),
        (1 - F.try_divide("fp", "_nt")).alias("specificity"), mode.alias("triage_mode"),
    )


def sensitivity_threshold(train: DataFrame, keys: list[str], target: float = 0.90) -> DataFrame:
    """Thresholds of the training rows that reach the target sensitivity: the smallest and the largest.

    Sensitivity falls with the threshold, so the smallest always reaches the target; the largest is
    the one that gives up least specificity. Apply it unchanged to held-out rows.
    """
    pts = running_points(train, keys)
    ok = (F.col("pos_total") - F.col("pos_before")) >= F.lit(target) * F.col("pos_total")
    return pts.groupBy(*keys).agg(
        F.min(F.when(ok, F.col("proba"))).alias("smallest_threshold"), F.max(F.when(ok, F.col("proba"))).alias("largest_threshold")
    )


def gen_gap(metrics: DataFrame, keys: list[str], value: str = "roc_auc", split: str = "split", limit: float = 0.10) -> DataFrame:
    """Train minus test, flagged above the limit."""
    pick = lambda s: F.max(F.when(F.col(split) == s, F.col(value)))
    wide = metrics.groupBy(*keys).agg(pick("train").alias("train"), pick("test").alias("test"))
    return wide.withColumn("gap", F.col("train") - F.col("test")).withColumn("overfit", F.col("gap") > limit)


def deviation(paired: DataFrame, row: str, col: str, ideal: str, measured: str) -> DataFrame:
    """Mean and max absolute deviation and RMSE: overall, per column and per row, in one job."""
    d = F.col(measured) - F.col(ideal)
    out = paired.groupingSets([[row], [col], []], row, col).agg(
        F.when(F.grouping(row) == 0, "row").when(F.grouping(col) == 0, "column").otherwise("all").alias("level"),
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mean_abs"), F.max(F.abs(d)).alias("max_abs"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
    )
    return out.select("level", F.coalesce(F.col(row).cast("long"), F.col(col).cast("long")).alias("item"), "n", "mean_abs", "max_abs", "rmse")


def bit_expectations(df: DataFrame, counts: str, n_bits: int) -> DataFrame:
    """Signed expectation per bit from a map bitstring -> count; the rightmost character is bit 0."""
    entries = F.map_entries(counts)
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda acc, e: acc + e["value"])

    def signed(i: int) -> Column:
        bit = lambda e: F.substring(F.substring(F.replace(e["key"], F.lit(" "), F.lit("")), -n_bits, n_bits), n_bits - i, 1)
        s = F.aggregate(entries, F.lit(0).cast("long"), lambda acc, e: acc + F.when(bit(e) == "0", e["value"]).otherwise(-e["value"]))
        return F.try_divide(s, total)

    return df.withColumns({f"z{i}": signed(i) for i in range(n_bits)})


def ranking_change(metrics: DataFrame, scale: str, model: str = "model", value: str = "roc_auc") -> DataFrame:
    """Rank of every model within its scale and whether the winner differs between scales."""
    w = Window.partitionBy(scale).orderBy(F.desc(value), model)  # one row per model and scale
    ranked = metrics.withColumn("rank", F.row_number().over(w))
    winners = ranked.filter("rank = 1").agg((F.count_distinct(model) > 1).alias("c")).scalar()
    return ranked.withColumn("winner_changed", winners)
