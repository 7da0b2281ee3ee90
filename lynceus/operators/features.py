"""Train-fitted feature transforms and feature rankings.

``fit_*`` runs aggregates over the training rows and returns a small fitted object (its size depends
on the number of columns, never of rows). A fitted object is a list of SQL expressions: it applies as
a plain projection inside codegen and can be saved as an MLlib ``SQLTransformer`` stage.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from lynceus.functions.hashing import gaussian, hash_word
from lynceus.operators.derive import FeatureGroups
from lynceus.operators.quality import ValidationError, column_moments, profile, value_counts
from lynceus.operators.ranking import fitted_quantiles
from lynceus.plans.config import FeatureConfig


def _lit(v) -> str:
    """A value as SQL text."""
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST({float(v)!r} AS DOUBLE)"


def _name(c: str) -> str:
    return f"`{c}`"


@dataclass(frozen=True)
class Fitted:
    """Named output expressions over the input columns, plus the statistics they were built from."""

    exprs: dict[str, str]
    stats: dict = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return list(self.exprs)

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns (all inputs not replaced by default) followed by the outputs."""
        kept = [c for c in (df.columns if keep is None else keep) if c not in self.exprs]
        return df.select(*[F.col(_name(c)) for c in kept], *[F.expr(e).alias(n) for n, e in self.exprs.items()])

    def stage(self) -> SQLTransformer:
        """The same projection as an MLlib stage; inputs stay next to the outputs."""
        outs = ", ".join(f"{e} AS {_name(n)}" for n, e in self.exprs.items())
        return SQLTransformer(statement=f"SELECT *, {outs} FROM __THIS__")

    def then(self, other: "Fitted") -> "Fitted":
        """``other`` applied to this one's outputs, as one projection."""
        inline = lambda m: f"({self.exprs[m[1]]})" if m[1] in self.exprs else m[0]
        exprs = {n: re.sub(r"`([^`]+)`", inline, e) for n, e in other.exprs.items()}
        return Fitted(exprs, {**self.stats, **other.stats})


# ---- imputation ---------------------------------------------------------------------------------


def known(stats: dict, cols: list[str]) -> dict:
    """The statistics, if every column had a value to learn from."""
    missing = [c for c in cols if stats.get(c) is None]
    if missing:
        raise ValidationError(f"no value to fit on in {', '.join(missing)}")
    return stats


def fit_median(train: DataFrame, cols: list[str]) -> Fitted:
    """Exact interpolated median per column."""
    med = known({c: q["m"] for c, q in fitted_quantiles(train, cols, {"m": 0.5}).items()}, cols)
    return Fitted({c: f"coalesce(CAST({_name(c)} AS DOUBLE), {_lit(med[c])})" for c in cols}, {"impute": med})


def fit_mean(train: DataFrame, cols: list[str]) -> Fitted:
    mean = known({r["column_name"]: r["mean"] for r in column_moments(train, cols).collect()}, cols)
    return Fitted({c: f"coalesce(CAST({_name(c)} AS DOUBLE), {_lit(mean[c])})" for c in cols}, {"impute": mean})


def fit_mode(train: DataFrame, cols: list[str]) -> Fitted:
    """Most frequent value per column; a tie goes to the smallest value."""
    types = dict(train.dtypes)
    text = [c for c in cols if types[c] == "string"]
    nums = [c for c in cols if c not in text]
    modes: dict = {}
    for part, cast in ((text, "string"), (nums, "double")):
        if part:
            counts = value_counts(train, part).withColumn("value", F.col("value").cast(cast))
            best = counts.groupBy("column_name").agg(F.min(F.struct(-F.col("n"), "value"))["value"].alias("v"))
            modes.update({r["column_name"]: r["v"] for r in best.collect()})
    modes = known(modes, cols)
    cast = {c: "STRING" if c in text else "DOUBLE" for c in cols}
    return Fitted({c: f"coalesce(CAST({_name(c)} AS {cast[c]}), {_lit(modes[c])})" for c in cols}, {"impute": modes})


# ---- scaling ------------------------------------------------------------------------------------


def _affine(c: str, shift: float, scale: float) -> str:
    return f"(CAST({_name(c)} AS DOUBLE) - {_lit(shift)}) / {_lit(scale if scale else 1.0)}"


def fit_standard(train: DataFrame, cols: list[str]) -> Fitted:
    """Zero mean, unit population deviation; a constant column is only centred."""
    m = profile(train, {c: {"m": F.avg(c), "s": F.stddev_pop(c)} for c in cols}).collect()
    stats = {r["column_name"]: (r["m"], r["s"]) for r in m}
    known({c: v[0] for c, v in stats.items()}, cols)
    return Fitted({c: _affine(c, *stats[c]) for c in cols}, {"scale": stats})


def fit_minmax(train: DataFrame, cols: list[str]) -> Fitted:
    m = profile(train, {c: {"lo": F.min(c).cast("double"), "hi": F.max(c).cast("double")} for c in cols}).collect()
    stats = {r["column_name"]: (r["lo"], r["hi"] - r["lo"]) for r in m}
    return Fitted({c: _affine(c, *stats[c]) for c in cols}, {"scale": stats})


def fit_robust(train: DataFrame, cols: list[str]) -> Fitted:
    """Median and interquartile range."""
    q = fitted_quantiles(train, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    stats = {c: (q[c]["q50"], q[c]["q75"] - q[c]["q25"]) for c in cols}
    return Fitted({c: _affine(c, *stats[c]) for c in cols}, {"scale": stats})


SCALERS = {"standard": fit_standard, "minmax": fit_minmax, "robust": fit_robust}


def fit_range(train: DataFrame, cols: list[str], lo: float = 0.0, hi: float = math.pi) -> Fitted:
    """Maps the training range to [lo, hi]; unseen values beyond it are clipped."""
    m = profile(train, {c: {"mn": F.min(c).cast("double"), "mx": F.max(c).cast("double")} for c in cols}).collect()
    stats = {r["column_name"]: (r["mn"], r["mx"]) for r in m}
    exprs = {}
    for c in cols:
        mn, mx = stats[c]
        scaled = f"{_lit(lo)} + {_affine(c, mn, mx - mn)} * {_lit(hi - lo)}"
        exprs[c] = f"least({_lit(hi)}, greatest({_lit(lo)}, {scaled}))"
    return Fitted(exprs, {"range": stats})


# ---- encoding and the column-group transformer --------------------------------------------------


def fit_onehot(train: DataFrame, cols: list[str]) -> Fitted:
    """0/1 columns for every level but the smallest; an unknown level is all zeros.

    The levels become output columns, so they reach the driver: for columns with few of them. ``level_dictionary`` has no
    such bound.
    """
    types = dict(train.dtypes)
    rows = value_counts(train, cols).select("column_name", "value").collect()
    exprs, levels = {}, {}
    for c in cols:
        as_text = types[c] == "string"
        vals = sorted((r["value"] if as_text else float(r["value"])) for r in rows if r["column_name"] == c)
        levels[c] = vals
        for v in vals[1:]:
            label = v if as_text or v != int(v) else int(v)
            exprs[f"{c}_{label}"] = f"CAST(coalesce({_name(c)} = {_lit(v)}, false) AS DOUBLE)"
    return Fitted(exprs, {"levels": levels})


#: Hash buckets in which levels are numbered, a fixed number so that a level's place does not depend on the cluster.
LEVEL_BUCKETS = 1024
#: A level with more than one in this many of the rows is frequent: at most this many a column, sent to every task.
FREQUENT_SHARE = 10_000


def level_dictionary(train: DataFrame, cols: list[str], buckets: int = LEVEL_BUCKETS) -> DataFrame:
    """``(column_name, value, n, place)``: every level of each column with its place among the levels of all columns.

    Levels are numbered by (column, hash bucket, value): a bucket is numbered on its own and a small table of bucket counts
    gives its offset, so a column with one level per row never meets the driver or one task. The smallest level of a column
    has a null place; null is no level. A table without levels gives an empty dictionary.
    """
    least = profile(train, {c: {"least": F.min(c).cast("string")} for c in cols})
    order = F.create_map(*[v for i, c in enumerate(cols) for v in (F.lit(c), F.lit(i))])
    counted = value_counts(train, cols).join(F.broadcast(least), "column_name")  # one row per column
    counted = counted.withColumns({"_column": order[F.col("column_name")], "_bucket": hash_word(F.col("value")) % buckets})
    counted = counted.withColumn("_base", F.col("value") == F.col("least")).drop("least")
    sizes = counted.groupBy("_column", "_bucket").agg(F.sum((~F.col("_base")).cast("long")).alias("_size"))
    before = Window.orderBy("_column", "_bucket").rowsBetween(Window.unboundedPreceding, -1)  # columns x buckets rows
    offsets = sizes.select("_column", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_column", "_bucket").orderBy("_base", "value")) - 1
    numbered = counted.withColumn("_inside", inside).join(F.broadcast(offsets), ["_column", "_bucket"])
    place = F.when(~F.col("_base"), F.col("_offset") + F.col("_inside")).cast("long")
    return numbered.select("column_name", "value", "n", place.alias("place"))


def encode_levels(df: DataFrame, cols: list[str], dictionary: DataFrame, n_train: int, id_col: str = "id") -> DataFrame:
    """``(id, places)``: one sorted array of places per id, the ones of a 0/1 vector over the whole dictionary.

    Frequent levels are looked up in every task: there are at most ``FREQUENT_SHARE`` of them in a column, keyed by digest.
    Other levels meet their rows in a shuffle in which no key has more than that share of the training rows. Null, unknown
    and smallest levels give no place; repeated ids share one array, and so do null ids.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.md5(F.col(c).cast("string")).alias("_key")) for c in cols])
    cells = df.select(id_col, F.inline(pairs)).filter("_key is not null")
    keyed = dictionary.select("column_name", F.md5("value").alias("_key"), "n", "place")
    often = F.col("n") * FREQUENT_SHARE > n_train
    known = cells.join(F.broadcast(keyed.filter(often)), ["column_name", "_key"], "left")
    rare = keyed.filter(~often & F.col("place").isNotNull()).select("column_name", "_key", F.col("place").alias("_rare"))
    looked = known.filter("n is null").join(rare, ["column_name", "_key"]).select(id_col, F.col("_rare").alias("place"))
    every = known.filter("n is not null").select(id_col, "place").unionByName(looked)
    every = every.unionByName(df.select(id_col, F.lit(None).cast("long").alias("place")))
    return every.groupBy(id_col).agg(F.sort_array(F.collect_set("place")).alias("places"))


def fit_preprocessor(train: DataFrame, groups: FeatureGroups, cfg: FeatureConfig = FeatureConfig()) -> Fitted:
    """Impute, encode and scale by semantic group; names survive into the outputs.

    Numeric columns: median (or mean), scaled. Ordinal: mode, scaled. Binary: mode. Nominal: mode,
    one-hot. Two passes over the training rows: imputation values, then statistics of imputed rows.
    """
    numeric, ordinal = list(groups.numeric), list(groups.ordinal)
    parts: list[Fitted] = []
    if numeric:
        parts.append((fit_median if cfg.numeric_impute == "median" else fit_mean)(train, numeric))
    cats = [*ordinal, *groups.binary, *groups.nominal]
    if cats:
        parts.append(fit_mode(train, cats))
    impute = Fitted({n: e for p in parts for n, e in p.exprs.items()}, {"impute": {k: v for p in parts for k, v in p.stats["impute"].items()}})
    filled = impute.transform(train, keep=[])
    exprs: dict[str, str] = {}
    stats: dict = {}
    if numeric or ordinal:
        scale = SCALERS[cfg.scaler](filled, [*numeric, *ordinal])
        exprs.update(scale.exprs)
        stats.update(scale.stats)
    exprs.update({c: f"CAST({_name(c)} AS DOUBLE)" for c in groups.binary})
    if groups.nominal:
        onehot = fit_onehot(filled, list(groups.nominal))
        exprs.update(onehot.exprs)
        stats.update(onehot.stats)
    return impute.then(Fitted(exprs, stats))


# ---- feature scores -----------------------------------------------------------------------------


def anova_f(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    """``(feature, f_score)``: between over within mean square, from one aggregate per class."""
    x = lambda c: F.col(c).cast("double")
    agg = df.groupBy(y).agg(
        *[e.alias(f"{i}|{t}") for i, c in enumerate(cols) for t, e in (("n", F.count(c)), ("m", F.avg(x(c))), ("v", F.var_pop(x(c))))]
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"`{i}|{t}`").cast("double").alias(t) for t in ("n", "m", "v")])
        for i, c in enumerate(cols)
    ])
    long = agg.select(F.inline(rows)).filter("n > 0")
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / n
    total = long.groupBy("feature").agg(
        n.alias("N"), F.count(F.lit(1)).alias("k"), mean.alias("M"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.collect_list(F.struct("n", "m")).alias("cls"),  # one entry per class
    )
    ssb = F.aggregate("cls", F.lit(0.0), lambda acc, c: acc + c["n"] * (c["m"] - F.col("M")) * (c["m"] - F.col("M")))
    f = F.try_divide(ssb / (F.col("k") - 1), F.col("ssw") / (F.col("N") - F.col("k")))
    return total.select("feature", F.when(F.col("k") > 1, F.coalesce(f, F.lit(0.0))).otherwise(F.lit(0.0)).alias("f_score"))


def fit_quantile_bins(train: DataFrame, cols: list[str], q: int = 4) -> Fitted:
    """Right-closed bins between interpolated quantiles; repeated edges are dropped."""
    probs = {f"e{i}": i / q for i in range(q + 1)}
    edges = {c: sorted({v for v in q.values() if v is not None}) for c, q in fitted_quantiles(train, cols, probs).items()}
    exprs = {}
    for c in cols:
        inner = edges[c][1:-1]
        steps = " + ".join(f"CAST({_name(c)} > {_lit(e)} AS INT)" for e in inner) or "0"
        exprs[f"{c}_bin"] = f"CASE WHEN {_name(c)} IS NOT NULL THEN {steps} END"
    return Fitted(exprs, {"edges": edges})


def _mi(counts: DataFrame, keys: list[str], x: list[str], y: list[str], n: str = "n") -> Column:
    """Term of the plug-in mutual information of x and y; sum it per keys. Windows run over code counts."""
    total = F.sum(n).over(Window.partitionBy(*keys))
    px = F.sum(n).over(Window.partitionBy(*keys, *x))
    py = F.sum(n).over(Window.partitionBy(*keys, *y))
    c = F.col(n).cast("double")
    return c / total * F.log(c * total / (px * py))


def code_counts(binned: DataFrame, bins: list[str], y: str | None, keys: list[str]) -> DataFrame:
    """Distinct code tuples with counts: everything below works on these, not on the rows."""
    return binned.groupBy(*keys, *bins, *([y] if y else [])).agg(F.count(F.lit(1)).alias("n"))


def marginal_mi(binned: DataFrame, bins: list[str], y: str, keys: list[str] | None = None) -> DataFrame:
    """``(keys, feature, mi)``: information of each binned feature about the label, in nats."""
    keys = keys or []
    codes = code_counts(binned, bins, y, keys)
    long = F.array(*[F.struct(F.lit(b.removesuffix("_bin")).alias("feature"), F.col(b).alias("b")) for b in bins])
    counts = (
        codes.select(*keys, F.col(y).alias("_y"), "n", F.inline(long)).filter("b is not null")
        .groupBy(*keys, "feature", "b", "_y").agg(F.sum("n").alias("n"))
    )
    by = [*keys, "feature"]
    return counts.withColumn("_t", _mi(counts, by, ["b"], ["_y"])).groupBy(*by).agg(F.sum("_t").alias("mi"))


def _pair_counts(codes: DataFrame, bins: list[str], keys: list[str], extra: list[str]) -> DataFrame:
    pairs = F.array(*[
        F.struct(
            F.lit(a.removesuffix("_bin")).alias("i"), F.lit(b.removesuffix("_bin")).alias("j"),
            F.col(a).alias("bi"), F.col(b).alias("bj"),
        )
        for a, b in combinations(bins, 2)
    ])
    return (
        codes.select(*keys, *extra, "n", F.inline(pairs)).filter("bi is not null and bj is not null")
        .groupBy(*keys, "i", "j", "bi", "bj", *extra).agg(F.sum("n").alias("n"))
    )


def pair_synergy(binned: DataFrame, bins: list[str], y: str, keys: list[str] | None = None) -> DataFrame:
    """``(keys, i, j, synergy)``: label information of a pair beyond its two features alone.

    The three information terms of a pair use the same rows and come from one table of pair counts.
    """
    keys = keys or []
    codes = code_counts(binned, bins, y, keys).withColumnRenamed(y, "_y")
    counts = _pair_counts(codes, bins, keys, ["_y"])
    by = [*keys, "i", "j"]
    joint = counts.withColumn("_t", _mi(counts, by, ["bi", "bj"], ["_y"])).groupBy(*by).agg(F.sum("_t").alias("joint"))

    def single(b: str, out: str) -> DataFrame:
        c = counts.groupBy(*by, b, "_y").agg(F.sum("n").alias("n"))
        return c.withColumn("_t", _mi(c, by, [b], ["_y"])).groupBy(*by).agg(F.sum("_t").alias(out))

    return joint.join(single("bi", "mi_i"), by).join(single("bj", "mi_j"), by).select(
        *by, (F.col("joint") - F.col("mi_i") - F.col("mi_j")).alias("synergy")
    )


def pairwise_mi(binned: DataFrame, bins: list[str], keys: list[str] | None = None) -> DataFrame:
    """Symmetric ``(keys, i, j, mi)`` between features, both orders listed."""
    keys = keys or []
    counts = _pair_counts(code_counts(binned, bins, None, keys), bins, keys, [])
    by = [*keys, "i", "j"]
    half = counts.withColumn("_t", _mi(counts, by, ["bi"], ["bj"])).groupBy(*by).agg(F.sum("_t").alias("mi"))
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return half.select(*keys, "mi", F.inline(both)).select(*by, "mi")


def top_pairs(scores: DataFrame, score: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """Best n unordered pairs (per keys): score descending, then i, j. Scores are rounded so ties are ties."""
    once = scores.groupBy(*(keys or []), F.least("i", "j").alias("_p"), F.greatest("i", "j").alias("_q")).agg(
        F.round(F.max(score), 9).alias(score), F.min(F.struct("i", "j")).alias("_ij")
    )
    rounded = once.select(*(keys or []), "_ij.i", "_ij.j", score)
    order = [F.desc(score), "i", "j"]
    if not keys:
        return rounded.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)  # one row per pair of features
    return rounded.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def pair_frequency(selections: DataFrame) -> DataFrame:
    return selections.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n_selected"))


def select_k(scores: DataFrame, score: str, k: int) -> list[str]:
    """The k best features, clipped to how many there are; ties by name."""
    rows = scores.orderBy(F.desc(F.round(score, 9)), "feature").limit(k).collect()
    return [r["feature"] for r in rows]


def select_k_f(train: DataFrame, cols: list[str], y: str, k: int) -> list[str]:
    return select_k(anova_f(train, cols, y), "f_score", k)


def select_k_mi(train: DataFrame, cols: list[str], y: str, k: int, bins: int = 4) -> list[str]:
    fitted = fit_quantile_bins(train, cols, bins)
    return select_k(marginal_mi(fitted.transform(train, keep=[y]), fitted.names, y), "mi", k)


#: Fixed weights of the composite ranking: mutual information, ANOVA F, forest importance.
RANK_WEIGHTS = (0.4, 0.3, 0.3)


def composite_ranking(mi: DataFrame, f: DataFrame, forest: DataFrame) -> DataFrame:
    """Weighted sum of the three scores, each divided by its maximum, with ranks."""
    j = mi.join(f, "feature").join(forest, "feature")
    all_rows = Window.partitionBy(F.lit(0))  # one row per feature
    unit = lambda c: F.col(c) / (F.max(c).over(all_rows) + 1e-9)
    w = RANK_WEIGHTS
    score = unit("mi") * w[0] + unit("f_score") * w[1] + unit("rf_importance") * w[2]
    scored = j.withColumn("composite", F.round(score, 9))
    return scored.withColumn("rank", F.row_number().over(all_rows.orderBy(F.desc("composite"), "feature")))


def rank_features(df: DataFrame, cols: list[str], y: str, bins: int = 4, trees: int = 50, depth: int = 5, seed: int = 42) -> DataFrame:
    """Composite ranking of numeric features against a label; the id column must not be among them."""
    from pyspark.ml.classification import RandomForestClassifier

    filled = fit_median(df, cols).transform(df.select(*cols, y))
    fitted = fit_quantile_bins(filled, cols, bins)
    mi = marginal_mi(fitted.transform(filled, keep=[y]), fitted.names, y)
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(filled)
    forest = RandomForestClassifier(labelCol=y, numTrees=trees, maxDepth=depth, seed=seed).fit(vec)
    imp = forest.featureImportances.toArray()
    rows = df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, imp)], "feature string, rf_importance double")
    return composite_ranking(mi, anova_f(filled, cols, y), rows)


def proxy_target(df: DataFrame) -> Column:
    """Stand-in label where none is given: raised pressure or a raised level (fixed rule)."""
    return ((F.col("ap_hi") > 130) | (F.col("cholesterol") > 1)).cast("int")


# ---- projections --------------------------------------------------------------------------------


def _linear(cols: list[str], weights, bias: float = 0.0) -> str:
    terms = [f"{_lit(w)} * CAST({_name(c)} AS DOUBLE)" for c, w in zip(cols, weights)]
    return " + ".join([*terms, _lit(bias)])


def covariance(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(i, j, cov)`` sample covariances of complete pairs, one aggregate."""
    pairs = [(a, b) for k, a in enumerate(cols) for b in cols[k:]]
    agg = df.agg(*[F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs)])
    return agg.select(F.inline(rows))


def fit_pca(train: DataFrame, cols: list[str], n: int) -> Fitted:
    """Leading principal components of centred columns; the largest loading of each is positive."""
    n = min(n, len(cols))
    moments = {r["column_name"]: r for r in profile(train, {c: {"n": F.count(c), "rows": F.count(F.lit(1)), "mean": F.avg(F.col(_name(c)).cast("double"))} for c in cols}).collect()}
    holes = [c for c in cols if moments[c]["n"] < max(2, moments[c]["rows"])]
    if holes:
        raise ValidationError(f"components need two rows or more and no null in {', '.join(holes)}")
    means = {c: moments[c]["mean"] for c in cols}
    # centred first: the products of far-off values would lose their digits
    centred = train.select(*[(F.col(_name(c)).cast("double") - F.lit(means[c])).alias(c) for c in cols])
    at, cov = {c: i for i, c in enumerate(cols)}, np.zeros((len(cols), len(cols)))
    for r in covariance(centred, cols).collect():
        cov[at[r["i"]], at[r["j"]]] = cov[at[r["j"]], at[r["i"]]] = r["cov"]
    values, vectors = np.linalg.eigh(cov)
    values, load = np.maximum(values[::-1], 0.0), vectors[:, ::-1][:, :n]
    load = load * np.where(load[np.abs(load).argmax(axis=0), range(n)] < 0, -1.0, 1.0)
    mu = np.array([means[c] for c in cols])
    exprs = {f"pc{k + 1}": _linear(cols, load[:, k], float(-(mu @ load[:, k]))) for k in range(n)}
    return Fitted(exprs, {"loadings": load.tolist(), "columns": list(cols), "explained": (values / values.sum())[:n].tolist()})


def loading_map(spark, pca: Fitted, top: int = 3) -> DataFrame:
    """The source columns with the largest absolute loading per component."""
    load = pca.stats["loadings"]
    rows = [
        (f"pc{k + 1}", c, float(load[i][k])) for k in range(len(load[0])) for i, c in enumerate(pca.stats["columns"])
    ]
    df = spark.createDataFrame(rows, "component string, feature string, loading double")
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def rff(cols: list[str], k: int, seed: int, gamma: float | None = None, phi: list[float] | None = None) -> Fitted:
    """Random Fourier features cos(xW + b + phi): W normal (variance 2 gamma if given), b uniform.

    W and b are small and drawn once from the seed; the features are expressions, not a UDF.
    """
    rng = np.random.RandomState(seed)
    w = rng.normal(size=(len(cols), k)) * (math.sqrt(2 * gamma) if gamma else 1.0)
    b = rng.uniform(0, 2 * math.pi, size=k)
    shift = np.zeros(k) if phi is None else np.asarray(phi)
    exprs = {f"rff{j + 1}": f"cos({_linear(cols, w[:, j], float(b[j] + shift[j]))})" for j in range(k)}
    return Fitted(exprs, {"w": w.tolist(), "b": b.tolist()})


def random_projection(cols: list[str], k: int, seed: int) -> Fitted:
    """Fixed linear projection xW: the untrained control."""
    w = np.random.RandomState(seed).normal(size=(len(cols), k))
    return Fitted({f"proj{j + 1}": _linear(cols, w[:, j]) for j in range(k)}, {"w": w.tolist()})


def noise_features(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """k standard normal columns per row, drawn from (seed, column, id): same row, same noise."""
    return df.withColumns({f"noise{j + 1}": gaussian(F.lit(seed), F.lit(j), F.col(id_col)) for j in range(k)})


# ---- end to end ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class FittedFeatures:
    """Everything learned from the training rows: prepared and selected columns, reduced columns."""

    prepared: Fitted
    selected: list[str]
    reduced: Fitted
    explained: list[float]

    def classical(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return self.prepared.transform(df, keep=keep).select(*keep, *self.selected)

    def compact(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Selected columns reduced and mapped into the output range."""
        return self.reduced.transform(self.classical(df, keep), keep=keep)

    def model(self, space: str = "classical") -> PipelineModel:
        """Savable MLlib stages ending in a ``features`` vector."""
        chosen = Fitted({f"f_{n}": self.prepared.exprs[n] for n in self.selected})
        stages = [chosen.stage()]
        names = chosen.names
        if space == "compact":
            base = Fitted({n: self.prepared.exprs[n] for n in self.selected})
            both = base.then(self.reduced)
            stages, names = [Fitted({f"f_{n}": e for n, e in both.exprs.items()}).stage()], [f"f_{n}" for n in both.exprs]
        return PipelineModel([*stages, VectorAssembler(inputCols=names, outputCol="features")])


def fit_features(train: DataFrame, groups: FeatureGroups, y: str, cfg: FeatureConfig = FeatureConfig()) -> FittedFeatures:
    """Impute, encode, scale, select, reduce and range-map: fitted on ``train`` and nothing else.

    The training rows feed several aggregates; their feature columns are kept in memory or on disk meanwhile.
    """
    raw = train.select(*groups.all, y).persist()
    prepared = fit_preprocessor(raw, groups, cfg)
    ready = prepared.transform(raw, keep=[y]).persist()
    try:
        k = min(cfg.k_best, len(prepared.names))
        pick = select_k_mi(ready, prepared.names, y, k, cfg.mi_bins) if cfg.selector == "mutual_info" else select_k_f(ready, prepared.names, y, k)
        selected = [n for n in prepared.names if n in set(pick)]
        pca = fit_pca(ready, selected, min(cfg.n_components, len(selected)))
        ranged = fit_range(pca.transform(ready, keep=[]), pca.names, *cfg.out_range)
        return FittedFeatures(prepared, selected, pca.then(ranged), pca.stats["explained"])
    finally:
        ready.unpersist()
        raw.unpersist()
