"""Training, tuning, stacking and scoring with MLlib.

A learner is anything with ``fit(df) -> transformer``: an MLlib estimator or pipeline. Folds and seeds
are columns made by the sampling operators, so a row belongs to the same fold whatever the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lynceus.functions import scalar as sc
from lynceus.functions.hashing import gaussian, hash_word, uniform
from lynceus.operators import evaluate as ev, features as ft, forests as fs, margins as mg
from lynceus.operators.boosting import Boosted, CELLS_FROM, find_thresholds, plain_columns, saved_model
from lynceus.operators.derive import FeatureGroups
from lynceus.operators.newton import Problem, Solution, fit_many, mean_scores, score_many
from lynceus.operators.ranking import hash_rank
from lynceus.operators.sampling import assign_folds, nested_samples
from lynceus.plans.config import FeatureConfig
from lynceus.session import stored

#: Fixed search grids.
LOGREG_GRID = {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]}
FOREST_GRID = {"trees": [100, 300], "depth": [3, 5, None], "min_split": [2, 5], "subset": ["sqrt", "log2"]}
BOOSTED_GRID = {"trees": [100, 300], "depth": [2, 3, 4], "rate": [0.05, 0.1], "rows": [0.8, 1.0], "columns": [0.8, 1.0]}
SVM_GRID = {"C": [0.1, 1.0, 10.0, 100.0], "gamma": ["scale", 0.01, 0.1, 1.0]}
#: Fixed penalties of the similarity-kernel classifier.
KERNEL_GRID = {"C": [0.01, 0.1, 1.0, 10.0, 100.0]}
#: Fixed boosted configuration where a search is not repeated.
BOOSTED_FROZEN = {"trees": 300, "depth": 4, "rate": 0.05, "rows": 0.8, "columns": 1.0}
#: Deepest tree MLlib grows; stands for an unlimited depth.
DEEPEST = 30


def grid_points(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


# ---- learners -----------------------------------------------------------------------------------


class FeaturePrep(Estimator):
    """Fits the whole feature preparation on the rows it is given; yields MLlib stages."""

    def __init__(self, groups: FeatureGroups, y: str = "y", cfg: FeatureConfig = FeatureConfig(), space: str = "classical"):
        super().__init__()
        self.groups, self.y, self.cfg, self.space = groups, y, cfg, space

    def _fit(self, df: DataFrame) -> Transformer:
        return ft.fit_features(df, self.groups, self.y, self.cfg).model(self.space)


class LogReg(Estimator):
    """L2 logistic regression; C is the inverse penalty summed over the rows of the fit, so regParam = 1 / (C n).

    n is counted in every fit: a fold, a sample or a site gets the penalty of its own rows.
    """

    def __init__(self, C: float = 1.0, y: str = "y", weight: str | None = None):
        super().__init__()
        self.C, self.y, self.weight = C, y, weight

    def _fit(self, df: DataFrame) -> Transformer:
        lr = LogisticRegression(labelCol=self.y, regParam=1.0 / (self.C * df.count()), standardization=False, maxIter=100)
        return (lr.setWeightCol(self.weight) if self.weight else lr).fit(df)


def logreg(C: float = 1.0, y: str = "y", weight: str | None = None) -> LogReg:
    return LogReg(C, y, weight)


#: Most rows of a forest's training table in one task, on average: MLlib keeps a draw count per row and tree, so 300 trees
#: make a row about 1.3 kB.
FOREST_ROWS = 200_000


class Forest(RandomForestClassifier):
    """MLlib's forest; from ``cells_from`` rows with labels 0 and 1 on it is grown over cells. The model is MLlib's own class.

    What is left to MLlib (smaller tables, deep trees, weights, categorical columns, other labels) runs over partitions of
    bounded size; a table whose partitions are small enough stays as it lies.
    """

    cells_from = CELLS_FROM

    def _over_cells(self, dataset: DataFrame, n: int) -> bool:
        y = F.col(self.getLabelCol())
        if n < max(self.cells_from, 1) or not plain_columns(self, dataset) or self.getMaxDepth() > fs.DEEPEST:
            return False
        if self.getSubsamplingRate() != 1.0 or self.getImpurity() != "gini" or fs.subset_size(self.getFeatureSubsetStrategy(), 2) is None:
            return False
        neg, pos = dataset.select(F.count_if(y == 0), F.count_if(y == 1)).first()
        return neg + pos == n and neg > 0 and pos > 0

    def _fit(self, dataset: DataFrame):
        n = dataset.count()
        if self._over_cells(dataset, n):
            thresholds = find_thresholds(dataset.select(F.col(self.getFeaturesCol()).alias("features")), n, self.getMaxBins(), self.getSeed())
            rows = dataset.select(F.col(self.getLabelCol()).cast("double").alias("y"), vector_to_array(self.getFeaturesCol()).alias("features"))
            if thresholds:
                blocks = fs.cell_blocks(rows, thresholds)
                found = fs.grow_forest(
                    blocks, [len(t) + 1 for t in thresholds], self.getNumTrees(), self.getMaxDepth(), fs.subset_size(self.getFeatureSubsetStrategy(), len(thresholds)),
                    self.getSeed(), self.getBootstrap() and self.getNumTrees() > 1, self.getMinInstancesPerNode(), self.getMinInfoGain())
                path = saved_model(dataset.sparkSession, self, [(1.0, t) for t in found], thresholds, "RandomForestClassificationModel",
                                   "classification.DecisionTreeClassificationModel", numClasses=2)
                return self._copyValues(RandomForestClassificationModel.load(path))
        parts = math.ceil(n / FOREST_ROWS)
        return super()._fit(dataset.repartition(parts) if parts > dataset.rdd.getNumPartitions() else dataset)


def forest(trees: int = 100, depth: int | None = 5, min_split: int = 2, subset: str = "sqrt", y: str = "y", seed: int = 42):
    """A node splits from ``min_split`` rows; MLlib bounds the children, so each gets half of that."""
    return Forest(
        labelCol=y, numTrees=trees, maxDepth=DEEPEST if depth is None else depth, minInstancesPerNode=max(1, min_split // 2),
        featureSubsetStrategy=subset, seed=seed,
    )


def boosted(trees: int = 100, depth: int = 3, rate: float = 0.1, rows: float = 1.0, columns: float = 1.0, y: str = "y", seed: int = 42):
    return Boosted(
        labelCol=y, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=rows,
        featureSubsetStrategy="all" if columns >= 1 else str(columns), seed=seed,
    )


def scale_gamma(prepared: DataFrame) -> list[float]:
    """1 / (d * variance over all cells of the matrix) of every ``fit`` in order; ``features`` are arrays."""
    cells = prepared.select("fit", F.size("features").alias("d"), F.explode("features").alias("x"))
    rows = cells.groupBy("fit").agg(F.max("d").alias("d"), F.var_pop("x").alias("v")).orderBy("fit").collect()  # one row per fit
    return [1.0 / (r["d"] * r["v"]) if r["v"] else 1.0 for r in rows]


def _listed(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


class RbfSvm:
    """Gaussian-kernel classifier, linear in rows: random waves of the prepared columns under a squared-hinge machine.

    ``C`` and ``gamma`` may be lists: all their points are cross-validated over ``k`` folds in the same scans, the best mean
    ROC-AUC is refitted, and probabilities are its out-of-fold margins' calibrated sigmoid. Waves live for one batch.
    """

    def __init__(self, groups: FeatureGroups, C: float | list[float] = 1.0, gamma: float | str | list = "scale", width: int = 64, y: str = "y",
                 cfg: FeatureConfig = FeatureConfig(), seed: int = 42, k: int = 5, id_col: str = "id"):
        self.Cs, self.gammas, self.prep = _listed(C), _listed(gamma), FeaturePrep(groups, y, cfg)
        self.width, self.y, self.seed, self.k, self.id_col = width, y, seed, k, id_col

    def _waves(self, train: DataFrame, d: int) -> list[list[mg.Waves]]:
        scale = scale_gamma(train) if "scale" in self.gammas else []
        n_fits = train.select(F.max("fit")).first()[0] + 1
        gamma = lambda g, i: scale[i] if g == "scale" else g
        return [[mg.Waves.draw(d, self.width, gamma(g, i), self.seed) for i in range(n_fits)] for g in self.gammas]

    def search(self, folded: DataFrame, fold: str = "fold") -> mg.MarginSearch:
        """All points on rows that already have a fold; the preparation is fitted anew without each fold."""
        rows = prepared_folds([stored(folded)], self.prep, self.k, fold, self.id_col, self.y)
        rows = stored(rows.withColumnsRenamed({self.id_col: "id", fold: "fold"}))
        d = rows.select(F.size("features")).first()[0]
        maps = self._waves(rows.filter("fit <> fold").select("fit", "features"), d)
        return mg.margin_search(rows, maps, [{"gamma": g} for g in self.gammas], self.Cs, self.k)

    def fit(self, df: DataFrame) -> mg.KernelMachine:
        df = stored(df)
        found = self.search(assign_folds(df, self.id_col, self.y, self.k, self.seed))
        stage = self.prep.fit(df)
        rows = stored(stage.transform(df).select(F.lit(0).alias("fit"), F.col(self.y).alias("y"), vector_to_array("features").alias("features")))
        best = found.points[found.best]
        waves = self._waves(rows, rows.select(F.size("features")).first()[0])[self.gammas.index(best["gamma"])][0]
        return mg.fit_machine(rows, waves, best["C"], found.calibration.final, stage)


class LandmarkClassifier:
    """Similarity-kernel classifier: whitened kernel columns of m landmarks under a squared-hinge machine.

    Landmarks are drawn by leverage from the rows of the fit, anew for every fold. They travel with every task, so m is
    chosen to fit one. ``C`` may be a list, searched and calibrated as in ``RbfSvm``. Rows need ``id``, ``vec`` and a label;
    a null or ragged vector stops the job.
    """

    def __init__(self, m: int = 64, C: float | list[float] = 1.0, y: str = "y", seed: int = 42, k: int = 5):
        self.m, self.Cs, self.y, self.seed, self.k = m, _listed(C), y, seed, k

    def search(self, folded: DataFrame, fold: str = "fold") -> mg.MarginSearch:
        data = stored(folded.select("id", F.col(self.y).alias("y"), F.col(fold).alias("fold"), F.col("vec").alias("features")))
        maps = [mg.Nystrom.of(mg.leverage_landmarks(data.filter(F.col("fold") != i), self.m, self.seed, vec="features")) for i in range(self.k)]
        rows = data.withColumn("fit", F.explode(F.array(*[F.lit(i) for i in range(self.k)])))
        return mg.margin_search(rows, [maps], [{"m": self.m}], self.Cs, self.k)

    def fit(self, df: DataFrame) -> mg.KernelMachine:
        df = stored(df)
        found = self.search(assign_folds(df.drop("fold"), "id", self.y, self.k, self.seed))
        nystrom = mg.Nystrom.of(mg.leverage_landmarks(df, self.m, self.seed))
        rows = df.select(F.col(self.y).alias("y"), "vec")
        return mg.fit_machine(rows, nystrom, found.points[found.best]["C"], found.calibration.final, features="vec")


def positive_score(scored: DataFrame) -> Column:
    """Probability of class 1; the clipped sigmoid of the margin where a model gives margins only."""
    if "probability" in scored.columns:
        return vector_to_array("probability")[1]
    return sc.sigmoid(vector_to_array("rawPrediction")[1])


def score(model: Transformer, df: DataFrame, keep: list[str]) -> DataFrame:
    """``(keep, proba)`` of a whole table in one pass."""
    out = model.transform(df)
    return out.select(*keep, positive_score(out).alias("proba"))


# ---- cross-validation ---------------------------------------------------------------------------


def _parallel(jobs: list[Callable], parallelism: int) -> list:
    pool = ThreadPool(max(1, min(parallelism, len(jobs))))
    try:
        inherit = inheritable_thread_target(SparkSession.getActiveSession())
        return pool.map(lambda j: j(), [inherit(j) for j in jobs])
    finally:
        pool.close()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True, eq=False)
class LogisticLearner:
    """A preparation under a logistic model. Called with training rows it fits them; ``oof_scores`` solves all folds at once.

    ``weight`` names a column of the rows that the preparation leaves in place.
    """

    prep: Estimator
    C: float = 1.0
    y: str = "y"
    weight: str | None = None

    def __call__(self, train: DataFrame) -> Transformer:
        return Pipeline(stages=[self.prep, logreg(self.C, self.y, self.weight)]).fit(train)


def logistic_oof(base: DataFrame, learners: dict[str, LogisticLearner], k: int, fold: str = "fold", id_col: str = "id", y: str = "y",
                 parallelism: int = 4) -> list[DataFrame]:
    """Out-of-fold scores of logistic learners over stored rows, one table for the learners that share a preparation.

    A preparation is fitted once without each fold, whatever the number of its learners, and all folds and learners are solved
    in the same scans. The penalty follows the count of a fit's rows, weighted or not.
    """
    shared: dict[tuple, dict[str, LogisticLearner]] = {}
    for name, learner in learners.items():
        places = [key for key, group in shared.items() if key[0] == id(learner.prep) and learner.weight in (None, key[1], key[1] or learner.weight)]
        key = places[0] if places else (id(learner.prep), learner.weight)
        group = shared.pop(key, {})
        shared[(key[0], key[1] or learner.weight)] = {**group, name: learner}
    out = []
    for (_, weight), group in shared.items():
        names, prep = list(group), next(iter(group.values())).prep
        rows = prepared_folds([base], prep, k, fold, id_col, y, parallelism, [weight] if weight else [])
        held = F.col(fold) == F.col("fit")
        share = [1.0] * k
        if weight:
            sums = base.filter(F.col(fold).isNotNull()).groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).collect()
            share = [sum(r["n"] for r in sums if r[fold] != i) / sum(r["w"] for r in sums if r[fold] != i) for i in range(k)]
        problems = [Problem(i, group[n].C * (share[i] if group[n].weight else 1.0), weighted=group[n].weight is not None) for i in range(k) for n in names]
        solutions = fit_many(rows.filter(~held), problems, y="y", weight=weight)
        scored = score_many(rows.filter(held), problems, solutions, ["fit", id_col, "y", fold])
        model = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("problem") % len(names) + 1)
        out.append(scored.select(id_col, F.col("y").alias(y), fold, model.alias("model"), "proba"))
    return out


def oof_scores(df: DataFrame, learners: dict[str, Callable[[DataFrame], Transformer]], k: int, fold: str = "fold",
               id_col: str = "id", y: str = "y", parallelism: int = 4) -> DataFrame:
    """Long ``(id, y, fold, model, proba)``: every row scored once per learner, by a model that never saw it.

    A learner maps training rows to a fitted transformer, so its feature preparation is refitted per fold.
    The folded rows are checkpointed once: fits and scoring passes read them instead of dealing folds again.
    Logistic learners are solved for all folds in the same scans.
    """
    base = stored(df)
    joint = {n: f for n, f in learners.items() if isinstance(f, LogisticLearner) and f.y == y}
    parts = logistic_oof(base, joint, k, fold, id_col, y, parallelism)

    def job(name, fit, i):
        model = fit(base.filter(F.col(fold) != i))
        return score(model, base.filter(F.col(fold) == i), [id_col, y, fold]).withColumn("model", F.lit(name))

    jobs = [(lambda n=n, f=f, i=i: job(n, f, i)) for i in range(k) for n, f in learners.items() if n not in joint]
    return _union([*parts, *(_parallel(jobs, parallelism) if jobs else [])]).select(id_col, y, fold, "model", "proba")


CV_METRICS = ["roc_auc", "pr_auc", *ev.LABEL_METRICS]


def cv_scores(df: DataFrame, learners: dict[str, Callable], k: int, fold: str = "fold", y: str = "y", **kw) -> DataFrame:
    """Long ``(fold, model, metric, value)``: seven metrics of every learner on every held-out fold."""
    scored = stored(oof_scores(df, learners, k, fold, y=y, **kw).withColumnRenamed(y, "y"))
    return ev.metrics_long(ev.all_metrics(scored, [fold, "model"]), [fold, "model"], CV_METRICS)


@dataclass
class GridResult:
    table: DataFrame
    best: dict
    model: Transformer


def grid_search(df: DataFrame, build: Callable[..., Callable[[DataFrame], Transformer]], grid: dict[str, list], k: int,
                fold: str = "fold", y: str = "y", prep: Estimator | None = None, parallelism: int = 4) -> GridResult:
    """Leakage-safe search: preparation refitted per fold, all points scored on held-out rows, best refitted.

    ``build(**point)`` returns an estimator over a ``features`` column when ``prep`` is given (one
    preparation per fold, shared by all points), else a whole learner. The best mean ROC-AUC wins; ties
    go to the earlier point. There is no test set among the arguments.
    """
    df = stored(df)
    points = grid_points(grid)
    scored, cached = [], []
    try:
        for i in range(k):
            train, held = df.filter(F.col(fold) != i), df.filter(F.col(fold) == i)
            if prep is not None:
                stage = prep.fit(train)
                train = stage.transform(train).select(y, "features").persist()
                held = stage.transform(held).select("id", y, fold, "features").persist()
                cached += [train, held]

            def job(j, point, train=train, held=held):
                model = build(**point).fit(train)
                return score(model, held, ["id", y, fold]).withColumn("point", F.lit(j))

            scored += _parallel([(lambda j=j, p=p: job(j, p)) for j, p in enumerate(points)], parallelism)
        rows = ev.all_metrics(stored(_union(scored).withColumnRenamed(y, "y")), [fold, "point"])
        long = ev.metrics_long(rows, [fold, "point"], CV_METRICS)
        table = ev.cv_summary(long, ["point", "metric"])
        # points x metrics rows: written to the driver once, so later uses do not refit or rescore
        local = table.collect()
        table = df.sparkSession.createDataFrame(local, table.schema)
    finally:
        for c in cached:
            c.unpersist()
    auc = {r["point"]: r["mean"] for r in local if r["metric"] == "roc_auc"}
    best = points[min(auc, key=lambda j: (-round(auc[j], 9), j))]
    learner = build(**best)
    final = learner.fit(df) if prep is None else Pipeline(stages=[prep, learner]).fit(df)
    names = df.sparkSession.createDataFrame([(j, str(p)) for j, p in enumerate(points)], "point int, params string")
    return GridResult(table.join(names, "point"), best, final)


# ---- many logistic models at once ----------------------------------------------------------------


def prepared_folds(sets: list[DataFrame], prep: Estimator, k: int, fold: str = "fold", id_col: str = "id", y: str = "y",
                   parallelism: int = 4, keep: list[str] = ()) -> DataFrame:
    """``(fit, id, y, fold, keep, features array)``: every row of every set as prepared without each fold; fit = set * k + fold."""

    def prepared(s: int, i: int):
        stage = prep.fit(sets[s].filter(F.col(fold) != i))
        rows = stage.transform(sets[s])
        return rows.select(F.lit(s * k + i).alias("fit"), id_col, F.col(y).alias("y"), fold, *keep, vector_to_array("features").alias("features"))

    places = [(s, i) for s in range(len(sets)) for i in range(k)]
    return _union(_parallel([(lambda p=p: prepared(*p)) for p in places], parallelism))


@dataclass
class LogisticFolds:
    """All problems (set, fold, C) of some folded tables, solved together, and their held-out scores."""

    train: DataFrame
    scores: DataFrame
    problems: list[Problem]
    solutions: list[Solution]
    k: int

    def place(self, j: int) -> tuple[int, int]:
        """(set, fold) of a problem."""
        return divmod(self.problems[j].fit, self.k)


def logistic_folds(sets: list[DataFrame], prep: Estimator, k: int, Cs: list[float], fold: str = "fold", id_col: str = "id",
                   y: str = "y", parallelism: int = 4) -> LogisticFolds:
    """Logistic models of every set, held-out fold and C: one preparation per set and fold, one series of scans for all fits.

    ``scores`` is long ``(set, id, y, fold, point, proba)``: every row of a set scored once per C (``point`` numbers
    them), by models that never saw it.
    """
    places = [(s, i) for s in range(len(sets)) for i in range(k)]
    # a projection of the stored sets: packed once to be solved, read once more to be scored
    rows = prepared_folds([stored(s) for s in sets], prep, k, fold, id_col, y, parallelism)
    held = F.col(fold) == F.col("fit") % k
    problems = [Problem(s * k + i, float(c)) for s, i in places for c in Cs]
    solutions = fit_many(rows.filter(~held), problems)
    scored = score_many(rows.filter(held), problems, solutions, ["fit", id_col, "y", fold])
    point = (F.col("problem") % len(Cs)).alias("point")
    scores = stored(scored.select(F.floor(F.col("fit") / k).cast("int").alias("set"), id_col, "y", fold, point, "proba"))
    return LogisticFolds(rows.filter(~held), scores, problems, solutions, k)


def logistic_search(df: DataFrame, Cs: list[float], k: int, prep: Estimator, fold: str = "fold", y: str = "y") -> GridResult:
    """``grid_search`` over the penalties of a logistic model, all points and folds in the same scans."""
    df = stored(df)
    found = logistic_folds([df], prep, k, Cs, fold, y=y)
    long = ev.metrics_long(ev.all_metrics(found.scores, [fold, "point"]), [fold, "point"], CV_METRICS)
    table = stored(ev.cv_summary(long, ["point", "metric"]))
    auc = {r["point"]: r["mean"] for r in table.filter("metric = 'roc_auc'").collect()}
    best = min(auc, key=lambda j: (-round(auc[j], 9), j))
    names = df.sparkSession.createDataFrame([(j, str({"C": c})) for j, c in enumerate(Cs)], "point int, params string")
    return GridResult(table.join(names, "point"), {"C": Cs[best]}, Pipeline(stages=[prep, logreg(Cs[best], y)]).fit(df))


def logistic_stability(df: DataFrame, prep: Estimator, C: float, k: int, seeds: list[int], id_col: str = "id", y: str = "y") -> DataFrame:
    """``seed_stability`` of a logistic model: the folds of all seeds are fitted in the same scans."""
    found = logistic_folds([assign_folds(df, id_col, y, k, s) for s in seeds], prep, k, [C], id_col=id_col, y=y)
    long = ev.metrics_long(ev.all_metrics(found.scores, ["set", "fold"]), ["set", "fold"], CV_METRICS)
    per_seed = long.groupBy("set", "metric").agg(F.avg("value").alias("value"))
    return per_seed.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count(F.lit(1)).alias("n_seeds"))


def training_means(found: LogisticFolds, Cs: list[float]) -> DataFrame:
    """``(fold, C, n, mean_score)`` over the rows each model of the first set was fitted on.

    The intercept is free, so at the optimum the mean score is the label rate of those rows, whatever the penalty.
    """
    means = mean_scores(found.train.filter(F.col("fit") < found.k), found.problems, found.solutions)
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("problem") + 1)
    return means.select(of([p.fit for p in found.problems]).alias("fold"), of([float(p.C) for p in found.problems]).alias("C"), "n", "mean_score")


def class_weights(df: DataFrame, y: str = "y", out: str = "weight") -> DataFrame:
    """Adds n / (2 n_class) per row, from class counts."""
    counts = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    n = sum(counts.values())
    expr = F.lit(None).cast("double")
    for label, c in counts.items():
        expr = F.when(F.col(y) == label, F.lit(n / (2.0 * c))).otherwise(expr)
    return df.withColumn(out, expr)


def compare_weighting(df: DataFrame, prep: Estimator, C: float, k: int, y: str = "y", **kw) -> DataFrame:
    """Unweighted against balanced class weights at fixed parameters, by fold."""
    weighted = class_weights(df, y)
    learners = {
        "unweighted": LogisticLearner(prep, C, y),
        "weighted": LogisticLearner(prep, C, y, weight="weight"),
    }
    return cv_scores(weighted, learners, k, y=y, **kw)


def compare_candidates(df: DataFrame, candidates: dict[str, Callable], k: int, **kw) -> DataFrame:
    """Mean, deviation and interval per candidate and metric over the same folds."""
    return ev.cv_summary(cv_scores(df, candidates, k, **kw), ["model", "metric"])


def seed_stability(df: DataFrame, learners: dict[str, Callable], k: int, seeds: list[int], id_col: str = "id", y: str = "y") -> DataFrame:
    """Cross-validated metric means per seed, then mean and population deviation over seeds."""
    parts = []
    for s in seeds:
        folded = assign_folds(df, id_col, y, k, s)
        parts.append(cv_scores(folded, learners, k, y=y).groupBy("model", "metric").agg(F.avg("value").alias("value")).withColumn("seed", F.lit(s)))
    return _union(parts).groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n_seeds")
    )


# ---- stacking -----------------------------------------------------------------------------------


def oof_wide(oof: DataFrame, models: list[str]) -> DataFrame:
    """``(id, y, fold, p_model...)``; every id has one row per model."""
    return oof.groupBy("id", "y", "fold").agg(*[F.max(F.when(F.col("model") == m, F.col("proba"))).alias(f"p_{m}") for m in models])


def meta_learner(cols: list[str], y: str = "y") -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), logreg(1.0, y)])


def stack_cv(wide: DataFrame, base: str, aux: str, control: str, k: int) -> DataFrame:
    """Long out-of-fold scores of base alone, base + aux and base + control.

    Each meta-learner is fitted on the other folds' out-of-fold rows.
    """
    stacks = {"stack_aux": [base, aux], "stack_control": [base, control]}
    learners = {name: LogisticLearner(Pipeline(stages=[VectorAssembler(inputCols=c, outputCol="features")])) for name, c in stacks.items()}
    alone = wide.select("id", "y", "fold", F.lit("base").alias("model"), F.col(base).alias("proba"))
    return alone.unionByName(oof_scores(wide, learners, k))


@dataclass
class StackedModel:
    """Base models fitted on all training rows under a meta-learner fitted on their out-of-fold scores."""

    models: dict[str, Transformer]
    meta: Transformer

    def transform(self, df: DataFrame) -> DataFrame:
        """One pass over any table: each model adds its score, the meta-learner reads the scores."""
        for name, model in self.models.items():
            out = model.transform(df)
            df = out.select(*[F.col(c) for c in df.columns], positive_score(out).alias(f"p_{name}"))
        return self.meta.transform(df)

    def save(self, path: str) -> None:
        for name, model in self.models.items():
            model.write().overwrite().save(f"{path}/base/{name}")
        self.meta.write().overwrite().save(f"{path}/meta")

    @classmethod
    def load(cls, path: str, names: list[str]) -> "StackedModel":
        """``names`` are the base models in the order they were fitted."""
        return cls({n: PipelineModel.load(f"{path}/base/{n}") for n in names}, PipelineModel.load(f"{path}/meta"))


def fit_stack(df: DataFrame, learners: dict[str, Callable[[DataFrame], Transformer]], k: int, parallelism: int = 4) -> StackedModel:
    """The final stack of the folded rows ``df`` (id, y, fold, ...): to save, and to score new rows with."""
    base = stored(df)
    wide = stored(oof_wide(oof_scores(base, learners, k, parallelism=parallelism), list(learners)))
    meta = meta_learner([f"p_{n}" for n in learners]).fit(wide)
    fitted = _parallel([(lambda fit=fit: fit(base)) for fit in learners.values()], parallelism)
    return StackedModel(dict(zip(learners, fitted)), meta)


def residual_fusion(wide: DataFrame, cols: list[str], p: str, width: int = 8, seed: int = 42) -> DataFrame:
    """Refines a base score: Fourier features fit its residual, then base, refinement and margin are fused.

    Least squares on the residual replaces an iterative weight search. The score ``p`` must already be
    out of fold; ``fold`` marks held-out rows for both fits.
    """
    inputs = wide.withColumn("margin", sc.margin(F.col(p))).withColumn("residual", sc.residual(F.col("y"), F.col(p)))
    waves = ft.rff([*cols, p, "margin"], width, seed)
    refined = Pipeline(stages=[
        waves.stage(), VectorAssembler(inputCols=waves.names, outputCol="waves"),
        LinearRegression(featuresCol="waves", labelCol="residual", predictionCol="refinement", regParam=1e-6),
        VectorAssembler(inputCols=[p, "refinement", "margin"], outputCol="features"),
    ])
    k = wide.agg(F.max("fold")).first()[0] + 1
    return oof_scores(inputs, {"fusion": LogisticLearner(refined)}, k)


# ---- explanation --------------------------------------------------------------------------------


def explain_global(spark, model: Transformer, names: list[str]) -> DataFrame:
    """Coefficients or importances, named by the columns the model was fitted on."""
    values = (model.coefficients if hasattr(model, "coefficients") else model.featureImportances).toArray()
    if len(values) != len(names):
        raise ValueError(f"{len(values)} values for {len(names)} names")
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, value double")


def contributions(coefs: dict[str, float], means: dict[str, float]) -> Column:
    """Array of ``(feature, contribution)``: coefficient times distance from the training mean.

    For a linear score these are exact and add up to its difference from the mean row's.
    """
    return F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c) - F.lit(float(means[c])))).alias("contribution"))
        for c, w in coefs.items()
    ])


def explain_rows(df: DataFrame, coefs: dict[str, float], means: dict[str, float], k: int, id_col: str = "id") -> DataFrame:
    """The k largest signed contributions per row; ties by feature name."""
    keyed = F.transform(
        contributions(coefs, means),
        lambda s: F.struct((-F.abs(s["contribution"])).alias("o"), s["feature"].alias("feature"), s["contribution"].alias("contribution")),
    )
    top = F.slice(F.sort_array(keyed), 1, k)
    return df.select(id_col, F.posexplode(top).alias("pos", "s")).select(
        id_col, (F.col("pos") + 1).alias("rank"), F.col("s.feature").alias("feature"), F.col("s.contribution").alias("contribution")
    )


def contribution_summary(df: DataFrame, coefs: dict[str, float], means: dict[str, float]) -> DataFrame:
    """Mean absolute contribution per feature over a table."""
    return df.select(F.inline(contributions(coefs, means))).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def column_means(df: DataFrame, cols: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def shuffled_column(df: DataFrame, id_col: str, col: str, seed: int) -> DataFrame:
    """``df`` with one column permuted: rows in one seeded order take the values of another order."""
    to = hash_rank(df.drop(col), id_col, [], seed, rank="_r", size="_n")
    source = hash_rank(df.select(id_col, col), id_col, [], seed + 1, rank="_r", size="_n").select("_r", col)
    return to.join(source, "_r").drop("_r", "_n").select(*df.columns)


def permuted_values(df: DataFrame, cols: list[str], repeats: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``df`` with ``donated``, an array over 0..repeats-1 of ``(repeat, cols)`` from another row: a permutation per repeat.

    Rows are ranked once in a seeded order; in repeat t a row takes the values of the row s_t ranks on, cyclically, with s_t
    hashed from (seed, t) within 1..n-1. Every row sends its values to their ``repeats`` ranks and meets them in one shuffle,
    whatever the number of columns. A single row keeps its own values; null values travel like any other.
    """
    ranked = hash_rank(df, id_col, [], seed, rank="_r", size="_n")
    step = lambda t: F.lit(1) + F.pmod(hash_word(F.lit(seed), F.lit(t)), F.greatest(F.col("_n") - 1, F.lit(1)))
    to = lambda t: F.pmod(F.col("_r") - 1 - step(t), F.col("_n")) + 1
    own = ranked.select("_r", F.struct(*df.columns).alias("_own"), F.lit(None).cast("int").alias("repeat"), *cols)
    sent = ranked.select(F.explode(F.array(*[F.struct(to(t).alias("_r"), F.lit(t).alias("repeat")) for t in range(repeats)])).alias("_s"), *cols)
    sent = sent.select("_s._r", F.lit(None).cast(own.schema["_own"].dataType).alias("_own"), "_s.repeat", *cols)
    gift = F.when(F.col("repeat").isNotNull(), F.struct("repeat", *cols))
    met = own.unionByName(sent).groupBy("_r").agg(F.first("_own", ignorenulls=True).alias("_own"), F.sort_array(F.collect_list(gift)).alias("donated"))
    return met.select("_own.*", "donated")


def permutation_importance(df: DataFrame, model: Transformer, cols: list[str], seed: int = 42, id_col: str = "id", y: str = "y",
                           repeats: int = 10) -> DataFrame:
    """Drop of ROC-AUC when one column is permuted: mean ``importance`` and population deviation ``std`` over the repeats.

    All variants of a row are scored in one pass and ranked in one job: a row's ``repeats * columns + 1`` versions.
    """
    variants = F.array(
        F.struct(F.lit("").alias("feature"), F.lit(0).alias("repeat")),
        *[F.struct(F.lit(c).alias("feature"), F.lit(t).alias("repeat")) for c in cols for t in range(repeats)])
    given = permuted_values(df.drop("feature", "repeat", "donated"), cols, repeats, seed, id_col)
    long = given.withColumn("_v", F.explode(variants)).select("*", "_v.*").drop("_v")
    donor = F.element_at("donated", F.col("repeat") + 1)
    long = long.withColumns({c: F.when(F.col("feature") == c, donor[c]).otherwise(F.col(c)) for c in cols}).drop("donated")
    scored = stored(score(model, long, [id_col, y, "feature", "repeat"]).withColumnRenamed(y, "y"))
    auc = stored(ev.roc_auc(scored, ["feature", "repeat"]))
    plain = auc.filter("feature = ''").select("roc_auc").scalar()
    drop = plain - F.col("roc_auc")
    return auc.filter("feature <> ''").groupBy("feature").agg(
        F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("std"), F.count(F.lit(1)).alias("repeats"))


# ---- curves and perturbations -------------------------------------------------------------------


def learning_curve(pool: DataFrame, held: DataFrame, sizes: list[int], fit: Callable, seed: int, id_col: str = "id", y: str = "y") -> DataFrame:
    """Metrics on fixed held-out rows by size of nested training samples."""
    samples, held = stored(nested_samples(pool, id_col, y, sizes, seed)), stored(held)
    parts = [score(fit(samples.filter(F.col("size") == s)), held, [id_col, y]).withColumn("size", F.lit(s)) for s in sizes]
    return ev.all_metrics(stored(_union(parts).withColumnRenamed(y, "y")), ["size"])


def cross_site(df: DataFrame, site: str, train_site, fit: Callable, id_col: str = "id", y: str = "y") -> DataFrame:
    """Metrics per site of a model trained on one site."""
    model = fit(df.filter(F.col(site) == train_site))
    return ev.all_metrics(stored(score(model, df, [id_col, y, site]).withColumnRenamed(y, "y")), [site])


def with_noise(df: DataFrame, cols: list[str], std: dict[str, float], sigmas: list[float], seed: int, id_col: str = "id") -> DataFrame:
    """One copy of the rows per noise level: columns plus sigma * training deviation * hashed normal."""
    long = df.withColumn("level", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])))
    return long.withColumns({
        c: F.col(c) + F.col("level") * F.lit(float(std[c])) * gaussian(F.lit(seed), F.lit(j), F.col(id_col)) for j, c in enumerate(cols)
    })


def with_mask(df: DataFrame, cols: list[str], rates: list[float], seed: int, id_col: str = "id") -> DataFrame:
    """One copy of the rows per masking rate: hashed cells become null, more of them at higher rates."""
    long = df.withColumn("level", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    return long.withColumns({
        c: F.when(uniform(F.lit(seed), F.lit(j), F.col(id_col)) >= F.col("level"), F.col(c)) for j, c in enumerate(cols)
    })


def perturbation_sweep(perturbed: DataFrame, model: Transformer, id_col: str = "id", y: str = "y") -> DataFrame:
    """Metrics per perturbation level; a mask is filled by the model's own train-fitted imputation."""
    return ev.all_metrics(stored(score(model, perturbed, [id_col, y, "level"]).withColumnRenamed(y, "y")), ["level"])
