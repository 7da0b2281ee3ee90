"""Resumable searches over tree ensembles: every (setting, fold) is a trial with its own durable result.

A trial fits the largest ensemble of its setting and scores all its prefixes, so a grid of 48 points over numbers of trees
and other settings is 24 fits a fold. Its metrics are written as one part with a success marker: a search cut short, or run
again, fits only what is missing. The prepared folds are written beside them, so a resumed search sees the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from lynceus.operators import evaluate as ev
from lynceus.operators.models import CV_METRICS, _parallel, grid_points, prepared_folds
from lynceus.operators.sampling import table_digest
from lynceus.operators.staged import staged_scores, trees_of
from lynceus.session import stored
from lynceus.sources.io import _exists

SIZE = "trees"


@dataclass(frozen=True)
class Trial:
    setting: int
    fold: int

    def part(self, path: str) -> str:
        return f"{path}/trials/setting={self.setting}/fold={self.fold}"


class StaleSearch(ValueError):
    """The folder holds trials of other rows or another grid."""


@dataclass
class TrialSearch:
    """A grid over ``trees`` and other settings, k folds, results under ``path``."""

    build: Callable[..., Estimator]
    grid: dict[str, list]
    k: int
    path: str

    @property
    def settings(self) -> list[dict]:
        return grid_points({name: values for name, values in self.grid.items() if name != SIZE})

    @property
    def trials(self) -> list[Trial]:
        return [Trial(s, f) for s in range(len(self.settings)) for f in range(self.k)]

    def missing(self, spark) -> list[Trial]:
        return [t for t in self.trials if not _exists(spark, t.part(self.path))]

    def _prepared(self, df: DataFrame, prep: Estimator, fold: str, id_col: str, y: str) -> DataFrame:
        """The prepared folds, written once; a folder begun with other rows, another grid or another k is refused."""
        spark = df.sparkSession
        df = stored(df)
        begun = {"rows": table_digest(df).first()["digest"], "grid": json.dumps(self.grid, sort_keys=True), "k": self.k}
        if _exists(spark, f"{self.path}/search"):
            if spark.read.parquet(f"{self.path}/search").first().asDict() != begun:
                raise StaleSearch(f"{self.path} was begun with other rows or another grid")
        else:
            spark.createDataFrame([begun], "rows string, grid string, k int").coalesce(1).write.parquet(f"{self.path}/search")
        if not _exists(spark, f"{self.path}/rows"):
            rows = prepared_folds([df], prep, self.k, fold, id_col, y).withColumnsRenamed({id_col: "id", fold: "fold"})
            rows.write.mode("overwrite").partitionBy("fit").parquet(f"{self.path}/rows")
        return spark.read.parquet(f"{self.path}/rows").withColumn("features", array_to_vector("features"))

    def _run(self, rows: DataFrame, trial: Trial) -> None:
        sizes = sorted(self.grid[SIZE])
        mine = rows.filter(F.col("fit") == trial.fold)
        model = self.build(trees=sizes[-1], **self.settings[trial.setting]).fit(mine.filter("fold <> fit").select("y", "features"))
        trees = trees_of(rows.sparkSession, model)
        forest = isinstance(model, RandomForestClassificationModel)
        scored = stored(staged_scores(mine.filter("fold = fit"), trees, sizes, ["id", "y"], average=forest))
        ev.all_metrics(scored, ["stage"]).coalesce(1).write.mode("overwrite").parquet(trial.part(self.path))

    def run(self, df: DataFrame, prep: Estimator, fold: str = "fold", id_col: str = "id", y: str = "y", parallelism: int = 4) -> DataFrame:
        """Runs the missing trials and returns ``(setting, fold, stage, metrics)`` of all: settings x folds x sizes rows."""
        spark = df.sparkSession
        rows = self._prepared(df, prep, fold, id_col, y)
        todo = self.missing(spark)
        if todo:
            _parallel([(lambda t=t: self._run(rows, t)) for t in todo], parallelism)
        return spark.read.parquet(f"{self.path}/trials")

    def summary(self, found: DataFrame) -> tuple[DataFrame, dict]:
        """Mean, deviation and interval per point and metric, and the point of the best mean ROC-AUC (ties: the earlier)."""
        long = ev.metrics_long(found, ["setting", "stage", "fold"], CV_METRICS)
        table = stored(ev.cv_summary(long, ["setting", "stage", "metric"]))
        best = min(table.filter("metric = 'roc_auc'").collect(), key=lambda r: (-round(r["mean"], 9), r["setting"], r["stage"]))
        return table, {**self.settings[best["setting"]], SIZE: best["stage"]}
