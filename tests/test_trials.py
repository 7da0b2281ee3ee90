"""Resumable searches, staged forests and repeated permutations."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from lynceus.catalog.learning import CFG, GROUPS
from lynceus.operators import models as ml, sampling as sp, staged, trials as tr
from lynceus.plans.roles import cohort

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def learnable(spark):
    c = cohort(spark, SF).withColumn("y", (F.col("price") / 500000 + F.col("priority") / 10 > 0.8).cast("int"))
    return sp.assign_folds(c, "id", "y", 2, 42).persist()


def prep():
    return ml.FeaturePrep(GROUPS, "y", CFG)


def test_killed_search_repeats_no_finished_trial(spark, learnable, tmp_path):
    fits, stop = [], [2]

    def build(**setting):
        if len(fits) == stop[0]:
            raise RuntimeError("killed")
        fits.append(setting)
        return ml.boosted(**setting)

    grid = {"trees": [2, 4], "depth": [1, 3]}
    search = tr.TrialSearch(build, grid, 2, str(tmp_path / "s"))
    with pytest.raises(RuntimeError):
        search.run(learnable, prep(), parallelism=1)
    assert len(search.missing(spark)) == 2
    stop[0] = 99
    found = search.run(learnable, prep(), parallelism=1)
    assert len(fits) == 4 and all(f["trees"] == 4 for f in fits) and not search.missing(spark)
    assert found.count() == 8 and found.select("setting", "fold", "stage").distinct().count() == 8
    search.run(learnable, prep(), parallelism=1)
    assert len(fits) == 4
    table, best = search.summary(found)
    assert table.filter("metric = 'roc_auc'").count() == 4 and best["depth"] == 3 and best["trees"] in (2, 4)
    with pytest.raises(tr.StaleSearch):
        tr.TrialSearch(build, {"trees": [2, 4], "depth": [1]}, 2, search.path).run(learnable, prep())
    with pytest.raises(tr.StaleSearch):
        search.run(learnable.filter("id > 5"), prep())


def test_staged_forest_is_mllibs(spark, learnable):
    model = Pipeline(stages=[prep(), ml.forest(6, 4)]).fit(learnable)
    rows = model.stages[0].transform(learnable)
    trees = staged.trees_of(spark, model.stages[-1])
    got = {(r.id, r.stage): r.proba for r in staged.staged_scores(rows, trees, [3, 6], ["id"], average=True).collect()}
    want = {r.id: r.proba for r in ml.score(model, learnable, ["id"]).collect()}
    assert len(got) == 2 * len(want)
    assert max(abs(got[i, 6] - p) for i, p in want.items()) < 1e-12


def test_every_repeat_is_a_permutation(spark, learnable):
    df = learnable.select("id", "price", "known_bal", "y")
    held = ml.permuted_values(df, ["price", "known_bal"], 10, 7).cache()
    assert held.count() == df.count() and sorted(held.columns) == sorted([*df.columns, "donated"])
    key = lambda rows: sorted(((p is None, p or 0.0), (b is None, b or 0.0)) for p, b in rows)
    want = key((r.price, r.known_bal) for r in df.collect())
    long = held.select("id", F.inline("donated")).collect()
    for t in range(10):
        assert key((r.price, r.known_bal) for r in long if r.repeat == t) == want
    moved = held.select(F.col("price").alias("own"), F.inline("donated")).filter("own = price").count()
    assert moved < 10 * df.count() * 0.02
    one = ml.permuted_values(df.limit(1), ["price"], 3, 7).first()
    assert [d.price for d in one.donated] == [one.price] * 3
    assert ml.permuted_values(df.filter("false"), ["price"], 3, 7).count() == 0


def test_permutation_importance_repeats(spark, learnable):
    model = Pipeline(stages=[prep(), ml.boosted(4, 3)]).fit(learnable)
    got = {r.feature: r for r in ml.permutation_importance(learnable, model, ["price", "known_bal"], repeats=4).collect()}
    assert got["price"].importance > 0.2 > abs(got["known_bal"].importance) and got["price"].repeats == 4
    assert np.isfinite(got["price"]["std"]) and got["price"]["std"] > 0
