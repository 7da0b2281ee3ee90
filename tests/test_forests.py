"""Forests grown over cells against MLlib's."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector

from lynceus.operators import forests as fs, models as ml


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(3)
    x = np.column_stack([rng.normal(size=14000), rng.exponential(size=14000).round(1), rng.randint(0, 3, 14000)])
    y = (x[:, 0] + 0.4 * x[:, 1] * (x[:, 2] - 1) + 0.7 * rng.normal(size=14000) > 0.2).astype(int)
    plain = spark.createDataFrame([(i, int(t), [float(v) for v in r]) for i, (t, r) in enumerate(zip(y, x))], "id long, y int, x array<double>")
    return plain.repartition(3).select("id", "y", array_to_vector("x").alias("features")).localCheckpoint()


@pytest.fixture
def over_cells(monkeypatch):
    monkeypatch.setattr(ml.Forest, "cells_from", 1)


def test_trees_without_draws_are_mllibs(spark, rows, over_cells, monkeypatch):
    """Same thresholds, splits, leaves and pruning; rows are read into cells and not handed to MLlib's trainer."""
    want = RandomForestClassifier(labelCol="y", numTrees=2, maxDepth=5, bootstrap=False, featureSubsetStrategy="all", seed=42).fit(rows)
    monkeypatch.setattr(RandomForestClassifier, "_fit", None)
    got = ml.forest(2, 5, subset="all").setBootstrap(False).fit(rows)
    assert [t.toDebugString.split("\n", 1)[1] for t in got.trees] == [t.toDebugString.split("\n", 1)[1] for t in want.trees]
    a, b = ({r["id"]: list(r["probability"]) for r in m.transform(rows).collect()} for m in (got, want))
    assert all(a[i] == pytest.approx(b[i], abs=1e-12) for i in b)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-9)


def test_drawn_forests_score_like_mllibs(spark, rows, over_cells):
    """Draws are others, so scores agree as two forests of different seeds do."""
    got = ml.forest(60, 4).fit(rows)
    want = RandomForestClassifier(labelCol="y", numTrees=60, maxDepth=4, featureSubsetStrategy="sqrt", seed=7).fit(rows)
    p, q = (np.array([v["probability"][1] for v in m.transform(rows).orderBy("id").collect()]) for m in (got, want))
    assert got.getNumTrees == 60 and np.abs(p - q).mean() < 0.02 and np.corrcoef(p, q)[0, 1] > 0.98


def test_draws_do_not_follow_the_layout(rows, over_cells):
    """With thresholds from all rows the forest is the same wherever the rows lie."""
    few = rows.filter("id < 9000")
    a, b = (ml.forest(8, 3).fit(t) for t in (few, few.repartition(5)))
    assert [t.toDebugString.split("\n", 1)[1] for t in a.trees] == [t.toDebugString.split("\n", 1)[1] for t in b.trees]


def test_draws_of_a_cell_are_those_of_its_rows():
    """A cell of n rows is drawn n times on average with variance n, by every tree anew."""
    block = (0, 0, np.zeros((4000, 1), np.uint8), np.full(4000, 7), np.full(4000, 2))
    stump = fs.as_tree([fs.Vote(np.zeros(2), 0.0)], 1.0, 0)
    one, two = (fs.level_sums(block, t, stump, [0], [2], 42, True)[:, 0].sum(axis=1) for t in (0, 1))
    assert list(one) != list(two)
    for sums in (one, two):
        assert abs(sums[0] - 28000) < 5 * 28000**0.5 and abs(sums[1] - 8000) < 5 * 8000**0.5


def test_cells_of_all_tasks_meet(spark):
    rows = spark.range(3000, numPartitions=6).selectExpr("CAST(id % 2 AS DOUBLE) AS y", "array(CAST(id % 3 AS DOUBLE), CAST(id % 2 AS DOUBLE)) AS features")
    (block,) = fs.cell_blocks(rows, [np.array([0.5, 1.5]), np.array([0.5])]).collect()
    assert len(block[3]) == 6 and block[3].sum() == 1500 and block[4].sum() == 1500
