"""Fitted models: leakage, coverage, persistence, streaming."""

import numpy as np
import pytest
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lynceus.catalog.learning import CFG, GROUPS
from lynceus.catalog.streaming import drained
from lynceus.operators import evaluate as ev, models as ml, sampling as sp
from lynceus.plans.roles import cohort, vectors
from lynceus.session import new_table_path
from lynceus.sources import io

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def learnable(spark):
    """The cohort with a label the features explain."""
    c = cohort(spark, SF).withColumn("y", (F.col("price") / 500000 + F.col("priority") / 10 > 0.8).cast("int"))
    return sp.assign_folds(c, "id", "y", 3, 42).persist()


def prep():
    return ml.FeaturePrep(GROUPS, "y", CFG)


def test_grid_search_picks_and_refits(spark, learnable):
    found = ml.grid_search(learnable, ml.logreg, {"C": [1e-6, 10.0]}, 3, prep=prep())
    assert found.best == {"C": 10.0} and found.table.filter("metric = 'roc_auc'").count() == 2
    auc = ev.roc_auc(ml.score(found.model, learnable, ["id", "y"]).withColumn("m", F.lit("m")), ["m"]).first()["roc_auc"]
    assert auc > 0.95


def test_penalty_follows_the_rows_of_each_fit(spark, learnable, monkeypatch):
    """regParam is 1 / (C n) of the fold's training rows, not of the table."""
    seen = []
    plain = ml.LogisticRegression
    monkeypatch.setattr(ml, "LogisticRegression", lambda **kw: seen.append(kw["regParam"]) or plain(**kw))
    sizes = [learnable.filter(F.col("fold") != i).count() for i in range(3)]
    ml.oof_scores(learnable, {"lr": lambda t: Pipeline(stages=[prep(), ml.logreg(2.0)]).fit(t)}, 3).count()
    assert sorted(seen) == pytest.approx(sorted(1 / (2.0 * n) for n in sizes))


def test_final_stack_is_saved_and_scores_single_rows(spark, learnable, tmp_path):
    """A loaded stack scores a row alone as it does in a batch, and beats chance."""
    learners = {"lr": lambda t: Pipeline(stages=[prep(), ml.logreg()]).fit(t), "tree": lambda t: Pipeline(stages=[prep(), ml.boosted(3, 2)]).fit(t)}
    stack = ml.fit_stack(learnable, learners, 3)
    stack.save(str(tmp_path))
    again = ml.StackedModel.load(str(tmp_path), ["lr", "tree"])
    batch = {r.id: r.proba for r in ml.score(again, learnable, ["id", "y"]).collect()}
    assert len(batch) == learnable.count()
    one = learnable.orderBy("id").limit(1)
    r = ml.score(stack, one, ["id"]).first()
    assert r.proba == pytest.approx(batch[r.id], abs=1e-12)
    auc = ev.roc_auc(ml.score(again, learnable, ["id", "y"]).withColumn("m", F.lit("m")), ["m"]).first()["roc_auc"]
    assert auc > 0.95


def test_oof_scores_every_row_once(spark, learnable):
    n = learnable.count()
    oof = ml.oof_scores(learnable, {"lr": lambda t: Pipeline(stages=[prep(), ml.logreg()]).fit(t)}, 3)
    assert oof.count() == n == oof.select("id").distinct().count()
    assert oof.filter("proba < 0 or proba > 1 or proba is null").count() == 0


def test_oof_model_never_sees_its_rows(spark, learnable):
    """Held-out rows with an absurd value do not change what the other folds fitted."""
    seen = []

    def fit(t):
        seen.append({r.fold for r in t.select("fold").distinct().collect()})
        return Pipeline(stages=[prep(), ml.logreg()]).fit(t)

    ml.oof_scores(learnable, {"lr": fit}, 3, parallelism=1)
    assert sorted(map(sorted, seen)) == [[0, 1], [0, 2], [1, 2]]


def test_other_learners_learn(spark, learnable):
    for est in (ml.forest(10, 4), ml.boosted(5, 3)):
        model = Pipeline(stages=[prep(), est]).fit(learnable)
        auc = ev.roc_auc(ml.score(model, learnable, ["id", "y"]).withColumn("m", F.lit("m")), ["m"]).first()["roc_auc"]
        assert auc > 0.95
    auc = ev.roc_auc(ml.score(ml.RbfSvm(GROUPS, C=10.0, width=32, cfg=CFG).fit(learnable), learnable, ["id", "y"]).withColumn("m", F.lit("m")), ["m"]).first()["roc_auc"]
    assert auc > 0.85


def test_landmark_classifier(spark):
    v = vectors(spark, SF).withColumn("y", (F.col("label") < 5).cast("int"))
    scored = ml.score(ml.LandmarkClassifier(32).fit(v), v, ["id", "y"])
    assert scored.filter("proba between 0 and 1").count() == v.count()


def test_weights_and_shuffle(spark, learnable):
    w = ml.class_weights(learnable).groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert [r.w for r in w] == pytest.approx([learnable.count() / 2] * 2)
    mixed = ml.shuffled_column(learnable, "id", "price", 5)
    same = mixed.join(learnable.select("id", F.col("price").alias("p")), "id")
    assert mixed.count() == learnable.count() and same.filter("price = p").count() < 20
    assert mixed.agg(F.sum(F.col("price").cast("decimal(20,2)"))).first() == learnable.agg(F.sum(F.col("price").cast("decimal(20,2)"))).first()


def test_saved_model_scores_alike(spark, learnable):
    path = new_table_path(spark, "model")
    model = Pipeline(stages=[prep(), ml.logreg()]).fit(learnable)
    io.save_model(model, path, io.manifest_of(config=CFG))
    loaded, manifest = io.load_model(path)
    assert manifest["config"]["k_best"] == CFG.k_best
    a, b = (ml.score(m, learnable, ["id"]).orderBy("id").collect() for m in (model, loaded))
    assert a == b


def test_stream_equals_batch(spark):
    stream, batch = drained(spark, SF)
    assert stream.count() == batch.count() > 0
    assert stream.exceptAll(batch).count() == 0


# ---- many models at once, the gate ----------------------------------------------------------------


def test_grouped_newton_equals_mllib(spark, learnable):
    """Every fold and penalty against a fit of its own; weights and a constant column included."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from lynceus.operators import newton as nt

    rows = learnable.select(F.col("fold").alias("fit"), "id", "y", (F.col("id") % 3 + 1).cast("double").alias("w"),
                            F.array(F.col("price") / 1e5, F.col("priority").cast("double"), F.lit(2.0)).alias("features"))
    problems = [nt.Problem(i, c) for i in range(3) for c in (1e-3, 1.0, 100.0)]
    found = nt.fit_many(rows, problems, weight="w")
    assert max(s.scans for s in found) <= 15
    for j in (0, 4, 8):
        part = rows.filter(F.col("fit") == problems[j].fit).withColumn("features", array_to_vector("features"))
        n = part.agg(F.sum("w")).first()[0]
        m = LogisticRegression(labelCol="y", weightCol="w", regParam=1 / (problems[j].C * n), standardization=False, maxIter=1000, tol=1e-13).fit(part)
        assert list(found[j].coefficients) == pytest.approx(list(m.coefficients), abs=1e-5) and found[j].intercept == pytest.approx(m.intercept, abs=1e-4)
    scored = nt.score_many(rows, problems, found, ["fit", "id"])
    assert scored.count() == 3 * rows.count()
    with pytest.raises(ValueError):
        nt.fit_many(rows, [nt.Problem(77, 1.0)])


def test_rows_are_packed_once_for_all_scans(spark, monkeypatch):
    """Newton scans read blocks of one fit: the rows' own plan is run once, whatever the number of scans and blocks."""
    from lynceus.operators import newton as nt

    rng = np.random.RandomState(3)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plain = spark.createDataFrame([(i % 3, int(t), [float(v) for v in r], 1.0 + i % 2) for i, (t, r) in enumerate(zip(y, x))], "fit int, y int, features array<double>, w double").coalesce(2)
    rows = plain.mapInArrow(counted, plain.schema)
    monkeypatch.setattr(nt, "BLOCK", 7)
    problems = [nt.Problem(i, c) for i in range(3) for c in (0.1, 10.0)]
    found = nt.fit_many(rows, problems, weight="w")
    assert seen.value == 300 and max(s.scans for s in found) > 2
    for j, p in enumerate(problems):
        of = np.arange(300) % 3 == p.fit
        w, z = 1.0 + np.arange(300)[of] % 2, x[of] @ found[j].coefficients + found[j].intercept
        slope = w * (1 / (1 + np.exp(-z)) - y[of])
        assert abs(slope.sum()) < 1e-6 and np.abs(x[of].T @ slope + found[j].coefficients / p.C).max() < 1e-6


def test_mean_scores_equal_those_of_listed_scores(spark):
    """Sums of scores leave a task, not the scores: one line per problem and task."""
    from lynceus.operators import newton as nt

    rows = spark.range(0, 90, 1, 3).select((F.col("id") % 2).cast("int").alias("fit"), F.array(F.sin("id"), F.col("id") / 50.0).alias("features"))
    problems = [nt.Problem(i, c) for i in range(2) for c in (0.1, 10.0)]
    solutions = [nt.Solution(np.array([0.3 * j - 0.4, 1.0 - j]), 0.2 * j, 0.0, 1) for j in range(4)]
    listed = nt.score_many(rows, problems, solutions, ["fit"]).groupBy("problem").agg(F.count("*").alias("n"), F.avg("proba").alias("m"))
    want = {r["problem"]: (r["n"], r["m"]) for r in listed.collect()}
    got = nt.mean_scores(rows, problems, solutions).collect()
    assert len(got) == 4 and all(r["n"] == want[r["problem"]][0] == 45 and abs(r["mean_score"] - want[r["problem"]][1]) < 1e-12 for r in got)


def gate_case(spark, seal, gain, held_gain, seeds):
    from lynceus.operators import gate

    import numpy as np

    rng = np.random.default_rng(1)
    n = 1500
    y = rng.integers(0, 2, 2 * n)
    edge = np.where(np.arange(2 * n) < n, gain, held_gain)
    data = [(i, int(y[i]), *[float(v) for v in (y[i] + 2 * rng.normal(), y[i] * (1 + edge[i]) + 2 * rng.normal(), y[i] + 2 * rng.normal())]) for i in range(2 * n)]
    wide = spark.createDataFrame(data, "id long, y int, a double, s double, c double").persist()
    long = wide.select("id", "y", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("proba")) for m in "asc"])))
    return gate.accept(long.filter(F.col("id") < n), long.filter(F.col("id") >= n), wide.filter(F.col("id") < n), "a", "s", "c", "s", seal, seeds, 5).first()


def test_every_outcome_of_the_gate_and_one_look_at_the_holdout(spark, tmp_path):
    from lynceus.operators import gate

    seal = gate.HoldoutSeal(spark, f"file://{tmp_path}/seal")
    weak = gate_case(spark, seal, 0.15, 0.0, [42, 7])
    assert not weak.gate_passed and weak.confirmed is None and weak.partial_gap > 0.01 and weak.decision == "complementary_only"
    none = gate_case(spark, seal, -0.5, 0.0, [42, 7])
    assert none.decision == "no_contribution" and none.partial_gap < 0
    strong = gate_case(spark, seal, 2.0, 2.0, [42, 7])
    assert strong.gate_passed and strong.seeds_passed == 2 and strong.confirmed and strong.decision == "demonstrated"
    with pytest.raises(gate.SealError):
        gate_case(spark, seal, 2.0, 2.0, [42, 7])
    fresh = gate.HoldoutSeal(spark, f"file://{tmp_path}/fresh")
    lucky = gate_case(spark, fresh, 2.0, 0.0, [42, 7])
    assert lucky.gate_passed and lucky.confirmed is False and lucky.decision == "no_contribution"
    with pytest.raises(gate.SealError):
        fresh.open(spark.range(5), earned=False)
    assert not fresh.opened(spark.range(5))


def test_staged_scores_equal_separate_fits(spark, learnable):
    """The first trees of an ensemble score as an ensemble of that many trees, all stages in one scan."""
    from lynceus.operators import staged

    rows = prep().fit(learnable).transform(learnable).select("id", "y", "features").persist()
    model = ml.boosted(6, 3, 0.1, 0.8).fit(rows)
    trees = staged.trees_of(spark, model)
    assert len(trees) == 6
    got = staged.staged_scores(rows, trees, [2, 6], ["id", "y"])
    for m, alone in ((6, model), (2, ml.boosted(2, 3, 0.1, 0.8).fit(rows))):
        want = {r.id: r.proba for r in ml.score(alone, rows, ["id"]).collect()}
        assert {r.id: r.proba for r in got.filter(F.col("stage") == m).collect()} == pytest.approx(want, abs=1e-12)
    auc = {r["stage"]: r["roc_auc"] for r in staged.staged_metrics(rows, trees, [2, 6]).collect()}
    whole = ev.roc_auc(ml.score(model, rows, ["id", "y"]).withColumn("m", F.lit(1)), ["m"]).first()["roc_auc"]
    assert auc[6] == pytest.approx(whole) and set(auc) == {2, 6}
    with pytest.raises(ValueError):
        staged.staged_scores(rows, trees, [7], ["id"])


def test_logistic_learners_of_all_folds_are_solved_together(spark):
    """One preparation per fold serves all learners that share it; scores are those of single fits."""
    rng = np.random.RandomState(7)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=600) > 0.8).astype(int)
    df = spark.createDataFrame([(i, int(t), i % 3, float(a), float(b)) for i, (t, (a, b)) in enumerate(zip(y, x))], "id long, y int, fold int, a double, b double")
    weighted = ml.class_weights(df)
    fitted = []

    class Counted(Estimator):
        def _fit(self, rows):
            fitted.append(rows.count())
            return VectorAssembler(inputCols=["a", "b"], outputCol="features")

    table = ml.compare_weighting(df, Counted(), 1.0, 3).collect()
    assert sorted(fitted) == [400, 400, 400] and len(table) == 2 * 3 * len(ml.CV_METRICS)
    prep = Counted()
    learners = {"plain": ml.LogisticLearner(prep), "balanced": ml.LogisticLearner(prep, weight="weight")}
    together = ml.oof_scores(weighted, learners, 3)
    single = ml.oof_scores(weighted, {n: (lambda t, f=f: f(t)) for n, f in learners.items()}, 3).withColumnRenamed("proba", "alone")
    both = together.join(single, ["id", "y", "fold", "model"]).toPandas()
    assert len(both) == 1200 and (both["proba"] - both["alone"]).abs().max() < 1e-4


def test_a_forest_trains_on_partitions_of_bounded_size(spark, monkeypatch):
    """MLlib holds a draw count per row and tree: few large partitions are dealt anew, small tables stay as they lie."""
    seen = []
    monkeypatch.setattr(ml.RandomForestClassifier, "_fit", lambda self, rows: seen.append((rows.rdd.getNumPartitions(), rows.count())))
    monkeypatch.setattr(ml, "FOREST_ROWS", 100)
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(1000).selectExpr("id", "CAST(id % 2 AS INT) y", "CAST(id AS DOUBLE) x"))
    ml.forest(3).fit(rows.coalesce(2))
    ml.forest(3).fit(rows.repartition(12))
    assert seen == [(10, 1000), (12, 1000)]
