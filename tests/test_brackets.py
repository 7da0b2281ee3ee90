"""Quantiles from brackets and the fused reports against numpy and against the count of their scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.operators import quality as dq, ranking as rk

PROBS = {"lo": 0.0, "q25": 0.25, "q50": 0.5, "q51": 0.51, "q999": 0.999, "hi": 1.0}


def frame(spark, *cols):
    names = ", ".join(f"c{i} double" for i in range(len(cols)))
    return spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in zip(*cols)], names)


def wanted(values):
    x = np.array([v for v in values if v is not None], dtype=float)
    return [pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-300) for p in PROBS.values()]


def test_quantiles_equal_numpy(spark):
    """Skewed, tied, constant, nearly empty columns and one with a third of its rows on one value."""
    rng = np.random.RandomState(5)
    n = 4000
    cols = [
        np.exp(rng.normal(size=n) * 9), rng.randint(0, 3, n), np.full(n, 7.5), np.where(np.arange(n) % 3 == 0, 0.0, rng.normal(size=n)),
        [None if i else -2.0 for i in range(n)], np.arange(n) - 1e9, [np.inf if i % 50 == 0 else -float(i) for i in range(n)],
    ]
    df = frame(spark, *cols).repartition(7)
    got = rk.fitted_quantiles(df, df.columns, PROBS)
    for i, c in enumerate(cols):
        if i < 6:
            assert list(got[f"c{i}"].values()) == wanted(c)
    assert got["c6"]["hi"] == np.inf and got["c6"]["q25"] == pytest.approx(np.sort(cols[6])[:3920][[999, 1000]] @ [0.25, 0.75], rel=1e-12)


def test_null_empty_and_nan(spark):
    df = frame(spark, [None, None, None, None], [1.0, float("nan"), -0.0, 0.0])
    got = rk.fitted_quantiles(df, ["c0", "c1"], {"lo": 0.0, "hi": 1.0, "m": 0.5})
    assert got["c0"] == {"lo": None, "hi": None, "m": None}
    assert got["c1"]["lo"] == 0 and np.isnan(got["c1"]["hi"]) and got["c1"]["m"] == 0.5
    assert rk.fitted_quantiles(df.filter("false"), ["c1"], {"m": 0.5}) == {"c1": {"m": None}}
    assert rk.fitted_quantiles(df, [], {"m": 0.5}) == {}


def test_missed_brackets_are_found_again(spark):
    """Brackets in the wrong place cost a pass over the column, never a wrong quantile."""
    rng = np.random.RandomState(6)
    a, b = rng.normal(size=500), rng.normal(size=500)
    df = frame(spark, a, b)
    edges = {"c0": [5.0, 6.0, -9.0, -8.0], "c1": None}
    pairs = df.select(F.inline(F.array(*rk.bracket_pairs(edges)))).filter("x is not null")
    got = rk.quantiles_from_brackets(df, rk.bracket_counts(pairs), ["c0", "c1"], PROBS)
    assert list(got["c0"].values()) == wanted(a) and list(got["c1"].values()) == wanted(b)


def test_few_values_are_told_apart(spark):
    """Of 200,000 different values only those near a quantile leave their task singly."""
    df = spark.range(200_000).select(F.xxhash64("id").cast("double").alias("x"))
    edges = df.agg(rk.bracket_sketch("x", dq.QUARTILES)).first()[0]
    pairs = df.select(F.inline(F.array(*rk.bracket_pairs({"x": edges}))))
    counts = rk.bracket_counts(pairs)
    assert counts.count() < 2000 and counts.agg(F.sum("cnt")).first()[0] == 200_000


def test_disjoint_brackets():
    assert rk.disjoint([3.0, 4.0, 0.0, 1.0, 1.0, 2.0]) == [(0.0, 2.0), (3.0, 4.0)]


SPEC = dq.TableSpec(("id", "y", "a", "k"), "y", ("a",), ("k",), {"k": ("u", "v")}, {"a": (0.0, 1.0)}, ("a",))


def reports(df):
    return {
        "audit": lambda: dq.audit(df, SPEC, "id", {"high": F.col("a") > 0.9}),
        "report": lambda: dq.quality_report(df, SPEC, "id"),
        "quartiles": lambda: dq.describe_quartiles(df, ["a"]),
    }


@pytest.mark.parametrize("name, scans", [("audit", 3), ("report", 3), ("quartiles", 2)])
def test_scans_of_a_report(spark, name, scans):
    seen = spark.sparkContext.accumulator(0)

    def passing(x):
        seen.add(1)
        return x

    n = 300
    spy = F.udf(passing, "double").asNondeterministic()
    raw = spark.range(n).select("id", (F.col("id") % 2).alias("y"), spy(F.col("id") / n).alias("a"), F.element_at(F.array(F.lit("u"), F.lit("w")), (F.col("id") % 2 + 1).cast("int")).alias("k"))
    # every scan runs the spy once a row: the domain check reads no other column than its own
    reports(raw)[name]().collect()
    assert 0 < seen.value <= scans * n


def test_reports_of_an_empty_and_a_null_table(spark):
    df = spark.createDataFrame([], "id long, y int, a double, k string")
    null = spark.createDataFrame([(None, None, None, None)] * 2, df.schema)
    assert {(r.section, r.item, r.metric): r.value for r in reports(df)["audit"]().collect()}[("shape", "table", "rows")] == 0
    assert reports(df)["report"]().filter("check_name = 'missing' and value > 0").count() == 0
    audit = {(r.section, r.item, r.metric): r.value for r in reports(null)["audit"]().collect()}
    assert audit[("duplicates", "table", "rows")] == 1 and audit[("duplicates", "table", "ids")] == 1
    assert audit[("target", None, "n")] == 2 and audit[("numeric", "a", "n")] == 0 and audit[("numeric", "a", "q50")] is None
    report = {(r.check_name, r.column_name): (r.value, r.severity) for r in reports(null)["report"]().collect()}
    assert report[("missing", "a")] == (2, "info") and report[("duplicates", "*")] == (1, "warning")
    assert report[("target_share", "y")][0] == 1.0 and report[("zero_variance", "a")] == (1, "warning")
