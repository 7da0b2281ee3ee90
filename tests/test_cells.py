"""Level dictionaries and tolerant matches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.operators import features as ft, sampling as sp


def test_levels_get_dense_places_at_any_bucketing(spark):
    rows = [(i, f"k{i}", "x" if i % 3 else None) for i in range(200)] + [(200, "k5", "w"), (201, None, None)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    for buckets in (1, 7, 1024):
        d = ft.level_dictionary(df, ["a", "b"], buckets).collect()
        places = sorted(r.place for r in d if r.place is not None)
        assert places == list(range(199 + 1)) and sorted(r.value for r in d if r.place is None) == ["k0", "w"]
        assert max(r.place for r in d if r.column_name == "a" and r.place is not None) == 198


def test_sparse_levels_equal_dense_ones(spark, monkeypatch):
    """Frequent and rare levels, unknown and null values, a level with a third of the rows."""
    monkeypatch.setattr(ft, "FREQUENT_SHARE", 20)
    train = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"v{i}", i % 4) for i in range(120)], "id long, a string, b int")
    held = spark.createDataFrame([(1, "hot", 0), (2, "v7", 3), (3, "new", None), (4, None, 9)], "id long, a string, b int")
    d = ft.level_dictionary(train, ["a", "b"])
    place = {(r.column_name, r.value): r.place for r in d.collect()}
    for df in (train, held):
        got = {r.id: r.places for r in ft.encode_levels(df, ["a", "b"], d, 120).collect()}
        for r in df.collect():
            want = [place.get(("a", r.a)), place.get(("b", None if r.b is None else str(r.b)))]
            assert got[r.id] == sorted(p for p in want if p is not None)
    assert ft.level_dictionary(train.filter("false"), ["a", "b"]).count() == 0


def brute(a, b, tol, rtol):
    """Rows of a close to some row of b; equal infinities are close, NaN is not."""
    return [i for i, x in enumerate(a) if any(np.isclose(x, z, rtol=rtol, atol=tol).all() for z in b)]


@pytest.mark.parametrize("tol, rtol", [(1e-8, 1e-5), (0.01, 0.0), (1e-3, 0.2), (1e-12, 0.5)])
def test_tolerant_match_is_isclose(spark, tol, rtol):
    rng = np.random.RandomState(11)
    wide = np.sign(rng.normal(size=(150, 2))) * np.exp(rng.uniform(-12, 12, size=(150, 2)))
    b = np.vstack([wide, [[0.0, 0.0], [np.inf, 1.0], [-np.inf, np.inf], [np.nan, 1.0], [1e300, 1e300]], rng.uniform(0.5, 0.5001, size=(80, 2))])
    step = rng.choice([0.0, 0.3, 0.9, 0.999, 1.001, 1.2, 3.0], size=wide.shape) * np.sign(rng.normal(size=wide.shape))
    a = np.vstack([wide + step * (tol + rtol * np.abs(wide)), b, -b[:20], rng.uniform(0.5, 0.5001, size=(80, 2))])
    frame = lambda x: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, u double, v double")
    got = sp.shared_values(frame(a), frame(b).drop("id"), ["u", "v"], tol=tol, rtol=rtol)
    assert sorted(r.id for r in got.collect()) == brute(a, b, tol, rtol)


def test_tolerant_match_of_a_crowd_nulls_and_empty(spark):
    """A third of the rows share a cell in both tables; null matches nothing, repeated rows come once."""
    near = [(i, 0.5 + 1e-9 * i, 2.0) for i in range(300)]
    rest = [(300 + i, float(i), -1.0) for i in range(600)]
    a = spark.createDataFrame([*near, *rest, (900, None, 2.0), near[0]], "id long, u double, v double")
    b = spark.createDataFrame([(0.5 + 1e-9 * i, 2.0) for i in range(300)] + [(None, 2.0), (7.0, -1.0)], "u double, v double")
    got = sp.shared_values(a, b, ["u", "v"], tol=1e-6, rtol=1e-6)
    assert sorted(r.id for r in got.collect()) == [*range(300), 307]
    assert sp.shared_values(a, b.filter("false"), ["u", "v"], tol=1e-6).count() == 0
    with pytest.raises(ValueError):
        sp.shared_values(a, b, ["u", "v"], rtol=0.1)
