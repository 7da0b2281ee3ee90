"""Splits, samples, identity digests and leakage guards.

Exact class counts come from the rank of a seeded hash inside each class (see ``hash_rank``), never
from sorting a class in one task.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from lynceus.operators.ranking import bucket_count, hash_rank, join_groups


class LeakageError(ValueError):
    """Two row sets that must be disjoint share rows, or a subset has rows outside its superset."""


def _quota(n: int, strata: list[tuple], total: int) -> dict:
    """Largest-remainder share of ``n`` per stratum; ties go to the smaller label."""
    exact = [(label, n * cnt / total) for label, cnt in strata]
    base = {label: int(x) for label, x in exact}
    left = n - sum(base.values())
    for label, _ in sorted(exact, key=lambda t: (-(t[1] - int(t[1])), t[0] is not None, t[0]))[:left]:
        base[label] += 1
    return base


def class_counts(df: DataFrame, y: str) -> list[tuple]:
    """Label and row count: two rows for a binary label."""
    return [(r[0], r[1]) for r in df.groupBy(y).count().orderBy(y).collect()]


def _take(ranked: DataFrame, y: str, quota: dict, rank: str = "rank") -> Column:
    cond = F.lit(False)
    for label, q in quota.items():
        cond = cond | (F.col(y).eqNullSafe(F.lit(label)) & (F.col(rank) <= q))
    return cond


def stratified_split(df: DataFrame, id_col: str, y: str, test: float | int, seed: int) -> DataFrame:
    """Adds ``split`` in {train, test}: exact class counts, reproducible under repartitioning."""
    strata = class_counts(df, y)
    total = sum(c for _, c in strata)
    n_test = test if isinstance(test, int) else -int(-total * test // 1)
    quota = _quota(n_test, strata, total)
    ranked = hash_rank(df, id_col, [y], seed)
    return ranked.withColumn("split", F.when(_take(ranked, y, quota), "test").otherwise("train")).drop("rank", "n_stratum")


def fixed_split(df: DataFrame, id_col: str, y: str, n_test: int, n_small: int, seed: int) -> DataFrame:
    """Adds ``part`` in {pool, test, test_small}; ``test_small`` is nested in the hold-out.

    Both hold-outs come from the same in-class rank, so the small one is the head of the large one.
    """
    strata = class_counts(df, y)
    total = sum(c for _, c in strata)
    big = _quota(n_test, strata, total)
    small = _quota(n_small, [(k, v) for k, v in big.items()], n_test)
    ranked = hash_rank(df, id_col, [y], seed)
    return ranked.withColumn(
        "part",
        F.when(_take(ranked, y, small), "test_small").when(_take(ranked, y, big), "test").otherwise("pool"),
    ).drop("rank", "n_stratum")


def nested_key(df: DataFrame, id_col: str, y: str, seed: int | Column, by: list[str] | None = None) -> DataFrame:
    """Adds ``nest_rank``: the first s rows of this order are a stratified sample of size s, for every s.

    In-class rank r of n_class rows is placed at (r - 1/2) / n_class, which interleaves the classes
    in proportion; smaller samples are subsets of larger ones by construction. The placements are
    evenly spread over [0, 1), so the global rank is taken bucket by bucket.
    """
    by = by or []
    ranked = hash_rank(df, id_col, [*by, y], seed)
    keyed = ranked.withColumn("_key", (F.col("rank") - 0.5) / F.col("n_stratum")).drop("rank", "n_stratum")
    return _global_rank(keyed, by, y)


def _global_rank(keyed: DataFrame, by: list[str], y: str) -> DataFrame:
    n = bucket_count(keyed)
    b = keyed.withColumn("_b", F.floor(F.col("_key") * n).cast("int"))
    keys = [*by, "_b"]
    tot = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    prior = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_o"))
    local = Window.partitionBy(*keys).orderBy("_key", y)
    return join_groups(b, off, by, ["_b"]).withColumn("nest_rank", F.col("_o") + F.row_number().over(local)).drop("_b", "_key", "_o")


def nested_samples(pool: DataFrame, id_col: str, y: str, sizes: list[int], seed: int) -> DataFrame:
    """Long ``(size, pool columns)``: nested stratified samples of the requested sizes."""
    n = pool.count()
    if max(sizes) > n:
        raise ValueError(f"sample size {max(sizes)} exceeds the pool of {n} rows")
    ranked = nested_key(pool, id_col, y, seed).filter(F.col("nest_rank") <= max(sizes))
    fitting = F.filter(F.array(*[F.lit(s) for s in sorted(set(sizes))]), lambda s: s >= F.col("nest_rank"))
    return ranked.withColumn("size", F.explode(fitting)).drop("nest_rank")


def verify_nesting(samples: DataFrame, id_col: str, size: str = "size") -> DataFrame:
    """Per size: does every row also belong to the next larger sample? The largest nests trivially."""
    sizes = samples.select(size).distinct()
    nxt = sizes.select(size, F.lead(size).over(Window.partitionBy(F.lit(0)).orderBy(size)).alias("_next"))
    # the table of sizes holds one row per requested size
    tagged = samples.select(id_col, size).join(F.broadcast(nxt), size)
    # one row per id and size; membership of the next size is looked up by (id, size)
    outside = (
        tagged.filter("_next is not null")
        .join(samples.select(F.col(id_col), F.col(size).alias("_next")), [id_col, "_next"], "left_anti")
        .groupBy(size)
        .agg(F.count(F.lit(1)).alias("n_outside"))
    )
    return (
        sizes.join(outside, size, "left")
        .select(size, F.coalesce("n_outside", F.lit(0).cast("long")).alias("n_outside"))
        .withColumn("nested", F.col("n_outside") == 0)
    )


def overlap_report(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """One row: ids shared by a and b, and ids of a outside b."""
    ia, ib = a.select(id_col).distinct(), b.select(id_col).distinct()
    shared = ia.join(ib, id_col, "left_semi").agg(F.count(F.lit(1)).alias("n_shared"))
    outside = ia.join(ib, id_col, "left_anti").agg(F.count(F.lit(1)).alias("n_outside"))
    return shared.select("n_shared", outside.scalar().alias("n_outside"))


def assert_disjoint(a: DataFrame, b: DataFrame, id_col: str) -> None:
    n = overlap_report(a, b, id_col).first()["n_shared"]
    if n:
        raise LeakageError(f"{n} ids are in both sets")


def assert_subset(sub: DataFrame, sup: DataFrame, id_col: str) -> None:
    n = overlap_report(sub, sup, id_col).first()["n_outside"]
    if n:
        raise LeakageError(f"{n} ids are outside the superset")


def split_id(n_rows: int, test_size: float, seed: int, stratify: bool) -> str:
    """Short digest of the split parameters and the table size."""
    return hashlib.sha256(f"{n_rows}|{test_size}|{seed}|{stratify}".encode()).hexdigest()[:16]


def split_id_of(df: DataFrame, test_size: float, seed: int, stratify: bool) -> DataFrame:
    """The same digest computed from the table itself."""
    text = F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.lit(str(test_size)), F.lit(str(seed)), F.lit(str(stratify)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.substring(F.sha2(text, 256), 1, 16).alias("split_id"))


def config_digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def id_fingerprint(df: DataFrame, id_col: str) -> DataFrame:
    """Order-free identity of an id set: (count, sum, xor) of 60-bit id hashes, digested.

    Merges map-side, so the size of the set does not matter.
    """
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 15), 16, 10).cast("long")
    parts = df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("s"),
        F.bit_xor("h").alias("x"),
    )
    text = F.concat_ws("|", F.col("n_ids").cast("string"), F.col("s").cast("string"), F.col("x").cast("string"))
    return parts.select("n_ids", F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def table_digest(df: DataFrame) -> DataFrame:
    """Content digest of a table, independent of row order: count, sum and xor of row hashes, schema."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    parts = df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("s"),
        F.bit_xor("h").alias("x"),
    )
    text = F.concat_ws(
        "|", F.col("n").cast("string"), F.coalesce(F.col("s").cast("string"), F.lit("")),
        F.coalesce(F.col("x").cast("string"), F.lit("")), F.lit(df.schema.simpleString()),
    )
    return parts.select(F.col("n").alias("n_rows"), F.substring(F.sha2(text, 256), 1, 24).alias("digest"))


def assign_folds(
    df: DataFrame, id_col: str, y: str, k: int, seed: int | Column, fold: str = "fold", by: list[str] | None = None
) -> DataFrame:
    """Stratified K folds: every class is dealt round-robin in its seeded order."""
    ranked = hash_rank(df, id_col, [*(by or []), y], seed)
    return ranked.withColumn(fold, ((F.col("rank") - 1) % k).cast("int")).drop("rank", "n_stratum")


def repeated_folds(df: DataFrame, id_col: str, y: str, k: int, repeats: int, seed: int) -> DataFrame:
    """Long ``(repeat, fold)`` per row; every repeat deals its own seeded order."""
    long = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return assign_folds(long, id_col, y, k, F.lit(seed) + F.col("repeat"), by=["repeat"])


def seeded_draws(pool: DataFrame, id_col: str, y: str, n: int, seeds: list[int]) -> DataFrame:
    """Independent (not nested) stratified draws of n rows, one per seed."""
    long = pool.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    ranked = nested_key(long, id_col, y, F.col("seed"), by=["seed"])
    return ranked.filter(F.col("nest_rank") <= n).drop("nest_rank")


def bounded_subsample(df: DataFrame, id_col: str, y: str, n: int, seed: int) -> DataFrame:
    """At most n rows with the table's share of positives, at least one positive when there is one."""
    counts = dict(class_counts(df, y))
    n_pos_all, n_neg_all = counts.get(1, 0), counts.get(0, 0)
    n = min(n, n_pos_all + n_neg_all)
    n_pos = min(n_pos_all, max(1, round(n * n_pos_all / (n_pos_all + n_neg_all))))
    n_neg = min(n_neg_all, n - n_pos)
    n_pos = min(n_pos, n - n_neg)
    ranked = hash_rank(df, id_col, [y], seed)
    return ranked.filter(_take(ranked, y, {1: n_pos, 0: n_neg})).drop("rank", "n_stratum")


def balanced_draw(pool: DataFrame, holdout: DataFrame, id_col: str, y: str, n: int, seed: int) -> DataFrame:
    """n/2 rows per class (the rest to the negatives), none of them in the hold-out."""
    free = pool.join(holdout.select(id_col), id_col, "left_anti")
    ranked = hash_rank(free, id_col, [y], seed)
    return ranked.filter(_take(ranked, y, {1: n // 2, 0: n - n // 2})).drop("rank", "n_stratum")


def subsample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows in seeded order, or the whole table when it is smaller."""
    return hash_rank(df, id_col, [], seed).filter(F.col("rank") <= n).drop("rank", "n_stratum")


#: Columns whose cells a tolerant match is keyed on (a row looks into two cells of each), the largest level whose half units
#: a double still tells apart, and the level all greater values share.
_CELL_COLUMNS, _COUNTED, _FARTHEST = 3, 1e14, 1e17


def shared_values(a: DataFrame, b: DataFrame, cols: list[str], tol: float | None = None, rtol: float = 0.0) -> DataFrame:
    """Distinct rows of ``a`` numerically equal to some row of ``b`` on every column; with neither tolerance, by an exact semi join.

    With tolerances a value matches b's when |a - b| <= tol + rtol |b|, or when both are the same infinity; null and NaN match
    nothing. Values are laid on a scale where the tolerance is about one unit everywhere, ln(1 + rtol |x| / tol) / rtol.
    Rows that share a cell of half a unit in all columns match for sure: one semi join on distinct cells settles the crowds.
    The rest look into their own and the nearer neighbouring cell, two units wide, of up to three columns, and the values decide.
    """
    if tol is None and not rtol:
        cond = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols]
        return a.alias("l").join(b.select(*cols).distinct().alias("r"), cond, "left_semi")
    if not tol or tol < 0 or not 0 <= rtol < 1:
        raise ValueError("tolerances need tol > 0 and 0 <= rtol < 1")

    def level(c: str) -> Column:
        x = F.col(c).cast("double")
        scaled = F.signum(x) * F.log1p(F.abs(x) * (rtol / tol)) / rtol if rtol else x / tol
        return F.greatest(F.lit(-_FARTHEST), F.least(F.lit(_FARTHEST), scaled))

    numbers = lambda df: df.filter(reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols]))
    fine = [F.floor(level(c) * 2).alias(f"_f{i}") for i, c in enumerate(cols)]
    keys = [f"_f{i}" for i in range(len(cols))]
    right = numbers(b.select(*cols).distinct())
    exact = reduce(and_, [F.abs(level(c)) < _COUNTED for c in cols])
    left = numbers(a.distinct()).select("*", *fine, exact.alias("_exact"))
    cells = right.filter(exact).select(*fine).distinct().withColumn("_sure", F.lit(True))
    left = left.join(cells, keys, "left")
    sure = left.filter("_exact and _sure").select(*a.columns)

    wide = 2.0 / (1.0 - rtol) + 1e-6  # close values lie less than half of it apart
    cell = lambda c: F.floor(level(c) / wide)
    nearer = lambda c: cell(c) + F.when(level(c) / wide - cell(c) < 0.5, F.lit(-1)).otherwise(F.lit(1))
    looking = left.filter("not coalesce(_exact and _sure, false)").select(*a.columns)
    split = cols[:_CELL_COLUMNS]
    for i, c in enumerate(split):
        looking = looking.withColumn(f"_c{i}", F.explode(F.array(cell(c), nearer(c))))
    found = right.select(*[cell(c).alias(f"_k{i}") for i, c in enumerate(split)], *[F.col(c).cast("double").alias(f"_r_{c}") for c in cols])
    cond = reduce(and_, [F.col(f"_c{i}") == F.col(f"_k{i}") for i in range(len(split))])
    for c in cols:
        x, z = F.col(c).cast("double"), F.col(f"_r_{c}")
        cond = cond & ((x == z) | ((F.abs(z) < float("inf")) & (F.abs(x - z) <= tol + rtol * F.abs(z))))
    return sure.unionByName(looking.join(found, cond, "left_semi").select(*a.columns).distinct())
