"""Order-dependent building blocks that never sort a whole group in one task.

A window without a wide partition key pulls every row of a group into one task. Here each ordered
pass is split into value buckets: a small table of bucket totals gives every bucket its starting
offset and only the rows of one bucket are sorted together. The join to the offsets and the window
share one hash partitioning on (keys, bucket), so the split costs no extra shuffle of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lynceus.functions.hashing import WORD, hash_word
from lynceus.session import stored

_BUCKET = "_bucket"
_GROUP = "_group"


def with_group(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds the keys as one struct that is never null, so a null key is a group like any other.

    Grouping, join and window on this one column share a hash partitioning; a null-safe join on the keys
    themselves would hash other expressions than the window and shuffle the rows once more.
    """
    return (df.withColumn(_GROUP, F.struct(*keys)), [_GROUP]) if keys else (df, [])


def bucket_count(df: DataFrame, buckets: int | None = None) -> int:
    """Number of order buckets: follows the session's shuffle parallelism, within [8, 1024]."""
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(1024, buckets))


def with_value_bucket(df: DataFrame, order: str, n: int, bucket: str = _BUCKET) -> DataFrame:
    """Adds a monotone bucket of ``order`` with near-equal row counts, cut at the edges of one sketch.

    The edges only balance the work. Any edges give the same result, so the sketch's error is harmless.
    """
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    edges = df.select(F.percentile_approx(F.col(order), probs, 10_000)).scalar()
    return (
        df.withColumn("_edges", edges)
        # never null, so a later join on the bucket adds no null test below the aggregation
        .withColumn(bucket, F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(order))), F.lit(0)))
        .drop("_edges")
    )


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], exact: list[str] = (), how: str = "inner") -> DataFrame:
    """Joins on group ``keys`` where null is a group like any other, and on columns ``exact`` that are never null."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in (*keys, *exact) else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    for c in exact:
        on = on & (F.col(c) == F.col(f"_r_{c}"))
    return left.join(other, on, how).drop(*[f"_r_{c}" for c in (*keys, *exact)])


def running_sums(
    df: DataFrame, keys: list[str], order: str, sums: list[str], buckets: int | None = None
) -> DataFrame:
    """Adds ``{s}_before`` (sum over smaller ``order``) and ``{s}_total`` per ``keys``.

    ``(keys, order)`` must be unique: aggregate to distinct values first.
    """
    n = bucket_count(df, buckets)
    bucketed, group_key = with_group(with_value_bucket(df, order, n), keys)
    by = [*group_key, _BUCKET]
    totals = bucketed.groupBy(*by).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    group = Window.partitionBy(*(group_key or [F.lit(0)]))
    prior = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        *[F.coalesce(F.sum(f"_t_{s}").over(prior), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(group).alias(f"{s}_total") for s in sums],
    )
    local = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = bucketed.join(offsets, by)
    for s in sums:
        out = out.withColumn(f"{s}_before", F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(local), F.lit(0)))
    return out.drop(_BUCKET, _GROUP, *[f"_o_{s}" for s in sums])


def hash_rank(
    df: DataFrame, id_col: str, by: list[str], seed: int | Column, rank: str = "rank",
    size: str = "n_stratum", buckets: int | None = None,
) -> DataFrame:
    """Rank of every row in a seeded random order inside its stratum, and the stratum's size.

    The order key is a uniform hash, so equal slices of its range hold equal shares of any stratum
    and a stratum with most of the rows is still spread over all buckets.
    """
    n = bucket_count(df, buckets)
    hashed = df.withColumn("_h", hash_word(seed if isinstance(seed, Column) else F.lit(seed), F.col(id_col)))
    hashed = hashed.withColumn(_BUCKET, F.floor(F.col("_h") * n / F.lit(WORD)).cast("int"))
    hashed, group_key = with_group(hashed, by)
    keys = [*group_key, _BUCKET]
    totals = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*(group_key or [F.lit(0)]))
    offsets = totals.select(
        *keys,
        F.coalesce(
            F.sum("_n").over(group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_o"),
        F.sum("_n").over(group).alias(size),
    )
    local = Window.partitionBy(*keys).orderBy("_h", id_col)
    return (
        hashed.join(offsets, keys)
        .withColumn(rank, F.col("_o") + F.row_number().over(local))
        .drop("_h", "_o", _BUCKET, _GROUP)
    )


def value_counts_long(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """``(keys, column_name, value double, cnt)`` over non-null values: one scan, one combined shuffle."""
    keys = keys or []
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols]
    )
    return (
        df.select(*keys, F.inline(pairs))
        .filter("value is not null")
        .groupBy(*keys, "column_name", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def quantiles_from_counts(
    counts: DataFrame, keys: list[str], probs: dict[str, float], value: str = "value", cnt: str = "cnt",
    wide: Column | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per ``keys``; one column per entry of ``probs``.

    The values at the two ranks around each quantile are picked from running counts, so no group's
    values meet in one buffer (the built-in exact percentile keeps a map of all values per group).
    ``wide`` marks rows that stand for more than one value; a column ``wide`` then tells which keys hit one.
    """
    run = running_sums(counts, keys, value, [cnt])
    before, total = F.col(f"{cnt}_before"), F.col(f"{cnt}_total")
    picks, hits = [], F.lit(False)
    for name, p in probs.items():
        pos = F.lit(p) * (total - 1)
        for tag, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (before <= r) & (r < before + F.col(cnt))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{tag}_{name}"))
            hits = hits | hit
    if wide is not None:
        picks.append(F.max(hits & wide).alias("wide"))
    agg = run.groupBy(*keys).agg(F.max(total).alias("_n"), *picks)
    cols = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        between = lo + (hi - lo) * (pos - F.floor(pos))  # undefined between equal infinities
        cols.append(F.when(lo == hi, lo).otherwise(between).alias(name))
    return agg.select(*keys, *cols, *(["wide"] if wide is not None else []))


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: dict[str, float], keys: list[str] | None = None
) -> DataFrame:
    """Exact quantiles of several columns in one pass: ``(keys, column_name, one column per prob)``."""
    keys = keys or []
    return quantiles_from_counts(value_counts_long(df, cols, keys), [*keys, "column_name"], probs)


# ---- quantiles without a shuffle of all values ---------------------------------------------------

#: The sketch places a value within 1 / SKETCH of the rows of its rank; brackets reach twice as far.
SKETCH = 10_000


def bracket_sketch(c: str, probs: dict[str, float]) -> Column:
    """Aggregate of one column: lower and upper edge of a bracket around every quantile, in turn.

    It is mergeable and of bounded size, so it may stand beside any other aggregates of the same scan.
    """
    around = [min(1.0, max(0.0, p + d)) for p in probs.values() for d in (-2 / SKETCH, 2 / SKETCH)]
    return F.percentile_approx(F.col(c).cast("double"), F.array(*[F.lit(p) for p in around]), SKETCH)


def disjoint(edges: list[float]) -> list[tuple[float, float]]:
    """Brackets in order, those that meet as one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(zip(edges[::2], edges[1::2])):
        if out and not lo > out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def bracket_pairs(edges: dict[str, list[float] | None]) -> list[Column]:
    """Per column a struct ``(column_name, gap, value, x)``: ``value`` is null between the brackets.

    Grouped by the first three, all rows of a gap meet in one count before any shuffle, and only the values of
    the brackets (about 4 / SKETCH of the rows for each quantile) are told apart.
    """
    pairs = []
    for c, found in edges.items():
        x, gap, inside = F.col(c).cast("double"), F.lit(0), F.lit(False)
        for lo, hi in disjoint(found or []):
            gap = gap + (x > F.lit(hi)).cast("int")
            inside = inside | x.between(F.lit(lo), F.lit(hi))
        pairs.append(F.struct(
            F.lit(c).alias("column_name"), gap.alias("gap"), F.when(inside, x).alias("value"), x.alias("x")))
    return pairs


def bracket_counts(pairs: DataFrame) -> DataFrame:
    """``(column_name, value, top, cnt)``: a gap is listed by its smallest value, ``top`` is its largest one."""
    grouped = pairs.groupBy("column_name", "gap", F.col("value").alias("v"))
    return grouped.agg(F.min("x").alias("value"), F.max("x").alias("top"), F.count(F.lit(1)).alias("cnt")).drop("gap", "v")


def quantiles_from_brackets(df: DataFrame, counts: DataFrame, cols: list[str], probs: dict[str, float]) -> dict[str, dict[str, float]]:
    """``{column: {name: value}}`` from stored ``bracket_counts``; one number per column and quantile reaches the driver.

    A rank that fell into a gap (the sketch missed its bound) is found again among all values of its column.
    """
    rows = quantiles_from_counts(counts, ["column_name"], probs, wide=F.col("value") < F.col("top")).collect()
    again = [r["column_name"] for r in rows if r["wide"]]
    if again:
        rows = [r for r in rows if not r["wide"]] + exact_quantiles(df, again, probs).collect()
    found = {r["column_name"]: {p: r[p] for p in probs} for r in rows}
    return {c: found.get(c, dict.fromkeys(probs)) for c in cols}


def fitted_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float]) -> dict[str, dict[str, float]]:
    """The quantiles of ``exact_quantiles`` on the driver, ``{column: {name: value}}``, from two scans.

    The first scan sketches a bracket for every quantile, the second counts the values within the brackets and
    the rows between them. A column without a value has quantiles None; NaN is the largest number.
    """
    if not cols:
        return {}
    edges = df.agg(*[bracket_sketch(c, probs).alias(str(i)) for i, c in enumerate(cols)]).first()
    pairs = df.select(F.inline(F.array(*bracket_pairs(dict(zip(cols, edges)))))).filter("x is not null")
    return quantiles_from_brackets(df, stored(bracket_counts(pairs)), cols, probs)
