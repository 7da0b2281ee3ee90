"""Audits, quality reports, plausibility flags, guards and contracts.

Per-column statistics come from one aggregate over the table; anything that needs distinct values
comes from one (column, value, count) table, so a report is a fixed number of scans whatever its width.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from lynceus.operators.ranking import (
    bracket_counts, bracket_pairs, bracket_sketch, quantiles_from_brackets, quantiles_from_counts, value_counts_long,
)
from lynceus.session import stored


class ValidationError(ValueError):
    """A table breaks an invariant later stages depend on."""


def flag(cond: Column) -> Column:
    """A comparison with null counts as False."""
    return F.coalesce(cond, F.lit(False))


def count_where(cond: Column) -> Column:
    return F.coalesce(F.sum(flag(cond).cast("long")), F.lit(0).cast("long"))


def profile(df: DataFrame, metrics: dict[str, dict[str, Column]], key: str = "column_name") -> DataFrame:
    """One aggregate over ``df`` turned into one row per entry of ``metrics``."""
    aggs = [c.alias(f"{i}|{m}") for i, ms in enumerate(metrics.values()) for m, c in ms.items()]
    rows = F.array(*[
        F.struct(F.lit(name).alias(key), *[F.col(f"`{i}|{m}`").alias(m) for m in ms])
        for i, (name, ms) in enumerate(metrics.items())
    ])
    return df.agg(*aggs).select(F.inline(rows))


@dataclass(frozen=True)
class TableSpec:
    """What a table promises: columns in order, target, categories, domains, ranges, zero sentinels."""

    columns: tuple[str, ...]
    target: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    domains: dict[str, tuple] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    zero_sentinels: tuple[str, ...] = ()


def validate_structure(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Named structural violations ``(check_name, column_name, n_bad)``; no rows means valid."""
    present = set(df.columns)
    metrics: dict[str, dict[str, Column]] = {}
    n = F.count(F.lit(1))

    def add(check, column, value):
        metrics[f"{check}|{column}"] = {"n_bad": value}

    add("empty_table", "*", (n == 0).cast("long"))
    for c in spec.columns:
        if c not in present:
            add("missing_column", c, F.lit(1).cast("long"))
    for c in df.columns:
        if c not in spec.columns:
            add("unexpected_column", c, F.lit(1).cast("long"))
    kept = [c for c in df.columns if c in spec.columns]
    if kept != list(spec.columns) and set(kept) == set(spec.columns):
        add("column_order", "*", F.lit(1).cast("long"))
    if spec.target in present:
        t = F.col(spec.target)
        add("null_target", spec.target, count_where(t.isNull()))
        # two different values exist exactly when the smallest and the largest differ
        add("single_class", spec.target, flag(F.min(t) == F.max(t)).cast("long"))
    for c in kept:
        if c != spec.target:
            text = F.col(c).cast("string")
            add("not_numeric", c, count_where(text.isNotNull() & text.try_cast("double").isNull()))
    long = profile(df, metrics, key="_k").filter("n_bad > 0")
    return long.select(
        F.split_part("_k", F.lit("|"), F.lit(1)).alias("check_name"),
        F.split_part("_k", F.lit("|"), F.lit(2)).alias("column_name"),
        "n_bad",
    )


def missing_report(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return profile(df, {
        c: {
            "n_missing": count_where(F.col(c).isNull()),
            "pct_missing": F.round(count_where(F.col(c).isNull()) * 100.0 / n, 2),
        }
        for c in df.columns
    })


def row_digest(df: DataFrame, cols: list[str]) -> Column:
    """SHA-256 of the values of ``cols``; null differs from any text, both zeros of a float are one."""
    kinds = dict(df.dtypes)
    text = lambda c: (F.col(c) + F.lit(0).cast(kinds[c]) if kinds[c] in ("float", "double") else F.col(c)).cast("string")
    parts = [F.coalesce(F.concat(F.lit("v"), text(c)), F.lit("n")) for c in cols]
    # every part is prefixed by its length, so different rows cannot spell the same text
    return F.sha2(F.concat(F.lit(""), *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def duplicate_rows(df: DataFrame, subset: list[str], id_col: str) -> DataFrame:
    """Ids of rows that repeat an earlier row (smallest id kept) on ``subset``.

    Rows travel as a digest of the subset. The first id per digest is pre-aggregated and kept only
    where something repeats, so a hot value costs one row on that side and can be split on the other.
    """
    keyed = df.select(F.col(id_col), row_digest(df, subset).alias("_k"))
    first = keyed.groupBy("_k").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return keyed.join(first, "_k").filter(F.col(id_col) > F.col("first_id")).select(id_col, "first_id")


def duplicate_count(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows beyond the first of every distinct ``subset``, and how many values repeat."""
    groups = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicates"), count_where(F.col("n") > 1).alias("n_repeated")
    )


def duplicate_summary(df: DataFrame, id_col: str) -> DataFrame:
    """Duplicates ignoring the id, and duplicate ids: digests of both kinds counted in one scan and one shuffle."""
    rest = [c for c in df.columns if c != id_col]
    digests = df.select(row_digest(df, rest).alias("rows"), row_digest(df, [id_col]).alias("ids"))  # once a row, then listed
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.unhex(kind).alias("k")) for kind in ("rows", "ids")])
    counts = digests.select(F.inline(kinds)).groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n"))
    beyond = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n") - 1))
    return counts.agg(beyond("rows").alias("n_duplicate_rows"), beyond("ids").alias("n_duplicate_ids"))


def moments(c: str) -> dict[str, Column]:
    x = F.col(c).cast("double")
    return {"n": F.count(c), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "std": F.stddev_samp(x)}


def column_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-null count, range, mean and sample deviation per column: one aggregate."""
    return profile(df, {c: moments(c) for c in cols})


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """min, max, mean, median, sample deviation and distinct count per column, 3 decimals.

    The distinct count is exact, so every distinct value is shuffled once; the median comes from the same counts.
    """
    counts = value_counts_long(df, cols)
    med = quantiles_from_counts(counts, ["column_name"], {"median": 0.5})
    unique = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))
    return column_moments(df, cols).join(med, "column_name").join(unique, "column_name").select(
        "column_name", *[F.round(c, 3).alias(c) for c in ("min", "max", "mean", "median", "std")], "n_unique"
    )


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def scan_metrics(df: DataFrame, metrics: dict) -> dict:
    """All ``metrics`` of a table from one aggregate, on the driver: as many values as the caller names."""
    return dict(zip(metrics, df.agg(*[c.alias(str(i)) for i, c in enumerate(metrics.values())]).first()))


def quartile_metrics(cols: list[str]) -> dict:
    """What the first scan gathers for ``quartile_rows``: moments and brackets of the quartiles."""
    out = {(c, m): col for c in cols for m, col in moments(c).items()}
    return out | {(c, "edges"): bracket_sketch(c, QUARTILES) for c in cols}


def quartile_rows(df: DataFrame, cols: list[str], seen: dict, counts: DataFrame) -> DataFrame:
    """One row per column from the metrics of the first scan and the bracket counts of the second."""
    quart = quantiles_from_brackets(df, counts, cols, QUARTILES)
    names = ("n", "mean", "std", "min", *QUARTILES, "max")
    rows = [(c, *[quart[c][m] if m in QUARTILES else seen[c, m] for m in names]) for c in cols]
    local = df.sparkSession.createDataFrame(rows, "column_name string, " + ", ".join(f"{m} {'long' if m == 'n' else 'double'}" for m in names))
    return local.select("column_name", "n", *[F.round(m, 6).alias(m) for m in names[1:]])


def describe_quartiles(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, deviation, range and exact quartiles per column: two scans, no shuffle of all values.

    A column without a value has count 0 and null statistics.
    """
    seen = scan_metrics(df, quartile_metrics(cols))
    pairs = df.select(F.inline(F.array(*bracket_pairs({c: seen[c, "edges"] for c in cols})))).filter("x is not null")
    return quartile_rows(df, cols, seen, stored(bracket_counts(pairs)))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts of every non-null value of every categorical column, values as text."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols
    ])
    return (
        df.select(F.inline(pairs)).filter("value is not null")
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def domain_violations(df: DataFrame, domains: dict[str, tuple]) -> DataFrame:
    """Observed values outside the allowed set of their column, with counts."""
    allowed = F.lit(False)
    for c, values in domains.items():
        allowed = allowed | ((F.col("column_name") == c) & F.col("value").isin(*[str(v) for v in values]))
    return value_counts(df, list(domains)).filter(~allowed)


def sentinel_counts(df: DataFrame, cols: list[str], sentinel: float = 0) -> DataFrame:
    return profile(df, {c: {"n_sentinel": count_where(F.col(c) == sentinel)} for c in cols})


def apply_sentinels(df: DataFrame, sentinels: dict[str, list]) -> DataFrame:
    """Declared placeholder values become null; run it before any statistic."""
    return df.withColumns({c: F.when(~flag(F.col(c).isin(*vals)), F.col(c)) for c, vals in sentinels.items()})


def out_of_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return profile(df, {
        c: {"n_out": count_where((F.col(c) < lo) | (F.col(c) > hi))} for c, (lo, hi) in ranges.items()
    })


def zero_variance(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns with at most one distinct non-null value: smallest equals largest, or neither exists."""
    flags = profile(df, {
        c: {"constant": F.coalesce(F.min(c) == F.max(c), F.lit(True))} for c in cols
    })
    return flags.filter("constant").select("column_name")


def target_distribution(df: DataFrame, y: str, threshold: float = 0, alarm: float = 0.20) -> DataFrame:
    """Raw and binarised label counts with shares; ``alarm`` marks a small minority class."""
    raw = df.groupBy(F.col(y).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    both = raw.select(F.lit("raw").alias("kind"), "value", "n").unionByName(
        raw.groupBy((F.col("value") > threshold).cast("double").alias("value"))
        .agg(F.sum("n").alias("n")).select(F.lit("binary").alias("kind"), "value", "n")
    )
    per_kind = Window.partitionBy("kind")  # one row per label value
    share = F.col("n") / F.sum("n").over(per_kind)
    return both.select(
        "kind", "value", "n", F.round(share, 6).alias("share"),
        ((F.col("kind") == "binary") & (F.min("n").over(per_kind) / F.sum("n").over(per_kind) < alarm)).alias("minority_alarm"),
    )


def quality_report(df: DataFrame, spec: TableSpec, id_col: str, threshold: float = 0, alarm: float = 0.20) -> DataFrame:
    """All checks as long rows ``(check_name, column_name, value, severity)`` from three scans.

    Missing values, sentinels, ranges, constant columns and label shares come from one aggregate; values outside
    their domain need a count per value, duplicates a count per row digest.
    """
    warn = lambda cond: F.when(cond, "warning").otherwise("info")
    feats = [c for c in df.columns if c not in (spec.target, id_col)]
    checks: list[tuple] = []  # name, column, value; condition of the row, condition of a warning (over _v, the value)
    v, always, never = F.col("_v"), F.lit(True), F.lit(False)
    for c in df.columns:
        checks.append(("missing", c, count_where(F.col(c).isNull()), always, never))
    for c in spec.zero_sentinels:
        checks.append(("zero_sentinel", c, count_where(F.col(c) == 0), always, v > 0))
    for c, (lo, hi) in spec.ranges.items():
        checks.append(("out_of_range", c, count_where((F.col(c) < lo) | (F.col(c) > hi)), always, v > 0))
    for c in feats:
        checks.append(("zero_variance", c, F.coalesce(F.min(c) == F.max(c), F.lit(True)).cast("long"), v > 0, always))
    y = F.col(spec.target).cast("double") > threshold
    for label, cond in ((f"{spec.target}=0", ~y), (f"{spec.target}=1", y), (spec.target, y.isNull())):
        checks.append(("target_share", label, count_where(cond), v > 0, F.col("_minority") < alarm))
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[value.alias(f"_c{i}") for i, (_, _, value, _, _) in enumerate(checks)])
    classes = [F.col(f"_c{i}") for i, check in enumerate(checks) if check[0] == "target_share"]
    one = one.withColumn("_minority", F.least(*[F.when(n > 0, n) for n in classes]) / F.col("_n"))
    flat = one.select("_n", "_minority", F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.col(f"_c{i}").alias("_v")) for i in range(len(checks))
    ])))
    pick = lambda part: F.element_at(F.array(*[part(check) for check in checks]), F.col("_i") + 1)
    name = pick(lambda check: F.lit(check[0]))
    scanned = flat.filter(pick(lambda check: check[3])).select(
        name.alias("check_name"), pick(lambda check: F.lit(check[1])).alias("column_name"),
        F.when(name == "target_share", F.round(v / F.col("_n"), 6)).when(name == "zero_variance", 1.0).otherwise(v.cast("double")).alias("value"),
        warn(pick(lambda check: check[4])).alias("severity"),
    )
    beyond = duplicate_count(df, [c for c in df.columns if c != id_col]).select(F.col("n_duplicates").cast("double").alias("value"))
    duplicates = beyond.select(F.lit("duplicates").alias("check_name"), F.lit("*").alias("column_name"), "value", warn(F.col("value") > 0).alias("severity"))
    out = scanned.unionByName(duplicates)
    if spec.domains:
        out = out.unionByName(domain_violations(df, spec.domains).select(
            F.lit("domain").alias("check_name"), F.concat_ws("=", "column_name", "value").alias("column_name"),
            F.col("n").cast("double").alias("value"), F.lit("warning").alias("severity")))
    return out


# ---- plausibility flags -------------------------------------------------------------------------


def range_rule(col: str, lo: float | None = None, hi: float | None = None) -> Column:
    cond = F.lit(False)
    if lo is not None:
        cond = cond | (F.col(col) < lo)
    if hi is not None:
        cond = cond | (F.col(col) > hi)
    return cond


#: Fixed plausibility bounds of the large-cohort layout (mmHg, cm, kg).
VITAL_BOUNDS = {"ap_hi": (60, 250), "ap_lo": (40, 200), "height": (100, 220), "weight": (30, None)}


def vital_rules() -> dict[str, Column]:
    """The five rules of the large-cohort layout, one of them across two columns."""
    rules = {f"{c}_implausible": range_rule(c, lo, hi) for c, (lo, hi) in VITAL_BOUNDS.items()}
    rules["ap_hi_below_ap_lo"] = F.col("ap_hi") < F.col("ap_lo")
    return rules


def plausibility_flags(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds one boolean per rule and ``any_flag``; never drops a row."""
    flags = {name: flag(cond) for name, cond in rules.items()}
    any_flag = F.lit(False)
    for f in flags.values():
        any_flag = any_flag | f
    return df.withColumns({**flags, "any_flag": any_flag})


def flag_metrics(names: list[str]) -> dict[str, Column]:
    share = F.avg(F.col("any_flag").cast("double")) * 100
    return {
        "n_total": F.count(F.lit(1)),
        **{n: count_where(F.col(n)) for n in names},
        "any_flag_count": count_where(F.col("any_flag")),
        "any_flag_percent": F.round(share, 6),
        "clean_count": count_where(~F.col("any_flag")),
        "clean_percent": F.round(100 - share, 6),
    }


def flag_summary(flagged: DataFrame, names: list[str]) -> DataFrame:
    return flagged.agg(*[c.alias(name) for name, c in flag_metrics(names).items()])


def target_rate_by_flag(flagged: DataFrame, y: str) -> DataFrame:
    """Label rate of flagged and clean rows: shows whether dropping flagged rows shifts the label."""
    return flagged.groupBy("any_flag").agg(
        F.round(F.avg(F.col(y).cast("double")), 6).alias("target_rate"), F.count(F.lit(1)).alias("n")
    )


def split_clean(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modelling rows, excluded rows): a partition of the input."""
    return flagged.filter(~F.col("any_flag")), flagged.filter("any_flag")


def audit(df: DataFrame, spec: TableSpec, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """Full audit as long rows ``(section, item, metric, value)`` from three scans.

    The first gathers all counts, moments, flags, label rates and quantile brackets in one aggregate. The second
    counts the values of categories, of the label and of the brackets in one shuffle; rows between brackets meet
    in one count per task. The third counts duplicates by digest.
    """
    flagged = plausibility_flags(df, rules)
    numeric, labels = list(spec.numeric), [spec.target, *spec.categorical]
    y, summary = F.col(spec.target).cast("double"), flag_metrics(list(rules))
    kinds = {"flagged": F.col("any_flag"), "clean": ~F.col("any_flag")}
    seen = scan_metrics(flagged, quartile_metrics(numeric) | {
        **{("missing", c): count_where(F.col(c).isNull()) for c in df.columns},
        **{("flags", m): c for m, c in summary.items()},
        **{("rate", k): F.round(F.avg(F.when(cond, y)), 6) for k, cond in kinds.items()},
        **{("n", k): count_where(cond) for k, cond in kinds.items()},
    })

    pairs = [p.withField("text", F.lit(None).cast("string")) for p in bracket_pairs({c: seen[c, "edges"] for c in numeric})]
    none = F.lit(None).cast("double")
    for i, c in enumerate(labels):  # the label first; numbered, since a column may be a number and a category
        pairs.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(-1 - i).alias("gap"), none.alias("value"), none.alias("x"),
            F.col(c).cast("string").alias("text")))
    long = df.select(F.inline(F.array(*pairs))).filter("gap < 0 or x is not null").filter("gap >= -1 or text is not null")
    counts = stored(long.groupBy("column_name", "gap", F.col("value").alias("v"), "text").agg(
        F.min("x").alias("value"), F.max("x").alias("top"), F.count(F.lit(1)).alias("cnt")))

    fixed = [("shape", "table", "rows", seen["flags", "n_total"]), ("shape", "table", "columns", len(df.columns))]
    fixed += [("missing", c, "n", seen["missing", c]) for c in df.columns if seen["missing", c] > 0]
    fixed += [("flags", "table", m, seen["flags", m]) for m in summary]
    for k in kinds:
        if seen["n", k]:
            fixed += [("rate_by_flag", k, "rate", seen["rate", k]), ("rate_by_flag", k, "n", seen["n", k])]
    schema = "section string, item string, metric string, value double"
    out = df.sparkSession.createDataFrame([(*r[:3], None if r[3] is None else float(r[3])) for r in fixed], schema)

    def rows(d: DataFrame, section: str, item: Column, metrics: dict[str, Column]) -> DataFrame:
        pairs = F.array(*[
            F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()
        ])
        return d.select(F.lit(section).alias("section"), item.alias("item"), F.inline(pairs))

    v = F.col
    if numeric:
        quart = quartile_rows(df, numeric, seen, counts.filter("gap >= 0").select("column_name", "value", "top", "cnt"))
        out = out.unionByName(rows(quart, "numeric", v("column_name"), {c: v(c) for c in quart.columns if c != "column_name"}))
    return (
        out.unionByName(rows(duplicate_summary(df, id_col), "duplicates", F.lit("table"), {"rows": v("n_duplicate_rows"), "ids": v("n_duplicate_ids")}))
        .unionByName(rows(counts.filter("gap = -1"), "target", v("text"), {"n": v("cnt")}))
        .unionByName(rows(counts.filter("gap < -1"), "categorical", F.concat_ws("=", "column_name", "text"), {"n": v("cnt")}))
    )


# ---- assertions and contracts -------------------------------------------------------------------


def matrix_violations(
    df: DataFrame, cols: list[str], lo: float | None = None, hi: float | None = None, atol: float = 1e-8,
    label: str | None = None,
) -> DataFrame:
    """Nulls, non-finite and out-of-range cells per column, bad labels: one aggregate."""
    metrics = {}
    for c in cols:
        x = F.col(c).cast("double")
        finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
        out = F.lit(False)
        if lo is not None:
            out = out | (x < lo - atol)
        if hi is not None:
            out = out | (x > hi + atol)
        metrics[c] = {
            "n_missing": count_where(x.isNull() | F.isnan(x)),
            "n_infinite": count_where(F.abs(x) == float("inf")),
            "n_outside": count_where(finite & out),
        }
    if label:
        y = F.col(label)
        metrics[label] = {
            "n_missing": count_where(y.isNull()), "n_infinite": F.lit(0).cast("long"), "n_outside": count_where(~y.isin(0, 1)),
        }
    return profile(df, metrics)


def assert_matrix(
    df: DataFrame, cols: list[str], *, lo: float | None = None, hi: float | None = None, label: str | None = None,
    expected_rows: int | None = None, expected_cols: int | None = None,
) -> None:
    """Raises ``ValidationError`` naming every broken invariant."""
    if expected_cols is not None and len(cols) != expected_cols:
        raise ValidationError(f"{len(cols)} columns, expected {expected_cols}")
    bad = matrix_violations(df, cols, lo, hi, label=label).filter("n_missing + n_infinite + n_outside > 0").collect()
    if bad:
        raise ValidationError("; ".join(
            f"{r.column_name}: {r.n_missing} missing, {r.n_infinite} infinite, {r.n_outside} outside" for r in bad
        ))
    if expected_rows is not None and (n := df.count()) != expected_rows:
        raise ValidationError(f"{n} rows, expected {expected_rows}")


def closeness(a: DataFrame, b: DataFrame, key: str, cols: list[str], rtol: float = 1e-8, atol: float = 1e-10) -> DataFrame:
    """Keyed comparison of two tables: rows on one side only, and per column max gap and cells apart."""
    j = a.select(key, *[F.col(c).alias(f"l_{c}") for c in cols], F.lit(1).alias("_l")).join(
        b.select(key, *[F.col(c).alias(f"r_{c}") for c in cols], F.lit(1).alias("_r")), key, "full_outer"
    )
    unmatched = count_where(F.col("_l").isNull() | F.col("_r").isNull())
    metrics = {}
    for c in cols:
        l, r = F.col(f"l_{c}"), F.col(f"r_{c}")
        gap = F.abs(l - r)
        metrics[c] = {
            "n_unmatched": unmatched,
            "max_abs_diff": F.round(F.max(gap), 9),
            "n_apart": count_where((gap > atol + rtol * F.abs(r)) | (l.isNull() != r.isNull())),
        }
    return profile(j, metrics)


def assert_close(a: DataFrame, b: DataFrame, key: str, cols: list[str], rtol: float = 1e-8, atol: float = 1e-10) -> None:
    bad = closeness(a, b, key, cols, rtol, atol).filter("n_unmatched > 0 or n_apart > 0").collect()
    if bad:
        raise ValidationError("; ".join(f"{r.column_name}: max difference {r.max_abs_diff}, {r.n_apart} apart" for r in bad))


def scoring_readiness(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Per required column: present, declared type matched, nulls; a missing column makes it invalid."""
    types = dict(df.dtypes)
    metrics = {}
    for c, t in required.items():
        present = c in types
        metrics[c] = {
            "present": F.lit(present),
            "type_ok": F.lit(present and types[c] == t),
            "n_missing": count_where(F.col(c).isNull()) if present else F.lit(None).cast("long"),
            "n_records": F.count(F.lit(1)),
            "table_valid": F.lit(all(k in types for k in required)),
        }
    return profile(df, metrics)


#: Fixed request bounds per column of the scoring contract.
REQUEST_BOUNDS = {
    "age_years": (1, 120), "height": (100, 250), "weight": (20, 300), "ap_hi": (60, 300), "ap_lo": (30, 200),
    "cholesterol": (1, 3), "gluc": (1, 3), "gender_male": (0, 1), "smoke": (0, 1), "alco": (0, 1), "active": (0, 1),
}


def contract_reasons(bounds: dict[str, tuple[float, float]]) -> Column:
    """Array of broken bounds of a row; a null value breaks its bound."""
    checks = [
        F.when(F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi), F.lit(c)) for c, (lo, hi) in bounds.items()
    ]
    return F.filter(F.array(*checks), lambda r: r.isNotNull())


def quarantine(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``reasons``)."""
    tagged = df.withColumn("reasons", contract_reasons(bounds))
    return tagged.filter(F.size("reasons") == 0).drop("reasons"), tagged.filter(F.size("reasons") > 0)


@dataclass(frozen=True)
class GuardSpec:
    """Hard bounds and the centre and scale of the distance; the defaults are fixed values."""

    ap_hi: tuple[float, float] = (70, 220)
    ap_lo: tuple[float, float] = (40, 140)
    age: tuple[float, float] = (10, 110)
    bmi: tuple[float, float] = (12, 65)
    centre: tuple[float, float, float, float] = (120, 80, 50, 25)
    scale: tuple[float, float, float, float] = (30, 20, 20, 10)
    decay: float = 0.1
    min_score: float = 0.40
    #: Values used where a field is absent: ap_hi, ap_lo, age_years, height, weight.
    defaults: tuple[float, float, float, float, float] = (130, 85, 52, 168, 78)


def ood_guard(df: DataFrame, spec: GuardSpec = GuardSpec()) -> DataFrame:
    """Adds distance, in-distribution score, warnings and a three-level verdict per row."""
    names = ("ap_hi", "ap_lo", "age_years", "height", "weight")
    hi, lo, age, height, weight = (
        F.coalesce(F.col(c).cast("double"), F.lit(float(d))) for c, d in zip(names, spec.defaults)
    )
    bmi = weight / F.pow(height / 100.0, F.lit(2.0))
    z = [(x - m) / s for x, m, s in zip((hi, lo, age, bmi), spec.centre, spec.scale)]
    d2 = z[0] * z[0] + z[1] * z[1] + z[2] * z[2] + z[3] * z[3]
    score = F.round(F.exp(-spec.decay * d2), 4)
    outside = lambda x, b: (x < b[0]) | (x > b[1])
    warnings = F.array(
        F.when(outside(hi, spec.ap_hi), "extreme_systolic"),
        F.when(outside(lo, spec.ap_lo), "extreme_diastolic"),
        F.when(hi <= lo, "inverted_pressure"),
        F.when(outside(age, spec.age), "age_out_of_bounds"),
        F.when(outside(bmi, spec.bmi), "extreme_bmi"),
        F.when(score < spec.min_score, "low_similarity"),
    )
    n = F.size("warnings")
    return (
        df.withColumn("distance", F.round(F.sqrt(d2), 3))
        .withColumn("similarity", score)
        .withColumn("warnings", F.filter(warnings, lambda w: w.isNotNull()))
        .withColumn("is_ood", n > 0)
        .withColumn("verdict", F.when(n == 0, "in_distribution").when(n > 1, "high_outlier").otherwise("moderate_deviation"))
    )


def runs_consistent(scores: DataFrame, run: str = "run", id_col: str = "id", y: str = "y", proba: str = "proba") -> DataFrame:
    """One row: do all runs score the same ids once, with the same labels and valid probabilities?

    The number of runs is a one-value subquery; the per-id check is one combined aggregate.
    """
    per_pair = scores.groupBy(id_col, run).agg(
        F.count(F.lit(1)).alias("_n"), F.min(y).alias("_y0"), F.max(y).alias("_y1"),
        count_where(~flag(F.col(proba).between(0.0, 1.0))).alias("_bad"),
    )
    n_runs = scores.select(run).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    per_id = per_pair.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_runs"), F.max("_n").alias("_rep"), F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1"),
        F.sum("_bad").alias("_bad"),
    ).withColumn("_n_runs", n_runs)
    return per_id.agg(
        count_where(F.col("_runs") != F.col("_n_runs")).alias("n_ids_missing"),
        count_where(F.col("_rep") > 1).alias("n_ids_repeated"),
        count_where(F.col("_y0") != F.col("_y1")).alias("n_label_conflicts"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("n_bad_proba"),
    ).withColumn(
        "consistent", (F.col("n_ids_missing") + F.col("n_ids_repeated") + F.col("n_label_conflicts") + F.col("n_bad_proba")) == 0
    )


def assert_runs_consistent(scores: DataFrame, **names) -> None:
    r = runs_consistent(scores, **names).first()
    if not r["consistent"]:
        raise ValidationError(f"runs differ: {r.asDict()}")


def subgroup_metrics(scores: DataFrame, dims: list[str], y: str = "y", pred: str = "pred", gap: float = 0.10) -> DataFrame:
    """Sensitivity and specificity per slice of every dimension and overall, in one pass.

    ``disparity`` marks a slice whose sensitivity or specificity is more than ``gap`` from the overall.
    """
    slices = F.array(
        F.struct(F.lit("all").alias("dim"), F.lit("all").alias("level")),
        *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("level")) for d in dims],
    )
    # (dim, level, y, pred) has few values: pairs combine map-side before the shuffle
    agg = scores.select(y, pred, F.inline(slices)).groupBy("dim", "level").agg(
        F.count(F.lit(1)).alias("n"),
        count_where((F.col(y) == 1) & (F.col(pred) == 1)).alias("tp"), count_where((F.col(y) == 1) & (F.col(pred) == 0)).alias("fn"),
        count_where((F.col(y) == 0) & (F.col(pred) == 0)).alias("tn"), count_where((F.col(y) == 0) & (F.col(pred) == 1)).alias("fp"),
    )
    rated = agg.withColumn("sensitivity", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn(
        "specificity", F.try_divide("tn", F.col("tn") + F.col("fp"))
    )
    overall = rated.filter("dim = 'all'")
    far = lambda m: flag(F.abs(F.col(m) - F.col(f"_all_{m}")) > gap)
    return (
        rated.withColumn("_all_sensitivity", overall.select("sensitivity").scalar())
        .withColumn("_all_specificity", overall.select("specificity").scalar())
        .select(
            "dim", "level", "n", F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"),
            (far("sensitivity") | far("specificity")).alias("disparity"),
        )
    )
