"""Row derivations over tables: engineered columns, nested bundles, scenarios, search, column presets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lynceus.functions import scalar as sc


def derive_features(df: DataFrame, age_days: str = "age", sex: str = "gender", label: str = "cardio") -> DataFrame:
    """Adds age in years, a 0/1 sex column (code 2 is male) and an integer copy of the label."""
    return df.withColumns({
        "age_years": sc.years_from_days(F.col(age_days)),
        "gender_male": sc.recode(F.col(sex), 2),
        "target": F.col(label).cast("int"),
    })


def engineer_features(df: DataFrame) -> DataFrame:
    """Adds BMI, pulse pressure, mean arterial pressure and age x level."""
    return df.withColumns({
        "bmi": sc.body_mass_index(F.col("weight"), F.col("height")),
        "pulse_pressure": sc.pulse_pressure(F.col("ap_hi"), F.col("ap_lo")),
        "mean_arterial_pressure": sc.mean_arterial_pressure(F.col("ap_hi"), F.col("ap_lo")),
        "age_x_cholesterol": F.col("age_years") * F.col("cholesterol"),
    })


@dataclass(frozen=True)
class FeatureGroups:
    """Which columns belong to which semantic type; the order is part of the contract."""

    continuous: tuple[str, ...] = ()
    discrete: tuple[str, ...] = ()
    ordinal: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    nominal: tuple[str, ...] = ()

    @property
    def numeric(self) -> tuple[str, ...]:
        return self.continuous + self.discrete

    @property
    def all(self) -> tuple[str, ...]:
        return self.numeric + self.ordinal + self.binary + self.nominal


#: Fixed column layouts of the two cohorts.
SITE_GROUPS = FeatureGroups(
    continuous=("age", "trestbps", "chol", "thalach", "oldpeak"), discrete=("ca",), ordinal=("slope",),
    binary=("sex", "fbs", "exang"), nominal=("cp", "restecg", "thal"),
)
LARGE_GROUPS = FeatureGroups(
    continuous=("age_years", "height", "weight", "ap_hi", "ap_lo"), ordinal=("cholesterol", "gluc"),
    binary=("gender_male", "smoke", "alco", "active"),
)
#: Results of late specialist tests, left out of the screening preset.
LATE_TESTS = ("ca", "thal")


def feature_set(groups: FeatureGroups, preset: str, late: tuple[str, ...] = LATE_TESTS) -> FeatureGroups:
    """``full`` keeps every column, ``screening`` drops the late tests."""
    if preset == "full":
        return groups
    if preset != "screening":
        raise ValueError(f"unknown preset {preset!r}: expected 'full' or 'screening'")
    drop = lambda cols: tuple(c for c in cols if c not in late)
    return FeatureGroups(*(drop(getattr(groups, f)) for f in ("continuous", "discrete", "ordinal", "binary", "nominal")))


# ---- nested bundles -----------------------------------------------------------------------------

_CODING = T.ArrayType(T.StructType([T.StructField("system", T.StringType()), T.StructField("code", T.StringType())]))
_RESOURCE_FIELDS = [
    T.StructField("resourceType", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("birthDate", T.StringType()),
    T.StructField("code", T.StructType([T.StructField("text", T.StringType()), T.StructField("coding", _CODING)])),
    T.StructField("valueQuantity", T.StructType([T.StructField("value", T.DoubleType())])),
]
BUNDLE_SCHEMA = T.StructType([
    *_RESOURCE_FIELDS,
    T.StructField("entry", T.ArrayType(T.StructType([T.StructField("resource", T.StructType(_RESOURCE_FIELDS))]))),
])

#: Fixed values of the bundle contract: codes and display words per field, in order of precedence.
OBSERVATION_RULES = [
    ("ap_hi", ("8480-6", "55284-4"), "systolic"),
    ("ap_lo", ("8462-4",), "diastolic"),
    ("cholesterol", ("2093-3", "14647-2"), "cholesterol"),
    ("gluc", ("2339-0", "15074-8"), "glucose"),
    ("height", ("8302-2",), "height"),
    ("weight", ("29463-7",), "weight"),
]
#: Fixed clamps of measured values and cut points of the two graded ones.
CLAMPS = {"ap_hi": (70, 240), "ap_lo": (40, 150), "height": (120, 220), "weight": (30, 200)}
LEVEL_CUTS = {"cholesterol": (200, 240), "gluc": (120, 180)}
AGE_CLAMP = (18, 100)
#: Fixed values used where a bundle says nothing.
BUNDLE_DEFAULTS = {
    "age_years": 52.0, "height": 168.0, "weight": 78.5, "ap_hi": 130.0, "ap_lo": 85.0, "cholesterol": 2, "gluc": 1,
    "gender_male": 1, "smoke": 0, "alco": 0, "active": 1,
}


def flatten_bundle(df: DataFrame, json_col: str, as_of_year: int) -> DataFrame:
    """Replaces a JSON bundle by its flat subject columns, row by row and without a shuffle.

    An observation belongs to the first rule one of its codes or its text matches. Within a field the
    last non-zero value wins; the last patient resource wins likewise.
    """
    doc = F.from_json(F.col(json_col), BUNDLE_SCHEMA)
    names = [f.name for f in _RESOURCE_FIELDS]
    own = F.struct(*[F.col("_doc")[n].alias(n) for n in names])
    is_bundle = (F.col("_doc.resourceType") == "Bundle") & F.col("_doc.entry").isNotNull()
    items = F.when(is_bundle, F.transform("_doc.entry", lambda e: e["resource"])).otherwise(F.array(own))

    # a rule's position is its precedence: the smallest position any code or the text reaches wins
    code_rank = F.create_map(*[
        x for i, (_, codes, _) in enumerate(OBSERVATION_RULES) for c in codes for x in (F.lit(c), F.lit(i))
    ])
    fields = F.array(*[F.lit(f) for f, _, _ in OBSERVATION_RULES])

    def text_rank(text: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, (_, _, word) in reversed(list(enumerate(OBSERVATION_RULES))):
            out = F.when(F.contains(text, F.lit(word)), i).otherwise(out)
        return out

    observations = F.transform(
        F.filter("_items", lambda r: (r["resourceType"] == "Observation") & (r["valueQuantity"]["value"] != 0)),
        lambda r: F.struct(
            F.try_element_at(fields, F.least(
                F.array_min(F.transform(r["code"]["coding"], lambda c: F.try_element_at(code_rank, c["code"]))),
                text_rank(F.lower(r["code"]["text"])),
            ) + 1).alias("field"),
            r["valueQuantity"]["value"].alias("value"),
        ),
    )
    patients = F.filter("_items", lambda r: r["resourceType"] == "Patient")
    staged = (
        df.withColumn("_doc", doc)
        .withColumn("_items", items)
        .withColumn("_obs", observations)
        .withColumn("_pat", patients)
    )

    def last(field: str) -> Column:
        return F.try_element_at(F.filter("_obs", lambda o: o["field"] == field), F.lit(-1))["value"]

    def clamped(field: str) -> Column:
        lo, hi = CLAMPS[field]
        v = F.col(f"_last_{field}")
        # least and greatest skip nulls, so an absent value must be kept apart
        return F.when(v.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v)))

    def graded(field: str) -> Column:
        mid, high = LEVEL_CUTS[field]
        v = F.col(f"_last_{field}")
        return F.when(v > high, 3).when(v > mid, 2).when(v.isNotNull(), 1)

    genders = F.transform("_pat", lambda p: F.lower(F.coalesce(p["gender"], F.lit("male"))).isin("male", "m").cast("int"))
    years = F.filter(
        F.transform("_pat", lambda p: F.split(p["birthDate"], "-")[0].try_cast("int")), lambda y: y.isNotNull()
    )
    year = F.try_element_at(years, F.lit(-1))
    age = F.greatest(F.lit(AGE_CLAMP[0]), F.least(F.lit(AGE_CLAMP[1]), F.lit(as_of_year) - year)).cast("double")
    values = {
        "age_years": F.when(year.isNotNull(), age),
        "gender_male": F.try_element_at(genders, F.lit(-1)),
        **{f: clamped(f) for f in CLAMPS},
        **{f: graded(f) for f in LEVEL_CUTS},
    }
    flat = {c: F.coalesce(values.get(c, F.lit(None)), F.lit(d)) for c, d in BUNDLE_DEFAULTS.items()}
    rest = [c for c in df.columns if c != json_col]
    found = staged.withColumns({f"_last_{f}": last(f) for f, _, _ in OBSERVATION_RULES})
    return found.select(*rest, *[v.alias(k) for k, v in flat.items()])


# ---- scenarios, batches, search -----------------------------------------------------------------


def what_if(df: DataFrame, id_col: str, scenarios: dict[str, dict[str, float]], scorer) -> DataFrame:
    """Scores every row before and after each scenario's field deltas.

    ``scorer(df)`` adds ``proba``. Base and modified rows go through one scoring pass; scenarios are
    laid out next to the row, so there is no join between rows and scenarios.
    """
    fields = sorted({f for deltas in scenarios.values() for f in deltas})
    base = F.struct(F.lit("").alias("scenario"), *[F.lit(0.0).alias(f"_d_{f}") for f in fields])
    moves = [
        F.struct(F.lit(name).alias("scenario"), *[F.lit(float(d.get(f, 0.0))).alias(f"_d_{f}") for f in fields])
        for name, d in scenarios.items()
    ]
    df = df.withColumn("_row", F.struct(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id")))
    laid = df.select(*df.columns, F.inline(F.array(base, *moves)))
    moved = laid.withColumns({f: F.col(f) + F.col(f"_d_{f}") for f in fields}).drop(*[f"_d_{f}" for f in fields])
    scored = scorer(moved).select("_row", "scenario", F.round("proba", 4).alias("proba"))
    # one row per input row, also where an id repeats: the scenarios of a row are a fixed handful
    per_id = scored.groupBy("_row").agg(
        F.max(F.when(F.col("scenario") == "", F.col("proba"))).alias("base_proba"),
        *[F.max(F.when(F.col("scenario") == n, F.col("proba"))).alias(f"_p_{i}") for i, n in enumerate(scenarios)],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(f"_p_{i}").alias("proba")) for i, n in enumerate(scenarios)])
    delta = F.col("proba") - F.col("base_proba")
    return per_id.select(F.col("_row.id").alias(id_col), "base_proba", F.inline(rows)).select(
        id_col, "scenario", "base_proba", F.col("proba").alias("modified_proba"),
        sc.risk_band(F.col("base_proba")).alias("base_band"), sc.risk_band(F.col("proba")).alias("modified_band"),
        F.round(delta * 100, 2).alias("delta_percent"), (delta < 0).alias("reduced"),
    )


def linear_risk(df: DataFrame, pressure: str, age: str, level: str) -> DataFrame:
    p = sc.linear_risk(F.col(pressure), F.col(age), F.col(level))
    return df.withColumn("proba", p).withColumn("band", sc.screening_band(F.col("proba")))


def band_counts(scored: DataFrame) -> DataFrame:
    """Batch summary: rows per band and the mean score, one aggregate."""
    n = lambda b: F.sum((F.col("band") == b).cast("long"))
    return scored.agg(
        F.count(F.lit(1)).alias("total"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"),
        F.round(F.avg("proba"), 3).alias("avg_proba"),
    )


def composite_indices(df: DataFrame, level: str, proba: str, hi: str, lo: str) -> DataFrame:
    return df.withColumns({
        "metabolic_index": sc.metabolic_index(F.col(level), F.col(proba)),
        "stiffness_index": sc.stiffness_index(F.col(hi), F.col(lo)),
    })


def search(df: DataFrame, term: str, cols: list[str]) -> DataFrame:
    """Rows where any of the columns contains the term, ignoring case."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(term.lower())), F.lit(False))
    return df.filter(cond)
