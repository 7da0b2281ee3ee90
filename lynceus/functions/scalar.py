"""Row-level expressions: targets, derived vitals, bands, residuals. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values the scoring contract is defined with.
RISK_HIGH, RISK_MEDIUM = 0.66, 0.33
DAYS_PER_YEAR = 365.25
SIGMOID_CLIP = 30.0


def binary_target(graded: Column, threshold: float = 0.0) -> Column:
    """1 when the graded label exceeds the threshold; an unknown label stops the job."""
    return F.when(
        graded.isNull(), F.raise_error(F.lit("graded label is null")).cast("int")
    ).otherwise((graded > threshold).cast("int"))


def years_from_days(days: Column) -> Column:
    return days / F.lit(DAYS_PER_YEAR)


def recode(col: Column, positive) -> Column:
    return F.coalesce((col == positive).cast("int"), F.lit(0))


def body_mass_index(weight: Column, height_cm: Column) -> Column:
    return weight / F.pow(height_cm / 100.0, F.lit(2.0))


def pulse_pressure(hi: Column, lo: Column) -> Column:
    return hi - lo


def mean_arterial_pressure(hi: Column, lo: Column) -> Column:
    return lo + (hi - lo) / 3.0


def risk_band(p: Column, high: float = RISK_HIGH, medium: float = RISK_MEDIUM) -> Column:
    return F.when(p >= high, "HIGH").when(p >= medium, "MEDIUM").otherwise("LOW")


def confidence(p: Column, threshold: float = 0.5) -> Column:
    """Distance from the decision threshold, rescaled to [0, 1]."""
    return F.least(F.lit(1.0), F.abs(p - threshold) / threshold)


def outcome_class(y: Column, p: Column, threshold: float = 0.5) -> Column:
    return (
        F.when((p >= threshold) & (y == 1), "TP")
        .when((p >= threshold) & (y == 0), "FP")
        .when((p < threshold) & (y == 1), "FN")
        .when((p < threshold) & (y == 0), "TN")
    )


def margin(p: Column) -> Column:
    return F.abs(p - 0.5)


def residual(y: Column, p: Column) -> Column:
    return y - p


def sigmoid(x: Column) -> Column:
    clipped = F.greatest(F.lit(-SIGMOID_CLIP), F.least(F.lit(SIGMOID_CLIP), x))
    return 1.0 / (1.0 + F.exp(-clipped))


def fit_width(v: Column, width: int) -> Column:
    """Pad a vector with zeros, or cut it, to exactly ``width`` entries."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), width)), 1, width)


#: Fixed values of the additive screening score: base, weights, clip and bands.
SCREEN_BASE, SCREEN_PRESSURE, SCREEN_AGE, SCREEN_LEVEL = 0.12, 0.45, 0.25, 0.15
SCREEN_CLIP = (0.05, 0.95)
SCREEN_BANDS = (0.6, 0.3)


def linear_risk(pressure: Column, age: Column, level: Column) -> Column:
    """Additive clipped screening score over pressure, age and a 1..3 level (null level = 1)."""
    raw = (
        F.lit(SCREEN_BASE)
        + (pressure - 90.0) / 100.0 * SCREEN_PRESSURE
        + (age - 30.0) / 50.0 * SCREEN_AGE
        + (F.coalesce(level, F.lit(1)) - 1) / 2.0 * SCREEN_LEVEL
    )
    return F.least(F.greatest(raw, F.lit(SCREEN_CLIP[0])), F.lit(SCREEN_CLIP[1]))


def screening_band(p: Column) -> Column:
    return risk_band(p, high=SCREEN_BANDS[0], medium=SCREEN_BANDS[1])


def metabolic_index(level: Column, p: Column) -> Column:
    return level * 15.0 + p * 40.0


def stiffness_index(hi: Column, lo: Column) -> Column:
    return (hi - lo) * 0.85
