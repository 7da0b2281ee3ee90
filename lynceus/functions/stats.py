"""Small statistical helpers as column expressions (no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

Z_975 = 1.959963984540054

#: Two-sided 95 % Student t quantiles for 1..30 degrees of freedom (fixed values).
T_975 = [
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
]

#: Coefficients of the rational approximation to the normal tail (Abramowitz and Stegun 26.2.17, fixed values).
_PHI_P = 0.2316419
_PHI_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)), absolute error below 1.6e-7."""
    a = F.abs(z)
    t = 1.0 / (1.0 + _PHI_P * a)
    poly = F.lit(0.0)
    for b in reversed(_PHI_B):
        poly = t * (F.lit(b) + poly)
    return F.least(F.lit(1.0), F.lit(2.0) * F.exp(-a * a / 2.0) / F.lit(math.sqrt(2 * math.pi)) * poly)


def t_quantile_975(df: Column) -> Column:
    """t(0.975, df) from the table up to 30, the Cornish-Fisher expansion above it."""
    table = F.array(*[F.lit(v) for v in T_975])
    z = Z_975
    v = df.cast("double")
    tail = (
        F.lit(z)
        + F.lit((z**3 + z) / 4) / v
        + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (v * v)
    )
    return F.when(df < 1, F.lit(None).cast("double")).when(
        df <= len(T_975), F.try_element_at(table, df.cast("int"))
    ).otherwise(tail)


def log_factorial(n: Column) -> Column:
    """ln(n!): exact products up to 15, Stirling series above (relative error below 1e-13)."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = F.greatest(n.cast("double"), F.lit(1.0)) + 1.0
    series = (
        (x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi))
        + 1.0 / (12.0 * x) - 1.0 / (360.0 * x * x * x) + 1.0 / (1260.0 * F.pow(x, F.lit(5.0)))
    )
    return F.when(n <= 15, F.try_element_at(table, n.cast("int") + 1)).otherwise(series)


def binomial_two_sided_p(b: Column, c: Column) -> Column:
    """Exact two-sided sign-test p of b against c discordant pairs; 1 when there are none.

    The tail is summed downwards from its largest term, each the one before times i / (n - i + 1). A term d below it is
    at most exp(-2 d^2 / n) of it, so 20 sqrt(n) terms hold all that a double can: one formula for every n.
    """
    n, low = b + c, F.least(b, c)
    first = F.exp(log_factorial(n) - log_factorial(low) - log_factorial(n - low) - n * F.lit(math.log(2.0)))
    terms = F.least(low, F.ceil(F.sqrt(n.cast("double")) * 20).cast("long"))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), terms),
        F.struct(F.lit(0.0).alias("sum"), first.alias("term")),
        lambda acc, d: F.struct(
            (acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * (low - d).cast("double") / (n - low + d + 1).cast("double")).alias("term")),
        lambda acc: acc["sum"])
    return F.when((n == 0) | (b == c), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * tail))
