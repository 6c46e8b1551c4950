"""The normal distribution as SQL expressions that Spark and DuckDB both run, without a UDF.

Numbers are written with an exponent, which makes them doubles in either dialect.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximation of the normal distribution function after Hart (1968), as published by West (2005).
_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def number(x: float) -> str:
    return f"{x:.17e}"


def _horner(coefficients: tuple[float, ...], z: str) -> str:
    out = number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {z} + {number(c)})"
    return out


def cdf_sql(x: str) -> str:
    """Probability that a standard normal value is at most x."""
    z = f"abs({x})"
    near = f"({_horner(_ABOVE, z)} / {_horner(_BELOW, z)})"
    far = f"(1e0 / (2.506628274631e0 * ({z} + 1e0 / ({z} + 2e0 / ({z} + 3e0 / ({z} + 4e0 / ({z} + 6.5e-1)))))))"
    tail = f"(CASE WHEN {z} > 37e0 THEN 0e0 WHEN {z} < 7.07106781186547e0 THEN exp(-{z} * {z} / 2e0) * {near} ELSE exp(-{z} * {z} / 2e0) * {far} END)"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) > 0e0 THEN 1e0 - {tail} ELSE {tail} END)"


def cdf(x: str) -> Column:
    """cdf_sql of a column, by its name. As a lambda's variable the value is computed once, however often the formula names it."""
    return F.expr(f"transform(array({x}), z_ -> {cdf_sql('z_')})[0]")


def quantile(p: float) -> float:
    """Inverse of the distribution function, for numbers that the driver has."""
    return NormalDist().inv_cdf(p)


# Acklam's rational approximation of the inverse (relative error 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def quantile_sql(p: str) -> str:
    """Inverse distribution function of a column of probabilities; NULL outside (0, 1)."""
    low, q = f"sqrt(-2e0 * ln({p}))", f"({p} - 5e-1)"
    high = f"sqrt(-2e0 * ln(1e0 - {p}))"
    tail = lambda u: f"({_horner(_C, u)} / {_horner(_D, u)})"
    middle = f"({_horner(_A, f'({q} * {q})')} * {q} / {_horner(_B, f'({q} * {q})')})"
    return f"(CASE WHEN ({p}) <= 0e0 OR ({p}) >= 1e0 THEN NULL WHEN {p} < 2.425e-2 THEN {tail(low)} WHEN {p} > 9.7575e-1 THEN -{tail(high)} ELSE {middle} END)"
