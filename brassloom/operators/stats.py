"""Is it skill or luck: probabilistic and deflated Sharpe ratios, hurdles, a Sharpe difference test.

Sharpe ratios in here are per period, kurtosis is the plain one (3 for a normal distribution).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brassloom.functions.normal import cdf, quantile_sql

EULER_GAMMA = 0.5772156649015329


def psr(df: DataFrame, sr: str, hurdle: Column, n: str, skew: str, kurt: str, to: str) -> DataFrame:
    """df with the probability that the true ratio is above the hurdle."""
    spread = 1.0 - F.col(skew) * F.col(sr) + (F.col(kurt) - 1.0) / 4.0 * F.pow(F.col(sr), F.lit(2.0))
    z = F.when((F.col(n) >= 3) & (spread > 0), (F.col(sr) - hurdle) * F.sqrt(F.col(n) - 1) / F.sqrt(F.when(spread > 0, spread)))
    return df.withColumn("_z", z).withColumn(to, cdf("_z")).drop("_z")


def expected_max(df: DataFrame, n_trials: str, variance: str, to: str) -> DataFrame:
    """df with the greatest ratio to expect among n_trials without skill."""
    e = f"{math.e:.17e}"
    a, b = quantile_sql(f"(1e0 - 1e0 / {n_trials})"), quantile_sql(f"(1e0 - 1e0 / ({n_trials} * {e}))")
    value = F.expr(f"sqrt({variance}) * ({1 - EULER_GAMMA:.17e} * {a} + {EULER_GAMMA:.17e} * {b})")
    return df.withColumn(to, F.when((F.col(n_trials) <= 1) | (F.col(variance) <= 0), F.lit(0.0)).otherwise(value))


def deflated(df: DataFrame, n_trials: str = "n_trials", variance: str = "variance") -> DataFrame:
    """df (sr_period, n_periods, skew, kurt and the two names) with sr0, psr_zero and dsr, and their 252-period yearly values."""
    df = expected_max(df, n_trials, variance, "sr0")
    df = psr(df, "sr_period", F.lit(0.0), "n_periods", "skew", "kurt", "psr_zero")
    df = psr(df, "sr_period", F.col("sr0"), "n_periods", "skew", "kurt", "dsr")
    return df.withColumn("sr_ann", F.col("sr_period") * math.sqrt(252)).withColumn("sr0_ann", F.col("sr0") * math.sqrt(252))


def hurdle_variance(trials: DataFrame, keys: list[str], sr: str, n_obs: Column) -> DataFrame:
    """keys, plain, robust, iid and used: the variance that sets the hurdle, the larger of a robust one and 1/T."""
    good = trials.where(F.col(sr).isNotNull() & ~F.isnan(sr))
    centre = good.groupBy(*keys).agg(F.percentile(sr, 0.5).alias("_m"), F.var_samp(sr).alias("plain"), F.count("*").alias("n"))
    spread = good.join(centre, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(sr) - F.col("_m")), 0.5).alias("_mad"))
    out = centre.join(spread, keys).withColumn("iid", F.lit(1.0) / F.greatest(n_obs, F.lit(2)))
    out = out.withColumn("robust", F.when(F.col("n") > 2, F.pow(1.4826 * F.col("_mad"), F.lit(2.0)))).withColumn("plain", F.when(F.col("n") > 2, F.col("plain")))
    return out.select(*keys, "n", "plain", "robust", "iid", F.greatest(F.coalesce("robust", F.lit(0.0)), F.col("iid")).alias("used"))


def sharpe_difference(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, n, z and one-sided p that the ratio of a is above that of b (Jobson and Korkie, corrected by Memmel)."""
    df = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.avg(a), F.stddev_samp(a)).alias("_a"), F.try_divide(F.avg(b), F.stddev_samp(b)).alias("_b"), F.corr(a, b).alias("_rho"))
    sa, sb, rho = F.col("_a"), F.col("_b"), F.col("_rho")
    v = (2 - 2 * rho + 0.5 * (sa * sa + sb * sb - 2 * sa * sb * rho * rho)) / F.col("n")
    out = out.withColumn("z", F.when((F.col("n") >= 10) & (v > 0), (sa - sb) / F.sqrt(F.when(v > 0, v))))
    return out.withColumn("p", 1 - cdf("z")).select(*keys, "n", "z", "p")


def nelder_mead(f, x0: list[float], steps: int = 400, tol: float = 1e-8) -> np.ndarray:
    """Least value of f by the simplex method of Nelder and Mead."""
    n = len(x0)
    points = [np.array(x0, float)]
    for i in range(n):
        p = np.array(x0, float)
        p[i] += 0.05 * abs(p[i]) or 0.00025
        points.append(p)
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tol and max(np.abs(p - points[0]).max() for p in points) < tol:
            break
        centre = np.mean(points[:-1], axis=0)
        towards = lambda t: centre + t * (points[-1] - centre)
        one = towards(-1.0)
        v = f(one)
        if v < values[0]:
            two = towards(-2.0)
            points[-1], values[-1] = min(((two, f(two)), (one, v)), key=lambda pv: pv[1])
        elif v < values[-2]:
            points[-1], values[-1] = one, v
        else:
            near = towards(-0.5) if v < values[-1] else towards(0.5)
            nv = f(near)
            if nv < min(v, values[-1]):
                points[-1], values[-1] = near, nv
            else:
                points = [points[0], *[points[0] + 0.5 * (p - points[0]) for p in points[1:]]]
                values = [values[0], *[f(p) for p in points[1:]]]
    return points[int(np.argmin(values))]
