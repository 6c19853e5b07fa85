"""Estimates of aggregates from a sample and the errors of the estimates, as columns.

``p`` is the sample's share, ``n`` the matching sampled rows, ``tsize`` the rows of the whole table, ``s`` the sample's
standard deviation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for "unknown": an error where too few rows match.
UNKNOWN_ERROR = 1e9
MIN_SUPPORT = 30


def est_count(n: Column, p: Column) -> Column:
    return F.bround(n / p).cast("double")


def est_sum(total: Column, p: Column) -> Column:
    return total / p


def est_var_samp(n: Column, var: Column) -> Column:
    """The finite-sample factor is applied on top of the unbiased variance; one row has no variance."""
    return F.when(n > 1, n / (n - 1) * var).otherwise(F.when(n == 1, F.lit(0.0)))


def est_var_pop(n: Column, var: Column) -> Column:
    return F.when(n > 1, var).otherwise(F.when(n == 1, F.lit(0.0)))


def err_count(n: Column, p: Column, tsize: Column) -> Column:
    share = n / (tsize * p)
    return tsize * F.sqrt(F.greatest(F.lit(0.0), (1 - p) * share * (1 - share)) / (p * (tsize - 1)))


def err_sum(s: Column, p: Column, tsize: Column) -> Column:
    return tsize * s * F.sqrt((1 - p) / (p * (tsize - 1)))


def err_avg(s: Column, n: Column) -> Column:
    return s / F.sqrt(n)


def err_var(n: Column, var: Column, sample: bool = False) -> Column:
    base = 2 * var * var / (n - 1)
    return base * F.pow(n / (n - 1), F.lit(2)) if sample else base


def guarded(error: Column, n: Column, p: Column, min_support: int = MIN_SUPPORT) -> Column:
    """No error for the whole table, unknown below the support, else the closed form."""
    return F.when(F.abs(p - 1) < 1e-9, F.lit(0.0)).when(n < min_support, F.lit(UNKNOWN_ERROR)).otherwise(error)


def distribution(error: Column, aggregate: str, replicates: Column | None = None) -> Column:
    tag = F.when(F.abs(error) < 1e-9, F.lit("fixed"))
    if replicates is not None:
        tag = tag.when(F.coalesce(F.size(replicates), F.lit(0)) > 2, F.lit("unknown"))
    return tag.otherwise(F.lit("r-normal" if aggregate == "max" else "normal"))


#: Coefficients of Acklam's rational approximation of the inverse normal distribution (fixed values).
CENTRE = ([-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239], [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0])
TAIL = ([-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783], [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0])
TAIL_FROM = 0.02425


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_ppf(u: Column) -> Column:
    """Inverse of the standard normal distribution."""
    q = u - 0.5
    middle = _horner(CENTRE[0], q * q) * q / _horner(CENTRE[1], q * q)
    low = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    tail = _horner(TAIL[0], low) / _horner(TAIL[1], low)
    return F.when(u < TAIL_FROM, tail).when(u > 1 - TAIL_FROM, -tail).otherwise(middle)


def sql_normal_ppf(u: str) -> str:
    """The same as SQL text, for comparing engines."""

    def horner(coefficients, x):
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    q = f"({u} - 0.5)"
    low = f"sqrt(-2 * ln(least({u}, 1 - {u})))"
    tail = f"({horner(TAIL[0], low)} / {horner(TAIL[1], low)})"
    middle = f"({horner(CENTRE[0], f'({q} * {q})')} * {q} / {horner(CENTRE[1], f'({q} * {q})')})"
    return f"(CASE WHEN {u} < {TAIL_FROM} THEN {tail} WHEN {u} > 1 - {TAIL_FROM} THEN -{tail} ELSE {middle} END)"


#: Coefficients of the rational approximation 26.2.17 of the normal distribution function (fixed values; error below 1e-7).
CDF = (0.2316419, [1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530])


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function."""
    t = 1 / (1 + CDF[0] * F.abs(z))
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * t * _horner(CDF[1], t)
    return F.when(z < 0, upper).otherwise(1 - upper)


def sql_normal_cdf(z: str) -> str:
    """The same as SQL text."""
    t = f"(1 / (1 + {CDF[0]!r} * abs({z})))"
    out = repr(CDF[1][0])
    for c in CDF[1][1:]:
        out = f"({out} * {t} + {c!r})"
    upper = f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * {t} * {out})"
    return f"(CASE WHEN {z} < 0 THEN {upper} ELSE 1 - {upper} END)"
