"""The standard normal distribution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Coefficients of Acklam's rational approximation of the quantile function (relative error under 1.2e-9).
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425

# Coefficients of Hart's approximation of the distribution function in the form given by West (double precision).
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(x: Column, coefficients) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def _horner_sql(x: str, coefficients) -> str:
    total = f"({coefficients[0]!r}::DOUBLE)"
    for c in coefficients[1:]:
        total = f"({total} * ({x}) + ({c!r}))"
    return total


def ppf_sql(p: str) -> str:
    """norm_ppf of a DuckDB expression within (0, 1)."""
    tail = lambda t: f"{_horner_sql(t, TAIL_TOP)} / {_horner_sql(t, TAIL_BOTTOM)}"
    q = f"({p} - 0.5)"
    return f"CASE WHEN {p} < {TAIL} THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > {1 - TAIL} THEN -({tail(f'sqrt(-2 * ln(1 - {p}))')}) ELSE {_horner_sql(q + ' * ' + q, CENTRE_TOP)} * {q} / {_horner_sql(q + ' * ' + q, CENTRE_BOTTOM)} END"


def cdf_sql(x: str) -> str:
    """norm_cdf of a DuckDB expression within -7 and 7."""
    upper = f"(exp(-({x}) * ({x}) / 2) * {_horner_sql(f'abs({x})', HART_TOP)} / {_horner_sql(f'abs({x})', HART_BOTTOM)})"
    return f"CASE WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END"


def norm_ppf(p: Column) -> Column:
    """The quantile of p; infinite at 0 and 1, null outside."""
    q, low, high = p - 0.5, F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    tail = lambda t: _horner(t, TAIL_TOP) / _horner(t, TAIL_BOTTOM)
    centre = _horner(q * q, CENTRE_TOP) * q / _horner(q * q, CENTRE_BOTTOM)
    inside = F.when(p < TAIL, tail(low)).when(p > 1 - TAIL, -tail(high)).otherwise(centre)
    return F.when(p == 0, float("-inf")).when(p == 1, float("inf")).when((p > 0) & (p < 1), inside)


def norm_cdf(x: Column) -> Column:
    """The share below x."""
    z = F.abs(x)
    bell = F.exp(-z * z / 2)
    # A continued fraction far out.
    far = z + F.lit(0.65)
    for k in (4, 3, 2, 1):
        far = z + F.lit(float(k)) / far
    upper = F.when(z > 37, 0.0).when(z < 7.07106781186547, bell * _horner(z, HART_TOP) / _horner(z, HART_BOTTOM)).otherwise(bell / far / 2.506628274631)
    return F.when(x > 0, 1 - upper).otherwise(upper)
