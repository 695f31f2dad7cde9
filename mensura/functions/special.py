"""Distribution functions as Column expressions.

Spark has no erf, gamma or beta function, so tails are built from series and
continued fractions with ``aggregate(sequence(...))``.  They run on result rows
(one per test), not on raw data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Coefficients of Acklam's rational approximation to the normal quantile.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00)
ACKLAM_LOW = 0.02425


def _col(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def bind(fn, **values: Column) -> Column:
    """``fn(**values)`` with every value computed once.

    A lambda variable stands for the value, so a long formula does not repeat
    the expressions it is built on.
    """
    packed = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(packed), lambda r: fn(**{k: r[k] for k in values})), F.lit(0))


def erfc(x) -> Column:
    """Complementary error function, relative error near 1e-13."""
    return bind(_erfc, x=_col(x).cast("double"))


def _erfc(x: Column) -> Column:
    a = F.abs(x)
    # erf(a) = 2/sqrt(pi) * exp(-a^2) * a * sum_n (2 a^2)^n / (2n+1)!!, nested from the inside out
    factors = F.expr("array(" + ", ".join(f"{2.0 / (2.0 * n + 1.0)!r}D" for n in range(48, 0, -1)) + ")")
    series = a * F.aggregate(factors, F.lit(1.0), lambda total, f: total * (a * a * f) + 1.0)
    small = 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-a * a) * series
    fraction = F.aggregate(
        F.sequence(F.lit(40), F.lit(1), F.lit(-1)), a, lambda acc, k: a + (k / 2.0) / acc
    )
    large = F.exp(-a * a) / math.sqrt(math.pi) / fraction
    upper = F.when(a < 2.5, small).otherwise(large)
    return F.when(x >= 0, upper).otherwise(2.0 - upper)


def normal_sf(z) -> Column:
    return erfc(_col(z) / math.sqrt(2.0)) * 0.5


def normal_two_sided_p(z) -> Column:
    """``2 * P(Z > |z|)``."""
    return erfc(F.abs(_col(z)) / math.sqrt(2.0))


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p) -> Column:
    """Inverse normal CDF: rational start plus one Halley step; null outside (0, 1)."""
    return bind(_normal_quantile, p=_col(p).cast("double"))


def _normal_quantile(p: Column) -> Column:
    tail_low = F.sqrt(-2.0 * F.log(p))
    tail_high = F.sqrt(-2.0 * F.log(1.0 - p))
    q = p - 0.5
    r = q * q
    one = F.lit(1.0)
    low = _horner(ACKLAM_C, tail_low) / (_horner(ACKLAM_D, tail_low) * tail_low + one)
    high = -_horner(ACKLAM_C, tail_high) / (_horner(ACKLAM_D, tail_high) * tail_high + one)
    mid = _horner(ACKLAM_A, r) * q / (_horner(ACKLAM_B, r) * r + one)
    start = F.when(p < ACKLAM_LOW, low).when(p > 1.0 - ACKLAM_LOW, high).otherwise(mid)
    refined = bind(lambda x: _halley(x, p), x=start)
    return F.when((p > 0) & (p < 1), refined)


def _halley(x: Column, p: Column) -> Column:
    error = erfc(-x / math.sqrt(2.0)) * 0.5 - p
    u = error * math.sqrt(2.0 * math.pi) * F.exp(x * x / 2.0)
    return x - u / (1.0 + x * u / 2.0)


def log_gamma(x) -> Column:
    """ln Gamma for x > 0: Stirling series after shifting the argument by eight."""
    return bind(_log_gamma, x=_col(x).cast("double"))


def _log_gamma(x: Column) -> Column:
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + float(k))
    y = x + 8.0
    y2 = y * y
    series = (1.0 / 12.0 - (1.0 / 360.0 - (1.0 / 1260.0 - (1.0 / 1680.0 - 1.0 / 1188.0 / y2) / y2) / y2) / y2) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2.0 * math.pi) + series - shift


def _beta_fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    def step(s, m):
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        d1 = 1.0 / (1.0 + even * s["d"])
        c1 = 1.0 + even / s["c"]
        d2 = 1.0 / (1.0 + odd * d1)
        c2 = 1.0 + odd / c1
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

    first = 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")),
        step,
        lambda s: s["h"],
    )


def t_two_sided_p(t, df, steps: int = 80) -> Column:
    """Two-sided Student-t tail, accurate for very small p as well.

    Above 20,000 degrees of freedom the normal equivalent of Hill (1970) is used.
    """
    return bind(lambda t, df: _t_tail(t, df, steps), t=_col(t).cast("double"), df=_col(df).cast("double"))


def _t_tail(t: Column, df: Column, steps: int) -> Column:
    x = df / (df + t * t)
    y = t * t / (df + t * t)
    a, b = df / 2.0, F.lit(0.5)
    front = F.exp(
        log_gamma(a + 0.5) - log_gamma(a) - math.log(math.sqrt(math.pi)) + a * F.log(x) + 0.5 * F.log(y)
    )
    small = x < (a + 1.0) / (a + 2.5)
    first, second = F.when(small, a).otherwise(b), F.when(small, b).otherwise(a)
    part = front / first * bind(
        lambda a, b, x: _beta_fraction(a, b, x, steps), a=first, b=second, x=F.when(small, x).otherwise(y)
    )
    h = df - 0.5
    b48 = 48.0 * h * h
    w = h * F.log1p(t * t / df)
    z = ((((((-0.4 * w - 3.3) * w - 24.0) * w - 85.5) / (0.8 * w * w + 100.0 + b48)) + w + 3.0) / b48 + 1.0) * F.sqrt(w)
    exact = F.when(t == 0, F.lit(1.0)).otherwise(bind(lambda p, s: F.when(s, p).otherwise(1.0 - p), p=part, s=small))
    return F.when(df > 20000.0, normal_two_sided_p(z)).otherwise(exact)


def t_quantile(q: float, df) -> Column:
    """Student-t quantile for q in (0.5, 1): expansion start, then Newton on the tail."""
    if not 0.5 < q < 1.0:
        raise ValueError("q must lie in (0.5, 1)")
    return bind(lambda df: _t_quantile(q, df), df=_col(df).cast("double"))


def _t_quantile(q: float, df: Column) -> Column:
    alpha = 2.0 * (1.0 - q)
    z = _normal_quantile_float(q)
    start = (
        z
        + (z**3 + z) / (4.0 * df)
        + (5 * z**5 + 16 * z**3 + 3 * z) / (96.0 * df * df)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384.0 * df * df * df)
    )
    # log density constant, independent of t
    log_norm = log_gamma((df + 1.0) / 2.0) - log_gamma(df / 2.0) - 0.5 * F.log(df * math.pi)

    def newton(t, _):
        log_density = log_norm - (df + 1.0) / 2.0 * F.log1p(t * t / df)
        return t + (t_two_sided_p(t, df) - alpha) / (2.0 * F.exp(log_density))

    refined = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, newton)
    one = math.tan(math.pi * (q - 0.5))
    two = (2 * q - 1) * math.sqrt(2.0 / (4 * q * (1 - q)))
    return F.when(df == 1, F.lit(one)).when(df == 2, F.lit(two)).otherwise(refined)


def _normal_quantile_float(q: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < q:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def chi2_two_df_p(x) -> Column:
    return F.exp(-_col(x) / 2.0)
