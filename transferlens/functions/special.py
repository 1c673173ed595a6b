"""Upper tail of the chi-squared distribution, for the few rows of a test report."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T


# From here on the expansion below is closer than the series and the fraction, whose front factor loses digits.
LARGE = 1e5


def _upper_gamma_large(a: float, x: float) -> float:
    """Q(a, x) for large a by the uniform expansion: a normal tail in eta and its first correction.

    eta has the sign of d = x/a - 1, and eta**2 / 2 = d - log(1 + d). The next term is under 1e-10 here.
    """
    d = (x - a) / a
    if abs(d) < 0.01:  # the difference as a power series, free of cancellation
        half = sum((-d) ** k / k for k in range(2, 12))
    else:
        half = d - math.log1p(d)
    eta = math.copysign(math.sqrt(2 * half), d)
    correction = -1 / 3 + eta / 12 - eta**2 * 2 / 135 if abs(eta) < 1e-3 else 1 / d - 1 / eta
    tail = 0.5 * math.erfc(eta * math.sqrt(a / 2)) + math.exp(-a * half) / math.sqrt(2 * math.pi * a) * correction
    return min(1.0, max(0.0, tail))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0 or a <= 0:
        return 1.0
    if a > LARGE:
        return _upper_gamma_large(a, x)
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        # Power series of the lower function.
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    # Continued fraction, evaluated from the front (modified Lentz).
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    i = 0
    while True:  # within some multiples of sqrt(a) steps, a being at most LARGE
        i += 1
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = c * d
        value *= step
        if abs(step - 1) < 1e-15:
            return front * value


@F.pandas_udf(T.DoubleType())
def chi2_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """P(X >= statistic) for a chi-squared variable with ``dof`` degrees of freedom."""
    return pd.Series([upper_gamma(d / 2.0, s / 2.0) for s, d in zip(statistic, dof)], dtype="float64")
