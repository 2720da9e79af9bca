"""Standard normal tail as a Column, from Cody's rational approximations to erf/erfc.

Neither engine has ``erf`` built in. Cody (1969) is accurate to about 1e-16 relative,
so six reported digits hold for very small p-values too.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from movecheck.functions.columns import let

# Cody's coefficients, highest power first, numerator then denominator.
# erf(x) = x * P(x^2) / Q(x^2) for x <= 0.46875
_ERF_SMALL = (
    (1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02,
     3.77485237685302021e02, 3.20937758913846947e03),
    (1.0, 2.36012909523441209e01, 2.44024637934444173e02,
     1.28261652607737228e03, 2.84423683343917062e03),
)
# erfc(x) = exp(-x^2) * P(x) / Q(x) for 0.46875 < x <= 4
_ERFC_MID = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00,
     6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
     1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03),
    (1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02,
     1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03,
     3.43936767414372164e03, 1.23033935480374942e03),
)
# erfc(x) = exp(-x^2) / x * (1/sqrt(pi) - P(1/x^2) / (x^2 Q(1/x^2))) for x > 4
_ERFC_LARGE = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
     1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1,
     6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def _erfc_of_magnitude(a: Column, square: Column) -> Column:
    small = F.lit(1.0) - a * _poly(square, _ERF_SMALL[0]) / _poly(square, _ERF_SMALL[1])
    middle = F.exp(-square) * _poly(a, _ERFC_MID[0]) / _poly(a, _ERFC_MID[1])

    def large(inverse: Column) -> Column:
        tail = inverse * _poly(inverse, _ERFC_LARGE[0]) / _poly(inverse, _ERFC_LARGE[1])
        return F.exp(-square) / a * (F.lit(1.0 / math.sqrt(math.pi)) - tail)

    beyond = let(F.lit(1.0) / square, large)
    return F.when(a <= 0.46875, small).when(a <= 4.0, middle).otherwise(beyond)


def erfc(x: Column) -> Column:
    """Complementary error function, any sign; null for null.

    The argument and its square are bound once: spelled out at each step, the polynomials
    would repeat them dozens of times in generated code too long for the JVM to compile.
    """
    x = x.cast("double")
    positive = let(F.abs(x), lambda a: let(a * a, lambda square: _erfc_of_magnitude(a, square)))
    return F.when(x >= 0, positive).when(x < 0, F.lit(2.0) - positive)


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a z statistic."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def normal_cdf(x: Column) -> Column:
    return erfc(-x / F.lit(math.sqrt(2.0))) / F.lit(2.0)


def check_alpha(alpha: float) -> float:
    """``alpha`` is always stated by the caller and lies strictly between 0 and 1."""
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie strictly between 0 and 1, got {alpha!r}")
    return float(alpha)


def critical_value(alpha: float) -> float:
    """z with two-sided tail ``alpha`` (a plan-time literal)."""
    return NormalDist().inv_cdf(1.0 - check_alpha(alpha) / 2.0)
