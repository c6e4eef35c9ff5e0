"""Scalar functions on returns, variances and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def simple_return(log_return) -> Column:
    return F.expm1(_c(log_return))


def ci_to_var(hi, lo) -> Column:
    """Variance of a normal whose 95 % interval spans four standard deviations."""
    return F.pow((_c(hi) - _c(lo)) / 4, F.lit(2.0))


def lognormal_var(mu, var) -> Column:
    """Variance of exp(N(mu, var))."""
    return F.expm1(_c(var)) * F.exp(2 * _c(mu) + _c(var))


def rectified(x) -> Column:
    return F.greatest(_c(x), F.lit(0.0))


def kelly_fraction(expected, variance, rate=0.0) -> Column:
    """Fraction of wealth to invest; nothing when |return| is below the rate."""
    e = _c(expected)
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return F.signum(e) * rectified(F.abs(e) - r) / _c(variance)
