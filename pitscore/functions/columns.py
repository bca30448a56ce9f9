"""Column expressions shared by all operators; none is a UDF. ``norm_cdf_values`` serves one on whole batches."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_number(c: str) -> Column:
    """Neither NULL nor NaN."""
    return F.col(c).isNotNull() & ~F.isnan(c)


def ratio(num: Col, den: Col) -> Column:
    """num / den, NULL when an input is NULL or the denominator is zero."""
    return F.try_divide(col(num), col(den))


def nonzero(c: Col) -> Column:
    return F.nullif(col(c), F.lit(0.0))


def to_double(c: Col) -> Column:
    """Safe numeric coercion: unparseable text and NaN become NULL."""
    return F.nullif(col(c).try_cast("double"), F.lit(float("nan")))


def parse_yyyymmdd(c: Col) -> Column:
    return F.try_to_timestamp(col(c), F.lit("yyyyMMdd")).cast("date")


def clean_ticker(c: Col) -> Column:
    return F.upper(F.trim(col(c)))


def listing_ticker(c: Col) -> Column:
    """Upper/trim, and ``A.B`` -> ``A-B`` for one dot with a suffix of at most two characters."""
    return F.regexp_replace(clean_ticker(c), r"^([^.]*)\.([^.]{0,2})$", "$1-$2")


def leverage_ratio(c: Col) -> Column:
    """Debt/equity quoted in percent (beyond 10) becomes a ratio."""
    c = col(c)
    return F.when(F.abs(c) > 10, c / 100.0).otherwise(c)


def percent_points(c: Col) -> Column:
    """Decimal rates (0.15) become percentage points (15); values beyond 1 already are."""
    c = col(c)
    return F.when(F.abs(c) > 1, c).otherwise(c * 100.0)


def clamp(c: Col, lo: Col | float, hi: Col | float) -> Column:
    c = col(c)
    lo = F.lit(lo) if isinstance(lo, float) else col(lo)
    hi = F.lit(hi) if isinstance(hi, float) else col(hi)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def linear_score(c: Col, lo: float, hi: float) -> Column:
    """Map [lo, hi] to 0-100, clamped; 0 for an empty interval."""
    c = col(c)
    if hi <= lo:
        return F.when(c.isNotNull(), F.lit(0.0))
    return clamp((c - lo) / (hi - lo) * 100.0, 0.0, 100.0)


Weighted = Mapping[str, float] | Iterable[tuple[Col, float]]


def _pairs(parts: Weighted) -> list[tuple[Column, float]]:
    items = parts.items() if isinstance(parts, Mapping) else parts
    return [(col(c), float(w)) for c, w in items]


def available_mass(parts: Weighted) -> Column:
    """Sum of the weights whose value is not NULL."""
    mass = F.lit(0.0)
    for c, w in _pairs(parts):
        mass = mass + F.when(c.isNotNull(), w).otherwise(0.0)
    return mass


def weighted_mean_of(parts: Weighted) -> Column:
    """Row-wise weighted mean over the values that are not NULL; NULL when no weight is left."""
    parts = _pairs(parts)
    total = F.lit(0.0)
    for c, w in parts:
        total = total + F.coalesce(c * w, F.lit(0.0))
    return ratio(total, available_mass(parts))


def mean_of(parts: Iterable[Col]) -> Column:
    """Row-wise mean of the values that are not NULL; NULL when there is none."""
    return weighted_mean_of([(c, 1.0) for c in parts])


def quarter_end(c: Col) -> Column:
    """Last day of the calendar quarter of a date."""
    return F.last_day(F.add_months(F.trunc(col(c), "quarter"), 2))


def is_meaningful(c: Column, data_type: str, zero_is_missing: bool = False) -> Column:
    """Not NULL, not blank or "unknown" (text), and not zero where zero means "no signal"."""
    ok = c.isNotNull()
    if data_type == "string":
        ok = ok & ~F.lower(F.trim(c)).isin("", "unknown")
    elif data_type == "double":
        ok = ok & ~F.isnan(c)
    if zero_is_missing:
        ok = ok & (c != 0)
    return F.coalesce(ok, F.lit(False))


# Coefficients of W. J. Cody's rational approximations of erf (1969).
_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02,
      3.20937758913846947e03, 1.85777706184603153e-1)
_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_C = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02,
      8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03,
      2.15311535474403846e-8)
_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03,
      3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2,
      6.58749161529837803e-4, 1.63153871373020978e-2)
_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2,
      2.33520497626869185e-3)
_INV_SQRT_PI = 0.56418958354775628695


def _fraction(x, top: tuple[float, ...], bottom: tuple[float, ...]):
    """Ratio of two polynomials; the last entry of ``top`` is its leading coefficient."""
    num, den = x * top[-1], x
    for a, b in zip(top[:-2], bottom[:-1]):
        num, den = (num + a) * x, (den + b) * x
    return (num + top[-2]) / (den + bottom[-1])


def erf(x: Column) -> Column:
    y = F.abs(x)
    small = x * _fraction(y * y, _A, _B)
    middle = 1.0 - F.exp(-y * y) * _fraction(y, _C, _D)
    w = F.try_divide(F.lit(1.0), y * y)
    tail = 1.0 - F.exp(-y * y) * F.try_divide(_INV_SQRT_PI - w * _fraction(w, _P, _Q), y)
    return F.when(y <= 0.46875, small).when(y <= 4.0, F.signum(x) * middle).otherwise(F.signum(x) * tail)


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    return (erf(z / (2.0 ** 0.5)) + 1.0) * 0.5


def norm_cdf_values(z: np.ndarray) -> np.ndarray:
    """``norm_cdf`` of many values; NaN stays NaN."""
    x = z / 2.0 ** 0.5
    y = np.abs(x)
    out = np.full(len(x), np.nan)
    with np.errstate(all="ignore"):
        at = y <= 0.46875
        out[at] = x[at] * _fraction(y[at] * y[at], _A, _B)
        at = (y > 0.46875) & (y <= 4.0)
        out[at] = np.sign(x[at]) * (1.0 - np.exp(-y[at] * y[at]) * _fraction(y[at], _C, _D))
        at = y > 4.0
        w = 1.0 / (y[at] * y[at])
        out[at] = np.sign(x[at]) * (1.0 - np.exp(-y[at] * y[at]) * ((_INV_SQRT_PI - w * _fraction(w, _P, _Q)) / y[at]))
    return (out + 1.0) * 0.5
