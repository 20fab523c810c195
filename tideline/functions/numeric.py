"""Scalar expressions that several operators share; all are Catalyst columns."""

from __future__ import annotations

from functools import reduce
from math import pi, sqrt
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Null stays null; NaN and infinities are false."""
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def all_of(*tests: Column) -> Column:
    """True where every test is; unknown counts as false."""
    return reduce(and_, (F.coalesce(t, F.lit(False)) for t in tests))


def any_of(*tests: Column) -> Column:
    return reduce(or_, (F.coalesce(t, F.lit(False)) for t in tests))


def first_reason(*gates: tuple[Column, str]) -> Column:
    """The code of the first gate that fails, null where none does. Unknown counts as failed."""
    out = F.lit(None).cast("string")
    for test, code in reversed(gates):
        out = F.when(~F.coalesce(test, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or unknown."""
    return F.when(b != 0, a / b)


def log_positive(x: Column) -> Column:
    """Natural logarithm; values that have none are absent, not floored."""
    return F.when(x > 0, F.log(x))


def log_quotient(a: Column, b: Column) -> Column:
    """ln(a / b) as doubles have it: infinite where one of the two is zero, NaN where both are or the signs differ."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    quotient = F.when(b != 0, a / b).when(b == 0, a * inf)
    return F.when(quotient > 0, F.log(quotient)).when(quotient == 0, -inf).when(quotient < 0, nan)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


TRANSFORMS = {"log": log_positive, "signed": signed_log, "raw": lambda x: x}


def transformed(column: str, kind: str) -> Column:
    """A registered transform of a column: log, signed or raw."""
    return TRANSFORMS[kind](F.col(column).cast("double"))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), F.log(p / (F.lit(1.0) - p)))


def clipped(x: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(low), F.least(as_col(high), x))


#: The coefficients of the Abramowitz-Stegun approximation 26.2.17 to the normal distribution.
_T, _B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(sqrt(2 * pi))


def normal_cdf(x: Column) -> Column:
    """Normal distribution, absolute error below 1e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_T) * F.abs(x))
    poly = F.lit(0.0)
    for b in reversed(_B):
        poly = (poly + F.lit(b)) * t
    tail = normal_density(x) * poly
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    """The same approximation as SQL text."""
    t = f"(1.0 / (1.0 + {_T} * abs({x})))"
    poly = "0.0"
    for b in reversed(_B):
        poly = f"(({poly} + ({b})) * {t})"
    tail = f"(exp(-({x}) * ({x}) / 2) / {sqrt(2 * pi)} * {poly})"
    return f"(CASE WHEN ({x}) >= 0 THEN 1.0 - {tail} ELSE {tail} END)"
