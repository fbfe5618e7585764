"""Two-sample test statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 2000
_HALF_PI = 1.5707963267948966


def welch(
    mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column
) -> tuple[Column, Column]:
    """(t, df) of Welch's test; t is 0 or infinite when both samples are constant."""
    se_a, se_b = var_a / n_a, var_b / n_b
    se = se_a + se_b
    enough = (n_a >= 2) & (n_b >= 2)
    t = F.when(
        enough,
        F.when(se > 0, F.try_divide(mean_a - mean_b, F.sqrt(se)))
        .when(mean_a == mean_b, F.lit(0.0))
        .otherwise(F.lit(float("inf"))),
    )
    spread = F.try_divide(se_a * se_a, n_a - 1) + F.try_divide(se_b * se_b, n_b - 1)
    df = F.when(enough & (se > 0), F.try_divide(se * se, spread))
    return t, df


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student's t.

    With T = sqrt(df) tan(x) the density is proportional to cos(x)^(df-1), so p is
    the ratio of two integrals of that power, taken by Simpson's rule from x(t)
    and from 0 to the point beyond which the integrand vanishes.
    """
    power = df - 1
    top = F.when(power > 0, F.least(F.lit(_HALF_PI), F.lit(12.0) / F.sqrt(power))).otherwise(_HALF_PI)
    start = F.atan(F.abs(t) / F.sqrt(df))

    def integral(low: Column, high: Column) -> Column:
        step = (high - low) / _STEPS
        total = F.aggregate(
            F.sequence(F.lit(0), F.lit(_STEPS)),
            F.lit(0.0),
            lambda acc, i: acc
            + F.when((i == 0) | (i == _STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            * F.pow(F.greatest(F.cos(low + step * i), F.lit(0.0)), power),
        )
        return total * step / 3

    tail = F.when(start >= top, F.lit(0.0)).otherwise(
        integral(start, top) / integral(F.lit(0.0), top)
    )
    return F.when(t.isNull(), F.lit(None).cast("double")).when(df.isNull(), F.when(t == 0, 1.0).otherwise(0.0)).otherwise(
        F.least(F.lit(1.0), tail)
    )
