"""Concentration radii and the chi-square tail as plain column arithmetic."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from likeness.functions.draws import as_col


def check_alpha(alpha: float) -> float:
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must be in (0, 1), got {alpha}")
    return float(alpha)


def hoeffding_radius(n_rows, n_features, alpha: float, sides: float = 2.0) -> Column:
    """``sqrt(ln(sides/alpha) / (2 n_rows n_features))``; an empty table counts as one cell."""
    check_alpha(alpha)
    cells = F.greatest(F.lit(1.0), as_col(n_rows).cast("double") * as_col(n_features).cast("double"))
    return F.sqrt(F.log(F.lit(sides / alpha)) / (F.lit(2.0) * cells))


def chi2_z(stat, dof) -> Column:
    """Wilson-Hilferty normal score of a chi-square statistic.

    Tests compare scores, not p-values, since p underflows on strong dependence.
    """
    k = as_col(dof).cast("double")
    shrink = F.lit(2.0) / (F.lit(9.0) * k)
    # The statistic is a difference of sums and may land a hair below zero.
    ratio = F.greatest(F.lit(0.0), as_col(stat)) / k
    return (F.cbrt(ratio) - (F.lit(1.0) - shrink)) / F.sqrt(shrink)


def critical_z(alpha: float) -> float:
    return NormalDist().inv_cdf(1.0 - alpha)
