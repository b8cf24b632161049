"""Alignment under linear-Gaussian conditionals for numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.operators.marginals import clean


@dataclass(frozen=True)
class GaussianModel:
    columns: list[str]
    mean: list[float]
    precision: list[list[float]]


def fit_gaussian(df: DataFrame, columns: Sequence[str]) -> GaussianModel:
    """Means and the N x N precision matrix from one aggregate over complete rows."""
    columns = list(columns)
    n = len(columns)
    named = df.select(*[clean(c).alias(c) for c in columns])
    # A condition inside the aggregates, not a filter: a filter would move below
    # the projection and compute a generated input twice.
    complete = reduce(and_, [F.col(c).isNotNull() for c in columns])
    used = [F.when(complete, F.col(c)) for c in columns]
    aggs = [F.avg(x).alias(f"m{i}") for i, x in enumerate(used)]
    aggs += [F.covar_pop(used[i], used[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]
    row = named.agg(*aggs).first()
    if row["m0"] is None:
        raise ValueError("no complete rows")
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    return GaussianModel(columns, [row[f"m{i}"] for i in range(n)], np.linalg.inv(cov).tolist())


def gaussian_matrix(df: DataFrame, model: GaussianModel, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """(keep..., target, v) with ``v = exp(-z^2 / 2)``; a pure projection.

    ``z_i = (y_i - m_i(y_-i)) / sigma_i = (Lambda (y - mu))_i / sqrt(Lambda_ii)``.
    The centred columns are named first, so a costly input is computed once.
    """
    n = len(model.columns)
    centred = df.select(
        *keep, *[(clean(c) - F.lit(mu)).alias(f"_y{i}") for i, (c, mu) in enumerate(zip(model.columns, model.mean))]
    )
    cells = []
    for i, c in enumerate(model.columns):
        weights = [w / float(np.sqrt(model.precision[i][i])) for w in model.precision[i]]
        z = sum((F.col(f"_y{j}") * F.lit(weights[j]) for j in range(n)), F.lit(0.0))
        cells.append(F.struct(F.lit(c).alias("target"), F.exp(F.lit(-0.5) * F.pow(z, F.lit(2.0))).alias("v")))
    return centred.select(*keep, F.inline(F.array(*cells)))


def gaussian_upsilon(df: DataFrame, model: GaussianModel, by: Sequence[str] = ()) -> DataFrame:
    """(by..., upsilon) averaged over rows and columns."""
    return gaussian_matrix(df, model, by).groupBy(*by).agg(F.avg("v").alias("upsilon"))
