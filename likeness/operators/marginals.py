"""Column-wise models and diagnostics: moments, frequencies, covariances."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.operators.frames import label_union, token


def split_types(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) by schema; booleans and dates are categorical."""
    numeric, categorical = [], []
    for c in columns:
        is_num = isinstance(df.schema[c].dataType, T.NumericType)
        (numeric if is_num else categorical).append(c)
    return numeric, categorical


def clean(c: str) -> Column:
    """A double with NaN read as NULL, so aggregates skip it."""
    return F.nullif(F.col(c).cast("double"), F.lit(float("nan")))


def marginal_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, mean, std) with population std; one pass for all columns."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(clean(c)).alias(f"m{i}"), F.stddev_pop(clean(c)).alias(f"s{i}")]
    one = df.agg(*aggs)
    rows = [
        F.struct(F.lit(c).alias("col"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*rows)))


def token_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., col, token, n) for all columns in one pass; NULL tokens dropped."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), token(c).alias("token")) for c in columns])
    return (
        df.select(*by, F.inline(cells))
        .filter(F.col("token").isNotNull())
        .groupBy(*by, "col", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def marginal_categorical(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., col, token, n, p) with p over the non-null rows of the column."""
    counts = token_counts(df, columns, by)
    totals = counts.groupBy(*by, "col").agg(F.sum("n").alias("total"))
    return counts.join(totals, [*by, "col"]).select(
        *by, "col", "token", "n", (F.col("n") / F.col("total")).alias("p")
    )


def marginal_compare(datasets: dict[str, DataFrame], column: str) -> DataFrame:
    """One column's distribution in every dataset."""
    stacked = label_union(datasets, [column], keep=())
    return marginal_categorical(stacked, [column], by=["dataset"])


def moment_compare(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means, variances and covariances of two tables side by side, one scan of each.

    ``stat`` is ``mean`` (y = x), ``var`` (y = x) or ``cov``.
    """
    def stats(df: DataFrame, name: str) -> DataFrame:
        pairs = list(combinations_with_replacement(range(len(columns)), 2))
        aggs = [F.avg(clean(c)).alias(f"m{i}") for i, c in enumerate(columns)]
        aggs += [F.covar_pop(clean(columns[i]), clean(columns[j])).alias(f"c{i}_{j}") for i, j in pairs]

        def row(stat: str, x: str, y: str, value: str):
            return F.struct(
                F.lit(stat).alias("stat"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(value).alias(name)
            )

        rows = [row("mean", c, c, f"m{i}") for i, c in enumerate(columns)]
        rows += [row("var" if i == j else "cov", columns[i], columns[j], f"c{i}_{j}") for i, j in pairs]
        return df.agg(*aggs).select(F.inline(F.array(*rows)))

    a, b = stats(real, "real"), stats(synth, "synth")
    return a.join(b, ["stat", "x", "y"]).select(
        "stat", "x", "y", "real", "synth", (F.col("real") - F.col("synth")).alias("diff")
    )
