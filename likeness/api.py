"""The two calls most users need."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from likeness.functions.bounds import check_alpha
from likeness.operators.alignment import upsilon_rows, upsilon_summary
from likeness.operators.conditionals import ConditionalModel
from likeness.operators.frames import assert_features
from likeness.plans.compare import generate
from likeness.sources.models import load_model


def compute_upsilon(
    df: DataFrame,
    model: ConditionalModel | None = None,
    model_path: str | None = None,
    n_workers: int = 1,
    verbose: bool = True,
    alpha: float | None = None,
    row_id: str = "row_id",
    epsilon: float = 0.0,
):
    """(row scores, df), and with ``alpha`` also the one-row summary.

    ``df`` has a unique ``row_id`` column beside exactly the model's features.
    ``n_workers`` and ``verbose`` are accepted for old call sites; Spark decides both.
    """
    del n_workers, verbose
    if model is None:
        if model_path is None:
            raise NotImplementedError("pass `model` or `model_path`")
        model = load_model(df.sparkSession, model_path)
    assert_features(df, model.features, [row_id])
    if row_id not in df.columns:
        raise ValueError(f"no {row_id!r} column: a table has no row order to identify rows by")
    rows = upsilon_rows(df, model, [row_id], epsilon)
    if alpha is None:
        return rows, df
    return rows, df, upsilon_summary(df, model, check_alpha(alpha), epsilon=epsilon)


def generate_syndata(
    num: int,
    model: ConditionalModel | None = None,
    model_path: str | None = None,
    gen_algorithm: str = "LSM",
    orig_df: DataFrame | None = None,
    data_generator: Callable | None = None,
    n_workers: int = 1,
    verbose: bool = True,
    feature_names: Sequence[str] | None = None,
    seed: int = 0,
    **options,
) -> DataFrame:
    """A synthetic DataFrame of ``num`` rows: ``row_id`` and the features in order.

    ``gen_algorithm`` is LSM, BASELINE, SEQUENTIAL, BOOTSTRAP, or any other name
    together with ``data_generator(model=, num=, orig_df=, ...)``; see ``gen_custom``.
    """
    del n_workers, verbose
    if model is None and model_path is not None:
        spark = orig_df.sparkSession if orig_df is not None else SparkSession.active()
        model = load_model(spark, model_path)
    return generate(num, model, gen_algorithm, orig_df, data_generator, feature_names, seed, **options)
