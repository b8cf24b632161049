"""Several generators side by side, and generate-and-score in one call."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.functions.bounds import hoeffding_radius
from likeness.operators.alignment import upsilon_quantiles, upsilon_rows, score_counts, weighted
from likeness.operators.conditionals import ConditionalModel
from likeness.operators.frames import assert_features, label_union, project_features, resolve_features
from likeness.operators.generators import (
    fit_sequential,
    gen_baseline,
    gen_bootstrap,
    gen_custom,
    gen_sequential,
    ids,
)
from likeness.operators.lsm import gen_lsm
from likeness.operators.novelty import novelty_summary
from likeness.operators.twosample import c2st_cv, c2st_holdout


def evaluate_generators(
    real: DataFrame,
    synths: Mapping[str, DataFrame],
    model: ConditionalModel,
    alpha: float = 0.05,
    epsilon: float = 0.0,
) -> DataFrame:
    """One row per dataset: alignment, its interval, hit rate, medians and novelty.

    All datasets travel stacked under one label, so each measure is one job
    however many generators there are.  The real table is included as ``real``.
    """
    features = model.features
    stacked = label_union({"real": real, **synths}, features)
    n = F.lit(len(features))
    base = (
        score_counts(stacked, model, ["dataset"], epsilon)
        .groupBy("dataset")
        .agg(
            F.sum(F.when(F.col("target") == 0, F.col("rows"))).alias("n_rows"),
            weighted("v").alias("upsilon_mean"),
            weighted("hit").alias("hit_rate"),
            weighted("expected").alias("expected_upsilon"),
        )
        .withColumn("radius", hoeffding_radius("n_rows", n, alpha))
    )
    rows = upsilon_rows(stacked, model, ["dataset", "row_id"], epsilon)
    medians = upsilon_quantiles(rows, {"upsilon_median": 0.5})
    novelty = novelty_summary(real, stacked, features, ["dataset"]).drop("n_synth")
    return base.join(medians, "dataset").join(novelty, "dataset")


def classifier_aucs(
    real: DataFrame, synths: Mapping[str, DataFrame], features: Sequence[str], folds: int | None = 5, **options
) -> DataFrame:
    """(dataset, auc, auc_std) per generator; one classifier (or one per fold) each."""
    out = None
    for name, synth in synths.items():
        if folds:
            part = c2st_cv(real, synth, features, folds, **options).select(
                F.lit(name).alias("dataset"), F.col("auc_mean").alias("auc"), "auc_std"
            )
        else:
            part = c2st_holdout(real, synth, features, **options).select(
                F.lit(name).alias("dataset"), "auc", F.lit(0.0).alias("auc_std")
            )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no synthetic tables given")
    return out


def generator_map(evaluated: DataFrame) -> DataFrame:
    """(generator, similarity median, its inverse, alignment median): the map's points."""
    x = F.col("nearest_real_similarity_median")
    return evaluated.filter(F.col("dataset") != "real").select(
        F.col("dataset").alias("generator"),
        x.alias("nearest_real_similarity_median"),
        F.try_divide(F.lit(1.0), x).alias("inverse_median"),
        "upsilon_median",
    )


def generate(
    num: int,
    model: ConditionalModel | None = None,
    gen_algorithm: str = "LSM",
    real: DataFrame | None = None,
    data_generator: Callable | None = None,
    features: Sequence[str] | None = None,
    seed: int = 0,
    id_col: str = "row_id",
    **options,
) -> DataFrame:
    """A synthetic table (row_id, features...) by generator name."""
    if model is None and (gen_algorithm == "LSM" or data_generator is not None):
        raise NotImplementedError("this generator needs a model: pass `model` or `model_path`")
    names = resolve_features(features, model, real, [id_col])
    if gen_algorithm == "LSM":
        spark = model.tokens.df.sparkSession
        rows = spark.range(num).select(F.col("id").alias("row_id"))
        return project_features(gen_lsm(rows, model, seed, **options), names, ["row_id"])
    if gen_algorithm in ("BASELINE", "SEQUENTIAL", "BOOTSTRAP"):
        if real is None:
            raise ValueError(f"{gen_algorithm} resamples a real table: pass it as orig_df")
        assert_features(real, names, [id_col])
        if gen_algorithm == "BASELINE":
            return gen_baseline(real, num, names, seed)
        if gen_algorithm == "SEQUENTIAL":
            return gen_sequential(ids(real, num), fit_sequential(real, names, **options), seed)
        return gen_bootstrap(real, num, seed=seed, id_col=id_col, **options)
    if data_generator is None:
        raise NotImplementedError(f"no generator named {gen_algorithm!r} and no `data_generator` given")
    return gen_custom(data_generator, real, num, names, model)


def generate_and_score(
    model: ConditionalModel,
    syndata: DataFrame | None = None,
    num: int | None = None,
    keep: Sequence[str] = ("row_id",),
    **generator,
) -> tuple[DataFrame, DataFrame]:
    """(row scores, table): score given data, or generate ``num`` rows and score those."""
    if syndata is None:
        if num is None:
            raise ValueError("no data given and nothing to generate")
        syndata = generate(num, model, **generator)
    return upsilon_rows(syndata, model, keep), syndata
