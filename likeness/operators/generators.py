"""Seeded synthetic tables whose every value is a function of (seed, column, id)."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.functions.draws import gaussian, uniform
from likeness.functions.ordering import draw_index, guide_cell, hash_rank, inverse_cdf_guide
from likeness.operators.conditionals import (
    ConditionalModel,
    Probe,
    descend,
    fit_context,
    settle,
)
from likeness.operators.frames import assert_features, from_rows, sample_n
from likeness.operators.lsm import sample_in_order
from likeness.operators.marginals import clean, split_types, token_counts
from likeness.operators.trees import fit_trees
from likeness.plans.materialise import Stored, lookup, store


def ids(real: DataFrame, num: int) -> DataFrame:
    """Row ids 0..num-1 of a synthetic table."""
    return real.sparkSession.range(num).select(F.col("id").alias("row_id"))


@dataclass(frozen=True)
class IndependentModel:
    """Independent columns: (mean, std) per numeric one, a guide table for the others."""

    features: list[str]
    numeric: dict[str, tuple[float | None, float | None]]
    categorical: dict[str, tuple[int, int]]  # column -> (total, tokens)
    guide: Stored | None


def fit_independent(real: DataFrame, features: Sequence[str]) -> IndependentModel:
    """Two aggregates over the real table; the driver sees two numbers per column."""
    numeric, categorical = split_types(real, features)
    stats = {}
    if numeric:
        aggs = []
        for i, c in enumerate(numeric):
            aggs += [F.avg(clean(c)).alias(f"m{i}"), F.stddev_pop(clean(c)).alias(f"s{i}")]
        row = real.agg(*aggs).first()
        stats = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(numeric)}
    guide, sizes = None, {}
    if categorical:
        counts = store(token_counts(real, categorical)).df
        guide = store(inverse_cdf_guide(counts, ["col"]))
        totals = counts.groupBy("col").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()
        sizes = {r["col"]: (r["n"], r["k"]) for r in totals}  # one row per column
    return IndependentModel(list(features), stats, sizes, guide)


def sample_independent(rows: DataFrame, model: IndependentModel, seed=0) -> DataFrame:
    """Fill each feature of ``rows`` (a ``row_id`` column); no shuffle while guides are small."""
    out = rows.select("row_id")
    for c in model.features:
        if c in model.numeric:
            mean, std = model.numeric[c]
            out = out.withColumn(
                c, F.lit(mean).cast("double") + F.lit(std).cast("double") * gaussian(seed, c, "row_id")
            )
        elif c in model.categorical:
            total, k = (F.lit(v).cast("bigint") for v in model.categorical[c])
            out = out.withColumn("_idx", draw_index(uniform(seed, c, "row_id"), total))
            out = out.withColumn("_cell", guide_cell(F.col("_idx"), k, total))
            cells = model.guide.df.filter(F.col("col") == c).select(
                F.col("cell"), F.col("token").alias(c), "lo", "hi"
            )
            out = out.join(lookup(cells, model.guide.small), draw_match([]), "left").drop(
                "_idx", "_cell", "cell", "lo", "hi"
            )
        else:  # an all-NULL column
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def draw_match(extra: Sequence[Column]) -> Column:
    hit = (F.col("_cell") == F.col("cell")) & (F.col("lo") <= F.col("_idx")) & (F.col("_idx") < F.col("hi"))
    for e in extra:
        hit = hit & e
    return hit


def gen_baseline(real: DataFrame, num: int, features: Sequence[str], seed=0) -> DataFrame:
    return sample_independent(ids(real, num), fit_independent(real, features), seed)


def model_guide(model: ConditionalModel) -> Stored:
    """Inverse-CDF guide cells for every leaf of a conditional model."""
    return store(inverse_cdf_guide(model.tokens.df, ["target", "leaf"]))


def draw_column(
    rows: DataFrame, model: ConditionalModel, guide: Stored, i: int, drawn: Sequence[str], seed, id_col: str = "row_id"
) -> DataFrame:
    """Add feature ``i`` drawn from its conditional given the columns already there."""
    name = model.features[i]
    context = [F.col(f) if f in drawn else F.lit("") for f in model.features]
    kept = list(rows.columns)
    splits = i in model.root_split if model.kind == "tree" else bool(model.contexts[i])
    at = rows.withColumn("target", F.lit(i)).withColumn("leaf0", model.start(Probe(i, F.lit(""), context)))
    if not splits:  # the marginal: its size is known, nothing to look up
        n, _, k, _ = model.roots[i]
        at = at.withColumns({"leaf_n": F.lit(n).cast("bigint"), "leaf_k": F.lit(k).cast("bigint")})
    else:
        if model.kind == "tree":
            at = at.withColumn("_toks", F.array(*context)).withColumn("_split", F.lit(model.root_split[i]).cast("int"))
            at = descend(at, model, "leaf0", "_split")
        at = settle(at, model)
    at = at.withColumn("_idx", draw_index(uniform(seed, name, id_col), "leaf_n"))
    at = at.withColumn("_cell", guide_cell(F.col("_idx"), F.col("leaf_k"), F.col("leaf_n")))
    cells = guide.df.filter(F.col("target") == i).select(
        F.col("leaf").alias("_leaf"), "cell", F.col("token").alias("_token"), "lo", "hi"
    )
    on = draw_match([F.col("leaf0") == F.col("_leaf")])
    return at.join(lookup(cells, guide.small), on).select(*kept, F.col("_token").alias(name))


def earlier_only(order: Sequence[str], given: Mapping[str, Sequence[str]] | None, window: int | None) -> dict[str, list[str]]:
    """Predictors of each column: earlier columns only, optionally the last ``window`` of them."""
    out = {}
    for i, f in enumerate(order):
        before = list(order[:i])
        if given is not None:
            out[f] = [g for g in given.get(f, []) if g in before]
        else:
            out[f] = before if window is None else before[-window:]
    return out


def fit_sequential(
    real: DataFrame,
    order: Sequence[str],
    learner: str = "tree",
    predictors: Mapping[str, Sequence[str]] | None = None,
    window: int | None = None,
    **options,
) -> ConditionalModel:
    """Conditionals of each column given earlier ones, by trees or by fixed contexts."""
    allowed = earlier_only(order, predictors, window)
    if learner == "context":
        return fit_context(real, order, allowed)
    if learner == "tree":
        return fit_trees(real, order, allowed=allowed, **options)
    raise ValueError(f"unknown learner {learner!r}")


def gen_sequential(rows: DataFrame, model: ConditionalModel, seed=123) -> DataFrame:
    """Draw the columns of ``rows`` (a ``row_id`` column) in model order.

    A model below the broadcast bound goes to the workers as arrays; with a larger one each
    column is a join.  Both draw the same rows.
    """
    if model.small:
        return sample_in_order(rows, model, seed)
    guide = model_guide(model)
    out = rows.select("row_id")
    for i, f in enumerate(model.features):
        out = draw_column(out, model, guide, i, model.features[:i], seed)
    return out


def gen_bootstrap(real: DataFrame, num: int, replace: bool = False, seed=0, id_col: str = "row_id") -> DataFrame:
    """Resampled real rows.  With replacement, ``src_id`` keeps the real row's id."""
    if not replace:
        return sample_n(real, num, seed, id_col)
    ranked = hash_rank(real, id_col, seed, "bootstrap", "_rank").withColumnRenamed(id_col, "src_id")
    total = real.count()
    # A uniform rank is an even join key, whatever the data looks like.
    picks = ids(real, num).withColumn("_rank", draw_index(uniform(seed, "pick", "row_id"), F.lit(total)) + 1)
    features = [c for c in real.columns if c != id_col]
    return picks.join(ranked, "_rank").select("row_id", "src_id", *features)


def gen_moment_pair(rows: DataFrame, rho: float | None = None, seed=0) -> tuple[DataFrame, DataFrame]:
    """A uniform cube and a Gaussian with the same mean and covariance, three columns.

    ``rho`` applies the same shear to both.
    """
    names = ["x1", "x2", "x3"]
    side = 3.0**0.5
    cube = {c: (uniform(seed, f"u{c}", "row_id") * 2.0 - 1.0) * side for c in names}
    bell = {c: gaussian(seed, f"g{c}", "row_id") for c in names}
    pair = []
    for cols in (cube, bell):
        df = rows.select("row_id", *[e.alias(c) for c, e in cols.items()])
        if rho is not None:
            r = F.lit(float(rho))
            df = df.select(
                "row_id",
                (F.col("x1") + r * F.col("x2")).alias("x1"),
                (F.col("x2") + r * F.col("x3")).alias("x2"),
                "x3",
            )
        pair.append(df)
    return pair[0], pair[1]


def gen_custom(
    generator: Callable,
    real: DataFrame | None,
    num: int,
    features: Sequence[str],
    model: ConditionalModel | None = None,
) -> DataFrame:
    """A user callable returning a DataFrame with exactly these columns, or array-like rows.

    It is called with ``model``, ``num``, ``orig_df`` (the real table or None) and, if it
    takes them, ``feature_names``, ``spark``, ``real`` and ``features``.  A ``row_id`` column is
    allowed beside the features.
    """
    spark = real.sparkSession if real is not None else SparkSession.active()
    offered = {
        "model": model, "num": num, "orig_df": real, "feature_names": list(features),
        "spark": spark, "real": real, "features": list(features),
    }
    takes = inspect.signature(generator).parameters.values()
    if any(p.kind is p.VAR_KEYWORD for p in takes):
        named = {p.name for p in takes} | {"model", "num", "orig_df", "feature_names"}
    else:
        named = {p.name for p in takes}
    result = generator(**{k: v for k, v in offered.items() if k in named})
    if isinstance(result, DataFrame):
        return assert_features(result, features, ignore=["row_id"])
    return from_rows(spark, result, features)


def gen_batches(rows: DataFrame, features: Sequence[str], fill: Callable) -> DataFrame:
    """A batch callable ``fill(row_ids: ndarray) -> dict[str, sequence]`` run on the executors."""
    features = list(features)
    schema = "row_id bigint, " + ", ".join(f"`{f}` string" for f in features)

    def run(batches):
        import pandas as pd

        for batch in batches:
            made = pd.DataFrame(dict(fill(batch["row_id"].to_numpy())))
            if list(made.columns) != features:
                raise ValueError(f"the batch callable made the columns {list(made.columns)}, not the features {features}")
            made.insert(0, "row_id", batch["row_id"].to_numpy())
            yield made.astype({f: str for f in features})

    return rows.select("row_id").mapInPandas(run, schema)


