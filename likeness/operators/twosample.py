"""Classifier two-sample test: can a model tell real rows from synthetic ones?"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.functions.draws import uniform
from likeness.functions.ordering import hash_rank, running_total
from likeness.operators.conditionals import ConditionalModel, Probe, place, score
from likeness.operators.frames import assert_features, tokenise
from likeness.operators.trees import fit_trees
from likeness.plans.materialise import store


def labelled(real: DataFrame, synth: DataFrame, features: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """(key, y, features...) with y = 0 for real rows and 1 for synthetic ones."""
    def side(df: DataFrame, y: int) -> DataFrame:
        rows = tokenise(df, features, [id_col])
        key = F.concat(F.lit(f"{y}|"), F.col(id_col).cast("string"))
        return rows.select(key.alias("key"), F.lit(y).alias("y"), *features)

    return side(real, 0).unionByName(side(synth, 1))


def stratified_split(df: DataFrame, test_size: float = 0.25, seed=123, key: str = "key", label: str = "y") -> DataFrame:
    """Add ``is_test``: the first ``ceil(test_size * n_y)`` rows of each class in hash order."""
    ranked = hash_rank(df, key, seed, "split", "_rank", [label])
    sizes = df.groupBy(label).agg(F.ceil(F.lit(float(test_size)) * F.count(F.lit(1))).alias("_cut"))
    return ranked.join(sizes, label).withColumn("is_test", F.col("_rank") <= F.col("_cut")).drop("_rank", "_cut")


def stratified_folds(df: DataFrame, folds: int, seed=123, key: str = "key", label: str = "y") -> DataFrame:
    """Add ``fold`` in 0..folds-1, dealt round-robin within each class in hash order."""
    ranked = hash_rank(df, key, seed, "fold", "_rank", [label])
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")).drop("_rank")


def auc_rank(df: DataFrame, score: str = "score", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc, n_pos, n_neg) of a score in [0, 1]; ties count half."""
    y = F.col(label)
    counted = df.select(*by, score, y.alias("pos"), (F.lit(1) - y).alias("neg"))
    return auc_counts(counted, score, by)


def auc_counts(df: DataFrame, score: str = "score", by: Sequence[str] = (), bins: int = 4096) -> DataFrame:
    """As :func:`auc_rank`, from rows that carry ``pos`` and ``neg`` counts.

    Equal scores collapse first, and the running count of negatives is cut into
    score bins, so no task ever holds the whole order.
    """
    by = list(by)
    counts = store(
        df.groupBy(*by, F.col(score).alias("_s"))
        .agg(F.sum("pos").cast("bigint").alias("pos"), F.sum("neg").cast("bigint").alias("neg"))
        .withColumn("_bin", F.floor(F.col("_s") * bins))
    ).df
    below = running_total(counts, "_bin", ["_s"], "neg", "below", by)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    totals = below.groupBy(*by).agg(
        F.sum(pos * (F.col("below") + neg / 2.0)).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return totals.select(*by, F.try_divide(F.col("_u"), pairs).alias("auc"), "n_pos", "n_neg")


def pattern_counts(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., features..., pos, neg): distinct records with their class counts.

    The classifier sees weights instead of repeated rows; its optimum is the same.
    """
    return store(
        df.groupBy(*by, *features).agg(
            F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
        )
    ).df


def weighted_rows(patterns: DataFrame, features: Sequence[str]) -> DataFrame:
    """(features..., y, w) over the given patterns, merged across folds."""
    merged = patterns.groupBy(*features).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sides = F.array(
        F.struct(F.lit(1.0).alias("y"), F.col("pos").cast("double").alias("w")),
        F.struct(F.lit(0.0).alias("y"), F.col("neg").cast("double").alias("w")),
    )
    return merged.select(*features, F.inline(sides)).filter(F.col("w") > 0)


def one_hot_stages(features: Sequence[str]) -> list:
    """Index, encode and assemble; tokens unseen in fitting get a slot of their own,
    which no training row uses and whose weight therefore stays 0.
    """
    idx = [f"_i_{f}" for f in features]
    hot = [f"_h_{f}" for f in features]
    return [
        StringIndexer(inputCols=list(features), outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=hot, handleInvalid="keep", dropLast=True),
        VectorAssembler(inputCols=hot, outputCol="x"),
    ]


def one_hot(train: DataFrame, features: Sequence[str]) -> PipelineModel:
    return Pipeline(stages=one_hot_stages(features)).fit(train)


def fit_classifier(train: DataFrame, features: Sequence[str], max_iter: int = 2000) -> PipelineModel:
    """One-hot logistic regression on (features..., y, w), ``regParam = 1 / sum(w)``.

    That is the usual unit inverse regularisation strength, intercept unpenalised.
    """
    n = train.agg(F.sum("w")).first()[0] or 1.0
    lr = LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="w", maxIter=max_iter, regParam=1.0 / n, elasticNetParam=0.0,
        standardization=False, tol=1e-6,
    )
    return Pipeline(stages=[*one_hot_stages(features), lr]).fit(train)


def classifier_scores(model: PipelineModel, test: DataFrame, keep: Sequence[str]) -> DataFrame:
    scored = model.transform(test)
    return scored.select(*keep, vector_to_array("probability")[1].alias("score"))


def prepare(real, synth, features, max_rows, seed, id_col) -> DataFrame:
    """Labelled rows of both tables; ``fits`` marks those a classifier may learn from."""
    assert_features(real, features, [id_col])
    assert_features(synth, features, [id_col])
    rows = labelled(real, synth, features, id_col)
    if max_rows is None:
        return rows.withColumn("fits", F.lit(True))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(max_rows / max(1, sizes.get(1, 0)))).otherwise(
        F.lit(max_rows / max(1, sizes.get(0, 0)))
    )
    return rows.withColumn("fits", uniform(seed, "fits", F.concat_ws("|", "y", "key")) < share)


def c2st_holdout(
    real: DataFrame,
    synth: DataFrame,
    features: Sequence[str],
    test_size: float = 0.25,
    seed=123,
    max_rows: int | None = None,
    id_col: str = "row_id",
    max_iter: int = 2000,
) -> DataFrame:
    """One row: mode, test_size, auc, n_real, n_synth.

    ``max_rows`` bounds the fit: about so many rows per side, by a hash of the id, may
    be learned from.  The AUC is over all held-out rows.
    """
    rows = stratified_split(prepare(real, synth, features, max_rows, seed, id_col), test_size, seed)
    patterns = pattern_counts(rows, features, ["is_test", "fits"])
    model = fit_classifier(weighted_rows(patterns.filter("fits and not is_test"), features), features, max_iter)
    scored = classifier_scores(model, patterns.filter("is_test"), ["pos", "neg"])
    auc = auc_counts(scored).select("auc").scalar()
    return patterns.agg(F.sum("neg").alias("n_real"), F.sum("pos").alias("n_synth")).select(
        F.lit("holdout").alias("mode"), F.lit(float(test_size)).alias("test_size"), auc.alias("auc"), "n_real", "n_synth"
    )


def c2st_cv(
    real: DataFrame,
    synth: DataFrame,
    features: Sequence[str],
    folds: int = 5,
    seed=123,
    max_rows: int | None = None,
    id_col: str = "row_id",
    max_iter: int = 2000,
) -> DataFrame:
    """One row: mode, cv_folds, auc_mean, auc_std, aucs, n_real, n_synth.

    The folds' out-of-fold scores are stacked and ranked together, one job for all AUCs.
    ``max_rows`` bounds the rows learned from, as in :func:`c2st_holdout`; all rows are scored.
    """
    rows = stratified_folds(prepare(real, synth, features, max_rows, seed, id_col), folds, seed)
    patterns = pattern_counts(rows, features, ["fold", "fits"])
    stacked = None
    for k in range(folds):
        model = fit_classifier(weighted_rows(patterns.filter((F.col("fold") != k) & F.col("fits")), features), features, max_iter)
        part = classifier_scores(model, patterns.filter(F.col("fold") == k), ["fold", "pos", "neg"])
        stacked = part if stacked is None else stacked.unionByName(part)
    per_fold = auc_counts(stacked, by=["fold"])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("fold", "auc"))), lambda s: s["auc"])
    return per_fold.agg(
        F.lit("cv").alias("mode"),
        F.lit(folds).alias("cv_folds"),
        F.avg("auc").alias("auc_mean"),
        F.coalesce(F.stddev_samp("auc"), F.lit(0.0)).alias("auc_std"),
        ordered.alias("aucs"),
        F.sum("n_neg").alias("n_real"),
        F.sum("n_pos").alias("n_synth"),
    )


# --------------------------------------------- a learner that sees dependence


def crossed(df: DataFrame, features: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with a column of both tokens for each pair of features (all pairs unless given), and all predictors."""
    features = list(features)
    pairs = list(combinations(features, 2)) if pairs is None else list(pairs)
    both = {f"{a} & {b}": F.when((F.col(a) != "") & (F.col(b) != ""), F.concat_ws("\x1f", a, b)).otherwise("") for a, b in pairs}
    return df.withColumns(both), [*features, *both]


def fit_tree_classifier(train: DataFrame, features: Sequence[str], depth: int, pairs=None, **options) -> ConditionalModel:
    """A conditional tree for ``y`` over the features and their pairs; ``train`` has (y, features...).

    An additive model sees single columns only, and so does a tree's first split; a table with one
    column permuted differs from the real one in none.  Pairs differ.
    """
    rows, names = crossed(train.withColumn("y", F.col("y").cast("string")), features, pairs)
    allowed = {"y": names, **{n: [] for n in names}}
    return fit_trees(rows, ["y", *names], max_depth=depth, allowed=allowed, **options)


def tree_scores(model: ConditionalModel, test: DataFrame, features: Sequence[str], keep: Sequence[str], pairs=None) -> DataFrame:
    """(keep..., score): the share of synthetic training rows in the leaf of each row."""
    rows, names = crossed(test.withColumn("y", F.lit("1")), features, pairs)
    probe = Probe(0, F.lit("1"), [F.lit(""), *[F.col(n) for n in names]])
    scored = score(place(rows, [model], keep, [probe]), model)
    return scored.select(*keep, F.col("p_obs").alias("score"))


def c2st_tree(
    real: DataFrame,
    synth: DataFrame,
    features: Sequence[str],
    folds: int | None = None,
    test_size: float = 0.25,
    seed=123,
    depth: int = 2,
    id_col: str = "row_id",
    pairs: Sequence[tuple[str, str]] | None = None,
    **options,
) -> DataFrame:
    """(part, auc, n_real, n_synth): real against synthetic rows by a conditional tree on pairs of columns.

    One row ``holdout``, or one per fold.  Labels and tokens stay in tables: nothing but a
    split per tree level comes to the driver.  Records collapse to patterns with counts first.
    """
    assert_features(real, features, [id_col])
    assert_features(synth, features, [id_col])
    rows = labelled(real, synth, features, id_col)
    rows = stratified_folds(rows, folds, seed) if folds else stratified_split(rows, test_size, seed)
    part = "fold" if folds else "is_test"
    rows = store(rows.select("key", "y", part, *features)).df
    stacked = None
    for k in range(folds or 1):
        held = F.col("fold") == k if folds else F.col("is_test")
        model = fit_tree_classifier(rows.filter(~held).select("y", *features), features, depth, pairs, **options)
        counts = pattern_counts(rows.filter(held), features, [])
        scored = tree_scores(model, counts, features, ["pos", "neg"], pairs)
        scored = scored.withColumn("part", F.lit(f"fold {k}" if folds else "holdout"))
        stacked = scored if stacked is None else stacked.unionByName(scored)
    return auc_counts(stacked, by=["part"]).select(
        "part", "auc", F.col("n_neg").alias("n_real"), F.col("n_pos").alias("n_synth")
    )
