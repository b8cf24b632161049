"""Conditional inference trees for every column at once, level by level.

Each level is one pass over the records: it places every (record, target) at
its current leaf, then counts (target, leaf, predictor, predictor token, target
token).  Everything after that, the test, the choice, the children and their
distributions, is computed from those counts alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.bounds import chi2_z, critical_z
from likeness.functions.draws import uniform
from likeness.operators.conditionals import ConditionalModel, build_model, descend, root_leaf
from likeness.operators.frames import tokenise
from likeness.operators.permutation import permutation_null
from likeness.plans.materialise import Stored, store


def allowed_indices(features: Sequence[str], allowed: Mapping[str, Sequence[str]] | None) -> dict[int, list[int]]:
    out = {}
    for i, f in enumerate(features):
        names = features if allowed is None else allowed.get(f, [])
        out[i] = sorted(features.index(g) for g in names if g != f)
    return out


def record_weights(df: DataFrame, features: Sequence[str], honest_id: str | None, seed) -> DataFrame:
    """Distinct records with weights: ``w`` for choosing splits, ``w_leaf`` for leaf counts.

    Honest mode puts each row in one of two halves by a hash of its id.
    """
    features = list(features)
    if honest_id is None:
        base = tokenise(df, features)
        one = F.count(F.lit(1))
        return base.groupBy(*features).agg(one.alias("w"), one.alias("w_leaf"))
    first_half = uniform(seed, "honest", honest_id) < 0.5
    base = tokenise(df.withColumn("_h", first_half), features, ["_h"])
    return base.groupBy(*features).agg(
        F.count_if(F.col("_h")).alias("w"), F.count_if(~F.col("_h")).alias("w_leaf")
    )


def contingency(
    records: DataFrame, features: Sequence[str], preds: dict[int, list[int]], grown: ConditionalModel | None, level: int
) -> DataFrame:
    """(target, leaf, pred, x, y, w, w_leaf) at the leaves of the current frontier."""
    targets = F.array(
        *[
            F.struct(
                F.lit(i).alias("target"),
                F.col(f).alias("y"),
                F.array(*[F.lit(j) for j in preds[i]]).cast("array<int>").alias("preds"),
                root_leaf().alias("leaf"),
                F.lit(grown.root_split.get(i) if grown else None).cast("int").alias("split"),
            )
            for i, f in enumerate(features)
        ]
    )
    long = records.select(F.array(*features).alias("_toks"), "w", "w_leaf", F.inline(targets))
    if grown is not None:
        long = descend(long, grown, "leaf", "split").filter(F.size("leaf") == level)
    # A blank target teaches nothing, and a row with a blank predictor stays at the node.
    return (
        long.select("_toks", "w", "w_leaf", "target", "leaf", "y", F.explode("preds").alias("pred"))
        .filter((F.col("y") != "") & (F.col("_toks")[F.col("pred")] != ""))
        .groupBy("target", "leaf", "pred", F.col("_toks")[F.col("pred")].alias("x"), "y")
        .agg(F.sum("w").alias("w"), F.sum("w_leaf").alias("w_leaf"))
    )


def association(counts: DataFrame) -> DataFrame:
    """(target, leaf, pred, n, top, chi2, dof, z) from observed cells only.

    ``chi2 = n (sum O^2 / (r c) - 1)``: cells never seen contribute nothing.
    Two aggregations, first per predictor token, then per predictor.  ``top`` counts
    the predictor's most frequent token.
    """
    seen = counts.filter(F.col("w") > 0)
    node_y = (
        seen.groupBy("target", "leaf", "pred", "y").agg(F.sum("w").alias("c"))
    )
    w = F.col("w").cast("double")
    per_x = (
        seen.join(node_y, ["target", "leaf", "pred", "y"])
        .groupBy("target", "leaf", "pred", "x")
        .agg(F.sum("w").alias("r"), F.sum(w * w / F.col("c")).alias("s"))
    )
    levels = node_y.groupBy("target", "leaf", "pred").agg(F.count(F.lit(1)).alias("ky"))
    stats = (
        per_x.groupBy("target", "leaf", "pred")
        .agg(
            F.sum("r").alias("n"),
            F.max("r").alias("top"),
            F.count(F.lit(1)).alias("kx"),
            F.sum(F.col("s") / F.col("r")).alias("q"),
        )
        .join(levels, ["target", "leaf", "pred"])
        .filter((F.col("kx") > 1) & (F.col("ky") > 1))
    )
    chi2 = F.col("n") * (F.col("q") - F.lit(1.0))
    dof = (F.col("kx") - 1) * (F.col("ky") - 1)
    return stats.select(
        "target", "leaf", "pred", "n", "top", chi2.alias("chi2"), dof.alias("dof"), F.round(chi2_z(chi2, dof), 9).alias("z")
    )


def critical_for(preds: dict[int, list[int]], alpha: float, target="target") -> Column:
    """Bonferroni threshold by target: alpha over the number of its predictors."""
    values = [critical_z(alpha / len(preds[i])) if preds[i] else None for i in sorted(preds)]
    return F.array(*[F.lit(v).cast("double") for v in values])[F.col(target)]


def chi2_screen(
    df: DataFrame,
    features: Sequence[str],
    alpha: float = 0.05,
    allowed: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(target, predictor, n, chi2, dof, z, rejected) for every allowed pair."""
    features = list(features)
    preds = allowed_indices(features, allowed)
    records = record_weights(df, features, None, 0)
    names = F.array(*[F.lit(f) for f in features])
    return association(contingency(records, features, preds, None, 0)).select(
        names[F.col("target")].alias("target"),
        names[F.col("pred")].alias("predictor"),
        "n",
        "chi2",
        "dof",
        "z",
        (F.col("z") > critical_for(preds, alpha)).alias("rejected"),
    )


def permutation_screen(
    df: DataFrame,
    features: Sequence[str],
    alpha: float = 0.05,
    allowed: Mapping[str, Sequence[str]] | None = None,
    draws: int = 999,
    seed: int = 0,
) -> DataFrame:
    """(target, predictor, n, chi2, z, p_perm, rejected): the screen's statistic beside its permutation null.

    ``p_perm`` needs no large expected counts, so it also holds for rare tokens.
    """
    features = list(features)
    preds = allowed_indices(features, allowed)
    counts = store(contingency(record_weights(df, features, None, 0), features, preds, None, 0)).df
    names = F.array(*[F.lit(f) for f in features])
    tested = association(counts).join(permutation_null(counts, draws, seed), ["target", "leaf", "pred"])
    return tested.select(
        names[F.col("target")].alias("target"),
        names[F.col("pred")].alias("predictor"),
        "n",
        "chi2",
        "z",
        "p_perm",
        (F.col("p_perm") <= bonferroni(preds, alpha)).alias("rejected"),
    )


def bonferroni(preds: dict[int, list[int]], alpha: float, target="target") -> Column:
    values = [alpha / len(preds[i]) if preds[i] else None for i in sorted(preds)]
    return F.array(*[F.lit(v).cast("double") for v in values])[F.col(target)]


def choose_splits(stats: DataFrame, significant: Column, min_node: int, min_leaf: int) -> DataFrame:
    """(target, leaf, split): the strongest significant predictor; ties go to the lower index.

    A predictor whose tokens are all rarer than ``min_leaf`` would have one child, the pool of
    all rows, and is no split.  So a chosen predictor has a child of its own for some token and below
    it is constant there, and rare throughout the pool: no path splits twice on one predictor.
    """
    return (
        stats.filter((F.col("n") >= min_node) & (F.col("top") >= min_leaf) & significant)
        .groupBy("target", "leaf")
        .agg(F.max(F.struct(F.col("z"), (-F.col("pred")).alias("neg"))).alias("best"))
        .select("target", "leaf", (-F.col("best.neg")).cast("int").alias("split"))
    )


def grow_children(counts: DataFrame, splits: DataFrame, min_leaf: int) -> DataFrame:
    """Contingency rows of the chosen predictors, each with its ``child`` leaf.

    Tokens below ``min_leaf`` rows share one child; if even that pool is too
    small they get no edge and stay at the parent.
    """
    chosen = counts.join(splits, ["target", "leaf"]).filter(F.col("pred") == F.col("split"))
    per_x = chosen.groupBy("target", "leaf", "split", "x").agg(
        F.sum("w").alias("n_x"), F.sum("w_leaf").alias("n_leaf")
    )
    labelled = per_x.withColumn(
        "label",
        F.when(F.col("n_x") >= min_leaf, F.concat(F.col("split").cast("string"), F.lit("="), F.col("x"))).otherwise(
            F.concat(F.col("split").cast("string"), F.lit("*"))
        ),
    )
    kept = (
        labelled.groupBy("target", "leaf", "label")
        .agg(F.sum("n_x").alias("n_child"), F.sum("n_leaf").alias("n_leaf"))
        .filter((F.col("n_child") >= min_leaf) & (F.col("n_leaf") > 0))
        .select("target", "leaf", "label")
    )
    edges = labelled.join(kept, ["target", "leaf", "label"]).select(
        "target", "leaf", "x", F.concat("leaf", F.array("label")).alias("child")
    )
    return chosen.join(edges, ["target", "leaf", "x"]).select(
        "target", "leaf", "split", F.col("x").alias("token"), "child", "y", "w_leaf"
    )


def fit_trees(
    df: DataFrame,
    features: Sequence[str],
    alpha: float = 0.05,
    max_depth: int | None = None,
    min_node: int = 20,
    min_leaf: int = 7,
    allowed: Mapping[str, Sequence[str]] | None = None,
    honest_id: str | None = None,
    seed=0,
    draws: int | None = None,
) -> ConditionalModel:
    """One multiway tree per column; a pass over the distinct records for each level.

    Growth ends where no predictor is significant or nodes are too small; a tree is at
    most as deep as it has predictors, and ``max_depth`` may end it earlier.  Blanks are
    missing values: no tokens, and no branches.  ``draws`` tests by that many seeded permutations
    instead of the chi-square limit; it must allow p-values below alpha over the predictors.
    ``honest_id`` names a row id and switches on honest splitting.  State
    between levels is the stored tree, not a per-record assignment, so lineage
    never grows.
    """
    features = list(features)
    preds = allowed_indices(features, allowed)
    most = max(map(len, preds.values()), default=0)
    if draws is not None and most and 1.0 / (draws + 1) > alpha / most:
        raise ValueError(f"{draws} draws cannot reach a p-value of {alpha / most:.3g}")
    records = store(record_weights(df, features, honest_id, seed)).df
    root_cells = F.array(
        *[F.struct(F.lit(i).alias("target"), F.col(f).alias("token")) for i, f in enumerate(features)]
    )
    roots = (
        records.select("w_leaf", F.inline(root_cells))
        .groupBy("target", "token")
        .agg(F.sum("w_leaf").alias("n"))
        .filter((F.col("n") > 0) & (F.col("token") != ""))
        .select("target", root_leaf().alias("leaf"), "token", "n")
    )
    tokens, edges, root_split, depth = [roots], None, {}, 0
    grown = None
    for level in range(most if max_depth is None else min(most, max_depth)):
        counts = store(contingency(records, features, preds, grown, level)).df
        stats = association(counts)
        if draws is None:
            significant = F.col("z") > critical_for(preds, alpha)
        else:
            stats = stats.join(permutation_null(counts, draws, seed), ["target", "leaf", "pred"])
            significant = F.col("p_perm") <= bonferroni(preds, alpha)
        splits = store(choose_splits(stats, significant, min_node, min_leaf))
        if splits.rows == 0:
            break
        if level == 0:
            root_split = {r["target"]: r["split"] for r in splits.df.collect()}  # one per feature
        else:
            edges = with_child_split(edges.df, splits.df)
        children = store(grow_children(counts, splits.df, min_leaf)).df
        tokens.append(
            children.groupBy("target", F.col("child").alias("leaf"), F.col("y").alias("token"))
            .agg(F.sum("w_leaf").alias("n"))
            .filter(F.col("n") > 0)
        )
        added = children.select(
            "target", "leaf", "split", "token", "child", F.lit(None).cast("int").alias("child_split")
        ).distinct()
        edges = store(added if level == 0 else edges.unionByName(added))
        depth = level + 1
        grown = tree_view(features, edges, root_split, depth)
    all_tokens = tokens[0]
    for part in tokens[1:]:
        all_tokens = all_tokens.unionByName(part)
    return build_model(
        features, "tree", all_tokens, edges=edges, root_split=root_split, depth=depth
    )


def with_child_split(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """Fill in the split column of children that were split at this level."""
    found = splits.select("target", F.col("leaf").alias("child"), F.col("split").alias("_found"))
    return edges.join(found, ["target", "child"], "left").select(
        "target", "leaf", "split", "token", "child", F.coalesce("_found", "child_split").alias("child_split")
    )


def tree_view(features, edges: Stored, root_split: dict[int, int], depth: int) -> ConditionalModel:
    """The part of a growing tree that :func:`descend` needs."""
    return ConditionalModel(
        features=list(features), kind="tree", tokens=edges, leaves=edges, roots={}, edges=edges,
        root_split=root_split, depth=depth,
    )
