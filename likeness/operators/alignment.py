"""MAP-alignment scores: per coordinate, per row, per dataset, between datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.bounds import check_alpha, hoeffding_radius
from likeness.functions.ordering import exact_quantiles
from likeness.operators.conditionals import (
    ConditionalModel,
    Probe,
    place,
    probabilities,
    record_counts,
    root_leaf,
    score,
)
from likeness.operators.frames import label_union, tokenise
from likeness.operators.lsm import array_values
from likeness.plans.materialise import Stored, store

# Scoring a row on the row itself plans two joins a column and one for each level of its tree.  Beyond so
# many the plan itself is the burden, and a worker looks all columns up in arrays.
WIDE_JOINS = 96
# Up to so many distinct records are scored once each; a row then looks its record up.  They are only
# counted where the model's alphabets allow at most POSSIBLE_RECORDS.
FEW_RECORDS = 100_000
POSSIBLE_RECORDS = 1 << 20


def score_counts(df: DataFrame, model: ConditionalModel, by: Sequence[str] = (), epsilon: float = 0.0) -> DataFrame:
    """Distinct (by..., target, leaf, token) with their ``rows`` and scores.

    Rows collapse map-side to distinct records, and those to coordinates, before anything is joined, so a
    context shared by a third of the table is one row per token here.  Every dataset-level measure
    is a weighted aggregate of this.
    """
    records = record_counts(df, model.features, by)
    cells = place(records, [model], [*by, "_rows"]).groupBy(*by, "target", "leaf0", "token").agg(F.sum("_rows").alias("rows"))
    return score(cells, model, epsilon)


def weighted(value: str) -> Column:
    """Mean over coordinates; undefined (NULL) coordinates do not count."""
    x = F.col(value)
    return F.sum(F.col("rows") * x) / F.sum(F.when(x.isNotNull(), F.col("rows")))


def upsilon_mean(df: DataFrame, model: ConditionalModel, by: Sequence[str] = (), epsilon: float = 0.0) -> DataFrame:
    return score_counts(df, model, by, epsilon).groupBy(*by).agg(weighted("v").alias("upsilon_mean"))


def upsilon_by_target(df: DataFrame, model: ConditionalModel, by: Sequence[str] = (), epsilon: float = 0.0) -> DataFrame:
    scored = score_counts(df, model, by, epsilon).withColumn("target", model.target_name())
    return scored.groupBy(*by, "target").agg(weighted("v").alias("upsilon"), weighted("hit").alias("hit_rate"))


def map_hit_rate(df: DataFrame, model: ConditionalModel, by: Sequence[str] = ()) -> DataFrame:
    return score_counts(df, model, by).groupBy(*by).agg(weighted("hit").alias("hit_rate"))


def expected_upsilon(df: DataFrame, model: ConditionalModel, by: Sequence[str] = (), epsilon: float = 0.0) -> DataFrame:
    return (
        score_counts(df, model, by, epsilon)
        .groupBy(*by)
        .agg(weighted("expected").alias("expected_upsilon"), weighted("v").alias("upsilon_mean"))
    )


def upsilon_summary(
    df: DataFrame, model: ConditionalModel, alpha: float = 0.05, by: Sequence[str] = (), epsilon: float = 0.0
) -> DataFrame:
    """The seven summary numbers; the interval is not clipped."""
    check_alpha(alpha)
    n = len(model.features)
    base = (
        score_counts(df, model, by, epsilon)
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum(F.when(F.col("target") == 0, F.col("rows"))), F.lit(0)).cast("double").alias("n_rows"),
            weighted("v").alias("upsilon_mean"),
        )
    )
    eps = hoeffding_radius("n_rows", F.lit(n), alpha)
    return base.select(
        *by,
        "n_rows",
        F.lit(float(n)).alias("n_features"),
        "upsilon_mean",
        eps.alias("upsilon_semibound_hoeffding"),
        (F.col("upsilon_mean") - eps).alias("upsilon_ci_lower"),
        (F.col("upsilon_mean") + eps).alias("upsilon_ci_upper"),
        F.lit(float(alpha)).alias("alpha"),
    )


def can_score_wide(model: ConditionalModel) -> bool:
    """Whether rows can be scored where they are, without a shuffle."""
    return model.small


def tree_depths(model: ConditionalModel) -> dict[int, int]:
    """Levels of each column's tree; one row per column comes to the driver."""
    if model.kind != "tree" or model.edges is None:
        return {}
    rows = model.edges.df.groupBy("target").agg(F.max(F.size("child")).alias("d")).collect()
    return {r["target"]: r["d"] for r in rows}


def wide_descent(out: DataFrame, model: ConditionalModel, i: int, depth: int) -> DataFrame:
    """Add ``_leaf``, the leaf of column ``i``'s tree that a row falls in: a broadcast lookup a level.

    A row that found no edge has no further split, and its lookups compare with NULL.
    """
    out = out.withColumns({"_leaf": root_leaf(), "_split": F.lit(model.root_split.get(i)).cast("int")})
    toks = F.array(*model.features)
    for level in range(depth):
        edges = model.edges.df.filter((F.col("target") == i) & (F.size("leaf") == level)).select(
            F.col("leaf").alias("_from"), F.col("token").alias("_token"),
            F.col("child").alias("_child"), F.col("child_split").alias("_next"),
        )
        on = (F.get(toks, F.col("_split")) == F.col("_token")) & (F.col("_leaf") == F.col("_from"))
        out = out.join(F.broadcast(edges), on, "left").withColumns(
            {"_leaf": F.coalesce("_child", "_leaf"), "_split": F.when(F.col("_child").isNotNull(), F.col("_next"))}
        ).drop("_from", "_token", "_child", "_next")
    return out.drop("_split")


def wide_counts(df: DataFrame, model: ConditionalModel, keep: Sequence[str]) -> DataFrame:
    """(keep..., features..., _o0, _n0, _m0, ...): observed count, leaf total and leaf maximum of every coordinate."""
    features = model.features
    depths = tree_depths(model)
    out = tokenise(df, features, keep)
    for i, f in enumerate(features):
        n, top = (F.lit(v).cast("bigint") for v in model.roots.get(i, (None, None))[:2])
        mine = model.leaves.df.filter(F.col("target") == i)
        counts = model.tokens.df.filter(F.col("target") == i).select(
            F.col("leaf").alias("_at"), F.col("token").alias("_token"), F.col("n").alias(f"_o{i}")
        )
        rooted = (not depths.get(i)) if model.kind == "tree" else not model.contexts[i]
        if rooted:
            out = out.withColumns({"_leaf": root_leaf(), f"_n{i}": n, f"_m{i}": top})
        else:
            if model.kind == "tree":
                out = wide_descent(out, model, i, depths[i])
            else:
                out = out.withColumn("_leaf", F.array(*[F.col(features[j]) for j in model.contexts[i]]))
            stats = mine.select(F.col("leaf").alias("_at"), F.col("n").alias("_ln"), F.col("n_max").alias("_lm"))
            # A leaf nothing is known of falls back to the marginal.
            out = out.join(F.broadcast(stats), F.col("_leaf") == F.col("_at"), "left").withColumns(
                {
                    "_leaf": F.when(F.col("_ln").isNull(), root_leaf()).otherwise(F.col("_leaf")),
                    f"_n{i}": F.coalesce("_ln", n),
                    f"_m{i}": F.coalesce("_lm", top),
                }
            ).drop("_at", "_ln", "_lm")
        on = (F.col(f) == F.col("_token")) & (F.col("_leaf") == F.col("_at"))
        out = out.join(F.broadcast(counts), on, "left").drop("_token", "_at", "_leaf")
        out = out.withColumn(f"_o{i}", F.coalesce(f"_o{i}", F.lit(0).cast("bigint")))
    return out


def planned_joins(model: ConditionalModel) -> int:
    return 2 * len(model.features) + len(model.features) * (model.depth if model.kind == "tree" else 0)


def wide_values(df: DataFrame, model: ConditionalModel, keep: Sequence[str], epsilon: float = 0.0) -> DataFrame:
    """(keep..., v0, v1, ...): every coordinate of a row scored on the row itself.

    Broadcast lookups, or beyond ``WIDE_JOINS`` one pass over arrays, and no shuffle at all, so
    it also runs on a stream.  Needs a model below the broadcast bound.
    """
    if planned_joins(model) > WIDE_JOINS:
        return array_values(df, model, keep, epsilon)
    values = []
    for i, f in enumerate(model.features):
        v = probabilities(F.col(f"_o{i}"), F.col(f"_n{i}"), F.col(f"_m{i}"), F.lit(0), epsilon)["v"]
        values.append(F.when(F.col(f) != "", v).alias(f"v{i}"))
    return wide_counts(df, model, keep).select(*keep, *values)


def few_records(df: DataFrame, model: ConditionalModel) -> Stored | None:
    """The distinct records of ``df``, stored, if they are few: None where the model's tokens allow more, or on a stream."""
    alphabets = [model.roots[i][2] + 1 if i in model.roots else 1 for i in range(len(model.features))]
    if df.isStreaming or not model.small or planned_joins(model) > WIDE_JOINS or prod(alphabets) > POSSIBLE_RECORDS:
        return None
    records = store(tokenise(df, model.features).distinct())
    return records if records.rows <= FEW_RECORDS and records.small else None


def by_record(df: DataFrame, scored: DataFrame, model: ConditionalModel, keep: Sequence[str], out: str) -> DataFrame:
    """(keep..., out) of every row from its record's: one broadcast lookup; blanks are tokens, so none is NULL."""
    named = scored.select(*[F.col(f).alias(f"_f{i}") for i, f in enumerate(model.features)], F.col(out).alias("_out"))
    rows = tokenise(df, model.features, keep)
    on = [F.col(f) == F.col(f"_f{i}") for i, f in enumerate(model.features)]
    return rows.join(F.broadcast(named), on).select(*keep, F.col("_out").alias(out))


def upsilon_matrix(
    df: DataFrame, model: ConditionalModel, keep: Sequence[str] = ("row_id",), epsilon: float = 0.0
) -> DataFrame:
    """(keep..., target, p_obs, p_max, v) for every coordinate; no shuffle while the model is small.

    Few distinct records are scored once each.  Otherwise trees are descended once on the row, instead of once
    for each of its coordinates with all its tokens.
    """
    records = few_records(df, model)
    if records or (model.kind == "tree" and model.small and planned_joins(model) <= WIDE_JOINS):
        cells = []
        for i, f in enumerate(model.features):
            k = F.lit(model.roots.get(i, (None, None, None))[2]).cast("bigint")
            parts = probabilities(F.col(f"_o{i}"), F.col(f"_n{i}"), F.col(f"_m{i}"), k, epsilon)
            seen = {name: parts[name] if name == "p_max" else F.when(F.col(f) != "", parts[name]) for name in ("p_obs", "p_max", "v")}
            cells.append(F.struct(F.lit(f).alias("target"), *[c.alias(name) for name, c in seen.items()]))
        if records:
            scored = wide_counts(records.df, model, ()).select(*model.features, F.array(*cells).alias("_cells"))
            return by_record(df, scored, model, keep, "_cells").select(*keep, F.inline("_cells"))
        return wide_counts(df, model, keep).select(*keep, F.inline(F.array(*cells)))
    cells = score(place(df, [model], keep), model, epsilon).withColumn("target", model.target_name())
    return cells.select(*keep, "target", "p_obs", "p_max", "v")


def mean_value(model: ConditionalModel) -> Column:
    """The mean of the defined ones of v0, v1, ..."""
    vs = [F.col(f"v{i}") for i in range(len(model.features))]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in vs), F.lit(0.0))
    defined = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in vs), F.lit(0))
    return F.when(defined > 0, total / defined)


def scored_records(records: DataFrame, model: ConditionalModel, epsilon: float = 0.0) -> DataFrame:
    """(features..., upsilon) of distinct records."""
    kept = records.select(*[F.col(f).alias(f"_k{i}") for i, f in enumerate(model.features)], *model.features)
    values = wide_values(kept, model, [f"_k{i}" for i in range(len(model.features))], epsilon)
    return values.select(*[F.col(f"_k{i}").alias(f) for i, f in enumerate(model.features)], mean_value(model).alias("upsilon"))


def upsilon_rows(
    df: DataFrame, model: ConditionalModel, keep: Sequence[str] = ("row_id",), epsilon: float = 0.0
) -> DataFrame:
    """(keep..., upsilon): mean alignment of each row; ``keep`` must identify a row.

    Few distinct records are scored once each.
    """
    records = few_records(df, model)
    if records:
        return by_record(df, scored_records(records.df, model, epsilon), model, keep, "upsilon")
    if can_score_wide(model):
        return wide_values(df, model, keep, epsilon).select(*keep, mean_value(model).alias("upsilon"))
    scored = score(place(df, [model], keep), model, epsilon)
    return scored.groupBy(*keep).agg(F.avg("v").alias("upsilon"))


def upsilon_histogram(rows: DataFrame, bins: int = 20, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Counts per score bin; a score of exactly 1 belongs to the last bin."""
    at = F.least(F.floor(F.col("upsilon") * bins), F.lit(bins - 1)).cast("bigint")
    return (
        rows.filter(F.col("upsilon").isNotNull())
        .groupBy(*by, at.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def upsilon_quantiles(
    rows: DataFrame, probs: Mapping[str, float] | None = None, by: Sequence[str] = ("dataset",), weight: str | None = None
) -> DataFrame:
    """Quantiles of row scores; ``weight`` names the count of rows that each stands for."""
    return exact_quantiles(rows, "upsilon", dict(probs or {"median": 0.5, "p95": 0.95}), by, weight=weight)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def delta_upsilon(
    real: DataFrame, synth: DataFrame, model: ConditionalModel, alpha: float = 0.05, epsilon: float = 0.0
) -> DataFrame:
    """One-sided fidelity: both tables scored under the model of the real one, in one job."""
    check_alpha(alpha)
    both = label_union({"real": real, "synth": synth}, model.features, keep=())
    scored = score_counts(both, model, ["dataset"], epsilon)

    def side(name: str) -> tuple[Column, Column]:
        mine = F.col("dataset") == name
        cells = F.sum(F.when(mine & F.col("v").isNotNull(), F.col("rows")))
        rows = F.sum(F.when(mine & (F.col("target") == 0), F.col("rows")))
        return F.sum(F.when(mine, F.col("rows") * F.col("v"))) / cells, F.coalesce(rows, F.lit(0))

    (u_real, m_real), (u_syn, m_syn) = side("real"), side("synth")
    n = F.lit(len(model.features))
    base = scored.agg(
        u_real.alias("upsilon_real"), u_syn.alias("upsilon_syn"), m_real.alias("m_real"), m_syn.alias("m_syn")
    )
    delta = F.col("upsilon_real") - F.col("upsilon_syn")
    radius = hoeffding_radius("m_real", n, alpha, 4.0) + hoeffding_radius("m_syn", n, alpha, 4.0)
    return base.select(
        "upsilon_real",
        "upsilon_syn",
        delta.alias("delta"),
        radius.alias("radius"),
        clip(delta - radius, -1.0, 1.0).alias("ci_lower"),
        clip(delta + radius, -1.0, 1.0).alias("ci_upper"),
    )


def map_distance(
    pool: DataFrame,
    model1: ConditionalModel,
    model2: ConditionalModel,
    alpha: float = 0.05,
    eps1: float = 0.0,
    eps2: float = 0.0,
    epsilon: float = 0.0,
    weight: str | None = None,
) -> DataFrame:
    """Mean absolute gap between the two models' alignments over the pooled records.

    Equal records, and coordinates equal under both models, collapse before either lookup; ``weight`` names
    the count of rows that each record of ``pool`` stands for.
    """
    check_alpha(alpha)
    if model1.features != model2.features:
        raise ValueError("the two models describe different features")
    cells = (
        place(record_counts(pool, model1.features, weight=weight), [model1, model2], ["_rows"])
        .groupBy("target", "leaf0", "leaf1", "token")
        .agg(F.sum("_rows").alias("rows"))
    )
    scored = score(score(cells, model1, epsilon, "leaf0", "_1"), model2, epsilon, "leaf1", "_2").withColumn(
        "gap", F.abs(F.col("v_1") - F.col("v_2"))
    )
    base = scored.agg(
        F.coalesce(F.sum(F.when(F.col("target") == 0, F.col("rows"))), F.lit(0)).alias("m"),
        weighted("gap").alias("distance"),
    )
    radius = hoeffding_radius("m", F.lit(len(model1.features)), alpha) + F.lit(float(eps1 + eps2))
    return base.select(
        "m",
        "distance",
        radius.alias("radius"),
        clip(F.col("distance") - radius, 0.0, 1.0).alias("ci_lower"),
        clip(F.col("distance") + radius, 0.0, 1.0).alias("ci_upper"),
    )


def brook_logodds(
    df: DataFrame,
    model: ConditionalModel,
    reference: Sequence[str],
    keep: Sequence[str] = ("row_id",),
    epsilon: float = 1e-3,
) -> DataFrame:
    """(keep..., log_odds): log P(x)/P(reference) by the Brook factorisation.

    Step i conditions on the row's own values before i and the reference's after.
    """
    if epsilon <= 0.0:
        raise ValueError("log-odds need a positive floor")
    features = model.features
    if len(reference) != len(features):
        raise ValueError(f"reference has {len(reference)} values, expected {len(features)}")
    ref = [F.lit(str(r)) for r in reference]
    probes = []
    for i, f in enumerate(features):
        hybrid = [F.col(g) if j < i else ref[j] for j, g in enumerate(features)]
        probes.append(Probe(i, F.col(f), hybrid, {"sign": F.lit(1.0)}))
        probes.append(Probe(i, ref[i], hybrid, {"sign": F.lit(-1.0)}))
    scored = score(place(df, [model], keep, probes), model, epsilon)
    return scored.groupBy(*keep).agg(F.sum(F.col("sign") * F.log("p_obs")).alias("log_odds"))
