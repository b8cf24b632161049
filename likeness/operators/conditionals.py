"""The conditional family: one categorical distribution per (column, leaf).

A model is three small tables.

* ``tokens(target, leaf, token, n)``: training rows per leaf and token;
* ``leaves(target, leaf, n, n_max, k, sq)``: per-leaf total, largest count,
  number of tokens and sum of squared probabilities, so neither the maximum nor
  the expected alignment ever loops over the alphabet at scoring time;
* ``edges`` (learned trees only): see :mod:`likeness.operators.trees`.

``leaf`` is an array of path elements.  The empty array is the root, that is
the column's marginal, and doubles as the alphabet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.operators.frames import tokenise
from likeness.plans.materialise import BROADCAST_ROWS, Stored, keyed_join, lookup, store

LEAF_TYPE = "array<string>"


def root_leaf() -> Column:
    return F.array().cast(LEAF_TYPE)


@dataclass(frozen=True)
class Probe:
    """One coordinate to look up: which column, its value and the rest of the row."""

    target: int
    token: Column
    context: Sequence[Column]
    tags: Mapping[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class ConditionalModel:
    features: list[str]
    kind: str  # "context" or "tree"
    tokens: Stored
    leaves: Stored
    roots: dict[int, tuple[int, int, int, float]]  # target -> (n, n_max, k, sq)
    contexts: dict[int, list[int]] = field(default_factory=dict)
    edges: Stored | None = None
    root_split: dict[int, int] = field(default_factory=dict)
    depth: int = 0

    @property
    def small(self) -> bool:
        """Every table was counted and is below the broadcast bound."""
        return all(t.small for t in (self.tokens, self.leaves, self.edges) if t is not None)

    @property
    def training_rows(self) -> int:
        return max((r[0] for r in self.roots.values()), default=0)

    def target_name(self, target="target") -> Column:
        return F.array(*[F.lit(f) for f in self.features])[F.col(target)]

    def start(self, probe: Probe) -> Column:
        """The leaf of a context model; the root for a tree, which then descends."""
        if self.kind == "tree":
            return root_leaf()
        ctx = self.contexts[probe.target]
        return F.array(*[probe.context[j] for j in ctx]) if ctx else root_leaf()

    def root_value(self, which: int, target="target") -> Column:
        """A per-column root constant; the list is as long as the feature list."""
        values = [self.roots[i][which] if i in self.roots else None for i in range(len(self.features))]
        kind = "double" if which == 3 else "bigint"
        return F.array(*[F.lit(v).cast(kind) for v in values])[F.col(target)]


def row_probes(features: Sequence[str]) -> list[Probe]:
    cols = [F.col(f) for f in features]
    return [Probe(i, cols[i], cols) for i in range(len(features))]


def place(
    df: DataFrame,
    models: Sequence[ConditionalModel],
    keep: Sequence[str] = (),
    probes: Sequence[Probe] | None = None,
) -> DataFrame:
    """One row per (record, probe): (keep..., target, token, tags..., leaf0, leaf1, ...).

    A pure projection for context models, so several models cost one scan.
    """
    features = models[0].features
    base = tokenise(df, features, keep)
    probes = row_probes(features) if probes is None else probes
    trees = [k for k, m in enumerate(models) if m.kind == "tree"]
    structs = []
    for p in probes:
        fields = [F.lit(p.target).alias("target"), p.token.alias("token")]
        fields += [c.alias(name) for name, c in p.tags.items()]
        fields += [m.start(p).alias(f"leaf{k}") for k, m in enumerate(models)]
        fields += [F.lit(models[k].root_split.get(p.target)).cast("int").alias(f"split{k}") for k in trees]
        if trees:
            fields.append(F.array(*p.context).alias("_toks"))
        structs.append(F.struct(*fields))
    long = base.select(*keep, F.inline(F.array(*structs)))
    for k in trees:
        long = descend(long, models[k], f"leaf{k}", f"split{k}").drop(f"split{k}")
    return long.drop("_toks") if trees else long


def descend(long: DataFrame, model: ConditionalModel, leaf: str, split: str) -> DataFrame:
    """Walk every row down its target's tree, one equi-join per level.

    A token without an edge leaves the row at the deepest node reached.
    """
    if model.edges is None:
        return long
    edges = lookup(
        model.edges.df.select(
            F.col("target").alias("_t"),
            F.col("leaf").alias("_leaf"),
            F.col("token").alias("_token"),
            F.col("child").alias("_child"),
            F.col("child_split").alias("_next"),
        ),
        model.edges.small,
    )
    for _ in range(model.depth):
        here = F.try_element_at(F.col("_toks"), F.col(split) + 1)
        on = (F.col("target") == F.col("_t")) & (F.col(leaf) == F.col("_leaf")) & (here == F.col("_token"))
        long = (
            long.join(edges, on, "left")
            .withColumn(split, F.when(F.col("_child").isNotNull(), F.col("_next")))
            .withColumn(leaf, F.coalesce(F.col("_child"), F.col(leaf)))
            .drop("_t", "_leaf", "_token", "_child", "_next")
        )
    return long


def settle(placed: DataFrame, model: ConditionalModel, leaf: str = "leaf0") -> DataFrame:
    """Attach leaf statistics; an unseen context falls back to the column's marginal."""
    stats = model.leaves.df.select(
        F.col("target").alias("_t"),
        F.col("leaf").alias("_leaf"),
        F.col("n").alias("leaf_n"),
        F.col("n_max").alias("leaf_max"),
        F.col("k").alias("leaf_k"),
        F.col("sq").alias("leaf_sq"),
    )
    joined = keyed_join(
        placed, stats, {"target": "_t", leaf: "_leaf"}, model.leaves.small, "leaf_n", model.training_rows
    )
    return (
        joined.withColumn(leaf, F.when(F.col("leaf_n").isNull(), root_leaf()).otherwise(F.col(leaf)))
        .withColumns(
            {
                "leaf_n": F.coalesce("leaf_n", model.root_value(0)),
                "leaf_max": F.coalesce("leaf_max", model.root_value(1)),
                "leaf_k": F.coalesce("leaf_k", model.root_value(2)),
                "leaf_sq": F.coalesce("leaf_sq", model.root_value(3)),
                "k": model.root_value(2),
            }
        )
    )


def probabilities(n_obs: Column, n: Column, n_max: Column, k: Column, epsilon: float) -> dict[str, Column]:
    """p_obs, p_max, v and hit from counts, with the positivity floor.

    Ties are compared as integer counts, never as ratios.
    """
    hit = (n_obs == n_max).cast("int")
    if epsilon == 0.0:
        return {"p_obs": n_obs / n, "p_max": n_max / n, "v": n_obs / n_max, "hit": hit}
    eps = F.lit(float(epsilon))
    mass = F.lit(1.0) + k * eps
    return {
        "p_obs": (n_obs / n + eps) / mass,
        "p_max": (n_max / n + eps) / mass,
        "v": (n_obs / n + eps) / (n_max / n + eps),
        "hit": hit,
    }


def expected_alignment(sq: Column, n: Column, n_max: Column, k: Column, epsilon: float) -> Column:
    """``sum_y p_y^2 / p_max`` of a leaf under the floor."""
    eps = F.lit(float(epsilon))
    top = sq + F.lit(2.0) * eps + k * eps * eps
    return top / ((F.lit(1.0) + k * eps) * (n_max / n + eps))


def score(
    placed: DataFrame, model: ConditionalModel, epsilon: float = 0.0, leaf: str = "leaf0", suffix: str = ""
) -> DataFrame:
    """Add p_obs, p_max, v, hit and expected for every placed coordinate."""
    settled = settle(placed, model, leaf)
    counts = model.tokens.df.select(
        F.col("target").alias("_t"),
        F.col("leaf").alias("_leaf"),
        F.col("token").alias("_token"),
        F.col("n").alias("_n"),
    )
    joined = keyed_join(
        settled,
        counts,
        {"target": "_t", leaf: "_leaf", "token": "_token"},
        model.tokens.small,
        "_n",
        model.training_rows,
    )
    n_obs = F.coalesce(F.col("_n"), F.lit(0).cast("bigint"))
    parts = probabilities(n_obs, F.col("leaf_n"), F.col("leaf_max"), F.col("k"), epsilon)
    # A blank is a missing value: nothing was observed, so its scores are undefined.
    parts = {k: c if k == "p_max" else F.when(F.col("token") != "", c) for k, c in parts.items()}
    parts["expected"] = expected_alignment(
        F.col("leaf_sq"), F.col("leaf_n"), F.col("leaf_max"), F.col("k"), epsilon
    )
    return (
        joined.withColumns({f"{name}{suffix}": c for name, c in parts.items()})
        .drop("_n", "leaf_n", "leaf_max", "leaf_k", "leaf_sq", "k")
    )


def leaf_stats(tokens: DataFrame) -> DataFrame:
    """Per-leaf totals; sums of squares in double since counts squared overflow."""
    n = F.col("n").cast("double")
    return (
        tokens.groupBy("target", "leaf")
        .agg(
            F.sum("n").alias("n"),
            F.max("n").alias("n_max"),
            F.count(F.lit(1)).alias("k"),
            F.sum(n * n).alias("_sq"),
        )
        .select("target", "leaf", "n", "n_max", "k", (F.col("_sq") / (F.col("n") * F.col("n").cast("double"))).alias("sq"))
    )


def build_model(features: Sequence[str], kind: str, tokens: DataFrame, **rest) -> ConditionalModel:
    """Store the token counts, derive the leaf table, read back one root row per column."""
    stored = store(tokens)
    leaves = store(leaf_stats(stored.df))
    return ConditionalModel(
        features=list(features), kind=kind, tokens=stored, leaves=leaves, roots=read_roots(leaves.df), **rest
    )


def read_roots(leaves: DataFrame) -> dict[int, tuple[int, int, int, float]]:
    rows = leaves.filter(F.size("leaf") == 0).collect()  # at most one per feature
    return {r["target"]: (r["n"], r["n_max"], r["k"], r["sq"]) for r in rows}


def context_indices(features: Sequence[str], contexts: Mapping[str, Sequence[str]]) -> dict[int, list[int]]:
    out = {}
    for i, f in enumerate(features):
        ctx = [features.index(c) for c in contexts.get(f, [])]
        if i in ctx:
            raise ValueError(f"column {f!r} cannot be its own context")
        out[i] = ctx
    return out


def record_counts(
    df: DataFrame, features: Sequence[str], by: Sequence[str] = (), weight: str | None = None, out: str = "_rows"
) -> DataFrame:
    """(by..., features..., out): distinct records and how many rows each stands for.

    ``weight`` names that count in a table that is already collapsed.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    return tokenise(df, features, [*by, weight] if weight else by).groupBy(*by, *features).agg(rows.alias(out))


def fit_context(
    df: DataFrame, features: Sequence[str], contexts: Mapping[str, Sequence[str]], weight: str | None = None
) -> ConditionalModel:
    """Frequency tables given named context columns: one scan, one shuffle of distinct records, one of partial counts.

    ``weight`` names the count of rows a record stands for.  The counts are stored, and the marginals come from the stored table.  Blanks are
    missing values: they are no tokens, and a context with a blank is none, so its rows
    count for the marginal alone.
    """
    features = list(features)
    idx = context_indices(features, contexts)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("target"),
                (F.array(*[features[j] for j in idx[i]]) if idx[i] else root_leaf()).alias("leaf"),
                F.col(f).alias("token"),
            )
            for i, f in enumerate(features)
        ]
    )
    counts = (
        record_counts(df, features, weight=weight)
        .select("_rows", F.inline(cells))
        .filter("token <> ''")
        .groupBy("target", "leaf", "token")
        .agg(F.sum("_rows").alias("n"))
    )
    counts = store(counts).df
    marginals = (
        counts.filter(F.size("leaf") > 0)
        .groupBy("target", "token")
        .agg(F.sum("n").alias("n"))
        .select("target", root_leaf().alias("leaf"), "token", "n")
    )
    known = counts.filter(~F.array_contains("leaf", ""))
    return build_model(features, "context", known.unionByName(marginals), contexts=idx)


def predict(
    df: DataFrame,
    model: ConditionalModel,
    keep: Sequence[str] = ("row_id",),
    epsilon: float = 0.0,
    all_tokens: bool = True,
) -> DataFrame:
    """(keep..., target, token, p): the whole predictive distribution of every coordinate.

    ``all_tokens=False`` leaves out tokens the leaf never saw.
    """
    settled = settle(place(df, [model], keep), model)
    seen = model.tokens.df.select(
        F.col("target").alias("_t"), F.col("leaf").alias("_leaf"), F.col("token").alias("y"), F.col("n").alias("_n")
    )
    if all_tokens:
        alphabet = model.tokens.df.filter(F.size("leaf") == 0).select(
            F.col("target").alias("_t"), F.col("token").alias("y")
        )
        leaves = model.leaves.df.select(F.col("target").alias("_t"), F.col("leaf").alias("_leaf"))
        # Model-sized: every leaf with its own column's alphabet.
        seen = leaves.join(alphabet, "_t").join(seen, ["_t", "_leaf", "y"], "left")
    on = (F.col("target") == F.col("_t")) & (F.col("leaf0") == F.col("_leaf"))
    eps = F.lit(float(epsilon))
    p = (F.coalesce(F.col("_n"), F.lit(0)) / F.col("leaf_n") + eps) / (F.lit(1.0) + F.col("k") * eps)
    widest = max((v[2] for v in model.roots.values()), default=0) if all_tokens else 1
    small = model.small and model.leaves.rows * widest <= BROADCAST_ROWS
    return settled.join(lookup(seen, small), on).select(
        *keep, model.target_name().alias("target"), F.col("y").alias("token"), p.alias("p")
    )


def suggest_restricted(df: DataFrame, features: Sequence[str], max_levels: int) -> list[str]:
    """Columns with too many levels to serve as predictors."""
    levels = df.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    return [f for f in features if levels[f] > max_levels]


def restrict_predictors(
    features: Sequence[str], barred: Sequence[str], contexts: Mapping[str, Sequence[str]] | None = None
) -> dict[str, list[str]]:
    """Allowed predictors per target: barred columns predict nothing but are still modelled."""
    out = {}
    for f in features:
        base = contexts.get(f, []) if contexts is not None else [g for g in features if g != f]
        out[f] = [g for g in base if g not in set(barred)]
    return out
