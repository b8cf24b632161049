"""Tree sampling: fill a row's coordinates in random order from their conditionals.

The order differs from row to row.  A model below the broadcast bound is shipped to the workers
as flat arrays and rows are filled batch by batch (:class:`LeafSampler`).  A larger one stays
a table: each step is one join of all rows, whichever column each visits, with leaves
and guide cells (:func:`sample_by_joins`).  Both draw the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from likeness.functions.draws import uniform
from likeness.functions.ordering import draw_index, guide_cell, token_order_guide
from likeness.operators.conditionals import ConditionalModel, Probe, descend, root_leaf, settle
from likeness.operators.frames import tokenise
from likeness.plans.materialise import keyed_join, store


class LeafSampler:
    """A model as flat arrays: token codes, leaf ranges, routes.

    A draw finds its token among those of a leaf laid end to end, in the order of ``place`` (their own).
    """

    def __init__(self, model: ConditionalModel, place: Callable[[str], str] = str):
        if not model.small:
            raise ValueError("only a model below the broadcast bound is shipped to workers")
        n = len(model.features)
        self.kind, self.depth, self.contexts = model.kind, model.depth, model.contexts
        tokens = sorted(
            ((r["target"], tuple(r["leaf"]), r["token"], r["n"]) for r in model.tokens.df.collect()),
            key=lambda t: (t[0], t[1], place(t[2]), t[2]),
        )
        self.alphabet: list[list[str]] = [[] for _ in range(n)]
        for target, leaf, tok, _ in tokens:
            if not leaf:
                self.alphabet[target].append(tok)
        self.code = [{t: i for i, t in enumerate(a)} for a in self.alphabet]
        self.base = 1 + max((len(a) for a in self.alphabet), default=0)
        self.leaf_id: dict = {}
        codes, counts, owner = [], [], []
        for target, leaf, tok, cnt in tokens:
            lid = self.leaf_id.setdefault((target, leaf), len(self.leaf_id))
            codes.append(self.code[target][tok])
            counts.append(cnt)
            owner.append(lid)
        self.codes = np.array(codes, dtype=np.int64)
        self.starts = np.searchsorted(np.array(owner, dtype=np.int64), np.arange(len(self.leaf_id)))
        self.upto = np.cumsum(np.array(counts, dtype=np.int64))
        self.size = np.bincount(np.array(owner), weights=np.array(counts), minlength=len(self.leaf_id)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        # A column that was always blank has no token to draw; it stays blank.
        self.root = np.array([self.leaf_id.get((t, ()), -1) for t in range(n)])
        self.routes(model, n)

    def routes(self, model: ConditionalModel, n: int) -> None:
        self.split = np.full(len(self.leaf_id), -1, dtype=np.int64)
        pairs: list[tuple[int, int]] = []
        self.context_keys: list[tuple[np.ndarray, np.ndarray]] = []
        if model.kind == "tree":
            for t, j in model.root_split.items():
                if self.root[t] >= 0:
                    self.split[self.root[t]] = j
            for r in model.edges.df.collect() if model.edges is not None else []:
                t, child = r["target"], self.leaf_id[(r["target"], tuple(r["child"]))]
                code = self.code[r["split"]].get(r["token"])
                if code is None:  # a token seen only in the other half of an honest fit
                    continue
                if r["child_split"] is not None:
                    self.split[child] = r["child_split"]
                pairs.append((self.leaf_id[(t, tuple(r["leaf"]))] * self.base + code, child))
        else:
            for t in range(n):
                ctx = model.contexts[t]
                found = {}
                for (target, leaf), lid in self.leaf_id.items():
                    if target == t and ctx and leaf:
                        found[tuple(self.code[j][tok] for j, tok in zip(ctx, leaf))] = lid
                self.context_keys.append(found)
        pairs.sort()
        self.edge_key = np.array([p[0] for p in pairs], dtype=np.int64)
        self.edge_to = np.array([p[1] for p in pairs], dtype=np.int64)

    def route(self, target: int, state: np.ndarray) -> np.ndarray:
        """Leaf of ``target`` for each row of codes (-1 = missing)."""
        at = np.full(len(state), self.root[target])
        if self.kind == "context":
            ctx, found = self.contexts[target], self.context_keys[target]
            if not ctx:
                return at
            seen, back = np.unique(state[:, ctx], axis=0, return_inverse=True)
            leaves = np.array([found.get(tuple(c), self.root[target]) for c in seen.tolist()])
            return leaves[back.reshape(-1)]
        if not len(self.edge_key):
            return at
        live = np.arange(len(state))
        for _ in range(self.depth):
            column = self.split[at[live]]
            live, column = live[column >= 0], column[column >= 0]
            code = state[live, column]
            live, code = live[code >= 0], code[code >= 0]
            key = at[live] * self.base + code
            pos = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            hit = self.edge_key[pos] == key
            live = live[hit]
            at[live] = self.edge_to[pos[hit]]
        return at

    def draw(self, leaf: np.ndarray, u: np.ndarray) -> np.ndarray:
        idx = np.minimum((u * self.size[leaf]).astype(np.int64), self.size[leaf] - 1)
        return self.codes[np.searchsorted(self.upto, self.first[leaf] + idx, side="right")]

    def fill(self, state: np.ndarray, order: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Resample missing coordinates; observed ones are never touched.

        ``order[:, s]`` is the column visited at step s, ``draws[:, s]`` its uniform draw.
        """
        free = state < 0
        for s in range(order.shape[1]):
            u = draws[:, s]
            for target in range(state.shape[1]):
                rows = np.flatnonzero((order[:, s] == target) & free[:, target])
                if len(rows) and self.root[target] >= 0:
                    state[rows, target] = self.draw(self.route(target, state[rows]), u[rows])
        return state


class LeafScorer(LeafSampler):
    """The same arrays, asked for counts instead of draws."""

    def __init__(self, model: ConditionalModel):
        super().__init__(model)
        owner = np.repeat(np.arange(len(self.size)), np.diff(np.append(self.starts, len(self.codes))))
        counts = np.diff(np.concatenate([[0], self.upto]))
        self.key = owner * self.base + self.codes
        by_key = np.argsort(self.key, kind="stable")
        self.key, self.seen = self.key[by_key], counts[by_key]
        self.most = np.zeros(len(self.size), np.int64)
        np.maximum.at(self.most, owner, counts)

    def values(self, target: int, state: np.ndarray, epsilon: float) -> np.ndarray:
        """Alignment of ``target`` for each row of codes; NaN where it is blank or has no model."""
        code = state[:, target]
        if self.root[target] < 0 or not len(state):
            return np.full(len(state), np.nan)
        leaf = self.route(target, state)
        key = leaf * self.base + np.where((code >= 0) & (code < self.base), code, 0)
        pos = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = (self.key[pos] == key) & (code >= 0) & (code < self.base)
        n, top = np.where(known, self.seen[pos], 0), self.most[leaf]
        v = n / top if epsilon == 0.0 else (n / self.size[leaf] + epsilon) / (top / self.size[leaf] + epsilon)
        return np.where(code == -1, np.nan, v)


def coded(sampler: LeafSampler, batch, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token codes of a batch (-1: blank) and where a token is outside the alphabet."""
    state = np.empty((len(batch), len(features)), dtype=np.int64)
    for j, f in enumerate(features):
        state[:, j] = batch[f].map(sampler.code[j]).fillna(-1).to_numpy(dtype=np.int64)
    # A token outside the alphabet is observed: it stays, and no leaf knows it.
    unknown = (batch[list(features)].to_numpy(dtype=object) != "") & (state < 0)
    state[unknown] = np.iinfo(np.int64).max // (sampler.base + 1)
    return state, unknown


def array_values(df: DataFrame, model: ConditionalModel, keep: Sequence[str], epsilon: float = 0.0) -> DataFrame:
    """(keep..., v0, v1, ...) by lookups in arrays: one pass for any number of columns and levels."""
    features, keep = list(model.features), list(keep)
    names = [f"v{i}" for i in range(len(features))]
    shipped = df.sparkSession.sparkContext.broadcast(LeafScorer(model))

    def run(batches: Iterator):
        scorer = shipped.value
        for batch in batches:
            state, _ = coded(scorer, batch, features)
            out = batch[keep].copy()
            for i, name in enumerate(names):
                out[name] = scorer.values(i, state, epsilon)
            yield out

    kept = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    scored = tokenise(df, features, keep).mapInPandas(run, f"{kept}, " + ", ".join(f"{v} double" for v in names))
    return scored.select(*keep, *[F.nanvl(v, F.lit(None)).alias(v) for v in names])


def by_target(model: ConditionalModel, make) -> Column:
    """``make(i)`` of the column a row visits."""
    out = None
    for i in range(len(model.features)):
        hit = F.col("target") == i
        out = F.when(hit, make(i)) if out is None else out.when(hit, make(i))
    return out


def sample_by_joins(rows: DataFrame, model: ConditionalModel, keep: Sequence[str], seed: int, steps: int | None) -> DataFrame:
    """The rows of :func:`run_sampler` without the model on the driver or in a worker.

    Every step is stored, so a plan spans one step, and lookups split the hot keys (roots, frequent leaves).
    """
    features, keep = list(model.features), list(keep)
    n = len(features)
    guide = store(
        token_order_guide(model.tokens.df, ["target", "leaf"]).select(
            F.col("target").alias("_t"), F.col("leaf").alias("_leaf"), "cell", F.col("token").alias("_drawn"), "lo", "hi"
        )
    )
    key = F.concat_ws("|", *keep)
    base = tokenise(rows, features, keep)
    if steps is None:
        first = F.array_sort(F.array(*[F.struct(uniform(seed, f"visit|{f}", key).alias("u"), F.lit(i).alias("i")) for i, f in enumerate(features)]))
        order = F.transform(first, lambda v: v["i"])
        draws = F.transform(order, lambda i: F.get(F.array(*[uniform(seed, f"fill|{f}", key) for f in features]), i))
    else:
        order = F.array(*[F.floor(uniform(seed, f"visit|{s}", key) * n).cast("int") for s in range(steps)])
        draws = F.array(*[uniform(seed, f"fill|{s}", key) for s in range(steps)])
    toks = F.array(*features)
    free = F.transform(toks, lambda x: x == "")
    state = base.select(*keep, toks.alias("_toks"), free.alias("_free"), order.alias("_order"), draws.alias("_draws"))
    for s in range(n if steps is None else steps):
        at = state.withColumn("target", F.get("_order", F.lit(s)))
        if model.kind == "tree":
            splits = F.array(*[F.lit(model.root_split.get(i)).cast("int") for i in range(n)])
            at = at.withColumns({"leaf0": root_leaf(), "_split": F.get(splits, F.col("target"))})
            at = descend(at, model, "leaf0", "_split").drop("_split")
        else:
            context = [F.get("_toks", F.lit(i)) for i in range(n)]
            at = at.withColumn("leaf0", by_target(model, lambda i: model.start(Probe(i, F.lit(""), context))))
        at = settle(at, model)
        at = at.withColumn("_idx", draw_index(F.get("_draws", F.lit(s)), "leaf_n"))
        at = at.withColumn("cell0", guide_cell(F.col("_idx"), F.col("leaf_k"), F.col("leaf_n")))
        cells = guide.df.withColumn("_mass", F.col("hi") - F.col("lo"))
        met = keyed_join(
            at, cells, {"target": "_t", "leaf0": "_leaf", "cell0": "cell"}, guide.small, "_mass", model.training_rows
        ).filter("lo is null or (lo <= _idx and _idx < hi)")
        # An observed coordinate stays, and so does one of a column that was always blank.
        filled = F.transform(
            "_toks", lambda x, i: F.when((i == F.col("target")) & F.get("_free", i), F.coalesce("_drawn", x)).otherwise(x)
        )
        state = store(met.select(*keep, filled.alias("_toks"), "_free", "_order", "_draws")).df
    return state.select(*keep, *[F.get("_toks", F.lit(i)).alias(f) for i, f in enumerate(features)])


def run_sampler(rows: DataFrame, model: ConditionalModel, keep: Sequence[str], seed: int, steps: int | None) -> DataFrame:
    """``rows`` has ``keep`` and the features, ``''`` meaning missing."""
    features, keep = list(model.features), list(keep)
    if not model.small:
        return sample_by_joins(rows, model, keep, seed, steps)
    n = len(features)
    shipped = rows.sparkSession.sparkContext.broadcast(LeafSampler(model))

    def run(batches: Iterator):
        sampler = shipped.value
        for batch in batches:
            state, unknown = coded(sampler, batch, features)
            first = np.column_stack([batch[c].to_numpy() for c in firsts])
            draws = np.column_stack([batch[c].to_numpy() for c in drawn])
            if steps is None:  # every column once, in the order of its rank; the draw goes with the column
                order = np.argsort(first, axis=1, kind="stable")
                draws = np.take_along_axis(draws, order, axis=1)
            else:
                order = (first * n).astype(np.int64)
            done = sampler.fill(state, order, draws)
            out = batch[keep].copy()
            for j, f in enumerate(features):
                names = np.array([*sampler.alphabet[j], ""], dtype=object)
                code = np.where(unknown[:, j] | (done[:, j] < 0), len(names) - 1, done[:, j])
                out[f] = np.where(unknown[:, j], batch[f].to_numpy(dtype=object), names[code])
            yield out

    # Draws are md5 functions of (seed, what is drawn, id), computed before the batches.
    names = features if steps is None else [str(s) for s in range(steps)]
    firsts, drawn = [f"_first{j}" for j in range(len(names))], [f"_draw{j}" for j in range(len(names))]
    key = F.concat_ws("|", *keep)
    keyed = tokenise(rows, features, keep).select(
        "*",
        *[uniform(seed, f"visit|{name}", key).alias(c) for name, c in zip(names, firsts)],
        *[uniform(seed, f"fill|{name}", key).alias(c) for name, c in zip(names, drawn)],
    )
    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    schema = f"{kept}, " + ", ".join(f"`{f}` string" for f in features)
    return keyed.mapInPandas(run, schema)


def sample_in_order(rows: DataFrame, model: ConditionalModel, seed) -> DataFrame:
    """``row_id`` and the features of a small model, each drawn given those before it.

    Tokens lie in the order of their md5, as in the guide cells that larger models are drawn by.
    """
    features = list(model.features)
    sampler = LeafSampler(model, lambda token: md5(token.encode()).hexdigest())
    shipped = rows.sparkSession.sparkContext.broadcast(sampler)
    kept = f"row_id {rows.schema['row_id'].dataType.simpleString()}"
    schema = StructType.fromDDL(f"{kept}, " + ", ".join(f"`{f}` string" for f in features))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = shipped.value
        names = [pa.array([*a, ""], pa.string()) for a in sampler.alphabet]
        for batch in batches:
            state = np.full((batch.num_rows, len(features)), -1, np.int64)
            for j in range(len(features)):
                if sampler.root[j] >= 0:
                    state[:, j] = sampler.draw(sampler.route(j, state), batch.column(j + 1).to_numpy())
            texts = [n.take(pa.array(np.where(c < 0, len(n) - 1, c))) for n, c in zip(names, state.T)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *texts], schema=arrow)

    drawn = rows.select("row_id", *[uniform(seed, f, "row_id").alias(f"_draw{j}") for j, f in enumerate(features)])
    return drawn.mapInArrow(run, schema)


def gen_lsm(rows: DataFrame, model: ConditionalModel, seed: int = 0, steps: int | None = None) -> DataFrame:
    """Sample whole rows from all-missing starts.

    ``steps=None`` visits every column once; a number draws that many random
    coordinates with replacement, which can leave ``''`` behind.
    """
    empty = rows.select("row_id", *[F.lit("").alias(f) for f in model.features])
    return run_sampler(empty, model, ["row_id"], seed, steps)


def complete_rows(
    df: DataFrame, model: ConditionalModel, keep: Sequence[str] = ("row_id",), seed: int = 0, steps: int | None = None
) -> DataFrame:
    """Fill the missing coordinates of given rows, the observed ones held fixed.

    Blank is missing, whether or not the model's training data had blanks.
    """
    return run_sampler(df, model, keep, seed, steps)
