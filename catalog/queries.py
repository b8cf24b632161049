"""Every operator as a query over the star-schema tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.functions.bounds import hoeffding_radius
from likeness.operators import alignment as al
from likeness.operators import conditionals as co
from likeness.operators import frames as fr
from likeness.operators import gaussian as ga
from likeness.operators import generators as ge
from likeness.operators import lsm
from likeness.operators import marginals as ma
from likeness.operators import novelty as no
from likeness.operators import trees as tr
from likeness.operators import twosample as ts
from likeness.plans import compare as cp
from likeness.plans.materialise import scratch_dir, store
from likeness.sources import fixtures as fx
from likeness.sources.models import load_model, save_model
from likeness.sources.tables import read_table, write_table
from likeness.streaming import drift as dr

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r(c, digits: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits) + F.lit(0.0)  # no negative zero


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def scratch(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/likeness/{uuid.uuid4().hex}"


def cust_model(spark, sf):
    return co.fit_context(fx.cust(spark, sf), fx.CUST, fx.CUST_CONTEXTS)


def line_model(spark, sf):
    return co.fit_context(fx.line(spark, sf), fx.LINE, fx.LINE_CONTEXTS)


def cust_perm(spark, sf):
    return fr.permute_column(fx.cust(spark, sf), "region")


def line_perm(spark, sf):
    return fr.permute_column(fx.line(spark, sf), "ship_half")


def cust_base(spark, sf):
    real = fx.cust(spark, sf)
    return ge.gen_baseline(real, real.count(), fx.CUST, 7)


def cust_pair(spark, sf):
    return fr.label_union({"real": fx.cust(spark, sf), "perm": cust_perm(spark, sf)}, fx.CUST)


# -- sources and sinks -------------------------------------------------------


@query
def load_table(spark, sf):
    df = read_table(spark, f"{sf}/customer.parquet", index_col="c_custkey")
    return df.select("row_id", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query
def load_csv(spark, sf):
    path = write_table(fx.cust_missing(spark, sf), scratch(spark), "csv")
    schema = "row_id bigint, region string, nation string, segment string, bal string"
    return read_table(spark, path, "csv", schema=schema)


@query
def write_parquet(spark, sf):
    path = write_table(fx.line(spark, sf), scratch(spark))
    return read_table(spark, path).groupBy("flag", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def model_roundtrip(spark, sf):
    model = load_model(spark, save_model(cust_model(spark, sf), scratch(spark)))
    return rounded(al.upsilon_by_target(fx.cust(spark, sf), model), 6, "upsilon", "hit_rate")


@query
def from_rows(spark, sf):
    return fr.from_rows(spark, fr.pack(fx.ord_(spark, sf), fx.ORD, ["row_id"]), fx.ORD)


# -- frame layer -------------------------------------------------------------


@query
def assert_features(spark, sf):
    model = cust_model(spark, sf)
    return fr.assert_features(fx.cust(spark, sf), model.features, ["row_id"])


@query
def resolve_features(spark, sf):
    """Features come from the model, then from the real table; both give the same columns."""
    real = fx.part(spark, sf)
    names = fr.resolve_features(None, None, real, ["row_id"])
    return fr.project_features(real, names, ["row_id"])


@query
def project_features(spark, sf):
    return fr.project_features(fx.line(spark, sf), ["ship_half", "flag", "tax"], ["row_id"])


@query
def drop_ids(spark, sf):
    out = fr.drop_ids(fx.table(spark, sf, "orders"), ["o_orderkey", "o_custkey"])
    return out.withColumns({"o_totalprice": r("o_totalprice", 2), "o_orderdate": F.to_date("o_orderdate").cast("string")})


@query
def rename_prefix(spark, sf):
    return fr.rename_prefix(fx.part(spark, sf), "x", ["row_id"])


@query
def round_to_int(spark, sf):
    line = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity") / 2).alias("half_qty")
    )
    return fr.round_to_int(line, ["l_extendedprice", "half_qty"])


@query
def tokenise(spark, sf):
    names = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    part = fx.table(spark, sf, "part").withColumn("p_retailprice", F.round(F.col("p_retailprice") * 100).cast("bigint"))
    return fr.tokenise(part, names, ["p_partkey"])


@query
def normalise_missing(spark, sf):
    return fr.normalise_missing(fx.cust_missing(spark, sf), fx.CUST, ["row_id"])


@query
def head_tail_split(spark, sf):
    orders = fx.ord_(spark, sf)
    head, tail = fr.head_tail_split(orders, 5000)
    return fr.label_union({"train": head, "test": tail}, fx.ORD)


@query
def sample_n(spark, sf):
    return fr.sample_n(fx.line(spark, sf), 1000, 123)


@query
def balanced_sample(spark, sf):
    real, synth = fr.balanced_sample(fx.cust(spark, sf), cust_perm(spark, sf), 2000, 123, equal=True)
    return fr.label_union({"real": real, "synth": synth}, fx.CUST)


@query
def label_union(spark, sf):
    return cust_pair(spark, sf)


@query
def discretise(spark, sf):
    return fr.discretise(
        fx.num3(spark, sf), {"l_quantity": 10.0, "l_extendedprice": 5000.0, "l_discount": 0.0625}
    )


# -- marginals and moments ---------------------------------------------------


@query
def column_types(spark, sf):
    """The numeric-or-categorical dispatch, with the level count it would model."""
    df = fx.table(spark, sf, "customer").drop("c_custkey")
    numeric, _ = ma.split_types(df, df.columns)
    kind = F.when(F.col("col").isin(numeric), "numeric").otherwise("categorical")
    return (
        ma.token_counts(df, df.columns)
        .groupBy("col")
        .agg(F.count(F.lit(1)).alias("levels"))
        .select("col", kind.alias("kind"), "levels")
    )


@query
def marginal_numeric(spark, sf):
    return rounded(ma.marginal_numeric(fx.num3(spark, sf), fx.NUM3), 4, "mean", "std")


@query
def marginal_categorical(spark, sf):
    return rounded(ma.marginal_categorical(fx.line(spark, sf), fx.LINE), 9, "p")


@query
def marginal_compare(spark, sf):
    data = {"real": fx.cust(spark, sf), "base": cust_base(spark, sf)}
    return rounded(ma.marginal_compare(data, "nation"), 9, "p")


@query
def moment_compare(spark, sf):
    # The price in thousands, so that its moments have as many digits as the others'.
    real = fx.num3(spark, sf).withColumn("l_extendedprice", F.col("l_extendedprice") / 1000)
    synth = ge.gen_baseline(real, real.count(), fx.NUM3, 7)
    return rounded(ma.moment_compare(real, synth, fx.NUM3), 5, "real", "synth", "diff")


# -- the conditional model ---------------------------------------------------


@query
def fit_context(spark, sf):
    model = line_model(spark, sf)
    named = model.tokens.df.withColumn("target", model.target_name())
    leaves = model.leaves.df.withColumn("target", model.target_name())
    return named.join(leaves.select("target", "leaf", F.col("n").alias("leaf_n"), "n_max"), ["target", "leaf"]).select(
        "target",
        F.concat_ws(",", "leaf").alias("context"),
        F.size("leaf").alias("context_size"),
        "token",
        "n",
        r(F.col("n") / F.col("leaf_n"), 9).alias("p"),
        r(F.col("n_max") / F.col("leaf_n"), 9).alias("p_max"),
    )


@query
def fit_trees(spark, sf):
    """Depth-one trees: leaf distributions per column."""
    model = tr.fit_trees(fx.cust(spark, sf), fx.CUST, max_depth=1)
    return model.tokens.df.select(
        model.target_name().alias("target"), F.concat_ws(",", "leaf").alias("path"), "token", "n"
    )


@query
def fit_trees_deep(spark, sf):
    model = tr.fit_trees(fx.line(spark, sf), fx.LINE, max_depth=3)
    out = al.upsilon_by_target(fx.line(spark, sf), model)
    return rounded(out, 6, "upsilon", "hit_rate")


@query
def fit_trees_rare(spark, sf):
    """Fully grown trees, default arguments, where the strongest predictor has rare tokens only."""
    model = tr.fit_trees(fx.runs(spark, sf), fx.RUNS)
    return model.tokens.df.select(
        model.target_name().alias("target"), F.concat_ws(",", "leaf").alias("path"), "token", "n"
    )


@query
def permutation_screen(spark, sf):
    """Every (target, predictor) of a table with rare tokens, by seeded permutations."""
    return rounded(tr.permutation_screen(fx.runs(spark, sf), fx.RUNS, draws=199, seed=1), 5, "chi2", "z", "p_perm")


@query
def upsilon_rows_grown(spark, sf):
    """Row scores under fully grown trees."""
    model = tr.fit_trees(fx.cust(spark, sf), fx.CUST)
    return rounded(al.upsilon_rows(cust_perm(spark, sf), model), 9, "upsilon")


def cust_tree(spark, sf):
    """Learned depth-one trees: SQL can still grow them."""
    return tr.fit_trees(fx.cust(spark, sf), fx.CUST, max_depth=1)


@query
def upsilon_matrix_trees(spark, sf):
    out = al.upsilon_matrix(cust_perm(spark, sf), cust_tree(spark, sf))
    return rounded(out, 9, "p_obs", "p_max", "v")


@query
def upsilon_rows_trees(spark, sf):
    return rounded(al.upsilon_rows(cust_perm(spark, sf), cust_tree(spark, sf)), 9, "upsilon")


@query
def upsilon_by_target_trees(spark, sf):
    out = al.upsilon_by_target(cust_pair(spark, sf), cust_tree(spark, sf), ["dataset"])
    return rounded(out, 6, "upsilon", "hit_rate")


@query
def chi2_screen(spark, sf):
    return rounded(tr.chi2_screen(fx.cust(spark, sf), fx.CUST), 5, "chi2", "z")


@query
def restrict_predictors(spark, sf):
    """High-cardinality columns predict nothing but are still tested as targets."""
    real = fx.cust(spark, sf)
    barred = co.suggest_restricted(real, fx.CUST, 10)
    allowed = co.restrict_predictors(fx.CUST, barred)
    return rounded(tr.chi2_screen(real, fx.CUST, allowed=allowed), 5, "chi2", "z")


@query
def epsilon_floor(spark, sf):
    out = al.upsilon_matrix(cust_perm(spark, sf), cust_model(spark, sf), epsilon=0.01)
    return rounded(out, 9, "p_obs", "p_max", "v")


@query
def predict_conditional(spark, sf):
    out = co.predict(fx.cust(spark, sf), cust_model(spark, sf), epsilon=0.01)
    return rounded(out, 9, "p")


@query
def upsilon_matrix(spark, sf):
    out = al.upsilon_matrix(fx.line(spark, sf), line_model(spark, sf))
    return rounded(out, 9, "p_obs", "p_max", "v")


@query
def upsilon_rows(spark, sf):
    return rounded(al.upsilon_rows(fx.line(spark, sf), line_model(spark, sf)), 9, "upsilon")


@query
def upsilon_mean(spark, sf):
    both = fr.label_union({"real": fx.line(spark, sf), "perm": line_perm(spark, sf)}, fx.LINE)
    return rounded(al.upsilon_mean(both, line_model(spark, sf), ["dataset"]), 6, "upsilon_mean")


@query
def upsilon_summary(spark, sf):
    out = al.upsilon_summary(fx.line(spark, sf), line_model(spark, sf), 0.05)
    return rounded(out, 6, *out.columns)


@query
def upsilon_by_target(spark, sf):
    out = al.upsilon_by_target(cust_pair(spark, sf), cust_model(spark, sf), ["dataset"])
    return rounded(out, 6, "upsilon", "hit_rate")


@query
def upsilon_histogram(spark, sf):
    rows = al.upsilon_rows(cust_pair(spark, sf), cust_model(spark, sf), ["dataset", "row_id"])
    return al.upsilon_histogram(rows.withColumn("upsilon", r("upsilon", 9)), 20)


@query
def upsilon_quantiles(spark, sf):
    both = fr.label_union({"real": fx.line(spark, sf), "perm": line_perm(spark, sf)}, fx.LINE)
    # Equal rows score alike: each distinct record once, with its count.
    counted = store(co.record_counts(both, fx.LINE, ["dataset"])).df
    rows = al.upsilon_rows(counted, line_model(spark, sf), ["dataset", "_rows"])
    return rounded(al.upsilon_quantiles(rows, weight="_rows"), 6, "median", "p95")


@query
def map_hit_rate(spark, sf):
    return rounded(al.map_hit_rate(fx.line(spark, sf), line_model(spark, sf)), 6, "hit_rate")


@query
def expected_upsilon(spark, sf):
    out = al.expected_upsilon(cust_pair(spark, sf), cust_model(spark, sf), ["dataset"])
    return rounded(out, 6, "expected_upsilon", "upsilon_mean")


@query
def delta_upsilon(spark, sf):
    out = al.delta_upsilon(fx.line(spark, sf), line_perm(spark, sf), line_model(spark, sf), 0.05)
    return rounded(out, 6, *out.columns)


@query
def map_distance(spark, sf):
    real, perm = fx.line(spark, sf), line_perm(spark, sf)
    # Both models and the distance read the distinct records with their counts.
    pool = store(co.record_counts(fr.label_union({"a": real, "b": perm}, fx.LINE), fx.LINE, ["dataset"])).df
    model1, model2 = (
        co.fit_context(pool.filter(F.col("dataset") == name), fx.LINE, fx.LINE_CONTEXTS, "_rows") for name in "ab"
    )
    out = al.map_distance(pool, model1, model2, 0.05, 0.01, 0.01, weight="_rows")
    return rounded(out, 6, "distance", "radius", "ci_lower", "ci_upper")


@query
def hoeffding_radius_table(spark, sf):
    """Radius of a score over each order status's rows, two alphas, two-sided and split."""
    counts = fx.ord_(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("m"))
    n = F.lit(len(fx.ORD))
    return counts.select(
        "status",
        "m",
        r(hoeffding_radius("m", n, 0.05), 9).alias("radius_05"),
        r(hoeffding_radius("m", n, 0.01), 9).alias("radius_01"),
        r(hoeffding_radius("m", n, 0.05, 4.0), 9).alias("radius_split"),
    )


@query
def brook_logodds(spark, sf):
    real = fx.cust(spark, sf)
    reference = real.orderBy("row_id").select(*fx.CUST).first()
    return rounded(al.brook_logodds(real, cust_model(spark, sf), list(reference), epsilon=0.01), 6, "log_odds")


@query
def gaussian_upsilon(spark, sf):
    real = fx.num3(spark, sf)
    model = ga.fit_gaussian(real, fx.NUM3)
    cells = ga.gaussian_matrix(real, model, [])
    return cells.groupBy("target").agg(r(F.avg("v"), 6).alias("upsilon"))


# -- generators --------------------------------------------------------------


@query
def gen_baseline(spark, sf):
    real = fx.line(spark, sf)
    return ge.gen_baseline(real, real.count(), fx.LINE, 7)


@query
def gen_baseline_numeric(spark, sf):
    real = fx.num3(spark, sf)
    return rounded(ge.gen_baseline(real, real.count(), fx.NUM3, 7), 3, *fx.NUM3)


@query
def gen_lsm(spark, sf):
    """Tree samples scored under the same trees."""
    real = fx.cust(spark, sf)
    model = tr.fit_trees(real, fx.CUST)
    synth = lsm.gen_lsm(ge.ids(real, real.count()), model, 11)
    return rounded(al.upsilon_by_target(synth, model), 6, "upsilon", "hit_rate")


@query
def gen_lsm_rows(spark, sf):
    """The sampled rows themselves."""
    real = fx.cust(spark, sf)
    return lsm.gen_lsm(ge.ids(real, real.count()), tr.fit_trees(real, fx.CUST), 11)


@query
def complete_rows(spark, sf):
    """Blanks filled under a model of the same table, blanks and all."""
    holes = fx.cust_missing(spark, sf)
    return lsm.complete_rows(holes, co.fit_context(holes, fx.CUST, fx.CUST_CONTEXTS), seed=5)


@query
def gen_sequential(spark, sf):
    real = fx.cust(spark, sf)
    model = ge.fit_sequential(real, fx.CUST, "context")
    return ge.gen_sequential(ge.ids(real, real.count()), model, 123)


@query
def gen_sequential_trees(spark, sf):
    real = fx.line(spark, sf)
    model = ge.fit_sequential(real, fx.LINE, "tree", max_depth=2)
    synth = ge.gen_sequential(ge.ids(real, real.count()), model, 123)
    return rounded(ma.marginal_categorical(synth, fx.LINE), 9, "p")


def uniform_tokens(spark, model, num, real, features):
    """A user generator: every column picks among the real table's distinct tokens evenly."""
    del model
    rows = ge.ids(real, num)
    counts = store(ma.token_counts(real, features).withColumn("n", F.lit(1).cast("bigint"))).df
    guide = store(ge.inverse_cdf_guide(counts, ["col"]))
    totals = {x["col"]: (x["k"], x["k"]) for x in counts.groupBy("col").agg(F.count(F.lit(1)).alias("k")).collect()}
    return ge.sample_independent(rows, ge.IndependentModel(list(features), {}, totals, guide), 3)


@query
def gen_custom(spark, sf):
    real = fx.cust(spark, sf)
    return ge.gen_custom(uniform_tokens, real, real.count(), fx.CUST)


@query
def gen_bootstrap(spark, sf):
    real = fx.ord_(spark, sf)
    return ge.gen_bootstrap(real, real.count(), True, 9)


@query
def gen_bootstrap_sample(spark, sf):
    return ge.gen_bootstrap(fx.line(spark, sf), 1000, False, 9)


@query
def gen_moment_pair(spark, sf):
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    cube, bell = ge.gen_moment_pair(rows, 0.5, 0)
    stacked = fr.label_union({"uniform": cube, "gaussian": bell}, ["x1", "x2", "x3"])
    return rounded(stacked, 6, "x1", "x2", "x3")


@query
def moment_pair_alignment(spark, sf):
    """Same moments, different alignment: Gaussian conditionals on the Gaussian, bins on the cube."""
    rows = fx.table(spark, sf, "lineitem").select(fx.line_id().alias("row_id"))
    cube, bell = ge.gen_moment_pair(rows)
    names = ["x1", "x2", "x3"]
    width = 2.0 * 3.0**0.5 / 4.0
    shifted = cube.select("row_id", *[(F.col(c) + 3.0**0.5).alias(c) for c in names])
    banded = fr.discretise(shifted, {c: width for c in names})
    flat = al.upsilon_mean(banded, co.fit_context(banded, names, {}))
    curved = ga.gaussian_upsilon(bell, ga.fit_gaussian(bell, names))
    return flat.select(F.lit("uniform").alias("cube"), r("upsilon_mean").alias("upsilon")).unionByName(
        curved.select(F.lit("gaussian").alias("cube"), r("upsilon").alias("upsilon"))
    )


@query
def generate(spark, sf):
    """Dispatch by name: the baseline generator over orders."""
    real = fx.ord_(spark, sf)
    return cp.generate(real.count(), gen_algorithm="BASELINE", real=real, seed=7)


# -- novelty -----------------------------------------------------------------


@query
def pair_similarity(spark, sf):
    out = no.pair_similarity(fx.line(spark, sf), line_perm(spark, sf), fx.LINE)
    return out.select("left_id", "right_id", r("match", 9).alias("match"))


@query
def pair_cosine(spark, sf):
    out = no.pair_similarity(fx.cust(spark, sf), cust_base(spark, sf), fx.CUST)
    return out.select("left_id", "right_id", r("cosine", 9).alias("cosine"))


@query
def similarity_histogram(spark, sf):
    out = no.similarity_histogram(fx.cust(spark, sf), cust_base(spark, sf), fx.CUST)
    return out.withColumn("pairs", F.col("pairs").cast("bigint"))


@query
def block_means(spark, sf):
    return rounded(no.block_means(fx.cust(spark, sf), cust_base(spark, sf), fx.CUST), 6, "similarity")


@query
def block_means_line(spark, sf):
    return rounded(no.block_means(fx.line(spark, sf), line_perm(spark, sf), fx.LINE), 6, "similarity")


@query
def nearest_real(spark, sf):
    return rounded(no.nearest_real(fx.cust(spark, sf), cust_base(spark, sf), fx.CUST), 9, "eta")


@query
def nearest_real_line(spark, sf):
    real = fx.line(spark, sf)
    synth = ge.gen_baseline(real, real.count(), fx.LINE, 7)
    return rounded(no.nearest_real(real, synth, fx.LINE), 9, "eta")


@query
def novelty_summary(spark, sf):
    real = fx.cust(spark, sf)
    stacked = fr.label_union(
        {"boot": ge.gen_bootstrap(real, real.count(), False, 9), "perm": cust_perm(spark, sf), "base": cust_base(spark, sf)},
        fx.CUST,
    )
    out = no.novelty_summary(real, stacked, fx.CUST, ["dataset"])
    return rounded(out, 6, *[c for c in out.columns if c not in ("dataset", "n_synth")])


@query
def exact_reuse(spark, sf):
    return rounded(no.exact_reuse(fx.line(spark, sf), line_perm(spark, sf), fx.LINE), 9, "share")


def wide_synths(spark, sf):
    """A table with one column permuted, and one with half of them."""
    real = fx.wide(spark, sf)
    far = fr.permute_columns(real, fx.WIDE[::2])
    return fr.label_union({"near": fr.permute_column(real, "segment"), "far": far}, fx.WIDE)


@query
def nearest_real_wide(spark, sf):
    """Nearest real row over twenty columns, at one disagreement and at many."""
    out = no.nearest_real(fx.wide(spark, sf), wide_synths(spark, sf), fx.WIDE, ["dataset", "row_id"])
    return rounded(out, 9, "eta")


@query
def similarity_report(spark, sf):
    """Nearest rows and block means of two generators beside a real table with blanks."""
    synths = fr.label_union({"permuted": cust_perm(spark, sf), "baseline": cust_base(spark, sf)}, fx.CUST)
    out = no.similarity_report(fx.cust_missing(spark, sf), synths, fx.CUST, by=["dataset"])
    return rounded(out, 6, *[c for c in out.columns if c not in ("dataset", "n_real", "n_synth", "missing_token")])


@query
def upsilon_drift(spark, sf):
    """Alignment of events by day under a model of all of them."""
    events = fx.shop(spark, sf)
    model = co.fit_context(events, fx.EVENTS, fx.EVENT_CONTEXTS)
    days = dr.drift(events, model, "ts")
    return days.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n_rows", "cells", r("upsilon_mean", 9).alias("upsilon_mean"))


# -- classifier two-sample test ----------------------------------------------


@query
def one_hot(spark, sf):
    """Active slots of the encoding, by width: every row has exactly one per column."""
    from pyspark.ml.functions import vector_to_array

    rows = fr.tokenise(fx.cust(spark, sf), fx.CUST, ["row_id"])
    x = vector_to_array(F.col("x"))
    return ts.one_hot(rows, fx.CUST).transform(rows).select(
        "row_id", F.size(x).alias("slots"), F.aggregate(x, F.lit(0.0), lambda a, b: a + b).alias("active")
    )


@query
def stratified_split(spark, sf):
    rows = ts.labelled(fx.cust(spark, sf), cust_perm(spark, sf), fx.CUST)
    return ts.stratified_split(rows, 0.25, 123).select("key", "y", "is_test")


@query
def stratified_folds(spark, sf):
    rows = ts.labelled(fx.line(spark, sf), line_perm(spark, sf), fx.LINE)
    return ts.stratified_folds(rows, 5, 123).select("key", "y", "fold")


@query
def auc_rank(spark, sf):
    """AUC of the discount band as a score for 'returned', within each ship year."""
    line = fx.line(spark, sf)
    scored = line.select(
        "ship_year", (F.col("disc").cast("double") / 10.0).alias("score"), (F.col("flag") == "R").cast("int").alias("y")
    )
    return rounded(ts.auc_rank(scored, by=["ship_year"]), 9, "auc")


@query
def c2st_holdout(spark, sf):
    out = ts.c2st_holdout(fx.cust(spark, sf), cust_base(spark, sf), fx.CUST, max_rows=20000)
    return rounded(out, 4, "auc")


@query
def c2st_cv(spark, sf):
    out = ts.c2st_cv(fx.cust(spark, sf), cust_base(spark, sf), fx.CUST, 5, max_rows=20000)
    return rounded(out.drop("aucs"), 4, "auc_mean", "auc_std")


@query
def c2st_tree_holdout(spark, sf):
    """A classifier that sees pairs of columns tells a permuted table from the real one."""
    return rounded(ts.c2st_tree(fx.cust(spark, sf), cust_perm(spark, sf), fx.CUST), 9, "auc")


@query
def c2st_tree_cv(spark, sf):
    return rounded(ts.c2st_tree(fx.cust(spark, sf), cust_base(spark, sf), fx.CUST, folds=3, depth=1), 9, "auc")


# -- comparison --------------------------------------------------------------


def evaluated(spark, sf):
    real = fx.cust(spark, sf)
    synths = {
        "baseline": cust_base(spark, sf),
        "permuted": cust_perm(spark, sf),
        "bootstrap": ge.gen_bootstrap(real, real.count(), False, 9),
    }
    return cp.evaluate_generators(real, synths, cust_model(spark, sf))


@query
def evaluate_generators(spark, sf):
    out = evaluated(spark, sf)
    return rounded(out, 6, *[c for c in out.columns if c not in ("dataset", "n_rows")])


@query
def generator_map(spark, sf):
    out = cp.generator_map(evaluated(spark, sf))
    return rounded(out, 6, "nearest_real_similarity_median", "inverse_median", "upsilon_median")


@query
def generate_and_score(spark, sf):
    real = fx.cust(spark, sf)
    scores, _ = cp.generate_and_score(
        cust_model(spark, sf), num=real.count(), gen_algorithm="BASELINE", real=real, seed=7
    )
    return rounded(scores, 9, "upsilon")


@query
def fidelity_report(spark, sf):
    """The flagship: real, permuted and baseline tables scored under the real model."""
    data = {"real": fx.cust(spark, sf), "perm": cust_perm(spark, sf), "base": cust_base(spark, sf)}
    out = al.upsilon_summary(fr.label_union(data, fx.CUST), cust_model(spark, sf), 0.05, ["dataset"])
    return rounded(out, 6, *[c for c in out.columns if c != "dataset"])
