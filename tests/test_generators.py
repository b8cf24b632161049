from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness import generate_syndata
from likeness.operators import alignment as al
from likeness.operators import generators as ge
from likeness.operators import lsm
from likeness.operators import trees as tr
from likeness.operators.conditionals import fit_context
from likeness.plans import materialise as mat
from likeness.plans.compare import generate, generate_and_score
from likeness.sources import fixtures as fx
from likeness.sources.models import save_model

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def tree(toy):
    return tr.fit_trees(toy, COLS)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_tree_sampling_ignores_layout_and_leaves_no_gaps(spark, tree):
    ids = spark.range(500).select(F.col("id").alias("row_id"))
    a, b = lsm.gen_lsm(ids.coalesce(1), tree, 3), lsm.gen_lsm(ids.repartition(7), tree, 3)
    assert as_set(a) == as_set(b)
    assert a.filter(" or ".join(f"{c} = ''" for c in COLS)).count() == 0
    assert as_set(lsm.gen_lsm(ids, tree, 4)) != as_set(a)


def test_tree_sampling_keeps_the_dependence(spark, toy, tree):
    ids = spark.range(2000).select(F.col("id").alias("row_id"))
    synth = lsm.gen_lsm(ids, tree, 1)
    base = ge.gen_baseline(toy, 2000, COLS, 1)
    assert al.upsilon_mean(synth, tree).first()[0] > al.upsilon_mean(base, tree).first()[0] + 0.1


def test_tree_sampling_with_few_steps_leaves_gaps(spark, tree):
    ids = spark.range(300).select(F.col("id").alias("row_id"))
    got = lsm.gen_lsm(ids, tree, 1, steps=2)
    filled = sum((F.when(F.col(c) != "", 1).otherwise(0) for c in COLS), F.lit(0))
    low, high = got.agg(F.min(filled), F.max(filled)).first()
    assert (low, high) == (1, 2)


def test_sampler_draws_follow_the_leaf(spark, toy, tree):
    """Marginal of a column drawn first equals the root distribution, within sampling error."""
    sampler = lsm.LeafSampler(tree)
    codes = sampler.draw(np.full(20000, sampler.root[0]), np.random.default_rng(5).random(20000))
    share = np.bincount(codes, minlength=3) / 20000
    assert np.allclose(share, 1 / 3, atol=0.02)


@pytest.mark.parametrize("kind", ["tree", "context"])
@pytest.mark.parametrize("steps", [None, 3])
def test_a_large_model_draws_the_same_rows(spark, toy, tree, monkeypatch, kind, steps):
    """Without the broadcast bound in its favour a model stays a table; the rows are the same."""
    holes = toy.filter("row_id < 120").withColumns(
        {
            "a": F.when(F.col("row_id") % 3 == 0, "").otherwise(F.col("a")),
            "b": F.when(F.col("row_id") % 2 == 0, "").otherwise(F.col("b")),
            "d": F.when(F.col("row_id") % 5 == 0, "alien").otherwise(F.col("d")),
        }
    )
    model = tree if kind == "tree" else fit_context(toy, COLS, {"b": ["a"], "c": ["a", "b"]})
    ids = spark.range(150).select(F.col("id").alias("row_id"))
    few = as_set(lsm.gen_lsm(ids, model, 3, steps)), as_set(lsm.complete_rows(holes, model, seed=4, steps=steps))
    monkeypatch.setattr(mat, "BROADCAST_ROWS", 0)
    assert not model.small
    assert few == (as_set(lsm.gen_lsm(ids, model, 3, steps)), as_set(lsm.complete_rows(holes, model, seed=4, steps=steps)))


def test_sampler_routes_like_the_join(toy, tree):
    from likeness.operators.conditionals import place

    sampler = lsm.LeafSampler(tree)
    rows = toy.collect()
    state = np.array([[sampler.code[j][r[c]] for j, c in enumerate(COLS)] for r in rows])
    by_id = {v: k for k, v in sampler.leaf_id.items()}
    joined = {(r["row_id"], r["target"]): tuple(r["leaf0"]) for r in place(toy, [tree], ["row_id"]).collect()}
    for t in range(4):
        for r, leaf in zip(rows, sampler.route(t, state)):
            assert by_id[leaf] == (t, joined[r["row_id"], t])


def test_completion_fills_gaps_and_keeps_the_rest(toy, tree):
    holes = toy.withColumn("b", F.when(F.col("row_id") % 2 == 0, "").otherwise(F.col("b")))
    holes = holes.withColumn("d", F.when(F.col("row_id") % 5 == 0, "alien").otherwise(F.col("d")))
    done = lsm.complete_rows(holes, tree)
    both = done.alias("x").join(holes.alias("y"), "row_id")
    for c in COLS:
        assert both.filter((F.col(f"y.{c}") != "") & (F.col(f"x.{c}") != F.col(f"y.{c}"))).count() == 0
        assert done.filter(F.col(c) == "").count() == 0


def test_baseline_is_seeded_and_layout_free(toy):
    a = ge.gen_baseline(toy, 400, COLS, 5)
    b = ge.gen_baseline(toy.repartition(5), 400, COLS, 5)
    assert as_set(a) == as_set(b) and a.count() == 400


def test_baseline_numeric_moments_and_missing(spark):
    df = spark.createDataFrame(
        [(i, float(i % 7), None if i % 4 else "t", None, i % 2 == 0) for i in range(700)],
        "row_id bigint, x double, s string, e string, f boolean",
    )
    got = ge.gen_baseline(df, 20000, ["x", "s", "e", "f"], 2)
    mean, std = got.agg(F.avg("x"), F.stddev_pop("x")).first()
    assert mean == pytest.approx(3.0, abs=0.05) and std == pytest.approx(2.0, abs=0.05)
    assert got.filter("s <> 't' or s is null or e is not null").count() == 0
    assert {r[0] for r in got.select("f").distinct().collect()} == {"true", "false"}


def test_sequential_trees_keep_the_dependence(toy, tree):
    model = ge.fit_sequential(toy, COLS)
    rows = ge.ids(toy, 1500)
    synth = ge.gen_sequential(rows, model, 3)
    assert synth.count() == 1500 and synth.columns == ["row_id", *COLS]
    base = ge.gen_baseline(toy, 1500, COLS, 1)
    assert al.upsilon_mean(synth, tree).first()[0] > al.upsilon_mean(base, tree).first()[0] + 0.1
    assert as_set(synth) == as_set(ge.gen_sequential(rows.repartition(3), model, 3))


@pytest.mark.parametrize("learner", ["tree", "context"])
def test_sequential_draws_the_same_from_arrays_and_from_joins(toy, learner):
    model = ge.fit_sequential(toy, COLS, learner)
    rows = ge.ids(toy, 1500)
    large = replace(model, tokens=replace(model.tokens, rows=10**9))
    quick, joined = ge.gen_sequential(rows, model, 3), ge.gen_sequential(rows, large, 3)
    assert as_set(quick) == as_set(joined) and quick.dtypes == joined.dtypes
    plan = quick._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # each column was a join or two, whose cost grew with rows times columns


def test_sequential_predictors_are_earlier_columns_only():
    assert ge.earlier_only(["a", "b", "c"], {"a": ["b"], "c": ["a", "b"]}, None) == {"a": [], "b": [], "c": ["a", "b"]}
    assert ge.earlier_only(["a", "b", "c"], None, 1) == {"a": [], "b": ["a"], "c": ["b"]}


def test_bootstrap(toy):
    with_rep = ge.gen_bootstrap(toy, 500, True, 1)
    assert with_rep.count() == 500
    assert with_rep.join(toy, COLS, "left_anti").count() == 0
    src = with_rep.join(toy.withColumnRenamed("row_id", "src_id"), ["src_id", *COLS])
    assert src.count() == 500
    assert ge.gen_bootstrap(toy, 120, False, 1).select("row_id").distinct().count() == 120


def test_dispatch_and_errors(spark, toy, tree, tmp_path):
    path = save_model(tree, str(tmp_path / "m"))
    lsm_rows = generate_syndata(50, model_path=path, gen_algorithm="LSM", n_workers=11)
    assert lsm_rows.columns == ["row_id", *COLS] and lsm_rows.count() == 50
    assert generate_syndata(40, gen_algorithm="BASELINE", orig_df=toy, verbose=False).count() == 40
    assert generate(30, gen_algorithm="SEQUENTIAL", real=toy, learner="context", window=1).count() == 30
    with pytest.raises(NotImplementedError, match="model"):
        generate_syndata(10, gen_algorithm="LSM")
    with pytest.raises(ValueError):
        generate_syndata(10, gen_algorithm="BASELINE")
    with pytest.raises(ValueError, match="reorder with select"):
        generate_syndata(10, gen_algorithm="BASELINE", orig_df=toy, feature_names=["b", "a", "c", "d"])
    with pytest.raises(NotImplementedError, match="CTGAN"):
        generate_syndata(10, gen_algorithm="CTGAN", orig_df=toy)


def test_custom_generators(toy, tree):
    def frame(spark, model, num, real, features):
        return spark.range(num).select(*[F.lit("x").alias(f) for f in features])

    def array(spark, model, num, real, features):
        return [["1"] * len(features)] * num

    def narrow(spark, model, num, real, features):
        return [["1"]] * num

    def swapped(spark, model, num, real, features):
        return frame(spark, model, num, real, features[::-1])

    assert generate(7, tree, "mine", toy, frame).count() == 7
    assert generate(7, tree, "mine", toy, array).columns == COLS
    with pytest.raises(ValueError, match="width 4"):
        generate(7, tree, "mine", toy, narrow)
    with pytest.raises(ValueError, match="where the features have"):
        generate(7, tree, "mine", toy, swapped)


def test_batch_generator(spark):
    ids = spark.range(20).select(F.col("id").alias("row_id"))
    got = ge.gen_batches(ids, ["p", "q"], lambda keys: {"p": keys % 2, "q": keys * 0 + 7})
    assert as_set(got) == {(i, str(i % 2), "7") for i in range(20)}


def test_generate_and_score(toy, tree):
    scores, data = generate_and_score(tree, syndata=toy)
    assert data is toy and scores.count() == 300
    scores, data = generate_and_score(tree, num=25, gen_algorithm="LSM")
    assert scores.count() == data.count() == 25
    with pytest.raises(ValueError, match="nothing to generate"):
        generate_and_score(tree)


def test_moment_pair_has_matching_moments(spark):
    from likeness.operators.gaussian import fit_gaussian, gaussian_upsilon

    rows = spark.range(40000).select(F.col("id").alias("row_id"))
    for rho in (None, 0.5):
        cube, bell = ge.gen_moment_pair(rows, rho)
        r = rho or 0.0
        for df in (cube, bell):
            row = df.agg(F.avg("x1"), F.var_pop("x1"), F.covar_pop("x1", "x2"), F.covar_pop("x1", "x3")).first()
            assert row[0] == pytest.approx(0, abs=0.03) and row[1] == pytest.approx(1 + r * r, abs=0.05)
            assert row[2] == pytest.approx(r, abs=0.03) and row[3] == pytest.approx(0, abs=0.03)
        u = gaussian_upsilon(bell, fit_gaussian(bell, ["x1", "x2", "x3"])).first()["upsilon"]
        assert u == pytest.approx(2**-0.5, abs=0.01)


@pytest.mark.parametrize("kind", ["context", "tree"])
def test_blanks_in_training_are_never_drawn(spark, kind):
    from likeness.operators import alignment as al
    from likeness.operators.conditionals import fit_context
    from likeness.operators.trees import fit_trees

    names = ["a", "b", "c"]
    rows = [(i, "xy"[i % 2], "" if i % 3 == 0 else "pq"[i % 2], "" if i % 5 == 0 else "uvw"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id bigint, a string, b string, c string")
    model = fit_trees(df, names) if kind == "tree" else fit_context(df, names, {"b": ["a"], "c": ["b"]})
    assert model.tokens.df.filter("token = ''").count() == 0
    made = lsm.gen_lsm(df.select("row_id"), model, 3)
    assert made.filter("a = '' or b = '' or c = ''").count() == 0
    filled = {r.row_id: r for r in lsm.complete_rows(df, model, seed=4).collect()}
    for i, a, b, c in rows:
        r = filled[i]
        assert r.a == a and r.b == (b or "pq"[i % 2]) and (r.c == c if c else r.c in "uvw")
    # An unobserved coordinate has no score, on the row and in the matrix alike.
    matrix = al.upsilon_matrix(df, model).filter("v is null").count()
    assert matrix == sum(b == "" for _, _, b, _ in rows) + sum(c == "" for *_, c in rows)
    scores = {r.row_id: r.upsilon for r in al.upsilon_rows(df, model).collect()}
    means = {r.row_id: r.m for r in al.upsilon_matrix(df, model).groupBy("row_id").agg({"v": "avg"}).withColumnRenamed("avg(v)", "m").collect()}
    assert scores == pytest.approx(means)


def test_always_blank_column_stays_blank(spark):
    from likeness.operators.conditionals import fit_context

    df = spark.createDataFrame([(i, "x", "") for i in range(5)], "row_id bigint, a string, b string")
    made = lsm.gen_lsm(df.select("row_id"), fit_context(df, ["a", "b"], {"b": ["a"]}), 1).collect()
    assert {(r.a, r.b) for r in made} == {("x", "")}


def test_custom_generator_with_old_keywords_and_no_real_table(spark):
    def old(model, num, orig_df, **rest):
        assert orig_df is None and rest["feature_names"] == ["a", "b"]
        return [["1", "2"]] * num

    def short(num):
        return [["1", "2"]] * num

    from likeness import generate_syndata
    from likeness.operators.conditionals import fit_context

    df = spark.createDataFrame([(1, "x", "y")], "row_id bigint, a string, b string")
    model = fit_context(df, ["a", "b"], {})
    for callable_ in (old, short):
        made = generate_syndata(3, model, gen_algorithm="own", data_generator=callable_)
        assert [(r.a, r.b) for r in made.collect()] == [("1", "2")] * 3
