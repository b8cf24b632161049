import math

import pytest
from pyspark.sql import functions as F

from likeness import compute_upsilon
from likeness.functions.bounds import hoeffding_radius
from likeness.operators import alignment as al
from likeness.operators import conditionals as co
from likeness.operators import frames as fr
from likeness.plans import materialise as mat
from likeness.sources import fixtures as fx


def test_published_radii(spark):
    row = spark.range(1).select(
        hoeffding_radius(F.lit(100), F.lit(100), 0.05).alias("a"),
        hoeffding_radius(F.lit(1000), F.lit(100), 0.05).alias("b"),
    ).first()
    assert round(row["a"], 4) == 0.0136 and round(row["b"], 4) == 0.0043


def test_alpha_outside_unit_interval(cust, cust_model):
    for alpha in (0.0, 1.0, -1, 2):
        with pytest.raises(ValueError, match="alpha"):
            al.upsilon_summary(cust, cust_model, alpha)


def test_scores_lie_in_unit_interval_and_map_rows_score_one(cust, cust_model):
    cells = al.upsilon_matrix(cust, cust_model)
    low, high = cells.agg(F.min("v"), F.max("v")).first()
    assert low >= 0.0 and high == 1.0
    assert cells.filter((F.col("p_obs") == F.col("p_max")) != (F.col("v") == 1.0)).count() == 0


def test_wide_and_long_scoring_agree(cust, cust_model, monkeypatch):
    perm = fr.permute_column(cust, "region")
    wide = {r["row_id"]: r["upsilon"] for r in al.upsilon_rows(perm, cust_model).collect()}
    monkeypatch.setattr(al, "can_score_wide", lambda model: False)
    long = {r["row_id"]: r["upsilon"] for r in al.upsilon_rows(perm, cust_model).collect()}
    assert wide.keys() == long.keys()
    assert all(math.isclose(wide[k], long[k], abs_tol=1e-12) for k in wide)


def test_layout_does_not_matter(cust, cust_model):
    one = al.upsilon_summary(cust.coalesce(1), cust_model).first()
    many = al.upsilon_summary(cust.repartition(8), cust_model).first()
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(one, many))


def test_model_too_large_to_broadcast_gives_the_same_scores(cust, cust_model, monkeypatch):
    perm = fr.permute_column(cust, "nation")
    small = {r["row_id"]: r["upsilon"] for r in al.upsilon_rows(perm, cust_model).collect()}
    monkeypatch.setattr(mat, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mat, "HOT_SHARE", 0.05)  # some keys hot, some not
    assert not cust_model.small
    large = {r["row_id"]: r["upsilon"] for r in al.upsilon_rows(perm, cust_model).collect()}
    assert small.keys() == large.keys()
    assert all(math.isclose(small[k], large[k], abs_tol=1e-12) for k in small)
    plan = al.upsilon_rows(perm, cust_model)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_unseen_context_falls_back_to_the_marginal(spark, toy):
    model = co.fit_context(toy, ["a", "b"], {"b": ["a"]})
    strange = spark.createDataFrame([(1, "new", "p")], "row_id bigint, a string, b string")
    cells = {r["target"]: r for r in al.upsilon_matrix(strange, model).collect()}
    n_p = toy.filter("b = 'p'").count()
    top = toy.groupBy("b").count().agg(F.max("count")).first()[0]
    assert cells["b"]["v"] == n_p / top
    assert cells["a"]["p_obs"] == 0.0 and cells["a"]["v"] == 0.0
    floored = {r["target"]: r for r in al.upsilon_matrix(strange, model, epsilon=0.01).collect()}
    assert 0.0 < floored["a"]["v"] < 0.05


def test_floor_renormalises(cust, cust_model):
    sums = co.predict(cust, cust_model, epsilon=0.05).groupBy("row_id", "target").agg(F.sum("p").alias("s"))
    low, high = sums.agg(F.min("s"), F.max("s")).first()
    assert math.isclose(low, 1.0) and math.isclose(high, 1.0)


def test_uniform_leaf_expects_one(spark):
    flat = spark.createDataFrame([(i, str(i % 4)) for i in range(40)], "row_id bigint, a string")
    model = co.fit_context(flat, ["a"], {})
    assert al.expected_upsilon(flat, model).first()["expected_upsilon"] == pytest.approx(1.0)


def test_expected_equals_observed_on_training_data(cust, cust_model):
    row = al.expected_upsilon(cust, cust_model).first()
    assert row["expected_upsilon"] == pytest.approx(row["upsilon_mean"])


def test_delta_of_a_table_with_itself_is_zero(cust, cust_model):
    row = al.delta_upsilon(cust, cust, cust_model).first()
    assert row["delta"] == pytest.approx(0.0) and row["ci_lower"] < 0 < row["ci_upper"]


def test_distance_axioms(cust, cust_model):
    perm = fr.permute_column(cust, "region")
    other = co.fit_context(perm, fx.CUST, fx.CUST_CONTEXTS)
    pool = fr.label_union({"a": cust, "b": perm}, fx.CUST)
    ab = al.map_distance(pool, cust_model, other).first()["distance"]
    ba = al.map_distance(pool, other, cust_model).first()["distance"]
    assert ab == pytest.approx(ba) and ab > 0.1
    assert al.map_distance(pool, cust_model, cust_model).first()["distance"] == 0.0


def test_triangle_inequality_on_a_common_pool(cust, cust_model):
    models = [cust_model] + [
        co.fit_context(fr.permute_column(cust, c), fx.CUST, fx.CUST_CONTEXTS) for c in ("region", "segment")
    ]
    d = {
        (i, j): al.map_distance(cust, models[i], models[j]).first()["distance"]
        for i, j in ((0, 1), (1, 2), (0, 2))
    }
    assert d[0, 2] <= d[0, 1] + d[1, 2] + 1e-12


def test_brook_odds_reproduce_the_joint_of_a_chain(spark):
    """With exact full conditionals the log-odds are those of the empirical joint."""
    rows = [("x", "p")] * 6 + [("x", "q")] * 3 + [("y", "p")] * 2 + [("y", "q")] * 8
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id bigint, a string, b string")
    model = co.fit_context(df, ["a", "b"], {"a": ["b"], "b": ["a"]})
    out = al.brook_logodds(df, model, ["x", "p"], epsilon=1e-12).join(df, "row_id")
    odds = {(r["a"], r["b"]): r["log_odds"] for r in out.collect()}
    for cell, n in ((("x", "q"), 3), (("y", "p"), 2), (("y", "q"), 8), (("x", "p"), 6)):
        assert odds[cell] == pytest.approx(math.log(n / 6), abs=1e-6)
    with pytest.raises(ValueError, match="floor"):
        al.brook_logodds(df, model, ["x", "p"], epsilon=0.0)


def test_histogram_counts_every_row(cust, cust_model):
    rows = al.upsilon_rows(cust.withColumn("dataset", F.lit("r")), cust_model, ["dataset", "row_id"])
    hist = al.upsilon_histogram(rows, 10)
    assert hist.agg(F.sum("n"), F.max("bin")).first()[0] == cust.count()


def test_compute_upsilon_signature(cust, cust_model):
    rows, same = compute_upsilon(cust, model=cust_model)
    assert same is cust and rows.columns == ["row_id", "upsilon"]
    rows, _, summary = compute_upsilon(cust, model=cust_model, alpha=0.05, n_workers=11, verbose=False)
    got = summary.first().asDict()
    assert set(got) == {
        "n_rows", "n_features", "upsilon_mean", "upsilon_semibound_hoeffding", "upsilon_ci_lower",
        "upsilon_ci_upper", "alpha",
    }
    assert got["upsilon_mean"] == pytest.approx(rows.agg(F.avg("upsilon")).first()[0])
    with pytest.raises(NotImplementedError):
        compute_upsilon(cust)
    with pytest.raises(ValueError, match="lacks the columns .'bal'."):
        compute_upsilon(cust.drop("bal"), model=cust_model)


def test_a_column_cannot_be_its_own_context(toy):
    with pytest.raises(ValueError, match="own context"):
        co.fit_context(toy, ["a", "b"], {"a": ["a"]})
