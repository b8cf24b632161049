"""Trees against a plain recursive fit of the same rules."""

import math
from collections import Counter, defaultdict
from itertools import permutations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.operators import alignment as al
from likeness.operators import conditionals as co
from likeness.operators import frames as fr
from likeness.operators import permutation
from likeness.operators import trees as tr
from likeness.plans import materialise as mat
from likeness.sources import fixtures as fx
from likeness.sources.models import load_model, save_model

COLS = ["a", "b", "c", "d"]


def z_score(rows, x, y):
    n, o, rx, cy = len(rows), Counter(), Counter(), Counter()
    for r in rows:
        o[r[x], r[y]] += 1
        rx[r[x]] += 1
        cy[r[y]] += 1
    dof = (len(rx) - 1) * (len(cy) - 1)
    if not dof:
        return None
    chi2 = n * (sum(v * v / (rx[i] * cy[j]) for (i, j), v in o.items()) - 1)
    s = 2 / (9 * dof)
    return round((math.copysign(abs(max(chi2, 0) / dof) ** (1 / 3), 1) - (1 - s)) / math.sqrt(s), 9)


def brute(rows, target, depth, alpha=0.05, min_node=20, min_leaf=7, path=()):
    leaves = {path: Counter(r[target] for r in rows)}
    if depth == 0 or len(rows) < min_node:
        return leaves
    preds = [j for j in range(len(COLS)) if j != target]
    crit = NormalDist().inv_cdf(1 - alpha / len(preds))
    scored = [
        (z, -j)
        for j in preds
        if (z := z_score(rows, j, target)) is not None and z > crit and max(Counter(r[j] for r in rows).values()) >= min_leaf
    ]
    if not scored:
        return leaves
    j = -max(scored)[1]
    groups = defaultdict(list)
    sizes = Counter(r[j] for r in rows)
    for r in rows:
        groups[f"{j}={r[j]}" if sizes[r[j]] >= min_leaf else f"{j}*"].append(r)
    for label, part in groups.items():
        if len(part) >= min_leaf:
            leaves.update(brute(part, target, depth - 1, alpha, min_node, min_leaf, (*path, label)))
    return leaves


@pytest.fixture(scope="module")
def tree(toy):
    return tr.fit_trees(toy, COLS, max_depth=3)


def test_leaves_equal_a_recursive_fit(toy, tree):
    rows = [tuple(r[c] for c in COLS) for r in toy.collect()]
    got = defaultdict(dict)
    for r in tree.tokens.df.collect():
        got[r["target"], tuple(r["leaf"])][r["token"]] = r["n"]
    expected = {(t, p): dict(c) for t in range(4) for p, c in brute(rows, t, 3).items()}
    assert dict(got) == expected
    assert tree.depth >= 2  # the fixture must exercise more than one level


def test_rows_land_in_the_leaf_that_counted_them(toy, tree):
    placed = co.place(toy, [tree], ["row_id"])
    counted = {
        (r["target"], tuple(r["leaf0"]), r["token"]): r["n"]
        for r in placed.groupBy("target", "leaf0", "token").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    stored = {(r["target"], tuple(r["leaf"]), r["token"]): r["n"] for r in tree.tokens.df.collect()}
    assert all(stored[k] == n for k, n in counted.items())


def test_unseen_token_stops_at_the_parent(spark, toy, tree):
    odd = spark.createDataFrame([(1, "never", "p", "u", "0")], toy.schema)
    leaves = {r["target"]: r["leaf0"] for r in co.place(odd, [tree], ["row_id"]).collect()}
    assert leaves[1] == []  # column b splits on a first


def test_barred_predictors_are_never_split_on(toy):
    model = tr.fit_trees(toy, COLS, allowed=co.restrict_predictors(COLS, ["a"]))
    assert 0 not in set(model.root_split.values())
    assert model.edges is None or model.edges.df.filter("split = 0 or child_split = 0").count() == 0
    assert model.roots.keys() == {0, 1, 2, 3}


def test_honest_fit_counts_only_the_other_half(toy):
    model = tr.fit_trees(toy, COLS, honest_id="row_id")
    assert 100 < model.roots[0][0] < 200
    out = al.upsilon_rows(toy, model).agg(F.count("upsilon"), F.min("upsilon"), F.max("upsilon")).first()
    assert out[0] == 300 and 0 <= out[1] and out[2] <= 1


def test_large_tree_tables_give_the_same_scores(toy, tree, monkeypatch):
    before = {r["row_id"]: r["upsilon"] for r in al.upsilon_rows(toy, tree).collect()}
    monkeypatch.setattr(mat, "BROADCAST_ROWS", 0)
    after = {r["row_id"]: r["upsilon"] for r in al.upsilon_rows(toy, tree).collect()}
    assert before == pytest.approx(after)


def test_save_and_load(spark, toy, tree, tmp_path):
    again = load_model(spark, save_model(tree, str(tmp_path / "m")))
    assert again.features == tree.features and again.root_split == tree.root_split and again.depth == tree.depth
    a = {r["row_id"]: r["upsilon"] for r in al.upsilon_rows(toy, tree).collect()}
    b = {r["row_id"]: r["upsilon"] for r in al.upsilon_rows(toy, again).collect()}
    assert a == b


def test_independent_columns_grow_no_tree(spark):
    rows = [(i, str(i % 3), str(i // 3 % 4)) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id bigint, a string, b string")
    model = tr.fit_trees(df, ["a", "b"])
    assert model.edges is None and model.depth == 0
    assert al.upsilon_mean(df, model).first()[0] == pytest.approx(1.0)


def test_real_beats_permuted(cust):
    model = tr.fit_trees(cust, fx.CUST)
    row = al.delta_upsilon(cust, fr.permute_column(cust, "region"), model).first()
    assert row["ci_lower"] > 0


def test_distance_between_a_tree_and_a_context_model(toy, tree):
    other = co.fit_context(toy, COLS, {"b": ["a"]})
    row = al.map_distance(toy, tree, other).first()
    assert 0.0 < row["distance"] < 1.0 and row["m"] == 300


def test_growth_ends_where_every_token_is_rare(spark):
    """Two columns that determine each other, all tokens rare: the pool of all rows is no split."""
    rows = [(i, str(i // 3), str(i // 6)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, a string, b string")
    model = tr.fit_trees(df, ["a", "b"])
    assert model.depth == 0 and model.edges is None


def test_no_tree_is_deeper_than_its_predictors(spark):
    # Some frequent tokens, many rare ones, everything associated.
    rows = [(i, str(i % 4) if i % 3 else f"r{i // 4}", str(i % 8) if i % 5 else f"q{i // 4}", str(i // 5 % 6)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id bigint, a string, b string, c string")
    cols = ["a", "b", "c"]
    model = tr.fit_trees(df, cols)
    leaves = [tuple(r["leaf"]) for r in model.leaves.df.collect()]
    assert 1 <= model.depth <= 2
    for path in leaves:
        used = [label.split("=")[0].rstrip("*") for label in path]
        assert len(used) == len(set(used))
    got = {(r["target"], tuple(r["leaf"]), r["token"]): r["n"] for r in model.tokens.df.collect()}
    plain = [tuple(r[1:]) + ("",) for r in rows]
    expected = {}
    for t in range(3):
        for path, seen in brute_three(plain, t).items():
            expected |= {(t, path, tok): n for tok, n in seen.items()}
    assert got == expected


def brute_three(rows, target):
    """The recursive fit over three columns, without a bound on the depth."""
    global COLS
    kept, COLS = COLS, ["a", "b", "c"]
    try:
        return brute(rows, target, 99)
    finally:
        COLS = kept


def exact_p(pairs):
    """Share of all matchings of the two columns that are at least as associated."""
    xs, ys = zip(*pairs)

    def q(y):
        o, r, c = Counter(zip(xs, y)), Counter(xs), Counter(y)
        return sum(n * n / (r[i] * c[j]) for (i, j), n in o.items())

    here = q(ys) * (1 - 1e-9)
    found = [q(y) >= here for y in permutations(ys)]
    return sum(found) / len(found)


@pytest.mark.parametrize("pairs", ["ap ap bq bq cq cr ap", "ap aq bp bq cp cq dr", "ap ap ap bq bq bq bp"])
def test_permutation_null_equals_all_matchings(spark, pairs):
    pairs = [tuple(p) for p in pairs.split()]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "row_id bigint, a string, b string")
    got = {r["target"]: r["p_perm"] for r in tr.permutation_screen(df, ["a", "b"], draws=4999).collect()}
    assert got["a"] == pytest.approx(exact_p(pairs), abs=0.03)
    assert got["b"] == pytest.approx(exact_p(pairs), abs=0.03)


def test_both_ways_of_drawing_agree():
    rows, columns = np.array([40, 25, 35]), np.array([50, 30, 20])
    by_cell = permutation.drawn_statistics(rows, columns, 4000, np.random.default_rng(1))
    rng = np.random.default_rng(2)
    x, y = np.repeat(np.arange(3), rows), np.repeat(np.arange(3), columns)
    by_row = []
    for _ in range(4000):
        table = np.zeros((3, 3))
        np.add.at(table, (x, rng.permutation(y)), 1)
        by_row.append((table**2 / np.outer(rows, columns)).sum())
    assert by_cell.mean() == pytest.approx(np.mean(by_row), rel=0.01)
    for p in (0.5, 0.9, 0.99):
        assert np.quantile(by_cell, p) == pytest.approx(np.quantile(by_row, p), rel=0.02)
    # The mean under permutation is known: chi2 = n (q - 1) has n / (n - 1) * dof.
    assert (100 * (by_cell - 1)).mean() == pytest.approx(100 / 99 * 4, rel=0.06)
    huge = permutation.drawn_statistics(rows * 10**8, columns * 10**8, 4000, np.random.default_rng(3))
    assert (10**10 * (huge - 1)).mean() == pytest.approx(4, rel=0.06)


def test_trees_by_permutation_and_their_repeat(toy, tree):
    by_draws = tr.fit_trees(toy, COLS, max_depth=1, draws=199, seed=3)
    again = tr.fit_trees(toy.repartition(3), COLS, max_depth=1, draws=199, seed=3)
    assert by_draws.root_split == again.root_split
    assert {t: s for t, s in tree.root_split.items() if t != 3} == {t: s for t, s in by_draws.root_split.items() if t != 3}
    with pytest.raises(ValueError, match="draws cannot reach"):
        tr.fit_trees(toy, COLS, draws=19)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("epsilon", [0.0, 0.01])
def test_scores_on_the_row_equal_the_long_form(spark, toy, tree, monkeypatch, epsilon):
    odd = toy.withColumn("a", F.when(F.col("row_id") % 7 == 0, "").when(F.col("row_id") % 11 == 0, "new").otherwise(F.col("a")))
    long = co.score(co.place(odd, [tree], ["row_id"]), tree, epsilon)
    cells = {(r["row_id"], COLS[r["target"]]): (r["p_obs"], r["p_max"], r["v"]) for r in long.collect()}
    on_row = al.upsilon_matrix(odd, tree, epsilon=epsilon)
    assert {(r["row_id"], r["target"]): (r["p_obs"], r["p_max"], r["v"]) for r in on_row.collect()} == cells
    rows = {r["row_id"]: r["upsilon"] for r in long.groupBy("row_id").agg(F.avg("v").alias("upsilon")).collect()}
    for joins in (96, 0):  # by joins, by arrays
        monkeypatch.setattr(al, "WIDE_JOINS", joins)
        got = {r["row_id"]: r["upsilon"] for r in al.upsilon_rows(odd, tree, epsilon=epsilon).collect()}
        assert got == pytest.approx(rows)


def test_tree_scores_do_not_shuffle(spark, toy, tree, tmp_path):
    path = str(tmp_path / "rows")
    toy.write.parquet(path)
    for scored in (al.upsilon_rows, al.upsilon_matrix):
        text = plan(scored(spark.read.parquet(path), tree))
        assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("columns", [4, 40])
def test_streams_take_trees_of_any_width(spark, toy, tmp_path, columns):
    from likeness.streaming.scoring import score_stream

    wide = toy.select("row_id", *[F.concat(F.col(COLS[i % 4]), F.lit("x" * (i // 4))).alias(f"c{i}") for i in range(columns)])
    names = wide.columns[1:]
    model = tr.fit_trees(wide, names, max_depth=2, allowed={n: names[:4] for n in names})
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    wide.repartition(2).write.parquet(path)
    stream = spark.readStream.schema(wide.schema).parquet(path)
    q = score_stream(stream, model).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "mark")
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["row_id"]: r["upsilon"] for r in spark.read.parquet(out).collect()}
    long = co.score(co.place(wide, [model], ["row_id"]), model)
    assert got == pytest.approx({r["row_id"]: r["u"] for r in long.groupBy("row_id").agg(F.avg("v").alias("u")).collect()})
