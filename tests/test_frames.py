import math

import pytest
from pyspark.sql import functions as F

from likeness.functions import ordering as od
from likeness.functions.bounds import chi2_z
from likeness.operators import frames as fr
from likeness.operators import marginals as ma
from likeness.operators import twosample as ts
from likeness.sources import fixtures as fx
from likeness.sources.tables import read_table, write_table


def test_schema_assertion_says_what_to_do(toy):
    with pytest.raises(ValueError, match="column 1 is"):
        fr.assert_features(toy, ["a", "c", "b", "d"], ["row_id"])
    with pytest.raises(ValueError, match=r"lacks the columns \['e'\] and has \['d'\]"):
        fr.assert_features(toy, ["a", "b", "c", "e"], ["row_id"])
    assert fr.assert_features(toy, ["a", "b", "c", "d"], ["row_id"]) is toy


def test_feature_resolution_order(toy, cust_model):
    assert fr.resolve_features(["z"], cust_model, toy) == ["z"]
    assert fr.resolve_features(None, cust_model, toy) == fx.CUST
    assert fr.resolve_features(None, None, toy, ["row_id"]) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        fr.resolve_features()


def test_csv_keeps_blanks_and_reads_an_index(spark, tmp_path):
    df = spark.createDataFrame([(0, "", "x"), (1, "y", "")], "i bigint, a string, b string")
    path = write_table(df, str(tmp_path / "t"), "csv")
    back = read_table(spark, path, "csv", index_col="i")
    assert {tuple(r) for r in back.collect()} == {(0, "", "x"), (1, "y", "")}
    assert back.columns == ["row_id", "a", "b"]


def test_rows_from_an_iterable(spark):
    df = fr.from_rows(spark, [[1, "a"], (None, "b")], ["p", "q"])
    assert {tuple(r) for r in df.collect()} == {("1", "a"), (None, "b")}
    with pytest.raises(ValueError, match="width 2"):
        fr.from_rows(spark, [["1"]], ["p", "q"])
    arrays = spark.createDataFrame([(["1"],)], "toks array<string>")
    with pytest.raises(Exception, match="expected width 2"):
        fr.from_rows(spark, arrays, ["p", "q"]).collect()


def test_large_n_takes_the_same_rows_as_a_sort(spark, monkeypatch):
    df = spark.range(20000).select(((F.col("id") * 7919) % 20011).alias("row_id"), F.lit("t").alias("a"))
    plain = {r[0] for r in fr.sample_n(df, 7777, 5).select("row_id").collect()}
    head, tail = fr.head_tail_split(df, 3333)
    small = {r[0] for r in head.select("row_id").collect()}
    monkeypatch.setattr(od, "TOP_N_ROWS", 50)
    assert {r[0] for r in fr.sample_n(df, 7777, 5).select("row_id").collect()} == plain
    head, tail = fr.head_tail_split(df, 3333)
    assert {r[0] for r in head.select("row_id").collect()} == small
    assert tail.count() == 20000 - 3333
    assert fr.sample_n(df, 50000, 5).count() == 20000
    assert len(plain) == 7777


def test_first_n_with_a_hot_key(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"))
    expected = {r[0] for r in df.orderBy("k", "row_id").limit(700).collect()}
    monkeypatch.setattr(od, "TOP_N_ROWS", 20)
    assert {r[0] for r in od.first_n(df, F.col("k"), ["row_id"], 700).collect()} == expected


def test_split_of_an_empty_or_short_table(toy):
    head, tail = fr.head_tail_split(toy, 1000)
    assert head.count() == 300 and tail.count() == 0
    head, tail = fr.head_tail_split(toy.limit(0), 10)
    assert head.count() == 0 and tail.count() == 0


def test_balanced_sample(toy):
    a, b = fr.balanced_sample(toy, toy.limit(80), 100, equal=True)
    assert a.count() == b.count() == 80
    a, b = fr.balanced_sample(toy, toy.limit(80), 100)
    assert a.count() == 100 and b.count() == 80
    assert fr.balanced_sample(toy, toy, None) == (toy, toy)


def test_hash_rank_is_a_permutation(toy):
    ranks = sorted(r["rank"] for r in od.hash_rank(toy, "row_id", 1, "x", digits=1).collect())
    assert ranks == list(range(1, 301))


def test_permute_column_keeps_marginals(toy):
    perm = fr.permute_column(toy, "b")
    count = lambda d: {r["b"]: r["count"] for r in d.groupBy("b").count().collect()}
    assert count(perm) == count(toy)
    assert perm.select("row_id", "a", "c", "d").exceptAll(toy.select("row_id", "a", "c", "d")).count() == 0


def test_quantile_bands_are_fitted_once(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"))
    edges = fr.quantile_edges(df, ["x"], 4, 0.0)
    sizes = fr.discretise_by_edges(df, edges).groupBy("x").count().collect()
    assert {r["x"] for r in sizes} == {"0", "1", "2", "3"} and all(240 <= r["count"] <= 260 for r in sizes)
    far = fr.discretise_by_edges(spark.createDataFrame([(1e9,), (None,)], "x double"), edges)
    assert [r["x"] for r in far.collect()] == ["3", None]


def test_booleans_and_dates_are_categorical(spark):
    df = spark.sql("select 1 as i, 1.5D as d, 2.5BD as m, true as b, current_date() as t, 'x' as s")
    assert ma.split_types(df, df.columns) == (["i", "d", "m"], ["b", "t", "s"])


def test_nan_is_skipped(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    row = ma.marginal_numeric(df, ["x"]).first()
    assert (row["mean"], row["std"]) == (2.0, 1.0)


def test_wilson_hilferty_known_value(spark):
    z = spark.range(1).select(chi2_z(F.lit(15.850578506621193), F.lit(20)).alias("z")).first()["z"]
    assert 1 - 0.5 * (1 + math.erf(z / math.sqrt(2))) == pytest.approx(0.72646, abs=1e-4)


def test_auc_against_counting(spark):
    rows = [((i * 37 % 11) / 10.0, 1 if (i * 13) % 5 < 2 + (i * 37 % 11 > 5) else 0) for i in range(200)]
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    expected = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "score double, y int")
    assert ts.auc_rank(df).first()["auc"] == pytest.approx(expected)


def test_classifier_sees_marginals_but_not_broken_dependence(cust, cust_model):
    from likeness.operators.alignment import delta_upsilon

    perm = fr.permute_column(cust, "region")
    blind = ts.c2st_cv(cust, perm, fx.CUST, 3).first()
    # Equal marginals make train and test folds lean opposite ways, so chance is at most one half.
    assert blind["auc_mean"] < 0.6
    assert delta_upsilon(cust, perm, cust_model).first()["delta"] > 0.2
    shifted = perm.withColumn("bal", F.lit("9"))
    seen = ts.c2st_holdout(cust, shifted, fx.CUST).first()
    assert seen["auc"] > 0.99 and seen["n_real"] == cust.count()


def test_splits_are_stratified(toy):
    rows = ts.labelled(toy, toy.limit(100), ["a", "b", "c", "d"])
    split = {(r["y"], r["is_test"]): r["count"] for r in ts.stratified_split(rows).groupBy("y", "is_test").count().collect()}
    assert split == {(0, True): 75, (0, False): 225, (1, True): 25, (1, False): 75}
    folds = ts.stratified_folds(rows, 4).groupBy("y", "fold").count().collect()
    assert {(r["y"], r["count"]) for r in folds} == {(0, 75), (1, 25)}


def test_stream_scores_equal_batch_scores(spark, cust, cust_model, tmp_path):
    from likeness.operators.alignment import upsilon_rows
    from likeness.streaming.scoring import score_stream

    path = str(tmp_path / "in")
    cust.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(cust.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    q = score_stream(stream, cust_model).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", mark
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert got == {tuple(r) for r in upsilon_rows(cust, cust_model).collect()}


@pytest.mark.parametrize("limit", [100_000, 5])
@pytest.mark.parametrize("n", [7, 40, 55, 80])
def test_rows_without_an_order_come_last_on_both_paths(spark, monkeypatch, limit, n):
    from likeness.functions import ordering

    monkeypatch.setattr(ordering, "TOP_N_ROWS", limit)
    rows = [(i, None if i % 4 == 0 else float(i * 37 % 101)) for i in range(66)]
    df = spark.createDataFrame(rows, "row_id bigint, x double")
    got = {r.row_id for r in ordering.first_n(df, df["x"], ["row_id"], n).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0.0, r[0]))
    assert got == {i for i, _ in order[:n]}


def test_a_tree_on_pairs_sees_broken_dependence(cust):
    """Where the additive model finds nothing (the permuted copy has the same marginals), pairs of columns differ."""
    perm = fr.permute_column(cust, "region")
    row = ts.c2st_tree(cust, perm, fx.CUST, min_node=10, min_leaf=3, depth=1).first()
    assert row["auc"] > 0.6 and row["n_real"] == row["n_synth"] > 0
    same = ts.c2st_tree(cust, cust, fx.CUST, depth=1).first()
    assert same["auc"] < 0.6


def test_drift_on_a_stream_equals_the_batch(spark, tmp_path):
    from likeness.operators.conditionals import fit_context
    from likeness.streaming.drift import drift
    from tests.conftest import SF

    events = fx.shop(spark, SF)
    model = fit_context(events, fx.EVENTS, fx.EVENT_CONTEXTS)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartitionByRange(3, "ts").write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    q = drift(stream, model, "ts", late="60 days").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "mark")
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {r["start"]: (r["n_rows"], round(r["upsilon_mean"], 9)) for r in drift(events, model, "ts").collect()}
    done = {r["start"]: (r["n_rows"], round(r["upsilon_mean"], 9)) for r in spark.read.parquet(out).collect()}
    # Windows are emitted when the watermark has passed them; with everything late enough none is wrong.
    assert done.items() <= batch.items()
    late = drift(stream, model, "ts", late="0 seconds").writeStream.format("memory").queryName("drifted").option(
        "checkpointLocation", str(tmp_path / "mark2")
    ).trigger(availableNow=True).start()
    late.awaitTermination(120)
    emitted = {r["start"]: (r["n_rows"], round(r["upsilon_mean"], 9)) for r in spark.table("drifted").collect()}
    assert len(emitted) >= len(batch) - 1 and set(emitted) <= set(batch)


def test_packed_columns_come_back(spark):
    from likeness.functions.packing import joined_texts, long_key, short_key, split_texts

    keys = ["12|3|4-5", "1", "", "f", "ff", "123", "1230", "12 3", "a|1", "\u00ff1", "12\n", None, "0", "00"]
    texts = ["", None, "\x1f", "\x1e", "\x1e1", "\x1e2", "\x1f\x1e0", "plain", "", None, "x", "y", "z", "\u00e4"]
    df = spark.createDataFrame(list(zip(keys, texts, reversed(texts))), "k string, a string, b string")
    packed = df.select("*", short_key(F.col("k")).alias("s"), joined_texts([F.col("a"), F.col("b")]).alias("t"))
    back = packed.select("k", "a", "b", "s", long_key(F.col("s")).alias("k2"), *[c.alias(f"c{i}") for i, c in enumerate(split_texts(F.col("t"), 2))])
    rows = back.collect()
    assert all((r.k, r.a, r.b) == (r.k2, r.c0, r.c1) for r in rows)
    assert len({bytes(r.s) for r in rows if r.s is not None}) == len(keys) - 1
    assert len(next(r.s for r in rows if r.k == "12|3|4-5")) == 4


def test_permuted_rows_are_shuffled_once(spark):
    """As the ranks say, with NULL, blank and repeated values; the rows move to their bucket and no further."""
    import hashlib

    rows = [(f"{i}|x", [None, "", "p", "q\x1f"][i % 4], i % 5, f"v{i % 7}" if i % 6 else None) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, "lost", 1, "v")], "row_id string, a string, n int, b string")
    perm = fr.permute_column(df, "b")
    numbers = fr.permute_columns(df, ["n", "b"])  # another type moves too
    plan = perm._jdf.queryExecution().executedPlan().toString()  # as first planned
    moves = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moves) <= 3, moves

    def order(name):
        return sorted(rows, key=lambda r: hashlib.md5(f"s|{name}|{r[0]}".encode()).hexdigest())

    expected = {(*to[:3], source[3]) for to, source in zip(order("to"), order("from"))}
    assert perm.columns == ["row_id", "a", "n", "b"]
    got = [tuple(r) for r in perm.collect()]
    assert set(got) == expected and len(got) == len(rows)
    both = {(*to[:2], *source[2:]) for to, source in zip(order("to"), order("from"))}
    assert {tuple(r) for r in numbers.collect()} == both and numbers.schema == df.schema
