"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from catalog.queries import QUERIES
from likeness.operators import alignment as al
from likeness.operators import conditionals as co
from likeness.operators import generators as ge
from likeness.sources import fixtures as fx
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "upsilon_rows", "upsilon_matrix", "upsilon_summary", "map_distance", "gen_baseline", "gen_sequential",
        "nearest_real", "novelty_summary", "similarity_histogram", "block_means", "evaluate_generators", "auc_rank",
        "gen_bootstrap", "predict_conditional", "chi2_screen", "stratified_folds", "generate_and_score",
    ],
)
def test_no_query_compares_all_pairs(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_row_scoring_does_not_shuffle(spark, tmp_path):
    path = str(tmp_path / "rows")
    fx.line(spark, SF).write.parquet(path)
    stored = spark.read.parquet(path)
    model = co.fit_context(stored, fx.LINE, fx.LINE_CONTEXTS)
    for df in (al.upsilon_rows(stored, model), al.upsilon_matrix(stored, model)):
        assert "Exchange hashpartitioning" not in plan(df) and "SortMergeJoin" not in plan(df)


def test_generation_does_not_shuffle(spark, cust):
    model = ge.fit_independent(cust, fx.CUST)
    assert "Exchange hashpartitioning" not in plan(ge.sample_independent(ge.ids(cust, 1000), model, 1))


def test_scan_reads_only_the_columns_used(spark):
    ready = fx.table(spark, SF, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    text = plan(ready.filter("flag = 'R'"))
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in text
    assert "EqualTo(l_returnflag,R)" in text


def test_counts_are_combined_before_the_shuffle(spark):
    text = plan(fx.line(spark, SF).groupBy("flag").count())
    assert "partial_count" in text
    model = co.fit_context(fx.cust(spark, SF), fx.CUST, fx.CUST_CONTEXTS)
    text = plan(al.score_counts(fx.cust(spark, SF), model))
    assert "partial_count" in text


def test_cluster_without_a_shared_folder_is_told_which_setting():
    from types import SimpleNamespace

    from likeness.plans.materialise import scratch_dir

    def session(master, folder=None):
        conf = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "/w"}
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda k, d=None: conf.get(k) or d),
            sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None),
        )

    for master in ("yarn", "local-cluster[3,2,1024]", "spark://x:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch_dir(session(master))
    assert scratch_dir(session("yarn", "hdfs:///c/")) == "hdfs:///c"
    assert scratch_dir(session("local[2]")) == "/w/_checkpoints"


def test_a_table_with_few_long_rows_is_not_broadcast(spark, monkeypatch):
    from likeness.plans import materialise

    kept = materialise.store(spark.range(10))
    assert kept.small and kept.rows == 10 and kept.size > 0
    monkeypatch.setattr(materialise, "BROADCAST_BYTES", kept.size - 1)
    assert not kept.small


def test_context_fit_counts_once(spark, toy):
    from likeness.operators.conditionals import fit_context

    model = fit_context(toy, ["a", "b"], {"b": ["a"]})
    plan = model.tokens.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_few_records_are_scored_once_each(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    fx.line(spark, SF).write.parquet(path)
    rows = spark.read.parquet(path)
    model = co.fit_context(rows, fx.LINE, fx.LINE_CONTEXTS)
    found = []
    for few in (al.FEW_RECORDS, 0):
        monkeypatch.setattr(al, "FEW_RECORDS", few)
        score, matrix = al.upsilon_rows(rows, model), al.upsilon_matrix(rows, model)
        found.append([sorted(tuple(r) for r in df.collect()) for df in (score, matrix)])
        by_record = few and al.few_records(rows, model)
        assert not few or by_record.rows < rows.count()
        assert ("_f6" in plan(score)) == ("_f6" in plan(matrix)) == bool(few)
    assert found[0] == found[1]


def test_records_with_counts_fit_and_score_as_their_rows(spark, cust):
    counted = co.record_counts(cust, fx.CUST)
    a = co.fit_context(cust, fx.CUST, fx.CUST_CONTEXTS)
    b = co.fit_context(counted, fx.CUST, fx.CUST_CONTEXTS, "_rows")
    assert sorted(map(tuple, a.tokens.df.collect())) == sorted(map(tuple, b.tokens.df.collect()))
    far = co.fit_context(cust.filter("bal <> '0'"), fx.CUST, fx.CUST_CONTEXTS)
    assert al.map_distance(cust, a, far).first() == al.map_distance(counted, b, far, weight="_rows").first()


def test_ranks_shuffle_no_hash(spark, toy):
    from likeness.functions.ordering import hash_rank

    text = plan(hash_rank(toy, "row_id", 1, "x"))
    above, below = text.split("REPARTITION_BY_COL", 1)
    assert "AS _hash" in above and "AS _hash" not in below.split("REPARTITION_BY_COL")[0].split("HashAggregate")[0]
