import __spark_entry__
from likeness.llm import queries


def test_every_query_is_registered_with_its_sql():
    names = __spark_entry__.queries()
    assert {*queries.QUERIES, "pipeline"} <= names.keys()
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert queries.ORACLE.keys() <= queries.QUERIES.keys()
