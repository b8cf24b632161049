import random

from likeness.llm.components import components


def plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in parent}


def test_random_graph_chain_and_star(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(90)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7)] + [(3, 4)] * 5
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == plain(edges)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
