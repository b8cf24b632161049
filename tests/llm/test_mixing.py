import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from likeness.llm import mixing


def plain_targets(rows):
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            return size, share | capped
        capped |= {s: 3.0 * size[s] for s in over}


def test_targets_and_copies(docs, rows):
    size, target = plain_targets(rows)
    found = mixing.mix(docs, carry=["doc_id", "source"]).collect()
    assert len(found) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        s = r.doc.source
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert int(r.rate) <= r.copies <= min(3, int(r.rate) + 1)
        taken[s] += r.size * r.copies
        largest[s] = max(largest[s], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    again = mixing.mix(docs.repartition(7), carry=["doc_id", "source"]).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_repeated_rows(docs, rows):
    mixed = mixing.mix(docs, carry=["doc_id", "text"])
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in mixed.collect())


def test_many_sources_reshare(spark):
    rows = [(i, "w " * (1 if i % 2 else 900), f"s{i:02}") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    _, target = plain_targets(rows)
    sizes = docs.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("source_size"), F.count("*").alias("n_docs"))
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == pytest.approx(target)


def test_many_levels_of_reshare(spark):
    """Each source that reaches its cap lifts the level to the next one's: as many levels as sources."""
    rows = [(i, "w " * int(1.25**i), f"s{i:02}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    _, target = plain_targets(rows)
    got = {r.doc.source: r.target for r in mixing.mix(docs, carry=["source"]).collect()}
    assert got == pytest.approx(target)


def test_each_document_draws_for_itself(spark):
    """Over many seeds a document's extra copy has about the fraction's probability, whatever its neighbours do."""
    rows = [(i, "w " * (5 + i % 7), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken: dict = defaultdict(list)
    for seed in range(5):
        for r in mixing.mix(docs, carry=["doc_id"], seed=seed).collect():
            taken[r.doc.doc_id].append(r.copies - int(r.rate))
            part = r.rate - int(r.rate)
    assert all(set(t) <= {0, 1} for t in taken.values())
    shares = [sum(t) / 5 for i, t in taken.items() if i % 2]
    assert abs(sum(shares) / len(shares) - part) < 0.05 or part == 0
    assert len({tuple(t) for t in taken.values()}) > 12


def test_null_ids_draw_by_their_text(spark):
    rows = [(None, f"word{i} " * (1 + i % 5), "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(docs, carry=["text", "source"]).collect()
    for s in "ab":
        mine = [r for r in found if r.doc.source == s]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= 10


def test_empty_and_wordless(no_docs, spark):
    assert mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id bigint, text string, source string")
    assert [(r.size, r.target, r.copies) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2
