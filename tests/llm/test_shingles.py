import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from likeness.llm import shingles
from tests.llm.conftest import SCHEMA


def plain_set(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}


def plain_leads(rows):
    """Smallest id reachable by similarity >= 0.8, all pairs compared."""
    sets = [plain_set(t) for _, t in rows]
    lead = list(range(len(rows)))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            lead[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


@pytest.fixture(scope="module")
def edited():
    """(doc_id, text): texts with some words replaced, by similarities on both sides of 0.8."""
    rng = random.Random(3)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 400]))]
        rows.append((len(rows), " ".join(base)))
        for share in (0.005, 0.01, 0.02, 0.06):
            copy = [f"x{rng.randrange(5000)}" if rng.random() < share else w for w in base]
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b")]


def frame(spark, rows):
    full = [(i, t, "en", "a", len(t or ""), *[None] * 9) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_near_stage_drops_edited_copies(spark, edited):
    left = corpus_pipeline.near_stage(spark, frame(spark, edited), "")
    expected = set(plain_leads(edited).values())
    assert len(expected) < len(edited) - 40
    assert sorted(r.doc_id for r in left.collect()) == sorted(expected)


@pytest.mark.parametrize("hot_key", [1, 3])
def test_hot_keys_lose_no_link(spark, edited, hot_key):
    """With nearly every key hot, those not connected through a central text still meet."""
    rows = edited[:60] + edited[-5:]
    found = shingles.similar_documents(frame(spark, rows), hot_key=hot_key).collect()
    assert {r.doc_id: r.component_id for r in found} == plain_leads(rows)


def test_sketches_keep_pairs_above_the_threshold():
    rng = np.random.default_rng(5)
    limit, apart = shingles.sketch_limit(0.8), []
    for _ in range(300):
        union = rng.integers(0, 1 << 63, 200, np.uint64)
        a, b = union[:180], union[20:]  # 160 shared of 200
        low = [shingles.sketch(shingles.minima(np.unique(x))) for x in (a, b)]
        apart.append(sum(((int(x) ^ int(y)) & (2**64 - 1)).bit_count() for x, y in zip(*low)))
    assert max(apart) <= limit < 35 and 6 < np.mean(apart) < 14


def test_rows_sharing_an_id_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text + " end"), (1, "other words here"), (None, text + " tail"), (None, "alone by itself"), (2, text)]
    found = sorted(((r.doc_id, r.component_id) for r in shingles.similar_documents(frame(spark, rows)).collect()), key=str)
    assert found == sorted([(1, 1), (1, 1), (1, 1), (None, 1), (None, None), (2, 1)], key=str)


def test_members_of_hot_keys_meet_their_centre(spark, edited):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:k] + [f"e{i}"] + base[k + 1 :])) for i in range(1, 80) for k in [rng.randrange(120)]]
    found = shingles.similar_documents(frame(spark, [(0, " ".join(base)), *rows]), hot_key=8).collect()
    assert {r.component_id for r in found} == {0} and len(found) == 80


def group_of_copies(spark, n):
    """Copies of one text of which most have too many edits to be similar to any other."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        edits = set(rng.sample(range(100), rng.choice([1, 3, 4, 5])))
        rows.append((i, " ".join(f"e{i}" if k in edits else w for k, w in enumerate(base))))
    return rows


def test_pairs_of_a_group_of_copies_grow_with_the_group(spark, monkeypatch):
    """Every pair of the group shares band keys and passes the sketches; few can be similar."""
    seen, check = [], shingles.verified

    def counted(pairs, *rest):
        seen.append(pairs.distinct().count())
        return check(pairs, *rest)

    monkeypatch.setattr(shingles, "verified", counted)
    rows = group_of_copies(spark, 300)
    found = shingles.similar_documents(frame(spark, rows), hot_key=8).collect()
    assert {r.doc_id: r.component_id for r in found} == plain_leads(rows)
    assert sum(seen) < 12 * len(rows), seen


@pytest.mark.parametrize("n", [150, 450])
def test_edited_copies_that_are_not_similar_seldom_meet(spark, monkeypatch, n):
    """Each copy alone is near enough to the text all come from; two of them have twice as many edits."""
    met, across = [], shingles.pairs_across

    def counted(*args):
        pairs = across(*args).localCheckpoint()
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(shingles, "pairs_across", counted)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        edits = set(rng.sample(range(150), rng.choice([1, 2, 3, 5, 6, 8])))
        rows.append((i, " ".join(f"e{i}" if k in edits else w for k, w in enumerate(base))))
    rows += [(n + i, text + " more") for i, text in rows[: n // 3]]
    found = shingles.similar_documents(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == plain_leads(rows)
    assert len(met) == 1 and met[0] < 4 * len(rows), met


def test_a_node_is_met_by_one_centre_of_a_group_not_one_a_band(spark, monkeypatch):
    """The band keys of a group have many central texts that are similar to each other."""
    met, opened = [], shingles.open_nodes

    def counted(*args):
        rows = opened(*args)
        met.append((rows.rows, rows.df.select("node").distinct().count()))
        return rows

    monkeypatch.setattr(shingles, "open_nodes", counted)
    rows = group_of_copies(spark, 300)
    found = shingles.similar_documents(frame(spark, rows), hot_key=8).collect()
    assert {r.doc_id: r.component_id for r in found} == plain_leads(rows)
    assert len(met) == 1 and met[0][0] <= 1.5 * met[0][1], met


def test_near_stage_pairs_documents_by_fingerprint(spark, monkeypatch):
    """SimHash pairs are verified beside those of the bands: without bands they are what is found."""
    monkeypatch.setattr(shingles, "pairs_of_cool_keys", lambda rows, *_: rows.selectExpr("node as a", "node as b").limit(0))
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, " ".join(words[::-1]))]
    left = corpus_pipeline.near_stage(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_empty_table(no_docs):
    assert shingles.similar_documents(no_docs).count() == 0
