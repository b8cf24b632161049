import hashlib
import random

import numpy as np
import pytest

from likeness.llm import order_minhash as om


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("text", ["", "a", "ab", "aaaaaaaaaaaaaaaa", "é😀", "x" * 5000, "\ud800 lone"])
def test_small_and_odd_texts(text):
    a, b = om.signature(text), om.signature(text)
    assert a.shape == (om.CELLS,) and (a == b).all() and len(om.spelled(a)) == 4 * om.CELLS
    assert (a == 0).all() == (text == "")


def test_prefiltered_cells_are_those_of_all_kmers(monkeypatch):
    rng = random.Random(2)
    texts = [words(rng, n) for n in (3, 30, 300, 3000)]
    fast = [om.signature(t) for t in texts]
    monkeypatch.setattr(om, "CANDIDATES", 10**9)
    assert all((om.signature(t) == f).all() for t, f in zip(texts, fast))


def test_likeness_falls_with_edits_and_with_order():
    rng = random.Random(7)
    near, moved, far = [], [], []
    for _ in range(12):
        text = words(rng, 400)
        cut = len(text) // 2
        near.append(om.likeness(om.signature(text), om.signature(text[:cut] + "qqq" + text[cut:])))
        moved.append(om.likeness(om.signature(text), om.signature(text[cut:] + text[:cut])))
        far.append(om.likeness(om.signature(text), om.signature(words(rng, 400))))
    assert np.mean(near) > 0.9 > np.mean(moved) + 0.1
    assert np.mean(moved) > np.mean(far) and np.mean(far) < 0.1


def test_edits_follow_descending_ids(spark):
    rng = random.Random(4)
    rows = [(i * 13 % 101, words(rng, rng.choice([0, 1, 5, 50]))) for i in range(101)] + [(None, "none last"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r.doc_id: r for r in om.compare_with_edits(docs).collect()}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    assert len(found) == len(rows)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following, r = text or "", following or "", found[i]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == om.spelled(om.signature(text))
        assert r.edited_fingerprint == om.spelled(om.signature(new))
        assert r.near_edited == om.likeness(om.signature(text), om.signature(new))
        assert r.near_next == om.likeness(om.signature(text), om.signature(following))


def test_repeated_rows_one_row_and_none(docs, rows, no_docs, spark):
    found = om.compare_with_edits(docs).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(i) for i, _, _ in rows)
    assert om.compare_with_edits(no_docs).count() == 0
    one = om.compare_with_edits(spark.createDataFrame([(2**60 + 1, "abcdef")], "doc_id bigint, text string")).first()
    assert one.doc_id == 2**60 + 1 and one.near_next == 1.0
    assert om.fingerprints(docs).count() == len(rows)


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_ids_are_compared_exactly(spark, kind):
    """Strings, and numbers that one double stands for, follow in their own order; copies of a row follow each other."""
    rng = random.Random(9)
    ids = [f"x{i}" for i in range(30)] if kind == "string" else [2**60 + i for i in range(30)]
    rows = [(i, words(rng, 20)) for i in ids] + [(None, "a"), (None, "b c d e f g")]
    rows += [rows[3]] * 4 + [(None, "a")]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(6)
    found = sorted(((str(r.doc_id), r.edited_sha256) for r in om.compare_with_edits(docs).collect()))
    known = sorted((r for r in rows if r[0] is not None), reverse=True)
    # NULL ids come last in an order of their texts' hashes, so either text may be the first of them.
    expected = []
    for nulls in (["a", "a", "b c d e f g"], ["b c d e f g", "a", "a"]):
        order = known + [(None, t) for t in nulls]
        made = []
        for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
            half = len(text) // 2
            made.append((str(i), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
        expected.append(sorted(made))
    assert found in expected
