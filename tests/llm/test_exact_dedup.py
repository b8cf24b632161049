import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from likeness.llm import exact_dedup
from pyspark.sql import functions as F


def plain(rows):
    groups = defaultdict(list)
    for i, text, _ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups[hashlib.sha256(norm.encode()).hexdigest()].append(i)
    return {d: (min((x is None, x) for x in ids)[1], len(ids)) for d, ids in groups.items()}


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_groups_match_a_dictionary(docs, rows, batches):
    found = exact_dedup.find_copies(docs, batches=batches).collect()
    expected = plain(rows)
    assert len(found) == len(rows)
    assert {(r.digest, r.keep_id, r.group_size) for r in found} == {(d, k, n) for d, (k, n) in expected.items()}
    kept = [r for r in found if r.kept]
    assert len(kept) == len(expected) and all(r.doc_id == r.keep_id for r in kept)


def test_dropping_keeps_columns_and_one_row_each(docs, rows):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted(
        (k is None, k or 0) for k, _ in plain(rows).values()
    )


def test_empty_table(no_docs):
    assert exact_dedup.find_copies(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).count() == 0


def test_byte_check_catches_a_weak_digest(docs):
    with pytest.raises(RuntimeError, match="share the digest"):
        exact_dedup.find_copies(docs, hashed=lambda norm: F.lpad(F.hex(F.length(norm)), 16, "0"))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    made = exact_dedup.FuseFilter.build(np.concatenate([keys, keys]))
    assert made.might_have(keys).all()
    others = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    assert made.might_have(others).mean() < 0.02
    assert len(made.cells) <= max(64, 2 * n + 4096)


def test_texts_the_filters_do_not_know_skip_the_exact_join(spark):
    number = {hashlib.sha256(str(i).encode()).hexdigest(): i for i in range(2000)}

    def groups(low, high):
        rows = [(d, (False, i, 0), 1) for d, i in number.items() if low <= i < high]
        return spark.createDataFrame(rows, "digest string, keep struct<none:boolean,id:bigint,row:bigint>, n bigint")

    snapshot, batch = exact_dedup.take_snapshot(groups(0, 300)), groups(200, 2000)
    told = {number[r.digest]: r.known for r in exact_dedup.screened(snapshot, batch).collect()}
    assert sorted(told) == list(range(200, 2000)) and all(told[i] for i in range(200, 300))
    assert sum(told.values()) < 200
    found = {number[r.digest]: (r.keep.id, r.n) for r in exact_dedup.admit(snapshot, batch).collect()}
    assert found == {i: (i, 2 if 200 <= i < 300 else 1) for i in range(2000)}
