"""The pipeline on a small table, stage by stage, against plain Python over what each stage was given."""

import re

import pytest

import corpus_pipeline
from likeness.llm.common import read, stored
from tests.llm.test_mixing import plain_targets
from tests.llm.test_shingles import plain_leads

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = read(spark, SF, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        seen.append(docs)
    return seen


def rows_of(frame):
    return [(r.doc_id, r.text, r.source) for r in frame.select("doc_id", "text", "source").collect()]


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_toxic_documents_go_and_labelled_clean_ones_stay(spark, stages):
    labels = {r.doc_id: r.toxic for r in read(spark, SF, "labels").collect()}
    left = {i for i, _, _ in rows_of(stages[1])}
    judged = [(i in left, labels[i]) for i, _, _ in rows_of(stages[0]) if i in labels]
    assert sum(kept == bool(toxic) for kept, toxic in judged) <= 0.02 * len(judged)


def test_exact_and_near_copies(stages):
    def norm(text):
        return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")

    best: dict = {}
    for i, text, _ in rows_of(stages[1]):
        best[norm(text)] = min(best.get(norm(text), i), i)
    assert sorted(i for i, _, _ in rows_of(stages[2])) == sorted(best.values())
    rows = sorted((i, t) for i, t, _ in rows_of(stages[2]))
    assert sorted(i for i, _, _ in rows_of(stages[3])) == sorted(set(plain_leads(rows).values()))


def test_mix_and_packing(stages):
    rows = rows_of(stages[3])
    size, target = plain_targets(rows)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    taken = dict.fromkeys(size, 0)
    copies: dict = {}
    for i, _, s in rows_of(stages[4]):
        taken[s] += words[i]
        copies[i] = copies.get(i, 0) + 1
    assert max(copies.values()) <= 3 and set(copies) <= set(words)
    for s in size:
        assert abs(taken[s] - target[s]) <= 2 * max(words[i] for i, _, source in rows if source == s)
    packed = stages[5].collect()
    assert sum(r.piece == 0 for r in packed) == sum(copies.values())
    filled: dict = {}
    for r in packed:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 1024
    least = lower_bound([r.length for r in packed])
    assert least <= len(filled) <= least + 1, (least, len(filled), sum(filled.values()))


def lower_bound(lengths):
    """No packing needs fewer: of pieces over half none share, and those of k and more go beside few of them."""
    best = 0
    for k in range(513):
        alone = sum(n > 1024 - k for n in lengths)
        middle = [n for n in lengths if 512 < n <= 1024 - k]
        small = sum(n for n in lengths if k <= n <= 512)
        best = max(best, alone + len(middle) + max(0, -(-(small - 1024 * len(middle) + sum(middle)) // 1024)))
    return best
