import random

import numpy as np
import pytest
import xxhash

from likeness.llm import simhash
from likeness.llm.simhash import near_codewords


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """(id, fingerprint) rows -> id by row, all pairs compared."""
    n = len(prints)
    lead = list(range(n))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                lead[root(i)] = root(j)
    best = {}
    for i in range(n):
        key = (prints[i][0] is None, prints[i][0])
        best[root(i)] = min(best.get(root(i), key), key)
    return [best[root(i)][1] for i in range(n)]


def test_golay_code_is_perfect_and_keys_cover_two_errors():
    rng = np.random.default_rng(1)
    _, distance = near_codewords(rng.integers(0, 1 << 23, 2000))
    assert (((distance >= 0) & (distance <= 3)).sum(axis=1) == 1).all()
    for errors in (0, 1, 2):
        for _ in range(150):
            a = int(rng.integers(0, 1 << 63))
            b = a
            for bit in rng.choice(64, errors, replace=False):
                b ^= 1 << int(bit)
            _, keys_a, near_a = simhash.golay_keys(np.array([a], np.uint64))
            _, keys_b, _ = simhash.golay_keys(np.array([b], np.uint64))
            assert set(keys_a[near_a]) & set(keys_b)


@pytest.mark.parametrize("hot_key", [64, 1])
def test_components_match_all_pairs(spark, hot_key):
    rng = random.Random(5)
    prints = []
    for i in range(40):
        base = rng.getrandbits(64)
        prints.append(base)
        for _ in range(rng.randrange(6)):
            base ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                base ^= 1 << rng.randrange(64)
            prints.append(base)
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in dict.fromkeys(prints)]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = {tuple(sorted(r)) for r in simhash.links(frame, hot_key).collect()}
    true = {
        tuple(sorted((a, b)))
        for a in signed
        for b in signed
        if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    }
    if hot_key > 1:
        assert found == true
    rows = [(i, p & (2**64 - 1)) for i, p in enumerate(signed)]
    by_links = simhash.components(simhash.links(frame, hot_key), "a", "b").collect()
    name = {r.node: r.component for r in by_links}
    pairs = list(zip(plain_components(rows), [name.get(p, p) for p in signed]))
    assert len(set(pairs)) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_documents_match_plain_python(docs, rows):
    found = simhash.near_duplicates(docs).collect()
    prints = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    expected = sorted(zip(prints, plain_components(prints)), key=str)
    got = sorted((((r.doc_id, r.fp & (2**64 - 1)), r.component_id) for r in found), key=str)
    assert got == expected
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert left.count() == len({c for _, c in expected})


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_long_text_is_counted_in_parts():
    text = " ".join(str(i % 977) for i in range(140_000))
    assert simhash.fingerprint(text) == plain_fingerprint(text)
