import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from likeness.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_audit(rows, min_docs):
    """(lang, source, part, item, value, rank) by whole numbers of any size."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(str.maketrans(UPPER, LOWER)))) for lang, source, text in rows]
    seen: dict = defaultdict(Counter)
    for lang, _, terms in docs:
        seen[lang].update(set(terms))
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        counts: dict = {s: Counter() for la, s, _ in docs if la == lang}
        for la, s, terms in docs:
            if la == lang:
                counts[s].update(t for t in terms if t in set(kept))

        def p(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // total for t in kept}

        share = {s: p(c) for s, c in counts.items()}
        whole = p(sum(counts.values(), Counter()))

        def far(a, b):
            return (a - b) ** 2 // (a + b)

        for s in counts:
            pairs = [(-sum(far(share[s][t], share[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-far(share[s][t], whole[t]), t.encode()) for t in kept if counts[s][t] and share[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def invented(seed):
    rng = random.Random(seed)
    words = [f"{'aé漢ß'[i % 4]}{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60)]
    rows = []
    for i in range(150):
        chosen = rng.choices(words, [1 / (1 + j) for j in range(60)], k=rng.choice([0, 3, 30, 80]))
        gap = rng.choice([" ", ", ", "\x00\n", "_1-"])
        text = gap.join(w.upper() if w.isascii() and rng.random() < 0.3 else w for w in chosen)
        rows.append((rng.choice(["en", "dé", None]), rng.choice(["a", "b", "é", None]), rng.choice([text, text, text, None])))
    return [*rows, ("xx", "alone", "one two"), ("yy", "p", "rare"), ("yy", "q", ""), rows[0], rows[0]]


@pytest.mark.parametrize("cells", [divergence.SHARD_CELLS, 50])
def test_matches_plain_python(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "SHARD_CELLS", cells)
    rows = invented(3)
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "lang string, source string, text string, n int, term string, shard string")
    got = sorted(tuple(r) for r in divergence.audit(frame).collect())
    assert got == plain_audit(rows, 10)
    assert {r[0] for r in got} == {"en", "dé", "", "yy"}  # one source has no pair, and no kept term


def test_columns_and_empty_table(spark):
    none = divergence.audit(spark.createDataFrame([], "text string, lang string, source string"))
    assert none.count() == 0
    assert none.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_long_text_and_many_slices(spark, monkeypatch):
    long = " ".join(f"w{i % 500}" + "ab"[i % 2] for i in range(400_000))
    rows = [("en", "s", long), ("en", "t", "ab wa wb"), *[("en", "t", "wa wb wa")] * 12]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.audit(frame).collect()) == plain_audit(rows, 10)


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(2)
    totals = rng.integers(3, 9 * 10**15, 2000)
    counts = (rng.random(2000) * (totals - 2)).astype(np.int64)
    small = rng.integers(2, 50, 2000)
    counts = np.concatenate([counts, small - 2])
    totals = np.concatenate([totals, small])
    expected = [1 + 1_000_000_000 * (int(c) + 2) // int(t) for c, t in zip(counts, totals)]
    assert divergence.shares(counts, totals).tolist() == expected
