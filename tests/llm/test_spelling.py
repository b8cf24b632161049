import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from likeness.llm import spelling


def plain_variants(rows):
    """All words compared with all."""
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [o for o in words if near(w, o)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(found[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(found[w]), words.get(form[w])))
    return sorted(out)


def invented(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeé÷ßÉ") for _ in range(rng.randint(3, 9))) for _ in range(40)]
    texts = []
    for i in range(120):
        words = []
        for _ in range(rng.choice([0, 5, 40])):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abZ") + w[at:], w[:at] + "a" + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        texts.append((i if rng.random() < 0.95 else None, rng.choice([" ", "-", "1\n"]).join(words)))
    long = "ab" * 700
    edge = "xy" * 32
    odd = [(900, None), (901, ""), (902, f"{long} {long}c {long} {long}c {long}c {long}"), (903, f"{long} {long}c")]
    odd += [(904 + k, f"{edge} {edge}z {edge[:-1]}") for k in range(5)]
    chain = [(960 + k, "chainab chainab" + " chainabc" * 5 + " chainaa" * (k < 3)) for k in range(5)]
    return [*texts, *odd, *chain, texts[0], texts[0]]


def test_matches_plain_python(spark):
    rows = invented(4)
    frame = spark.createDataFrame([(*r, 3, "k", "w") for r in rows], "doc_id bigint, text string, n int, key string, word string")
    got = sorted((tuple(r) for r in spelling.group_variants(frame).collect()), key=lambda r: r[0])
    assert got == plain_variants(rows)
    assert sum(r[1] is not None for r in got) >= 10 and any(r[1] != r[2] and r[1] for r in got)


def test_a_full_filter_loses_no_pair(spark, monkeypatch):
    frame = spark.createDataFrame(invented(5), "doc_id bigint, text string")
    words = spelling.word_counts(frame).groupBy("word").sum("n").toDF("word", "n").filter("n >= 3 and length(word) >= 5").cache()
    found = [sorted(map(tuple, spelling.near_words(words).collect()))]
    monkeypatch.setattr(spelling, "FILTER_BITS", 64)
    found.append(sorted(map(tuple, spelling.near_words(words).collect())))
    assert found[0] == found[1] and found[0]


def test_empty_table(spark):
    none = spelling.group_variants(spark.createDataFrame([], "doc_id bigint, text string"))
    assert none.count() == 0
    assert none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("size", [1, 2, 5, 9])
def test_neighbourhood_is_full_and_without_repeats(size):
    rng = np.random.default_rng(size)
    forms = rng.integers(1, spelling.SYMBOLS + 1, (20, size)).astype(np.uint64)
    for step in (1, 3, 100):
        got: dict = {}
        for start in range(0, size + 1, step):
            for row, key in zip(*spelling.neighbour_keys(forms, start, start + step)):
                got.setdefault(int(row), []).append(int(key))
        for i, form in enumerate(forms):
            f = form.tolist()
            near = {tuple(f)}
            for j in range(size):
                near.add(tuple(f[:j] + f[j + 1 :]))
                near |= {tuple(f[:j] + [s] + f[j + 1 :]) for s in range(1, spelling.SYMBOLS + 1)}
            near |= {tuple(f[:j] + [s] + f[j:]) for j in range(size + 1) for s in range(1, spelling.SYMBOLS + 1)}
            keys = sorted(int(spelling.reduced_key(np.array([n], np.uint64).reshape(1, -1))[0]) for n in near)
            assert sorted(got[i]) == keys


def test_chains_end_at_their_last_form(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(40)] + [("x", "w05"), ("y", "w05")]
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {w: "w40" for w, _ in chain}
