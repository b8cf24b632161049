import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from likeness.llm import context_mixing as cm


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    rows = []
    for i in range(400):
        # Sentences follow a fixed successor of each word half of the time.
        at, text = rng.randrange(300), []
        for _ in range(rng.choice([1, 5, 80, 200])):
            text.append(words[at])
            at = (at * 7 + 1) % 300 if rng.random() < 0.5 else min(299, int(rng.expovariate(0.02)))
        if i % 10 == 0:
            text.append(f"New{i}x")
        rows.append((i, " ".join(text).upper() if i % 4 else "\t".join(text)))
    return [*rows, (1000, None), (1001, " "), (None, "a b"), rows[0], (10**15, "ünï\xa0code \x1f x")]


@pytest.fixture(scope="module")
def scored(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").selectExpr("*", "1 as row", "2 as held_out", "3 as word")
    return cm.score_documents(docs).collect()


def test_base_and_counts_match_plain_python(scored, corpus):
    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2

    split = [(i, (t or "").encode().lower().split()) for i, t in corpus]
    count = Counter(w for i, ws in split if not held(i) for w in [*ws, "end"])
    n, v = sum(count.values()), len(count)
    assert len(scored) == len(corpus)
    expected = []
    for i, ws in split:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*ws, "end"])
        expected.append((str(i), held(i), len(ws) + 1, sum(count[w] > 0 for w in [*ws, "end"]), n, round(base, 6)))
    got = [
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored
    ]
    assert sorted(got) == sorted(expected)


def test_held_out_texts_are_predicted_better_than_by_the_base(scored):
    held = [r for r in scored if r.held_out and r.n_tokens > 2]
    assert all(r.score < 0 for r in scored)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_held_out_texts_teach_nothing(spark, corpus, scored):
    changed = [
        (i, "other words now" if zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 else t) for i, t in corpus
    ]
    again = cm.score_documents(spark.createDataFrame(changed, "doc_id bigint, text string")).collect()
    same = {(str(r.doc_id), r.n_tokens): r.score for r in scored if not r.held_out}
    for r in again:
        if not r.held_out:
            assert same[str(r.doc_id), r.n_tokens] == pytest.approx(r.score, abs=1e-6)


def random_model(words, tree_words, tree, letters, most, seed):
    rng = np.random.default_rng(seed)
    tables = cm.as_cells(*rng.integers(0, most, (2, cm.PREDICTORS, 1 << 18)))
    return cm.Model(words, tree_words, tree, letters, tables, cm.Mixer())


def test_probabilities_of_all_texts_add_up():
    words = [b"a", b"bb", b"c"]
    model = random_model(words, 3, cm.Code.of([5, 3, 4, 2, 1]), cm.Code.of(cm.byte_counts(words).tolist()), 60, 0)
    places = model.speller()
    counter = cm.Counter(18)
    for text in ("a bb c zz a", "bb q a") * 3:
        for bits in places.stream([cm.tokens(text)], *places.places([cm.tokens(text)])):
            counter.add(bits)
    model.mixer = counter.mixer
    table = model.mixer.table()
    # A bit's two values have probabilities that add up to one, so the code's leaves do.
    for text in ([b"a", b"zz"], [b"c"], []):
        for bits in places.stream([text], *places.places([text])):
            cells = [t[s] for t, s in zip(model.tables, bits.slots)]
            one = 2.0 ** model.mixer.log2(cells, bits.bit, bits.spelled, table)
            other = 2.0 ** model.mixer.log2(cells, 1 - bits.bit, bits.spelled, table)
            assert np.allclose(one + other, 1, atol=1e-9)


# Plain Python: one bit after the other, its contexts from their definition.
M = 0xFFFFFFFF
A, B, C, D = (int(k) for k in cm._ODD)


def scramble(x):
    x &= M
    x = (x ^ x >> 16) * 0x7FEB352D & M
    x = (x ^ x >> 15) * 0x846CA68B & M
    return x ^ x >> 16


def plain_bits(text, place, tree_words, tree, letters, table_bits):
    """(spelled, bit, three slots) of a text's bits."""

    def path(code, symbol, contexts, flag, spelled):
        for step in code.steps[code.start[symbol] : code.start[symbol + 1]].tolist():
            node = (step >> 1) ^ flag
            yield spelled, step & 1, [((node * A ^ c) & M) * B % (1 << 32) >> 32 - table_bits for c in contexts]

    one = two = last = cm.END
    for word in [*cm.tokens(text), None]:
        at = place.get(word, -1)
        symbol = cm.END if word is None else at + 2 if 0 <= at < tree_words else cm.ESCAPE
        language = scramble(last + 1)
        yield from path(tree, symbol, [language, scramble(one * C + 3), scramble(one * D + scramble(two))], 0, False)
        if symbol == cm.ESCAPE:
            back = [0, 0, 0]
            for letter in [*word, 32]:
                first = scramble(back[0] * C + (language | 1))
                three = scramble((back[0] * 257 + back[1]) * 257 + back[2] + (1 << 30))
                yield from path(letters, letter, [first, scramble(first + back[1] * D + 11), three], 1 << 28, True)
                back = [letter + 1, *back[:2]]
        elif symbol < cm.COMMON + 2:
            last = symbol
        one, two = symbol, one


def plain_score(model, text):
    mixer, total = model.mixer, 0.0
    place = {w: i for i, w in enumerate(model.words)}
    for spelled, bit, slots in plain_bits(text, place, model.tree_words, model.tree, model.letters, cm.MIN_TABLE_BITS):
        cells = [int(t[s]) for t, s in zip(model.tables, slots)]
        seen = [int(cm.SEEN[c]) for c in cells]
        gate = 32 * spelled + 16 * (seen[0] == 3) + 4 * seen[1] + seen[2]
        x = mixer.weights[-1][gate] + sum(mixer.weights[j][gate] * cm.STRETCH[c] for j, c in enumerate(cells))
        x = min(7.99, max(-7.99, float(x)))
        low = int((x + 8) * 2)
        row = mixer.refined[gate * cm.BUCKETS :][low : low + 2].tolist()
        final = (x + row[0] + (row[1] - row[0]) * ((x + 8) * 2 - low)) / 2
        total -= math.log10(1 + math.exp(-final if bit else final))
    return total


def test_scores_match_plain_python(spark, corpus, scored):
    train = [t or "" for i, t in corpus if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    frame = spark.createDataFrame([(t,) for t in train], "text string")
    model, _ = cm.fit(frame, cm.word_counts(frame))
    assert model.tables.shape == (3, 1 << cm.MIN_TABLE_BITS) and 0 < model.tree_words < len(model.words)
    place = {w: i for i, w in enumerate(model.words)}
    counts = np.zeros((2, 3, 1 << cm.MIN_TABLE_BITS), np.int64)
    for text in train:
        for _, bit, slots in plain_bits(text, place, model.tree_words, model.tree, model.letters, cm.MIN_TABLE_BITS):
            for j, slot in enumerate(slots):
                counts[bit, j, slot] += 1
    assert counts.max() < cm.Counter.HALF
    assert (model.tables == cm.as_cells(*counts)).all()
    table, speller = model.mixer.table(), model.speller()
    for _, text in corpus[::9]:
        words = [cm.tokens(text)]
        got = model.score(speller.stream(words, *speller.places(words)), table)[0] * math.log10(2)
        # Scoring rounds log odds to 1/128.
        assert got == pytest.approx(plain_score(model, text or ""), rel=3e-3)


def test_counters_are_halved_before_they_are_full():
    counter = cm.Counter(16)
    ones = cm.Bits(False, np.ones(10 * cm.BLOCK, np.uint8), [np.full(10 * cm.BLOCK, 7, np.uint32)] * 3, np.array([0]))
    zeros = cm.Bits(False, np.zeros(cm.BLOCK // 8, np.uint8), [np.full(cm.BLOCK // 8, 7, np.uint32)] * 3, np.array([0]))
    counter.add(ones)
    counter.add(zeros)
    expected = 0
    for _ in range(10):
        expected = (expected >> 1 if expected >= cm.Counter.HALF else expected) + cm.BLOCK
    assert expected < 1 << 16
    assert counter.tables[0, 14:16].tolist() == [cm.BLOCK // 8, expected >> 1]


def test_packed_slices_add_up_again():
    rng = np.random.default_rng(4)
    for share, most in ((0.01, 9), (0.9, 9), (0.9, 300), (0.5, 60_000), (0.0, 2)):
        own = (rng.integers(1, most, 1 << 16) * (rng.random(1 << 16) < share)).astype(np.uint16)
        total = np.ones(1 << 16, np.int64)
        rows = list(cm.packed(own))
        for at, n in rows:
            cm.add_packed(total, at, n)
        assert (total == own + 1).all()
        assert sum(len(at) + len(n) for at, n in rows) <= 4 * np.count_nonzero(own)


def test_mixers_are_averaged_by_the_bits_behind_them():
    a, b = cm.Mixer(), cm.Mixer()
    a.weights[:, 3], a.bits[3], b.weights[:, 3], b.bits[3] = 1.0, 30, 2.0, 10
    a.refined[5], a.hits[5] = 9.0, 2
    out = cm.Mixer.averaged(a.state() + b.state())
    assert np.allclose(out.weights[:, 3], 1.25) and out.refined[5] == 9.0
    assert np.allclose(out.weights[:3, 4], 0.4) and out.refined[6] == cm.Mixer().refined[6]


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(cm, "PIECE", 4)
    runs = list(cm._runs(["a b c d e f g h i", None, "x", "p q r s"]))
    flat = [(i, w, bool(e)) for own, words, ended in runs for i, w, e in zip(own, words, ended)]
    assert flat == [
        (0, [b"a", b"b", b"c", b"d"], False), (0, [b"e", b"f", b"g", b"h"], False), (0, [b"i"], True),
        (1, [], True), (2, [b"x"], True), (3, [b"p", b"q", b"r", b"s"], True),
    ]
    model = random_model([b"a", b"b", b"p"], 2, cm.Code.of([3] * 4), cm.Code.of([1] * 256), 9, 3)
    s, table = model.speller(), model.mixer.table()
    total = {}
    for own, words, ended in runs:
        for i, score in zip(own, model.score(s.stream(words, *s.places(words), ended), table)):
            total[i] = total.get(i, 0) + score
    # Each piece costs what it does alone; a piece without its end, less the end's path after it.
    alone = [model.score(s.stream([w], *s.places([w]), np.array([e])), table)[0] for _, w, e in flat]
    assert total[0] == pytest.approx(sum(alone[:3])) and total[3] == pytest.approx(alone[5])


def test_huffman_paths_are_a_prefix_code():
    code = cm.Code.of([5, 1, 1, 2, 9])
    codes = ["".join(str(x & 1) for x in code.steps[a:b].tolist()) for a, b in zip(code.start, code.start[1:])]
    # Equal beginnings lead through equal nodes.
    steps = [tuple(code.steps[a:b] >> 1) for a, b in zip(code.start, code.start[1:])]
    assert len({s[0] for s in steps}) == 1 and len({n for s in steps for n in s}) == 4
    assert all(not a.startswith(b) for a in codes for b in codes if a is not b)
    assert sum(2.0 ** -len(c) for c in codes) == 1


def test_texts_in_runs_score_as_alone(corpus):
    words = sorted({w for _, t in corpus for w in cm.tokens(t)})[:50]
    model = random_model(words, 40, cm.Code.of([3] * 42), cm.Code.of([1] * 256), 9, 1)
    s, table = model.speller(), model.mixer.table()
    texts = [cm.tokens(t) for _, t in corpus[:30]] + [[], [], [b"zzz"], []]
    together = model.score(s.stream(texts, *s.places(texts)), table)
    alone = [model.score(s.stream([t], *s.places([t])), table)[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-3)


def test_no_training_texts(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert cm.score_documents(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = cm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0.0 and row.score < 0
