import math
import random

import numpy as np
import pytest

from likeness.llm import lattice


def plain_links(rows, threshold):
    """(id, vector) rows -> (n_links, component id) of each, all pairs compared."""
    n = len(rows)

    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(v, w):
        if not fine(v) or not fine(w) or len(v) != len(w):
            return -2.0
        v, w = (np.array(x, np.float64) / np.abs(x).max() for x in (v, w))
        return float(v @ w / math.sqrt((v @ v) * (w @ w)))

    near = [[j for j in range(n) if j != i and cosine(rows[i][1], rows[j][1]) >= threshold] for i in range(n)]
    lead: list = [None] * n
    for i in range(n):
        if lead[i] is None:
            group, todo = {i}, [i]
            while todo:
                new = set(near[todo.pop()]) - group
                group |= new
                todo += new
            first = min(((rows[j][0] is None, rows[j][0]) for j in group), key=lambda k: (k[0], k[1] or 0))[1]
            for j in group:
                lead[j] = (first,)
    return [(rows[i][0], len(near[i]), lead[i][0], rows[i][0] is not None and rows[i][0] == lead[i][0]) for i in range(n)]


def at_cosine(rng, v, c):
    w = rng.standard_normal(len(v))
    w -= (w @ v) / (v @ v) * v
    return c * v / np.linalg.norm(v) + math.sqrt(1 - c * c) * w / np.linalg.norm(w)


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8)) * 3
    at = lattice.decode(x)
    doubled = at * 2
    assert (doubled == np.rint(doubled)).all() and (at.sum(axis=1) % 2 == 0).all()
    assert (np.ptp(doubled % 2, axis=1) == 0).all()  # all whole or all half
    own = ((x - at) ** 2).sum(axis=1)
    assert own.max() <= 1.0 + 1e-9  # the covering radius
    around = ((x[:, None] - at[:, None] - lattice.roots()) ** 2).sum(axis=2)
    assert (own[:, None] <= around + 1e-9).all()
    assert lattice.roots().shape == (240, 8) and np.allclose((lattice.roots() ** 2).sum(axis=1), 2)


def test_probes_start_at_home_and_cells_agree():
    rng = np.random.default_rng(2)
    unit = lattice.unit_rows(rng.standard_normal((50, 24)).tolist())
    home, looked = lattice.cells(unit, 0), lattice.cells(unit, 4)
    assert home.shape == (50, lattice.TABLES, 1) and looked.shape == (50, lattice.TABLES, 5)
    assert (home[:, :, 0] == looked[:, :, 0]).all()
    assert all(len(set(row.tolist())) == 5 for row in looked.reshape(-1, 5))


@pytest.mark.parametrize(("c", "least"), [(0.9001, 0.98), (0.93, 0.995), (0.99, 1.0)])
def test_recall_of_cells_and_signs(c, least):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((1500, 64))
    a, b = lattice.unit_rows(v.tolist()), lattice.unit_rows([at_cosine(rng, x, c) for x in v])
    home, look = lattice.cells(a, 0), lattice.cells(b, lattice.PROBES)
    back_home, back = lattice.cells(b, 0), lattice.cells(a, lattice.PROBES)
    found = ((home == look).any(axis=2) | (back_home == back).any(axis=2)).any(axis=1)
    apart = np.array([(int(x) ^ int(y)) & (2**64 - 1) for x, y in zip(lattice.signs(a), lattice.signs(b))])
    found &= np.array([int(x).bit_count() <= lattice.SIGNS for x in apart])
    assert found.mean() >= least


def planted(seed, dims=32):
    rng = np.random.default_rng(seed)
    pick = random.Random(seed)
    rows, i = [], 100
    for _ in range(40):
        base = rng.standard_normal(dims)
        rows.append((i := i - 1, base.astype(np.float32).tolist()))
        for c in pick.choices([0.85, 0.91, 0.95, 0.98, 0.999], k=pick.randrange(5)):
            rows.append((len(rows) + 1000, (at_cosine(rng, base, c) * pick.choice([1, 1e-3, 50])).astype(np.float32).tolist()))
    dense = rng.standard_normal(dims)
    rows += [(2000 + k, at_cosine(rng, dense, 0.985).astype(np.float32).tolist()) for k in range(60)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (3000, None), (3001, [0.0] * dims), (3002, [math.nan] * dims)]
    rows += [(3003, [1.0, None]), (3004, [math.inf, 1.0]), (3005, []), (3006, [1.0, 0.0]), (3007, [2.0, 0.01]), (3008, [1e-30, 0.0])]
    return rows


@pytest.mark.parametrize("cell_rows", [lattice.CELL_ROWS, 3])
def test_documents_match_all_pairs(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(lattice.candidates, "__defaults__", (lattice.TABLES, lattice.PROBES, cell_rows))
    rows = planted(7)
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id bigint, embedding array<float>, label int, cid string, n int")
    got = sorted((tuple(r) for r in lattice.similar_vectors(frame).collect()), key=str)
    assert got == sorted(plain_links(rows, 0.9), key=str)


def test_empty_table_and_types(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert lattice.similar_vectors(none).count() == 0
    whole = spark.createDataFrame([(1, [1, 0, 5]), (2, [2, 0, 10]), (3, [0, 7, 0])], "vec_id bigint, embedding array<int>")
    assert sorted(map(tuple, lattice.similar_vectors(whole).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
