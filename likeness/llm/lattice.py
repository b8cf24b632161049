"""Near duplicates of embeddings by lattice hashing: E8 cells propose pairs, the cosine decides.

A table projects unit vectors onto 16 random directions, as two blocks of eight, and
decodes each block to its nearest point of the E8 lattice; the two points are the home
cell.  A vector is looked for in its home and in the PROBES cells that are next nearest
(the lattice has 240 minimal vectors, so these are the best single steps of either block
or of both).  A pair is proposed where one's home is among the cells the other looks in.

With cells of WIDTH 2 a table proposes a pair of cosine 0.9 with probability 0.30, so
TABLES = 16 miss it with probability 0.003, and a pair of cosine 0 with about 0.0001.
Nearer pairs are missed more rarely still (0.99: below 1e-9).  Cells are as selective as
that whatever the table's size; a corpus of many billions of vectors takes more blocks
and tables, which are parameters.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from likeness.llm.common import smallest_first, stored
from likeness.llm.components import components
from likeness.plans.materialise import keyed_join, lookup, store

TABLES, BLOCKS, WIDTH, PROBES = 16, 2, 2.0, 4
SEED = 42
# Signs of 64 projections: a pair of cosine 0.9 differs in 9 of them, in more than 22 with
# probability 1e-5; of pairs at right angles 1 % differ in no more.
SIGNS = 22
# A cell with more vectors than this is dealt out to several tasks.
CELL_ROWS = 256
# Rounds in which vectors look for a leader so near that all its followers link with each other.
LEADER_ROUNDS = 3
# Vectors that a Python task projects at a time.
SLICE = 1024

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


# ------------------------------------------------------------------ lattice


@cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two of +-1, or eight halves with an even number of minus signs."""
    found = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            found.append(v)
    found += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole-number points with an even sum of coordinates."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(gap[odd]).argmax(axis=1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of eight numbers."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _steps(x: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The point itself and its ``n`` neighbours nearest to ``x``, and by how much farther each is."""
    farther = 2.0 - 2.0 * ((x - at) @ roots().T)
    best = np.argpartition(farther, n, axis=1)[:, :n]
    cost = np.take_along_axis(farther, best, axis=1)
    order = np.argsort(cost, axis=1, kind="stable")
    best, cost = np.take_along_axis(best, order, axis=1), np.take_along_axis(cost, order, axis=1)
    points = np.concatenate([at[:, None, :], at[:, None, :] + roots()[best]], axis=1)
    return points, np.concatenate([np.zeros((len(x), 1)), cost], axis=1)


@cache
def _frames(size: int, tables: int, blocks: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Projections, offsets, sign projections and odd multipliers for vectors of ``size`` components."""
    draw = np.random.default_rng([SEED, size])
    dims = tables * blocks * 8
    lines = draw.standard_normal((size, dims)) / width
    odd = draw.integers(0, 1 << 63, blocks * 8, np.uint64) << np.uint64(1) | np.uint64(1)
    return lines, draw.random(dims) * 4, draw.standard_normal((size, 64)), odd


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def cells(
    unit: np.ndarray, probes: int, tables: int = TABLES, blocks: int = BLOCKS, width: float = WIDTH
) -> np.ndarray:
    """Keys of the home cell (first) and of the ``probes`` next cells, by vector and table."""
    n, size = unit.shape
    lines, offset, _, odd = _frames(size, tables, blocks, width)
    placed = (unit @ lines + offset).reshape(n * tables * blocks, 8)
    homes = decode(placed)
    tag = np.tile(np.arange(1, tables + 1, dtype=np.uint64) * _MIX[2] ^ np.uint64(size), n)

    def partial(points: np.ndarray, block: int) -> np.ndarray:
        whole = (points * 2).astype(np.int64).view(np.uint64)
        return (whole * odd[block * 8 : block * 8 + 8]).sum(axis=-1, dtype=np.uint64)

    if not probes:
        at = homes.reshape(n * tables, blocks, 8)
        keys = sum((partial(at[:, b], b) for b in range(blocks)), np.zeros(n * tables, np.uint64))[:, None]
    else:
        keys, cost = np.zeros((n * tables, 1), np.uint64), np.zeros((n * tables, 1))
        for b in range(blocks):
            mine = placed.reshape(-1, blocks, 8)[:, b], homes.reshape(-1, blocks, 8)[:, b]
            points, farther = _steps(*mine, probes)
            keys = (keys[:, :, None] + partial(points, b)[:, None, :]).reshape(n * tables, -1)
            cost = (cost[:, :, None] + farther[:, None, :]).reshape(n * tables, -1)
            if keys.shape[1] > probes + 1:
                # The home costs nothing, so it stays first.
                order = np.argsort(cost, axis=1, kind="stable")[:, : probes + 1]
                keys, cost = np.take_along_axis(keys, order, axis=1), np.take_along_axis(cost, order, axis=1)
    return _mixed(keys ^ tag[:, None]).reshape(n, tables, -1)


def signs(unit: np.ndarray) -> np.ndarray:
    """64 signs of random projections, as one signed number."""
    _, _, lines, _ = _frames(unit.shape[1], TABLES, BLOCKS, WIDTH)
    bits = np.packbits(unit @ lines > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.int64).reshape(-1)


def unit_rows(vectors: list[list[float]]) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    # Scaled by the largest component first: squares of very small or large ones would be 0 or infinite.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def with_cells(vectors: DataFrame, keep: list[str], probes: int, tables: int, only: int | None = None) -> DataFrame:
    """(keep..., key, fp) for each cell a vector is in or looks in; ``only`` names a single table."""
    kinds = ", ".join(f"{k} {dict(vectors.dtypes)[k]}" for k in keep)
    schema = f"{kinds}, key bigint, fp bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(parts):
        for part in parts:
            for at in range(0, part.num_rows, SLICE):
                some = part.slice(at, SLICE)
                lists = some.column("vec").to_pylist()
                by_size: dict[int, list[int]] = {}
                for i, v in enumerate(lists):
                    by_size.setdefault(len(v), []).append(i)
                for rows in by_size.values():
                    unit = unit_rows([lists[i] for i in rows])
                    keys = cells(unit, probes, tables)
                    keys = keys if only is None else keys[:, only : only + 1]
                    each = keys[0].size
                    of = pa.array(np.repeat(np.array(rows), each))
                    cols = [some.column(k).take(of) for k in keep]
                    cols += [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(signs(unit), each))]
                    yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return vectors.select(*keep, "vec").mapInArrow(batches, schema)


# ------------------------------------------------------------------- cosine


def _distinct_vectors(rows: DataFrame) -> DataFrame:
    """(cid, h1, h2, vec, n, first): one row per distinct vector, known by 128 bits of hash."""
    once = rows.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.first("vec").alias("vec"),
        F.count(F.lit(1)).alias("n"),
        F.min(smallest_first("vec_id")).alias("first"),
    )
    return stored(once.withColumn("cid", F.monotonically_increasing_id()))


def _unit_vectors(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``vec`` scaled to length one, in double precision."""
    schema = "cid bigint, h1 bigint, vec array<double>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(parts):
        for part in parts:
            for at in range(0, part.num_rows, SLICE):
                some = part.slice(at, SLICE).to_pydict()
                made: list = [None] * len(some["cid"])
                by_size: dict[int, list[int]] = {}
                for i, v in enumerate(some["vec"]):
                    by_size.setdefault(len(v), []).append(i)
                for rows in by_size.values():
                    for i, u in zip(rows, unit_rows([some["vec"][i] for i in rows])):
                        made[i] = u
                yield pa.RecordBatch.from_pydict(some | {"vec": made}, schema=arrow)

    return vectors.select("cid", "h1", "vec").mapInArrow(batches, schema)


def _dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, t) -> s + t)")


def with_leaders(vectors: DataFrame, threshold: float, rounds: int = LEADER_ROUNDS) -> DataFrame:
    """(cid, h1, vec, lead): each vector's leader, itself where none is near.

    A follower is within half the angle of ``threshold`` of its leader, so two followers of one
    leader always link: a dense group needs no pairs among its followers.  In each round
    the vectors of a cell try the cell's first leader, or its first vector.
    """
    near = math.cos(math.acos(threshold) / 2 - 1e-6)
    state = vectors.select("cid", "h1", "vec", F.lit(None).cast("bigint").alias("lead"))
    for table in range(rounds):
        free = state.filter(F.col("lead").isNull() | (F.col("lead") == F.col("cid")))
        at = store(with_cells(free, ["cid", "h1", "lead"], 0, rounds, table))
        heads = at.df.groupBy("key").agg(
            F.min(F.struct(F.col("lead").isNull().alias("new"), "h1", "cid")).alias("head"),
            F.count(F.lit(1)).alias("size"),
        )
        heads = heads.filter("size > 1").select("key", "size", F.col("head.cid").alias("head"))
        heads = stored(heads.join(vectors.select(F.col("cid").alias("head"), F.col("vec").alias("head_vec")), "head"))
        tries = keyed_join(at.df.select("cid", "key"), heads, {"key": "key"}, False, "size", at.rows)
        tries = tries.filter("head is not null and head <> cid").select("cid", "head", "head_vec")
        joined = free.filter("lead is null").join(tries, "cid").filter(
            (F.size("vec") == F.size("head_vec")) & (_dot("vec", "head_vec") >= near)
        )
        follows = stored(joined.select("cid", F.col("head").alias("_lead")))
        leads = follows.select(F.col("_lead").alias("cid"), "_lead").distinct()
        state = stored(
            state.join(follows.union(leads), "cid", "left")
            .select("cid", "h1", "vec", F.coalesce("lead", "_lead").alias("lead"))
        )
    return state.withColumn("lead", F.coalesce("lead", "cid"))


def candidates(vectors: DataFrame, tables: int = TABLES, probes: int = PROBES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b) of vectors (cid, vec, lead) with different leaders, one's home among the other's cells.

    A cell with more than ``cell_rows`` vectors is dealt out by a hash, and those that look in it
    meet each part; nothing is left out.
    """
    homes = stored(with_cells(vectors, ["cid", "lead"], 0, tables))
    parts = store(
        homes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
        .select("key", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    )
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("cid"), F.col("parts"))).otherwise(F.lit(0))
    every = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    side = lookup(parts.df, parts.small)
    left = homes.join(side, "key", "left").select(
        "key", part.cast("int").alias("part"), F.col("cid").alias("a"), F.col("lead").alias("lead_a"), F.col("fp").alias("fp_a")
    )
    looking = with_cells(vectors, ["cid", "lead"], probes, tables)
    right = looking.join(side, "key", "left").select(
        "key", F.explode(every).alias("part"), F.col("cid").alias("b"), F.col("lead").alias("lead_b"), F.col("fp").alias("fp_b")
    )
    alike = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= SIGNS
    met = left.join(right, ["key", "part"]).filter((F.col("lead_a") != F.col("lead_b")) & alike)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_vectors(
    table: DataFrame,
    threshold: float = 0.9,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept.

    Vectors link when their cosine is at least ``threshold`` (above 0).  A vector that is
    NULL, empty, zero or holds NULL or a non-finite number links with nothing, nor do
    vectors of different lengths.  Repeated rows are rows of their own and link.  NULL
    ids come last when the smallest is sought and are never ``kept``.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("the threshold must be above 0 and at most 1")
    inner = table.schema[vec_col].dataType
    plain = isinstance(inner, ArrayType) and isinstance(inner.elementType, (FloatType, DoubleType))
    vec = F.col(vec_col) if plain else F.col(vec_col).cast("array<double>")
    fine = F.expr("size(vec) > 0 and forall(vec, v -> v is not null and not isnan(v) and abs(double(v)) < double('Infinity'))")
    fine = F.coalesce(fine & F.expr("exists(vec, v -> v <> 0)"), F.lit(False))
    rows = table.select(F.col(id_col).alias("vec_id"), vec.alias("vec")).select(
        "vec_id",
        F.when(fine, F.col("vec")).alias("vec"),
        F.when(fine, F.xxhash64("vec")).alias("h1"),
        F.when(fine, F.xxhash64(F.lit(SEED), "vec")).alias("h2"),
    )
    known = _distinct_vectors(rows)
    led = with_leaders(stored(_unit_vectors(known)), threshold)
    led = stored(led)
    pairs = stored(candidates(led, tables, probes))
    both = pairs
    for side in "ab":
        both = both.join(led.select(F.col("cid").alias(side), F.col("vec").alias(f"of_{side}")), side)
    near = (F.size("of_a") == F.size("of_b")) & (_dot("of_a", "of_b") >= threshold)
    links = stored(both.filter(near).select("a", "b"))

    counts = stored(known.select("cid", "n", "first").join(led.select("cid", "lead"), "cid"))
    group = counts.groupBy("lead").agg(F.sum("n").alias("rows"))
    n_of = counts.select(F.col("cid").alias("b"), F.col("n").alias("n_b"))
    each = links.union(links.select("b", "a")).join(n_of, "b").groupBy("a").agg(F.sum("n_b").alias("across"))
    joined = links.union(counts.filter("lead <> cid").select("cid", "lead"))
    member = components(joined, "a", "b").withColumnRenamed("node", "of")
    placed = (
        keyed_join(counts, group, {"lead": "lead"}, False, "rows", None)
        .join(each, F.col("cid") == F.col("a"), "left")
        .join(member, F.col("cid") == F.col("of"), "left")
        .select(
            "cid", "n", "first", F.coalesce("component", "cid").alias("component"),
            (F.col("rows") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"),
        )
    )
    placed = stored(placed)
    lead = placed.groupBy("component").agg(F.min("first").alias("lead"), F.count(F.lit(1)).alias("members"))
    named = keyed_join(placed, lead, {"component": "component"}, False, "members", placed.count()).select(
        "cid", "n", "n_links", F.col("lead.id").alias("component_id")
    )
    named = known.select("cid", "h1", "h2").join(named, "cid").drop("cid")
    total = known.agg(F.sum("n")).first()[0]
    found = keyed_join(rows.select("vec_id", "h1", "h2"), named, {"h1": "h1", "h2": "h2"}, False, "n", total)
    linked = F.col("n_links").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("vec_id"))
    return found.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
