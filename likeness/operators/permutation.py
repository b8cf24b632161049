"""Permutation null of the association test, drawn from stored contingency counts.

Shuffling one column against the other keeps both margins of their table, so the margins are
all a draw needs: no record is read again.  Blocks of draws are separate tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Draws that one task makes of one table.
BLOCK = 25
# numpy draws hypergeometric numbers exactly below this total.
EXACT_TOTAL = 1_000_000_000


def _hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, take: np.ndarray) -> np.ndarray:
    """How many of ``take`` drawn without replacement are good.

    Beyond numpy's range few draws are as good as with replacement, and many are normal.
    """
    total = good + bad
    if total.max(initial=0) < EXACT_TOTAL:
        return rng.hypergeometric(good, bad, take)
    share = good / np.maximum(total, 1)
    few = rng.binomial(np.minimum(take, 1 << 20), share)
    spread = np.sqrt(np.maximum(take * share * (1 - share) * (total - take) / np.maximum(total - 1, 1), 0))
    many = np.rint(take * share + spread * rng.standard_normal(len(take))).astype(np.int64)
    found = np.where(take <= 1 << 20, few, many)
    return np.clip(found, np.maximum(take - bad, 0), np.minimum(good, take))


def drawn_statistics(rows: np.ndarray, columns: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """``sum O^2 / (r c)`` of random tables with these margins.

    A table with more cells than records is drawn record by record, any other cell by cell
    from its hypergeometric law given the cells before it, for all draws at once.
    """
    n, found = int(rows.sum()), np.zeros(draws)
    if n <= len(rows) * len(columns):
        x, y = np.repeat(np.arange(len(rows)), rows), np.repeat(np.arange(len(columns)), columns)
        for d in range(draws):
            cell, seen = np.unique(x * len(columns) + rng.permutation(y), return_counts=True)
            i, j = np.divmod(cell, len(columns))
            found[d] = (seen.astype(float) ** 2 / (rows[i].astype(float) * columns[j])).sum()
        return found
    left = np.tile(columns.astype(np.int64), (draws, 1))
    for r in rows:
        need = np.full(draws, r, np.int64)
        rest = left.sum(axis=1)
        for j, c in enumerate(columns):
            rest = rest - left[:, j]
            got = _hypergeometric(rng, left[:, j], rest, need)
            found += got.astype(float) ** 2 / (float(r) * float(c))
            left[:, j] -= got
            need -= got
    return found


def permutation_null(counts: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(target, leaf, pred, p_perm) for counts (target, leaf, pred, x, y, w).

    ``p_perm = (1 + draws at least as associated) / (1 + draws)``.  Draws follow from (seed, table,
    block), whatever the partitioning.  Tables with a constant side have no row.
    """
    table = ["target", "leaf", "pred"]
    seen = counts.filter(F.col("w") > 0)
    sides = [
        seen.groupBy(*table, F.col(side).alias("token")).agg(F.sum("w").alias("m")).withColumn("side", F.lit(side))
        for side in ("x", "y")
    ]
    totals = sides[0].groupBy(*table).agg(F.count(F.lit(1)).alias("kx")).join(
        sides[1].groupBy(*table).agg(F.count(F.lit(1)).alias("ky")), table
    )
    w = F.col("w").cast("double")
    r, c = (s.select(*table, F.col("token").alias(k), F.col("m").alias(f"_{k}")) for s, k in zip(sides, "xy"))
    observed = (
        seen.join(r, [*table, "x"]).join(c, [*table, "y"]).groupBy(*table)
        .agg(F.sum(w * w / (F.col("_x").cast("double") * F.col("_y"))).alias("q"))
    )
    tested = totals.filter((F.col("kx") > 1) & (F.col("ky") > 1)).join(observed, table).select(*table, "q")
    blocks = F.sequence(F.lit(0), F.lit(-(-draws // BLOCK) - 1))
    margins = sides[0].unionByName(sides[1]).join(tested, table).select(
        "target", F.to_json("leaf").alias("at"), "pred", F.explode(blocks).alias("block"), "side", "token", "m", "q"
    )

    def block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        target, at, pred, number = (k.as_py() for k in key)
        order = rows.sort_by([("side", "ascending"), ("token", "ascending")])
        m, side = order["m"].to_numpy(), np.array(order["side"].to_pylist())
        rng = np.random.default_rng([abs(int(seed)), target, pred, number, *at.encode()])
        size = min(BLOCK, draws - number * BLOCK)
        q = drawn_statistics(m[side == "x"], m[side == "y"], size, rng)
        # The same table drawn again counts, whatever the order of its sum.
        more = int((q >= order["q"][0].as_py() * (1 - 1e-9)).sum())
        return pa.table({"target": pa.array([target], pa.int32()), "at": [at], "pred": pa.array([pred], pa.int32()), "more": pa.array([more], pa.int64())})

    beaten = margins.groupBy("target", "at", "pred", "block").applyInArrow(block, "target int, at string, pred int, more bigint")
    summed = beaten.groupBy("target", "at", "pred").agg(F.sum("more").alias("more"))
    return summed.select(
        "target", F.from_json("at", "array<string>").alias("leaf"), "pred",
        ((F.col("more") + 1) / F.lit(draws + 1)).alias("p_perm"),
    )
