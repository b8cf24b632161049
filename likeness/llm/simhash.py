"""Near duplicates by SimHash; Golay codewords near a fingerprint's segments are the join keys.

A 64-bit fingerprint is cut into A (23 bits), B (23 bits) and C (18 bits).  Two
fingerprints that differ in at most two bits have errors (a, b, c), a + b + c <= 2,
so one of these holds: A equal and b <= 1; B equal and a <= 1; C equal and a <= 1;
C equal and b <= 1.  Each case is one key family: the equal segment beside a
codeword of the (23, 12) Golay code near the other.  The code is perfect with
radius 3, so a segment has one codeword within 3, which is also within 4 of any
segment one bit away; a fingerprint therefore emits its nearest codeword once and
is found under all codewords within 4, five on average.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import map_rows, smallest_first, stored, text_of
from likeness.llm.components import components
from likeness.plans.materialise import keyed_join, store

# Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEED = 42
DISTANCE = 2

# A key shared by more distinct fingerprints than this goes by midpoints instead of pairs.
HOT_KEY = 64


# ------------------------------------------------------------ fingerprints


def fingerprint(text: str | None, words: int = 3) -> int:
    """The majority of each bit over the hashes of all word shingles; 0 for a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) >= words else [b" ".join(tokens)]
    return _majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    on = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(doc_id, fp): a signed 64-bit SimHash of each whole text."""

    def make(rows: dict[str, list]) -> dict:
        prints = np.array([fingerprint(t, words) for t in rows["text"]], dtype=np.uint64)
        return {"doc_id": rows["doc_id"], "fp": prints.view(np.int64)}

    kind = dict(docs.dtypes)[id_col]
    chosen = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_rows(chosen, make, f"doc_id {kind}, fp bigint")


# -------------------------------------------------------------- Golay keys


def _remainder(value: np.ndarray) -> np.ndarray:
    """The 11-bit syndrome: the remainder of a 23-bit word modulo the generator."""
    value = value.copy()
    for bit in range(22, 10, -1):
        value ^= np.where((value >> bit) & 1, GENERATOR << (bit - 11), 0)
    return value


@cache
def _cosets() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, the error patterns of weight at most 4, lightest first, and their weights (-1: none)."""
    errors = [sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)]
    patterns = np.array(errors, dtype=np.int64)
    syndromes = _remainder(patterns)
    most = int(np.bincount(syndromes).max())
    table = np.zeros((1 << 11, most), np.int64)
    weight = np.full((1 << 11, most), -1, np.int8)
    filled = np.zeros(1 << 11, np.int64)
    for e, s in zip(patterns, syndromes):
        table[s, filled[s]] = e
        weight[s, filled[s]] = int(e).bit_count()
        filled[s] += 1
    return table, weight


def near_codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of all codewords within 4 of each 23-bit segment, and their distances (-1: none)."""
    table, weight = _cosets()
    s = _remainder(segment)
    return (segment[:, None] ^ table[s]) >> 11, weight[s]


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``prints``, key, nearest) for all four families."""
    fp = prints.astype(np.uint64)
    a = (fp & np.uint64((1 << 23) - 1)).astype(np.int64)
    b = ((fp >> np.uint64(23)) & np.uint64((1 << 23) - 1)).astype(np.int64)
    c = (fp >> np.uint64(46)).astype(np.int64)
    near_a, far_a = near_codewords(a)
    near_b, far_b = near_codewords(b)
    rows, keys, nearest = [], [], []
    for family, (equal, codes, distance) in enumerate(
        ((a, near_b, far_b), (b, near_a, far_a), (c, near_a, far_a), (c, near_b, far_b))
    ):
        row, at = np.nonzero(distance >= 0)
        rows.append(row)
        keys.append((family << 40) | (equal[row] << 12) | codes[row, at])
        nearest.append(distance[row, at] <= 3)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(nearest)


def with_keys(prints: DataFrame) -> DataFrame:
    """(fp, key, nearest) of distinct fingerprints."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy(np.int64)
            row, key, nearest = golay_keys(fp.view(np.uint64))
            yield pd.DataFrame({"fp": fp[row], "key": key, "nearest": nearest})

    return prints.mapInPandas(batches, "fp bigint, key bigint, nearest boolean")


# -------------------------------------------------------------------- links


def links(prints: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that connect all those within ``DISTANCE`` bits.

    Keys with few fingerprints are joined and verified pair by pair.  The
    fingerprints of a key with more than ``hot_key`` meet in midpoints instead: two
    differ in at most two bits exactly when some value is within one bit of both.
    Each midpoint links its fingerprints to its smallest, so a dense group costs 65
    rows per fingerprint however large it is, and no link is lost.
    """
    keys = stored(with_keys(prints))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = stored(sizes)
    cool = keys.join(sizes.filter(F.col("n") <= hot_key), "key", "left_semi")
    left = cool.filter("nearest").select("key", F.col("fp").alias("a"))
    right = cool.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").filter(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    )
    hot = keys.join(sizes.filter(F.col("n") > hot_key), "key", "left_semi").select("fp").distinct()
    return pairs.select("a", "b").unionByName(_by_midpoint(hot)).distinct()


def _by_midpoint(prints: DataFrame) -> DataFrame:
    around = prints.select(
        F.col("fp").alias("b"),
        F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("mid"),
    )
    least = around.groupBy("mid").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return around.join(least, "mid").filter("a <> b").select("a", "b")


# ---------------------------------------------------------------- documents


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    hot_key: int = HOT_KEY,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest id reachable by links).

    NULL and wordless texts have fingerprint 0 and link like any other.  NULL ids
    come last when the smallest is sought.
    """
    rows = store(with_fingerprints(docs, id_col, text_col, words))
    groups = stored(
        rows.df.groupBy("fp").agg(F.min(smallest_first("doc_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    )
    member = components(links(groups.select("fp"), hot_key), "a", "b")
    named = groups.join(member, groups["fp"] == member["node"], "left").select(
        "fp", "first", "n", F.coalesce("component", "fp").alias("component")
    )
    named = store(named)
    lead = named.df.groupBy("component").agg(
        F.min("first").alias("lead"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("members")
    )
    placed = keyed_join(named.df, lead, {"component": "component"}, False, "members", named.rows).select(
        "fp", "n", F.col("lead.id").alias("component_id"), "size"
    )
    found = keyed_join(rows.df, placed, {"fp": "fp"}, False, "n", rows.rows)
    return found.select("doc_id", "fp", "component_id", F.col("size").alias("component_size"))


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    similarity: float | None = None,
) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id; all columns kept.

    Links are fingerprints within ``DISTANCE`` bits or, with a ``similarity``, texts whose
    word shingles have at least that Jaccard similarity: those fingerprints propose pairs, and MinHash
    bands the pairs further apart.  Of rows that repeat this id one stays.
    """
    if similarity is None:
        found = near_duplicates(docs, id_col, text_col, words)
    else:
        from likeness.llm.shingles import similar_documents  # it builds on this module

        found = similar_documents(docs, id_col, text_col, words, similarity)
    ids = stored(found.select("doc_id", "component_id"))
    keep = ids.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").count()
    keep = stored(keep.select(F.col("doc_id").alias("_keep"), "count"))
    left = docs.join(keep.select("_keep"), F.col(id_col).eqNullSafe(F.col("_keep")), "left_semi")
    if keep.filter("count > 1").limit(1).count():
        left = left.dropDuplicates([id_col])
    return left
