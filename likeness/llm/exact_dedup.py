"""Exact duplicates: immutable snapshots with static filters, screened batch by batch.

A snapshot is a table of distinct text digests, cut into buckets, and one static
binary-fuse filter per bucket that is built once.  An incoming batch is first
grouped on its own; its distinct digests pass the filters, and only those that a
filter claims to know are joined with the snapshot's exact buckets, where whole
texts are compared before a document counts as a copy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import SPACE, smallest_first, stored, text_of
from likeness.plans.materialise import keyed_join, store

# Distinct digests per bucket; a bucket's filter is about 1.3 bytes for each.
BUCKET_KEYS = 1 << 15

# Members of a group that one task compares with the document that stays.
MEMBERS = 2000


def normalised(text: str | Column) -> Column:
    """Each run of ASCII white space becomes one space; NULL is empty."""
    return F.regexp_replace(text_of(text), SPACE, " ")


# ---------------------------------------------------------------- filters


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class FuseFilter:
    """A static three-wise binary-fuse filter with 8-bit fingerprints (false positives: 1/256)."""

    seed: int
    segment: int
    segments: int
    cells: np.ndarray

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int):
        h = _mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        start = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        base = start.astype(np.int64) * segment
        mask = np.uint64(segment - 1)
        places = [
            base + k * segment + ((h >> np.uint64(shift)) & mask).astype(np.int64)
            for k, shift in enumerate((0, 13, 26))
        ]
        return np.stack(places), (_mix(h) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = max(1, len(keys))
        segment = 1 << max(2, min(12, int(np.log2(n) / np.log2(3.33) + 2.25)))
        wanted = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 1
        segments = max(1, -(-wanted // segment))
        for seed in range(1, 200):
            places, prints = cls._slots(keys, seed, segment, segments)
            size = (segments + 2) * segment
            layers = cls._peel(places, size)
            if layers is not None:
                cells = np.zeros(size, np.uint8)
                for ids, at in reversed(layers):
                    others = cells[places[0, ids]] ^ cells[places[1, ids]] ^ cells[places[2, ids]]
                    cells[at] = prints[ids] ^ others ^ cells[at]
                return cls(seed, segment, segments, cells)
            segments += 1 + segments // 8
        raise RuntimeError("no seed peels this key set")

    @staticmethod
    def _peel(places: np.ndarray, size: int):
        """Layers of (key, slot) such that a layer's slots hold no key of later layers."""
        n = places.shape[1]
        ids = np.arange(n, dtype=np.int64)
        count = np.bincount(places.ravel(), minlength=size)
        folded = np.zeros(size, np.int64)
        np.bitwise_xor.at(folded, places.ravel(), np.tile(ids, 3))
        layers, left = [], n
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                return None
            peeled, first = np.unique(folded[single], return_index=True)
            layers.append((peeled, single[first]))
            gone = places[:, peeled].ravel()
            np.subtract.at(count, gone, 1)
            np.bitwise_xor.at(folded, gone, np.tile(peeled, 3))
            left -= len(peeled)
        return layers

    def might_have(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._slots(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return (self.cells[places[0]] ^ self.cells[places[1]] ^ self.cells[places[2]]) == prints


def _key_of(digest: pd.Series) -> np.ndarray:
    """The first 64 bits of hexadecimal digests."""
    return np.array([int(d[:16], 16) for d in digest], dtype=np.uint64)


def _build(keys: pd.DataFrame) -> pd.DataFrame:
    made = FuseFilter.build(_key_of(keys["digest"]))
    return pd.DataFrame(
        {
            "bucket": [keys["bucket"].iloc[0]],
            "seed": [made.seed],
            "segment": [made.segment],
            "segments": [made.segments],
            "cells": [made.cells.tobytes()],
        }
    )


def _screen(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    known = np.zeros(len(incoming), bool)
    if len(incoming):
        keys = _key_of(incoming["digest"])
        for f in filters.itertuples():
            cells = np.frombuffer(f.cells, np.uint8)
            known |= FuseFilter(f.seed, f.segment, f.segments, cells).might_have(keys)
    return pd.DataFrame({"digest": incoming["digest"], "known": known})


# -------------------------------------------------------------- snapshots


@dataclass(frozen=True)
class Snapshot:
    """Immutable: distinct digests (digest, bucket, keep, n) and a filter for each bucket."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the member that stays and the group's size (partial sums before the shuffle)."""
    return rows.groupBy("digest").agg(
        F.min(smallest_first("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("n")
    )


def take_snapshot(groups: DataFrame, buckets: int | None = None) -> Snapshot:
    """Fix a table of groups as a snapshot; the number of buckets follows its measured size."""
    groups = stored(groups)
    buckets = buckets or max(1, -(-groups.count() // BUCKET_KEYS))
    groups = groups.withColumn("bucket", _bucket(buckets))
    filters = groups.select("bucket", "digest").groupBy("bucket").applyInPandas(
        _build, "bucket int, seed int, segment int, segments int, cells binary"
    )
    return Snapshot(groups, stored(filters), buckets)


def screened(snapshot: Snapshot, groups: DataFrame) -> DataFrame:
    """(digest, known) of ``groups``: whether the filters may know it, true for all the snapshot has and about 1 in 256 others."""
    keys = groups.select("digest", _bucket(snapshot.buckets).alias("bucket"))
    return (
        keys.groupBy("bucket")
        .cogroup(snapshot.filters.groupBy("bucket"))
        .applyInPandas(_screen, "digest string, known boolean")
    )


def admit(snapshot: Snapshot, groups: DataFrame) -> DataFrame:
    """Groups of the snapshot and of an incoming batch (grouped before) as one table of groups."""
    # Digests are distinct on both sides.  Stored, so that the filters run once.
    told = stored(groups.join(screened(snapshot, groups), "digest"))
    positive = told.filter("known").select("digest", F.col("keep").alias("new_keep"), F.col("n").alias("new_n"))
    old = snapshot.groups.join(positive, "digest", "left").select(
        "digest",
        F.least("keep", F.coalesce("new_keep", "keep")).alias("keep"),
        (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("n"),
    )
    # What the filters do not know is new; only their false positives are left to the exact join.
    wrong = told.filter("known").join(snapshot.groups, "digest", "left_anti")
    return old.unionByName(told.filter("not known").unionByName(wrong).select("digest", "keep", "n"))


# -------------------------------------------------------------- documents


def sha256_hex(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _grouped_rows(docs, id_col, text_col, batches, hashed) -> tuple[DataFrame, DataFrame, int]:
    """Stored (row, doc_id, digest) and stored groups; ``row`` tells repeated rows apart."""
    rows = store(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            hashed(normalised(text_col)).alias("digest"),
        )
    )
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    groups = grouped(rows.df.filter(batch == 0))
    for b in range(1, batches):
        groups = admit(take_snapshot(groups), grouped(rows.df.filter(batch == b)))
    groups = stored(groups)
    wrong = _unequal(docs, groups, rows.rows, id_col, text_col, hashed).limit(1).collect()
    if wrong:
        raise RuntimeError(f"different texts share the digest {wrong[0]['digest']}: use a longer one")
    return rows.df, groups, rows.rows


def _unequal(docs, groups, total, id_col, text_col, hashed) -> DataFrame:
    """Byte checks: digests of groups with a text that is not that of the member that stays.

    The text that stays is copied once for every ``MEMBERS`` members, and members
    are dealt over these copies, so a group with a third of all rows is compared
    by many tasks.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm")).withColumn(
        "digest", hashed(F.col("norm"))
    )
    several = groups.filter("n > 1").select(
        "digest", "n", F.col("keep.id").alias("keep_id"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("copies")
    )
    # Whole texts are shuffled here, once; the members, a fraction of them, are stored.
    found = keyed_join(norm, several.hint("merge"), {"digest": "digest"}, False, "n", total)
    salt = F.pmod(F.xxhash64("doc_id", "norm"), F.col("copies")).cast("int")
    members = stored(found.filter("n is not null").withColumn("salt", salt).drop("n"))
    stays = (
        members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "copies")
        .agg(F.min("norm").alias("kept_norm"))
        .select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    )
    compared = members.select("digest", "salt", "norm").join(stays, ["digest", "salt"])
    return compared.filter(F.col("norm") != F.col("kept_norm")).select("digest").distinct()


def find_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = 2,
    hashed=sha256_hex,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    Documents arrive in ``batches`` (by a hash of their id): the first becomes a
    snapshot, each later one is screened against the snapshot of all before it.
    NULL texts are empty; NULL ids come last when the smallest id is sought; of
    rows repeated with the same id and text one stays.  Should two texts share a
    digest, the byte check finds them and the call fails: nothing is lost silently.
    """
    rows, groups, total = _grouped_rows(docs, id_col, text_col, batches, hashed)
    found = keyed_join(rows, groups, {"digest": "digest"}, False, "n", total)
    return found.select(
        "doc_id",
        "digest",
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
    )


def drop_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = 2,
    hashed=sha256_hex,
) -> DataFrame:
    """``docs`` without exact copies, all columns kept; of equal texts the smallest id stays."""
    rows, groups, _ = _grouped_rows(docs, id_col, text_col, batches, hashed)
    keep = groups.select(F.col("digest").alias("_digest"), F.col("keep.id").alias("_keep"))
    same = (F.col("_digest") == hashed(normalised(text_col))) & F.col(id_col).eqNullSafe(F.col("_keep"))
    left = docs.join(keep, same, "left_semi")
    # Rows repeated with id and text are rare; only where some exist is the text shuffled again.
    repeated = rows.groupBy("doc_id", "digest").count().filter("count > 1").limit(1).count()
    if repeated:
        left = left.withColumn("_digest", hashed(normalised(text_col)))
        left = left.dropDuplicates([id_col, "_digest"]).drop("_digest")
    return left
