"""Near duplicates by word shingles: MinHash bands propose pairs, exact Jaccard similarity decides.

SimHash fingerprints within two bits, found by the Golay keys of :mod:`simhash`, propose the
closest pairs.  At a similarity of 0.8 fingerprints differ in about eight bits, and no
key of a 64-bit fingerprint that survives so many errors is selective.  A text's minima
under BANDS x DEPTH permutations are selective: two texts with similarity s share a band
with probability 1 - (1 - s^DEPTH)^BANDS, 0.9996 at 0.8.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.llm import simhash
from likeness.llm.common import map_rows, smallest_first, stored, text_of
from likeness.llm.components import components
from likeness.plans.materialise import Stored, forget_shuffles, keyed_join, lookup, store

BANDS, DEPTH = 20, 5
# The texts of a band key shared by more than this first meet a central one; then only those not yet connected meet,
# by the rarest shingles in which they differ from what most have in common.
HOT_KEY = 16
# Rows of one frequent shingle that meet in one task.
PART_ROWS = 256
# Bounds on whole numbers of shingles allow for rounding of the similarity; the sets decide.
SLACK = 1e-6
_PART = 1 << 12

_draw = np.random.default_rng(42)
_ODD = _draw.integers(0, 1 << 63, BANDS * DEPTH, np.uint64) << np.uint64(1) | np.uint64(1)
_XOR = _draw.integers(0, 1 << 63, BANDS * DEPTH, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-case word shingles; a shorter text is one shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    made = np.full(max(1, len(tokens) - width + 1), width, np.uint64)
    for i in range(width):
        made = _mixed(made * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(made)])
    return np.unique(made)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value under each permutation."""
    least = np.full(BANDS * DEPTH, ~np.uint64(0))
    for at in range(0, len(shingles), _PART):
        part = (shingles[at : at + _PART, None] ^ _XOR) * _ODD
        least = np.minimum(least, part.min(axis=0))
    return least


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band: a hash of the minima of its permutations."""
    return _keys(minima(shingles))


def _keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, DEPTH).T:
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def sketch(least: np.ndarray) -> np.ndarray:
    """A bit of each minimum, as two numbers."""
    bits = np.zeros(128, np.uint8)
    bits[: len(least)] = _mixed(least) & np.uint64(1)
    return np.packbits(bits, bitorder="little").view(np.int64)


def sketch_limit(similarity: float) -> int:
    """Differing bits of a sketch that a pair of this similarity exceeds with probability below 1e-6."""
    n, p = BANDS * DEPTH, (1 - similarity) / 2
    return min(n, math.ceil(n * p + 5 * math.sqrt(n * p * (1 - p))) + 1)


def _with_keys(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, node, n, keys, s0, s1, fp): a hash of the shingle set, its size, band keys, sketch and SimHash."""

    def make(rows: dict[str, list]) -> dict:
        out: dict[str, list] = {"doc_id": rows["doc_id"], "node": [], "n": [], "keys": [], "s0": [], "s1": [], "fp": []}
        for text in rows["text"]:
            found = shingle_set(text, words)
            least = minima(found)
            low, high = sketch(least).tolist()
            out["node"].append(node_of(found))
            out["n"].append(len(found))
            out["keys"].append(_keys(least).view(np.int64))
            out["s0"].append(low)
            out["s1"].append(high)
            out["fp"].append(simhash.fingerprint(text, words))
        out["fp"] = np.array(out["fp"], np.uint64).view(np.int64)
        return out

    kind = dict(docs.dtypes)[id_col]
    chosen = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_rows(chosen, make, f"doc_id {kind}, node bigint, n int, keys array<bigint>, s0 bigint, s1 bigint, fp bigint")


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def _alike(similarity: float) -> Column:
    """Whether the sizes and sketches of sides a and b allow this similarity."""
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - 1e-9
    apart = sum(F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in ("s0", "s1"))
    return near & (apart <= sketch_limit(similarity))


def _side(rows: DataFrame, side: str, *keys: str, more: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(*keys, F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "s0", "s1", *more)])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def pairs_by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs that connect the nodes whose SimHash fingerprints differ in at most two bits, found by Golay keys.

    Nodes of one fingerprint meet the smallest of them.
    """
    prints = store(nodes.groupBy("fp").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("often")))
    total = nodes.count()
    same = keyed_join(nodes.select("fp", F.col("node").alias("a")), prints.df, {"fp": "fp"}, prints.small, "often", total)
    near = stored(simhash.links(prints.df.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb")))
    for side in "ab":
        named = prints.df.select(F.col("fp").alias(f"f{side}"), F.col("b").alias(side))
        near = near.join(named, f"f{side}")
    return _ordered(same).unionByName(_ordered(near))


def banded(nodes: DataFrame) -> DataFrame:
    """(key, sub, node, n, s0, s1, size): a row per node and band key that at least two nodes share.

    Most keys are of one node; they are dropped before sizes and sketches join the rows.
    """
    after = F.concat(F.slice("keys", 2, BANDS - 1), F.slice("keys", 1, 1))
    each = nodes.select("node", F.explode(F.arrays_zip("keys", after.alias("after"))).alias("k"))
    rows = each.select("node", F.col("k.keys").alias("key"), F.xxhash64("k.keys", "k.after").alias("sub"))
    sizes = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    # Hot keys are few; the join with the others is no larger than its rows.
    shared = keyed_join(rows, sizes.df, {"key": "key"}, sizes.small, "size", nodes.count()).filter("size is not null")
    return stored(stored(shared).join(nodes.select("node", "n", "s0", "s1"), "node"))


def pairs_of_cool_keys(rows: DataFrame, similarity: float, hot_key: int) -> DataFrame:
    cool = rows.filter(F.col("size") <= hot_key)
    met = _side(cool, "a", "key").join(_side(cool, "b", "key"), "key").filter((F.col("a") < F.col("b")) & _alike(similarity))
    return met.select("a", "b")


def _majority_sketch(rows: DataFrame, key: str) -> DataFrame:
    """(key, m0, m1): of each bit of a key's sketches the more frequent value."""
    counts = [F.sum(F.shiftright(c, i).bitwiseAND(F.lit(1))).alias(f"{c}_{i}") for c in ("s0", "s1") for i in range(64)]
    summed = rows.groupBy(key).agg(F.count(F.lit(1)).alias("members"), *counts)

    def word(c: str) -> Column:
        bits = [F.when(F.col(f"{c}_{i}") * 2 > F.col("members"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64)]
        return sum(bits[1:], bits[0])

    return summed.filter("members > 1").select(key, "members", word("s0").alias("m0"), word("s1").alias("m1"))


def centres(hot: Stored, key: str) -> Stored:
    """(key, members, b, n_b, s0_b, s1_b): of the nodes of a key the one whose sketch is nearest to the majority of them."""
    middle = store(_majority_sketch(hot.df, key))
    placed = keyed_join(hot.df, middle.df, {key: key}, middle.small, "members", hot.rows).filter("members is not null")
    apart = sum(F.bit_count(F.col(s).bitwiseXOR(F.col(m))) for s, m in (("s0", "m0"), ("s1", "m1")))
    central = placed.groupBy(key).agg(F.min(F.struct(apart.alias("apart"), "node", "n", "s0", "s1")).alias("c"), F.first("members").alias("members"))
    return store(central.select(key, "members", F.col("c.node").alias("b"), *[F.col(f"c.{c}").alias(f"{c}_b") for c in ("n", "s0", "s1")]))


def pairs_with_centres(hot: Stored, central: dict[str, Stored], similarity: float) -> DataFrame:
    """The nodes of hot keys, each with the central ones of the key and of the
    key with the next band beside it: two pairs a row, however large the group is.
    """
    parts = []
    for key, table in central.items():
        met = keyed_join(_side(hot.df, "a", key), table.df, {key: key}, table.small, "members", hot.rows)
        parts.append(_ordered(met.filter(_alike(similarity)).select("a", "b")))
    return parts[0].unionByName(parts[1])


def _busiest_centres(named: DataFrame, similar: DataFrame) -> Stored:
    """(centre, merged) for the central nodes of ``named`` (key, members, centre): the one of most rows among a central
    node and those verified ``similar`` (a, b) to it.
    """
    often = store(named.groupBy("centre").agg(F.sum("members").alias("often")))
    total = int(often.df.agg(F.sum("often")).first()[0] or 0)
    edges = similar.select("a", "b").union(similar.select("b", "a")).union(often.df.select("centre", "centre"))
    for side in "ab":
        table = often.df.select(F.col("centre").alias(f"of_{side}"), F.col("often").alias(f"often_{side}"))
        edges = keyed_join(edges, table, {side: f"of_{side}"}, often.small, f"often_{side}", total).filter(f"often_{side} is not null")
    best = edges.groupBy("a").agg(F.max(F.struct("often_b", "b")).alias("best"), F.first("often_a").alias("often"))
    return store(best.select(F.col("a").alias("centre"), F.col("best.b").alias("merged"), "often"))


def open_nodes(hot: Stored, central: Stored, member: DataFrame, similar: DataFrame) -> Stored:
    """(centre, node, n, s0, s1, at) of hot keys whose nodes are not all connected, by the central node of the key.

    ``member`` has (of, component); ``at`` is the component.  The keys of a group have many central nodes, most of
    them ``similar``; any node may stand for a key's centre, so one of these does, and a node is met about once and
    not once a band.
    """
    rows = stored(hot.df.join(member, F.col("node") == F.col("of"), "left").withColumn("at", F.coalesce("component", "node")))
    mixed = rows.groupBy("key").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low <> high").select("key")
    named = stored(central.df.join(mixed, "key", "left_semi").select("key", "members", F.col("b").alias("centre")))
    busiest = _busiest_centres(named, similar)
    named = keyed_join(named, busiest.df, {"centre": "centre"}, busiest.small, "often", hot.rows)
    named = store(named.select("key", "members", F.col("merged").alias("centre")))
    met = keyed_join(rows.drop("of", "component"), named.df, {"key": "key"}, named.small, "members", hot.rows).filter("centre is not null")
    return store(met.select("centre", "node", "n", "s0", "s1", "at").distinct())


def _deviations(nodes: Stored, sets: ShingleSets, share: float) -> Stored:
    """The nodes with ``apart``, the shingles that just one of a set and its centre's has, and ``excess``, how many more
    they are than ``share`` of the set.
    """
    found = sets.of(nodes.df.select("node").distinct())
    often = nodes.df.groupBy("centre").agg(F.count(F.lit(1)).alias("members"))
    core = found.withColumnsRenamed({"node": "centre", "shingles": "core"}).join(often, "centre")
    beside = keyed_join(nodes.df.join(found, "node"), core, {"centre": "centre"}, False, "members", nodes.rows)
    apart = F.array_union(F.array_except("shingles", "core"), F.array_except("core", "shingles"))
    beside = beside.withColumn("apart", apart).drop("shingles", "core", "members")
    return store(beside.withColumn("excess", F.size("apart") - F.col("n") * share))


def _with_need(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(centre, node, excess, m, need) of the nodes that may be similar to one of another component: ``m`` elements
    they share with some, ``need`` at least with any similar one.

    A similar pair shares at least half the sum of both excesses, so each has as many elements:
    ``m - excess / 2`` of one is at least half the other's excess.  Of those that pass, the least excess gives ``need``;
    ``close`` nodes are connected and need not meet.
    """
    own = elements.groupBy("centre", "node").agg(F.count(F.lit(1)).alias("m"))
    own = nodes.join(own, ["centre", "node"])
    own = store(own.withColumn("level", F.floor(F.col("m") - F.col("excess") / 2 + SLACK)))
    least = own.df.groupBy("centre", "level", "close").agg(F.min("excess").alias("least"), F.count(F.lit(1)).alias("members"))
    steps = least.groupBy("centre").agg(
        F.collect_list(F.struct("level", F.col("close").alias("near"), "least")).alias("steps"), F.sum("members").alias("members")
    )
    beside = keyed_join(own.df, steps, {"centre": "centre"}, False, "members", own.rows)
    passing = F.filter("steps", lambda s: (s["level"] >= F.floor(F.col("excess") / 2 - SLACK)) & ~(s["near"] & F.col("close")))
    need = F.ceil((F.col("excess") + F.array_min(F.transform(passing, lambda s: s["least"]))) / 2 - SLACK)
    beside = beside.withColumn("need", F.when(F.size(passing) > 0, F.greatest(need, F.lit(1))))
    return stored(beside.filter("need <= m").select("centre", "node", "n", "s0", "s1", "excess", "m", "need"))


def pairs_across(
    hot: Stored, central: Stored, member: DataFrame, similar: DataFrame, sets: ShingleSets, similarity: float
) -> DataFrame:
    """Pairs that connect all similar nodes of hot keys that are not yet connected, and few others.

    Two sets of a key differ in elements that just one of them has apart from the key's centre, and are similar if these
    are at most ``share`` of both sizes.  So those whose excesses sum to 0 or less are similar, and so is
    each of them to the node of the least excess: one pair a node connects them, however many there are.  Any other similar
    pair shares so many elements apart from the centre that one is among the rarest ``m - need + 1`` of
    both; what all copies have in common is not compared.  Elements of a single component count for nothing, which the second round takes up for nodes the first left out.
    """
    share = (1 - similarity) / (1 + similarity)
    nodes = _deviations(open_nodes(hot, central, member, similar), sets, share)
    best = nodes.df.groupBy("centre").agg(F.min(F.struct("excess", "node", "at")).alias("best"), F.count(F.lit(1)).alias("members"))
    best = store(best)
    beside = keyed_join(nodes.df, best.df, {"centre": "centre"}, best.small, "members", nodes.rows).drop("members")
    close = F.col("excess") + F.col("best.excess") <= 1e-9
    around = beside.filter(close & (F.col("at") != F.col("best.at"))).select(F.col("node").alias("a"), F.col("best.node").alias("b"))
    beside = beside.withColumns({"at": F.when(close, F.col("best.at")).otherwise(F.col("at")), "close": close})
    nodes = beside.drop("best", "apart")
    elements = store(beside.select("centre", "node", "at", F.explode("apart").alias("shingle")))
    on = ["centre", "shingle"]
    for _ in range(2):
        seen = elements.df.groupBy(*on).agg(F.count(F.lit(1)).alias("often"), F.min("at").alias("low"), F.max("at").alias("high"))
        seen = store(seen.filter("low <> high").drop("low", "high"))
        shared = keyed_join(elements.df, seen.df, dict(zip(on, on)), seen.small, "often", elements.rows).filter("often is not null")
        shared = stored(shared)
        needed = _with_need(nodes.drop("at"), shared)
        elements = store(shared.join(needed.select("centre", "node"), ["centre", "node"], "left_semi").drop("often"))
    order = Window.partitionBy("centre", "node").orderBy("often", "shingle")
    rare = shared.withColumn("rank", F.row_number().over(order)).join(needed, ["centre", "node"])
    rare = stored(rare.filter(F.col("rank") <= F.col("m") - F.col("need") + 1).drop("often", "rank", "need"))
    sizes = rare.groupBy(*on).agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("low"), F.max("at").alias("high"))
    rare = rare.join(sizes.filter("low <> high").drop("low", "high"), on)
    # A frequent element's rows are dealt out by a hash, and each meets every part.
    parts = F.ceil(F.col("size") / PART_ROWS).cast("int")
    left = _side(rare.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")), "a", *on, "part", more=("at", "m", "excess"))
    every = rare.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = _side(every, "b", *on, "part", more=("at", "m", "excess"))
    enough = F.least("m_a", "m_b") >= (F.col("excess_a") + F.col("excess_b")) / 2 - SLACK
    met = left.join(right, [*on, "part"]).filter((F.col("a") < F.col("b")) & (F.col("at_a") != F.col("at_b")) & enough & _alike(similarity))
    return _ordered(around).unionByName(met.select("a", "b").distinct())


class ShingleSets:
    """Shingle sets of nodes in question, by reading the texts of one document of each again."""

    def __init__(self, docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, words: int):
        self.docs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
        self.groups, self.words = groups, words

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) for distinct ``nodes``."""
        wanted = store(self.groups.join(nodes, "node", "left_semi").select(F.col("first.id").alias("_id")).distinct())
        side = lookup(wanted.df, wanted.small)
        texts = self.docs.join(side, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        words = self.words

        def make(part: dict[str, list]) -> dict:
            sets = [shingle_set(t, words) for t in part["text"]]
            return {"node": [node_of(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]}

        made = map_rows(texts.select("text"), make, "node bigint, shingles array<bigint>")
        # Rows that share an id bring other texts along; nodes decide.
        return stored(made.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")))


def verified(pairs: DataFrame, sets: ShingleSets, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have at least this Jaccard similarity, stored."""
    pairs = store(pairs.distinct())
    needed = stored(pairs.df.select(F.col("a").alias("node")).union(pairs.df.select("b")).distinct())
    found = sets.of(needed)
    both = pairs.df
    for side in "ab":
        often = pairs.df.groupBy(side).agg(F.count(F.lit(1)).alias("often")).withColumnRenamed(side, "node")
        named = found.join(often, "node").select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}"), "often")
        both = keyed_join(both, named, {side: side}, False, "often", pairs.rows).drop("often")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - shared
    return stored(both.filter(shared >= union * similarity - 1e-9).select("a", "b"))


def links(nodes: DataFrame, sets: ShingleSets, similarity: float, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b): pairs of similar nodes that connect all those which share a band, and those near by fingerprint.

    Pairs of cool keys are compared all; the nodes of a hot key first with central ones, then with
    those that no link has connected them with so far, if they differ alike from a central one.
    """
    rows = banded(nodes)
    found = pairs_of_cool_keys(rows, similarity, hot_key).unionByName(pairs_by_fingerprint(nodes))
    hot = store(rows.filter(F.col("size") > hot_key))
    if not hot.rows:
        return verified(found, sets, similarity)
    central = {key: centres(hot, key) for key in ("key", "sub")}
    first = verified(found.unionByName(pairs_with_centres(hot, central, similarity)), sets, similarity)
    member = components(first, "a", "b").withColumnRenamed("node", "of")
    # Plans and shuffles of the steps so far would stay until the driver happens to collect its garbage.
    forget_shuffles(nodes.sparkSession)
    rest = store(pairs_across(hot, central["key"], member, first, sets, similarity))
    forget_shuffles(nodes.sparkSession)
    return first.unionByName(verified(rest.df, sets, similarity)) if rest.rows else first


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    hot_key: int = HOT_KEY,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (the smallest id reachable by similar pairs).

    NULL and wordless texts have one shingle in common.  NULL ids come last when the
    smallest is sought.  ``docs`` is read twice, so it should be a stored table.
    """
    rows = store(_with_keys(docs, id_col, text_col, words))
    groups = stored(
        rows.df.groupBy("node").agg(
            F.min(smallest_first("doc_id")).alias("first"),
            F.count(F.lit(1)).alias("rows"),
            *[F.first(c).alias(c) for c in ("n", "keys", "s0", "s1")],
            F.min("fp").alias("fp"),
        )
    )
    sets = ShingleSets(docs, groups, id_col, text_col, words)
    found = links(groups, sets, similarity, hot_key)
    member = components(found, "a", "b").withColumnRenamed("node", "of")
    named = groups.join(member, F.col("node") == F.col("of"), "left").select(
        "node", "first", "rows", F.coalesce("component", "node").alias("component")
    )
    named = store(named)
    lead = named.df.groupBy("component").agg(F.min("first").alias("lead"), F.count(F.lit(1)).alias("members"))
    placed = keyed_join(named.df, lead, {"component": "component"}, False, "members", named.rows).select(
        "node", "rows", F.col("lead.id").alias("component_id")
    )
    found = keyed_join(rows.df.select("doc_id", "node"), placed, {"node": "node"}, False, "rows", rows.rows)
    return found.select("doc_id", "component_id")
