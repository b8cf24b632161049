"""LM scoring by logistic context mixing.

A text is its lower-case words and an end mark.  Each word is spelled in bits: a
frequent word by its path in a Huffman tree, another by an escape and the Huffman
paths of its bytes.  The bits have probabilities that multiply to a proper
distribution over texts.  For each bit several predictors look counts up under a hash
of their context and the tree node: the node alone, the word before, the one before
that, both; inside a spelled word, up to three bytes before.  Their log odds are
mixed by weights that a gate selects, how much the contexts have seen, and an
adaptive table refines the mix.  The log probabilities of all bits add up to the
text's score.

One pass goes over every training text, whole, in blocks of bits: a task predicts a
block from what it has counted so far, takes an online step of weights and refinement
on the errors, then counts the block.  It emits its tables once, in slices that are
summed per slice, and its weights, which are averaged over all tasks by the bits behind
them.  The number of counters follows the training tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, repeat
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import SLICE_ROWS, map_rows, stored, text_of
from likeness.plans.materialise import keyed_join, store

# Each predictor has a counter for so many training tokens, a power of two of them in
# all, at most 2 ** MAX_TABLE_BITS: a counting worker holds 12 bytes for each, a scoring
# one 6.  More contexts than counters share them, as hashed contexts do.
TOKENS_PER_SLOT = 6
MIN_TABLE_BITS, MAX_TABLE_BITS = 20, 24
# Bounds of a worker's dictionary: words with a path of their own, words sent with counts.
# What all workers hold is bounded by these three; counts of words have no bound.
TREE_WORDS = 1 << 18
SENT_WORDS = 1 << 19
PREDICTORS = 3
SLICE = 1 << 16
# Bits of one online step.
BLOCK = 1 << 14
# Words spelled at a time; a longer text is cut into pieces whose contexts begin anew.
PIECE = 1 << 15
# Input splits that one counting task reads.
JOINED_SPLITS = 4
# Rarer words are spelled, so that the letters of unseen words are learned from them.
TREE_COUNT = 8
# The last of so many most frequent words tells the language a text is in just now.
COMMON = 64

END, ESCAPE = 0, 1
HELD_OUT = (7, 2)


def is_held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 7, is 2; NULL ids count as empty."""
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(HELD_OUT[0])) == HELD_OUT[1]


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# ---------------------------------------------------------------- code trees


def huffman(counts: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Parent and side (0 or 1) of every node of the tree; symbols come first, the root is last."""
    n = len(counts)
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = node
        side[j] = 1
        heapq.heappush(heap, (a + b, node))
    return parent, side


@dataclass
class Code:
    """Concatenated paths: symbol s has steps[start[s]:start[s + 1]], each a node times two plus the bit."""

    start: np.ndarray
    steps: np.ndarray

    @classmethod
    def of(cls, counts: Sequence[int]) -> Code:
        parent, side = huffman(counts)
        n, root = len(counts), 2 * len(counts) - 2
        at, length = np.arange(n), np.zeros(n, np.int64)
        while (below := at != root).any():
            length[below] += 1
            at = np.where(below, parent[at], at)
        start = np.concatenate([[0], np.cumsum(length)])
        steps = np.zeros(start[-1], np.uint32)
        # From the leaves up: every round fills one step of all paths that are not at the root yet.
        at, end, symbols = np.arange(n), start[1:].copy(), np.arange(n)
        while len(symbols := symbols[at[symbols] != root]):
            end[symbols] -= 1
            steps[end[symbols]] = 2 * (parent[at[symbols]] - n) + side[at[symbols]]
            at[symbols] = parent[at[symbols]]
        return cls(start, steps)

    def spell(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of bits of each symbol; node and bit of all bits in order."""
        first = self.start[symbols]
        length = self.start[symbols + 1] - first
        ends = np.cumsum(length)
        at = np.repeat(first - ends + length, length)
        at += np.arange(len(at))
        steps = self.steps[at]
        return length, steps >> np.uint32(1), (steps & np.uint32(1)).astype(np.uint8)


def byte_counts(words: Sequence[bytes]) -> np.ndarray:
    """How often each byte occurs in the words; 32 ends a word.  All are possible."""
    seen = np.ones(256, np.int64)
    for w in words:
        for b in w:
            seen[b] += 1
    seen[32] += len(words)
    return seen


# ------------------------------------------------------------------ contexts

_ODD = tuple(np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _slots(node: np.ndarray, length: np.ndarray, contexts: Sequence[np.ndarray], table_bits: int) -> list[np.ndarray]:
    """The table slot of each bit under each context; ``contexts`` are hashes per symbol of ``length`` bits."""
    own = node * _ODD[0]
    shift = np.uint32(32 - table_bits)
    out = []
    for c in contexts:
        slot = np.repeat(c, length)
        slot ^= own
        slot *= _ODD[1]
        slot >>= shift
        out.append(slot)
    return out


@dataclass
class Bits:
    """Bits in text order: whether they are spelled, their slots per predictor, and where each text begins."""

    spelled: bool
    bit: np.ndarray
    slots: list[np.ndarray]
    start: np.ndarray

    def sums(self, value: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
        return total[np.append(self.start[1:], len(value))] - total[self.start]

    def blocks(self) -> Iterator[slice]:
        return (slice(k, k + BLOCK) for k in range(0, len(self.bit), BLOCK))


class Speller:
    """Turns texts into streams of bits with their contexts' table slots."""

    def __init__(self, words: Sequence[bytes], tree_words: int, tree: Code, letters: Code, table_bits: int):
        """``words`` by falling count; the first ``tree_words`` have paths of their own."""
        self.place = {w: i for i, w in enumerate(words)}
        self.tree_words, self.tree, self.letters, self.table_bits = tree_words, tree, letters, table_bits

    def places(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words in the list (-1: not there), and where each text begins; no end marks."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        found = map(self.place.get, chain.from_iterable(texts), repeat(-1))
        flat = np.fromiter(found, np.int64, int(lengths.sum()))
        return flat, np.cumsum(lengths) - lengths

    def stream(
        self, texts: list[list[bytes]], places: np.ndarray, begins: np.ndarray, ended: np.ndarray | None = None
    ) -> list[Bits]:
        """The bits of the words' paths, and those of spelled words; an end follows where ``ended`` (all)."""
        ended = np.ones(len(texts), bool) if ended is None else ended
        rare = (places < 0) | (places >= self.tree_words)
        ids = np.insert(np.where(rare, ESCAPE, places + 2), np.append(begins[1:], len(places))[ended], END)
        first = begins + np.cumsum(ended) - ended
        prev = np.empty_like(ids)
        prev[1:], prev[first] = ids[:-1], END
        prev2 = np.empty_like(ids)
        prev2[1:], prev2[0] = prev[:-1], END
        prev2[first] = END
        # The last common word before each, END at a text's beginning.
        at = np.arange(len(ids))
        common = (prev < COMMON + 2) & (prev != ESCAPE)
        last = prev[np.maximum.accumulate(np.where(common, at, 0))].astype(np.uint32)
        one, two = prev.astype(np.uint32), prev2.astype(np.uint32)
        language = _scramble(last + np.uint32(1))
        contexts = [language, _scramble(one * _ODD[2] + np.uint32(3)), _scramble(one * _ODD[3] + _scramble(two))]
        lengths, node, bit = self.tree.spell(ids)
        before = np.concatenate([[0], np.cumsum(lengths)])
        parts = [Bits(False, bit, _slots(node, lengths, contexts, self.table_bits), before[first])]
        if rare.any():
            parts.append(self._spelled(texts, rare, begins, language[ids == ESCAPE]))
        return parts

    def _spelled(self, texts, rare, begins, language) -> Bits:
        """Letters of rare words: after the letter before, the two and the three before."""
        words = [w for t, s in zip(texts, begins.tolist()) for w, r in zip(t, rare[s : s + len(t)].tolist()) if r]
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        wide = data.astype(np.uint32) + np.uint32(1)
        back = []
        for k in (1, 2, 3):
            shifted = np.zeros(len(wide), np.uint32)
            shifted[k:] = wide[:-k] if k < len(wide) else 0
            back.append(np.where(place >= k, shifted, np.uint32(0)))
        tongue = np.repeat(language, sizes)
        c1 = _scramble(back[0] * _ODD[2] + (tongue | np.uint32(1)))
        c2 = _scramble(c1 + back[1] * _ODD[3] + np.uint32(11))
        c3 = _scramble((back[0] * np.uint32(257) + back[1]) * np.uint32(257) + back[2] + np.uint32(1 << 30))
        each, node, bit = self.letters.spell(data.astype(np.int64))
        lengths = np.add.reduceat(each, starts)
        per_text = np.add.reduceat(np.append(rare, False), np.minimum(begins, len(rare)))
        per_text[np.append(begins[1:], len(rare)) == begins] = 0
        ends = np.concatenate([[0], np.cumsum(lengths)])
        first = np.cumsum(per_text) - per_text
        return Bits(True, bit, _slots(node ^ np.uint32(1 << 28), each, [c1, c2, c3], self.table_bits), ends[first])


# -------------------------------------------------------------------- mixing

# A counter is kept in 16 bits: up to EXACT zeros and ones exactly, more as one of 1024
# log odds and one of 16 magnitudes.
EXACT = 22
_PAIR = np.full((EXACT + 1, EXACT + 1), 0, np.uint16)
_ZEROS, _ONES = np.meshgrid(np.arange(EXACT + 1), np.arange(EXACT + 1), indexing="ij")
_PAIR[:] = (_ZEROS * (EXACT + 1) + _ONES).astype(np.uint16)
_FIRST = 1024
STRETCH = np.zeros(_FIRST + 16 * 1024, np.float32)
STRETCH[: (EXACT + 1) ** 2] = np.log((_ONES.ravel() + 0.3) / (_ZEROS.ravel() + 0.3))
STRETCH[_FIRST:] = np.tile((np.arange(1024) - 511.5) / 64, 16)
_KNOWN = np.digitize(np.arange(21), [1, 4, 20]).astype(np.uint8)
SEEN = np.full(len(STRETCH), 3, np.uint8)
SEEN[: (EXACT + 1) ** 2] = _KNOWN[np.minimum(_ZEROS + _ONES, 20).ravel()]


def as_cells(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    odds = np.log((ones + 0.3) / (zeros + 0.3))
    step = np.clip(np.rint(odds * 64 + 511.5), 0, 1023)
    size = np.clip(np.log2(zeros + ones + 1.0) - 4, 0, 15).astype(np.int64)
    many = (_FIRST + size * 1024 + step).astype(np.uint16)
    few = (zeros <= EXACT) & (ones <= EXACT)
    return np.where(few, _PAIR[np.minimum(zeros, EXACT), np.minimum(ones, EXACT)], many)


GATES = 2 * 2 * 4 * 4
BUCKETS = 33
_LN2 = float(np.log(2.0))


# Log odds from -8 to 8 in so many steps, for scoring.
STEPS = 2048


def _at(table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Elements at 64-bit indices known to be inside; unlike subscripts, without a test of each."""
    return table.take(index, mode="clip")


def _average(total: np.ndarray, weight: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    return np.where(weight > 0, total / np.maximum(weight, 1e-300), otherwise).astype(np.float32)


class Mixer:
    """Gated weights and the adaptive refinement of their result."""

    def __init__(self):
        self.weights = np.full((PREDICTORS + 1, GATES), 0.4, np.float32)
        self.weights[-1] = 0.0
        self.refined = np.tile(np.linspace(-8, 8, BUCKETS, dtype=np.float32), GATES)
        # Bits behind each weight and cell, and the squares of their steps so far.
        self.bits, self.hits = np.zeros(GATES), np.zeros(GATES * BUCKETS)
        self.moved, self.turned = np.full((PREDICTORS + 1, GATES), 1e-9), np.full(GATES * BUCKETS, 1e-9)

    def _mixed(self, inputs: list[np.ndarray], seen: list[np.ndarray], spelled: bool):
        gate = (seen[0] == 3) * np.uint8(16) + seen[1] * np.uint8(4) + seen[2] + np.uint8(32 * spelled)
        gate = gate.astype(np.int64)
        x = _at(self.weights[PREDICTORS], gate)
        for j in range(PREDICTORS):
            x += _at(self.weights[j], gate) * inputs[j]
        return gate, np.clip(x, -7.99, 7.99, out=x)

    def learn(self, inputs: list[np.ndarray], seen: list[np.ndarray], bit: np.ndarray, spelled: bool, rate=0.02):
        """One online step over a block of bits, each step as long as the steps before allow."""
        gate, x = self._mixed(inputs, seen, spelled)
        place = (x + np.float32(8.0)) * np.float32((BUCKETS - 1) / 16.0)
        low = place.astype(np.int64)
        part = place - low.astype(np.float32)
        low += gate * BUCKETS
        below = _at(self.refined, low)
        final = (below + (_at(self.refined, low + 1) - below) * part + x) * np.float32(0.5)
        error = bit - 1 / (1 + np.exp(-x))
        self.bits += np.bincount(gate, minlength=GATES)
        for j in range(PREDICTORS + 1):
            step = np.bincount(gate, error * inputs[j] if j < PREDICTORS else error, GATES)
            self.moved[j] += step * step
            self.weights[j] += (rate * step / np.sqrt(self.moved[j])).astype(np.float32)
        error = bit - 1 / (1 + np.exp(-final))
        right = error * part
        step = np.bincount(low, error - right, GATES * BUCKETS)
        step[1:] += np.bincount(low, right, GATES * BUCKETS)[:-1]
        much = np.bincount(low, minlength=GATES * BUCKETS)
        self.hits += much
        self.hits[1:] += much[:-1]
        self.turned += step * step
        self.refined += (4 * rate * step / np.sqrt(self.turned)).astype(np.float32)
        np.clip(self.refined, -9, 9, out=self.refined)

    def state(self) -> np.ndarray:
        """Sums that add up over mixers: bits and weighted values of weights, then of refined cells."""
        cells = np.stack([self.hits, self.hits * self.refined])
        return np.concatenate([self.bits, (self.bits * self.weights).ravel(), cells.ravel()])

    @classmethod
    def averaged(cls, state: np.ndarray) -> Mixer:
        """The mixer whose every value is the mean of others, by the bits behind it."""
        out = cls()
        cut = GATES * (PREDICTORS + 2)
        out.bits, sums = state[:GATES], state[GATES:cut].reshape(PREDICTORS + 1, GATES)
        out.hits, cells = state[cut:].reshape(2, GATES * BUCKETS)
        out.weights = _average(sums, out.bits, out.weights)
        out.refined = _average(cells, out.hits, out.refined)
        return out

    def table(self) -> np.ndarray:
        """log2 of the probability of a bit, by (gate, step of the mixed log odds, bit)."""
        x = ((np.arange(STEPS) + 0.5) * (16.0 / STEPS) - 8.0)[None, :]
        place = (x + 8.0) * ((BUCKETS - 1) / 16.0)
        low = place.astype(np.int64)
        rows = self.refined.reshape(GATES, BUCKETS).astype(np.float64)
        below = rows[:, low[0]]
        final = 0.5 * (x + below + (rows[:, low[0] + 1] - below) * (place - low))
        return np.stack([np.logaddexp(0, final), np.logaddexp(0, -final)], axis=2).ravel() / -_LN2

    def log2(self, cells: list[np.ndarray], bit: np.ndarray, spelled: bool, table: np.ndarray) -> np.ndarray:
        """log2 of the probability of each bit of a block."""
        cells = [c.astype(np.int64) for c in cells]
        gate, x = self._mixed([_at(STRETCH, c) for c in cells], [_at(SEEN, c) for c in cells], spelled)
        x += np.float32(8.0)
        x *= np.float32(STEPS / 16.0)
        at = x.astype(np.int64)
        at += gate * STEPS
        at <<= 1
        at |= bit
        return _at(table, at)


@dataclass
class Model:
    """What a scoring task needs."""

    words: list[bytes]
    tree_words: int
    tree: Code
    letters: Code
    tables: np.ndarray
    mixer: Mixer

    def speller(self) -> Speller:
        table_bits = self.tables.shape[1].bit_length() - 1
        return Speller(self.words, self.tree_words, self.tree, self.letters, table_bits)

    def score(self, streams: list[Bits], table: np.ndarray) -> np.ndarray:
        """log2 probability of each text; ``table`` is the mixer's."""
        total = 0.0
        for bits in streams:
            each = np.empty(len(bits.bit))
            for k in bits.blocks():
                cells = [_at(self.tables[j], bits.slots[j][k].astype(np.int64)) for j in range(PREDICTORS)]
                each[k] = self.mixer.log2(cells, bits.bit[k], bits.spelled, table)
            total = total + bits.sums(each)
        return total


class Counter:
    """Counts bits, zeros and ones side by side, and teaches a mixer by what it has counted before.

    A counter that passes HALF is halved before its next block, so 16 bits suffice.
    """

    HALF = 1 << 15

    def __init__(self, table_bits: int):
        self.tables = np.zeros((PREDICTORS, 2 << table_bits), np.uint16)
        self.mixer = Mixer()

    def add(self, bits: Bits) -> None:
        for k in bits.blocks():
            bit, inputs, seen = bits.bit[k], [], []
            for j in range(PREDICTORS):
                slot = bits.slots[j][k].astype(np.int64)
                pair = _at(self.tables[j].view(np.uint32), slot)
                zeros, ones = pair & np.uint32(0xFFFF), pair >> np.uint32(16)
                if (large := pair & np.uint32(self.HALF << 16 | self.HALF)).any():
                    self.tables[j].reshape(-1, 2)[np.unique(slot[large > 0])] >>= 1
                seen.append(_at(_KNOWN, np.minimum(zeros + ones, np.uint32(20)).astype(np.int64)))
                odds = (ones.astype(np.float32) + np.float32(0.3)) / (zeros.astype(np.float32) + np.float32(0.3))
                inputs.append(np.log(odds))
                # Index and addend of these types take numpy's fast path.
                slot <<= 1
                slot |= bit
                np.add.at(self.tables[j], slot, np.uint16(1))
            self.mixer.learn(inputs, seen, bit, bits.spelled)


# --------------------------------------------------------------------- Spark


def _runs(texts: list[str | None]) -> Iterator[tuple[list[int], list[list[bytes]], np.ndarray]]:
    """(numbers of texts, their words, whether their ends follow), of about PIECE words."""
    own, words, ended, size = [], [], [], 0
    for i, text in enumerate(texts):
        split = tokens(text)
        for k in range(0, max(1, len(split)), PIECE):
            own.append(i)
            words.append(split[k : k + PIECE])
            ended.append(k + PIECE >= len(split))
            size += len(words[-1])
            if size >= PIECE:
                yield own, words, np.array(ended)
                own, words, ended, size = [], [], [], 0
    if own:
        yield own, words, np.array(ended)


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): words of all training texts, and one end for each text under the empty word."""
    # All six spaces become one, which splits without a pattern.
    lower = F.translate(text_of("text"), ascii_uppercase + "\t\n\x0b\f\r", ascii_lowercase + " " * 5)
    each = train.select(F.explode(F.split(lower, " ")).alias("word")).filter("word <> ''")
    ends = train.select(F.lit("").alias("word"))
    return each.unionAll(ends).groupBy("word").agg(F.count(F.lit(1)).alias("c"))


def packed(own: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """A slice of counters, either those above 0 with their places or, where that is shorter,
    one byte of each without places and then what is above a byte."""
    at = np.flatnonzero(own)
    over = at[own[at] > 255]
    if 4 * len(at) > len(own) + 4 * len(over):
        yield b"", np.minimum(own, 255).astype(np.uint8).tobytes()
        at, own = over, own - np.minimum(own, 255)
    if len(at):
        yield at.astype(np.uint16).tobytes(), own[at].astype(np.uint16).tobytes()


def add_packed(total: np.ndarray, at: bytes, n: bytes) -> None:
    if at:
        total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint16)
    else:
        total += np.frombuffer(n, np.uint8)


def bit_counts(train: DataFrame, shared, table_bits: int) -> DataFrame:
    """(predictor, part, cells): all tasks' counters, a slice of a table in each row; predictor -1 is the mixer's state."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, counter = Speller(*shared.value, table_bits), Counter(table_bits)
        for part in parts:
            for at in range(0, part.num_rows, SLICE_ROWS):
                for _, words, ended in _runs(part.column("text").slice(at, SLICE_ROWS).to_pylist()):
                    for bits in speller.stream(words, *speller.places(words), ended):
                        counter.add(bits)
        for j in range(PREDICTORS):
            for k in range(0, 2 << table_bits, SLICE):
                for at, n in packed(counter.tables[j, k : k + SLICE]):
                    row = {"predictor": [j], "part": [k // SLICE], "at": [at], "n": [n]}
                    yield pa.RecordBatch.from_pydict(row, schema=sparse)
        state = {"predictor": [-1], "part": [0], "at": [b""], "n": [counter.mixer.state().tobytes()]}
        yield pa.RecordBatch.from_pydict(state, schema=sparse)

    sparse = pa.schema([("predictor", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])
    # Each task emits its tables once, so fewer and longer tasks shuffle less.
    texts = train.select(text_of("text").alias("text"))
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-texts.rdd.getNumPartitions() // JOINED_SPLITS))
    partial = texts.coalesce(tasks).mapInArrow(
        count, "predictor int, part int, at binary, n binary"
    )

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = key[0].as_py() < 0
        total = np.zeros(len(Mixer().state()) if mixer else SLICE, np.float64 if mixer else np.int64)
        for part in parts:
            for at, n in zip(part.column("at").to_pylist(), part.column("n").to_pylist()):
                if mixer:
                    total += np.frombuffer(n)
                else:
                    add_packed(total, at, n)
        cells = total if mixer else as_cells(total[0::2], total[1::2])
        yield pa.RecordBatch.from_pydict(
            {"predictor": [key[0].as_py()], "part": [key[1].as_py()], "cells": [cells.tobytes()]}, schema=dense
        )

    dense = pa.schema([("predictor", pa.int32()), ("part", pa.int32()), ("cells", pa.binary())])
    return partial.groupBy("predictor", "part").applyInArrow(add, "predictor int, part int, cells binary")


def fit(train: DataFrame, counts: DataFrame) -> tuple[Model, np.ndarray]:
    """The model of all training texts (``text``) given their stored word counts, and its words' counts."""
    spark = train.sparkSession
    best = counts.filter("word <> ''").orderBy(F.desc("c"), "word").limit(SENT_WORDS)
    best = best.select(F.encode("word", "UTF-8").alias("word"), "c").toArrow()
    words, sizes = best["word"].to_pylist(), best["c"].to_numpy()
    del best
    tree_words = min(TREE_WORDS, int((sizes >= TREE_COUNT).sum()))
    ends, total = counts.agg(F.sum(F.when(F.col("word") == "", F.col("c"))), F.sum("c")).first()
    rest = (total or 0) - (ends or 0) - int(sizes[:tree_words].sum())
    tree = Code.of([max(1, ends or 0), max(1, rest), *sizes[:tree_words].tolist()])
    letters = Code.of(byte_counts(words[tree_words // 2 : tree_words + 20_000]).tolist())
    wanted = ((total or 0) // TOKENS_PER_SLOT).bit_length() - 1
    table_bits = min(MAX_TABLE_BITS, max(MIN_TABLE_BITS, wanted))
    shared = spark.sparkContext.broadcast((words[:tree_words], tree_words, tree, letters))
    tables, mixer = np.zeros((PREDICTORS, 1 << table_bits), np.uint16), Mixer()
    for row in stored(bit_counts(train, shared, table_bits)).toLocalIterator():
        if row["predictor"] < 0:
            mixer = Mixer.averaged(np.frombuffer(row["cells"]))
            continue
        first = row["part"] * (SLICE // 2)
        tables[row["predictor"], first : first + SLICE // 2] = np.frombuffer(row["cells"], np.uint16)
    model = Model(words, tree_words, tree, letters, tables, mixer)
    return model, np.append(sizes, [ends or 0])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``; learned from all those that are not held out.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram,
    log10), score (the mixture's log10 probability), bits_per_byte (of the words with
    one byte after each).  NULL text is empty: its end mark is scored.  Rows that are
    repeated teach and are scored each time; a NULL id counts as the empty text when rows
    are held out.  Without training texts all counts are 0 and every predictor is even.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    train = rows.filter("not held_out").select("text")
    counted = store(word_counts(train))
    counts = counted.df
    total = int(counts.agg(F.sum("c")).first()[0] or 0)
    model, sizes = fit(train, counts)
    everything = counted.rows <= SENT_WORDS
    shared = spark.sparkContext.broadcast((model, np.log10(sizes + 1.0), sizes > 0))
    base = float(np.log10(total + counted.rows + 1.0))
    kind = dict(docs.dtypes)[id_col]
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
        "n_bytes bigint, others array<string>"
    )
    ready: list = []

    def make(part: dict[str, list]) -> dict:
        if not ready:
            model, log, known = shared.value
            ready.extend((model, model.speller(), model.mixer.table(), log, known))
        model, speller, table, log, known = ready
        n = len(part["text"])
        out = {c: [0] * n for c in ("n_tokens", "n_known", "n_bytes")}
        out |= {c: [0.0] * n for c in ("base_score", "score")} | {"others": [[] for _ in range(n)]}
        for numbers, words, ended in _runs(part["text"]):
            places, begins = speller.places(words)
            scores = model.score(speller.stream(words, places, begins, ended), table) * np.log10(2.0)
            for i, own, first, last, score in zip(numbers, words, begins.tolist(), ended.tolist(), scores.tolist()):
                at = places[first : first + len(own)]
                found = at[at >= 0]
                out["score"][i] += score
                out["n_tokens"][i] += len(own) + last
                out["n_known"][i] += len(found) + int(last and known[-1])
                out["base_score"][i] += float(log[found].sum() + last * log[-1] - (len(own) + last) * base)
                out["n_bytes"][i] += sum(map(len, own)) + len(own) + last
                if not everything:
                    out["others"][i] += [own[k].decode("utf-8", "replace") for k in np.flatnonzero(at < 0).tolist()]
        return {"doc_id": part["doc_id"], "held_out": part["held_out"], **out}

    scored = map_rows(rows, make, schema)
    bits = -F.col("score") / F.lit(float(np.log10(2.0))) / F.col("n_bytes")
    columns = [
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"),
        "base_score", "score", bits.alias("bits_per_byte"),
    ]
    if everything:
        return scored.select(*columns)
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("others").alias("word"))
    found = keyed_join(rare, counts, {"word": "word"}, False, "c", total).filter("c is not null")
    more = found.groupBy("row").agg(F.count(F.lit(1)).alias("k"), F.sum(F.log10(F.col("c") + 1.0)).alias("l"))
    return (
        scored.drop("others")
        .join(more, "row", "left")
        .withColumn("n_known", F.col("n_known") + F.coalesce("k", F.lit(0)))
        .withColumn("base_score", F.col("base_score") + F.coalesce("l", F.lit(0.0)))
        .select(*columns)
    )
