"""Spelling variants: words one edit apart, found by their neighbourhoods in a reduced alphabet.

Characters are hashed to SYMBOLS symbols.  One edit of a word is at most one edit of its
reduced form, so a word's near words are among those whose reduced form is in the full
one-edit neighbourhood of its own: the form itself, all deletions, replacements and
insertions.  Over so few symbols that is some 16 keys a character instead of some 180 over the
letters, each generated once.  Keys meet the reduced vocabulary in an equi-join, and
the original strings decide.

A reduced form is known by a polynomial hash modulo 2^64 whose every edit follows from
the sums before and after the place, so a key costs a few operations however long the
word is.  Forms that share a hash cost a comparison, no result.  Of 150 keys of a word a
dozen are some word's form: a Bloom filter of the reduced vocabulary, of at most
FILTER_BITS, spares the others the shuffle.  A vocabulary too large for it passes more keys.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from likeness.llm.common import SLICE_ROWS, stored, text_of
from likeness.plans.materialise import keyed_join, store

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, DOMINANCE = 5, 3, 2
SYMBOLS = 8
# One run in so many loses a character.
SLIP = 97
# Distinct words a counting task holds, and keys a generating task holds.
HELD = 500_000
KEYS = 1 << 18
# Bits of the filter for each word, up to 16 MB in all.
BITS_A_WORD, FILTER_BITS = 16, 1 << 27
# Longer words travel as numbers until they have met.
LONG = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) per task of a table (doc_id, text): runs of letters, lower-cased, some with a slip."""
    arrow = to_arrow_schema(StructType.fromDDL("word string, n bigint"))

    def sent(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": list(words), "n": list(words.values())}, schema=arrow)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for part in parts:
            for at in range(0, part.num_rows, SLICE_ROWS):
                few = part.slice(at, SLICE_ROWS)
                for doc_id, text in zip(few.column("doc_id").to_pylist(), few.column("text").to_pylist()):
                    # Bytes lower A-Z alone.  The hash differs only by the run, so each distinct run is hashed once.
                    lower = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                    found = Counter(RUN.findall(lower))
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for run, n in found.items():
                        h = zlib.crc32(run.encode(), start)
                        if h % SLIP == 0:
                            place = h % len(run)
                            run = run[:place] + run[place + 1 :]
                        words[run] += n
                if len(words) > HELD:
                    yield sent(words)
                    words = Counter()
        yield sent(words)

    return docs.mapInArrow(batches, "word string, n bigint")


# ----------------------------------------------------------------- neighbours


def symbols(word: str) -> np.ndarray:
    """A symbol from 1 to SYMBOLS for each character, by a hash of the character."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = (codes * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    return mixed % np.uint64(SYMBOLS) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def reduced_key(forms: np.ndarray) -> np.ndarray:
    """Hash of each row of symbols."""
    return _mixed((forms * _powers(forms.shape[1])).sum(axis=1, dtype=np.uint64))


def neighbour_keys(forms: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the reduced forms one edit from each row, for edits at places ``start`` to ``stop``.

    Each form comes once over all places: a character is deleted only at the end of a run of equal ones,
    and none is inserted behind an equal one.  The form itself comes with place 0.
    """
    n, size = forms.shape
    power = _powers(size + 1)
    weighted = forms * power[:size]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(weighted, axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1:]
    rows, keys = [], []

    def add(found: np.ndarray, wanted: np.ndarray) -> None:
        row = np.nonzero(wanted)
        rows.append(row[0])
        keys.append(found[row])

    if start == 0:
        add(whole, np.ones((n, 1), bool))
    inner = slice(start, min(stop, size))
    here, prior = forms[:, inner], before[:, inner]
    if here.shape[1]:
        rest = (whole - before[:, inner.start + 1 : inner.stop + 1]) * _INVERSE
        after = np.concatenate([forms, np.zeros((n, 1), np.uint64)], axis=1)[:, inner.start + 1 : inner.stop + 1]
        add(prior + rest, here != after)
        for symbol in range(1, SYMBOLS + 1):
            other = np.uint64(symbol)
            add(whole - weighted[:, inner] + other * power[inner], here != other)
    spots = slice(start, min(stop, size + 1))
    ahead = np.concatenate([np.zeros((n, 1), np.uint64), forms], axis=1)[:, spots]
    moved = before[:, spots] + (whole - before[:, spots]) * _BASE
    for symbol in range(1, SYMBOLS + 1):
        other = np.uint64(symbol)
        add(moved + other * power[spots], ahead != other)
    return np.concatenate(rows), _mixed(np.concatenate(keys))


def _by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words of one length at a time, as rows of symbols."""
    lengths: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        lengths.setdefault(len(word), []).append(i)
    for size, rows in lengths.items():
        step = max(1, KEYS // max(1, size))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield some, np.stack([symbols(words[i]) for i in some])


def with_reduced(words: DataFrame) -> DataFrame:
    """(word, n, key, ...): adds the hash of each word's reduced form."""
    schema = StructType([*words.schema.fields]).add("key", "long")
    arrow = to_arrow_schema(schema)

    def batches(parts):
        for part in parts:
            key = np.zeros(part.num_rows, np.uint64)
            for rows, forms in _by_length(part.column("word").to_pylist()):
                key[rows] = reduced_key(forms)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key.view(np.int64))], schema=arrow)

    return words.mapInArrow(batches, schema)


def key_filter(reduced: DataFrame, words: int) -> np.ndarray:
    """Bits set at two places of each key of ``reduced``, as 64-bit words; its size follows the number of words."""
    bits = min(FILTER_BITS, max(64, 1 << (BITS_A_WORD * words - 1).bit_length()))
    spots = F.array(F.col("key"), F.shiftrightunsigned("key", 32))
    at = reduced.select(F.explode(spots).alias("at")).select(F.col("at").bitwiseAND(F.lit(bits - 1)).alias("at"))
    set_bits = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")
    )
    found = set_bits.toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for at in (keys, keys >> np.uint64(32)):
        at = at & np.uint64(len(bits) * 64 - 1)
        ok &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def with_neighbours(words: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """(column, key): the hashes of the reduced forms within one edit of each word's, as far as the filter knows them."""
    schema = StructType([words.schema[column]]).add("key", "long")
    arrow = to_arrow_schema(schema)
    shipped = words.sparkSession.sparkContext.broadcast(bits)

    def batches(parts):
        for part in parts:
            named = part.column(column)
            for rows, forms in _by_length(part.column("word").to_pylist()):
                of = np.array(rows)
                each = 2 * SYMBOLS + 1
                step = max(1, KEYS // each // len(rows))
                few = max(1, KEYS // each // step)
                for low in range(0, len(rows), few):
                    for start in range(0, forms.shape[1] + 1, step):
                        row, key = neighbour_keys(forms[low : low + few], start, start + step)
                        some = _passes(key, shipped.value)
                        yield pa.RecordBatch.from_arrays(
                            [named.take(pa.array(of[low + row[some]])), pa.array(key[some].view(np.int64))], schema=arrow
                        )

    return words.mapInArrow(batches, schema)


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): all pairs of ``words`` (word, n) exactly one edit apart, both ways round."""
    one_edit = (F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1)
    short = store(with_reduced(words.filter(F.length("word") <= LONG).select("word", "n")))
    other = short.df.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    found = with_neighbours(short.df, "word", key_filter(short.df, short.rows)).join(other, "key").filter(one_edit)
    found = found.select("word", "other", "other_n")
    long = words.filter(F.length("word") >= LONG).withColumn("id", F.monotonically_increasing_id())
    long = store(with_reduced(stored(long)))
    if long.df.filter(F.length("word") > LONG).limit(1).count():
        looking = with_neighbours(long.df, "id", key_filter(long.df, long.rows))
        met = looking.join(long.df.select("key", F.col("id").alias("other_id")), "key").filter("id <> other_id")
        strings = long.df.select("id", "word")
        others = long.df.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
        both = stored(met.select("id", "other_id")).join(strings, "id").join(others, "other_id")
        both = both.filter((F.greatest(F.length("word"), F.length("other")) > LONG) & one_edit)
        found = found.unionByName(both.select("word", "other", "other_n"))
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form): the end of each chain, by pointer doubling.

    A form has at least twice the count, so there are no rings and a few rounds do.
    """
    at = store(forms.select("word", F.col("form").alias("root")))
    while True:
        heads = at.df.groupBy("root").agg(F.count(F.lit(1)).alias("weight"))
        ahead = at.df.select(F.col("word").alias("head"), F.col("root").alias("next"))
        ahead = ahead.join(heads.withColumnRenamed("root", "head"), "head")
        moved = keyed_join(at.df, ahead, {"root": "head"}, at.small, "weight", at.rows)
        moved = store(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved
        if not moved.df.filter("moved").limit(1).count():
            return moved.df.select("word", "root")
        at = store(moved.df.select("word", "root"))


def group_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the corpus.

    NULL texts have no words, a NULL id counts as '' before the colon, repeated rows count
    each time, and a run of any length is one word.  Of near words with equal counts the
    first in code-point order is the form.  An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    words = store(
        word_counts(texts).groupBy("word").agg(F.sum("n").alias("n"))
        .filter((F.col("n") >= min_count) & (F.length("word") >= min_length))
    )
    near = near_words(words.df).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    named = words.df.join(near, "word", "left")
    strong = -F.col("best.less") >= DOMINANCE * F.col("n")
    named = stored(
        named.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(strong, F.col("best.other")).alias("form"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        )
    )
    ends = roots(named.filter("form is not null").select("word", "form"))
    return named.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
