"""Document fingerprints by order MinHash.

The k-mers of a text are numbered by occurrence, so repeats count.  A hash of k-mer
and number deals them to cells; in each cell the two with the smallest hashes are
taken, put back into text order and hashed as a tuple.  Cells agree when the same
k-mers are minimal and stand in the same order, so moving text lowers the likeness
as edits do, where plain MinHash sees the same set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from likeness.llm.common import map_rows, text_of
from likeness.plans.materialise import lookup, store

# Text that a range of ids holds, and ranges at most (their bounds are literals of the plan).
RANGE_BYTES = 32 << 20
MOST_RANGES = 4096
K = 6
CELLS = 64
TAKEN = 2
# Expected candidates per cell that are kept for sorting; a text with a cell that
# gets fewer than TAKEN of them is done again with all its k-mers.
CANDIDATES = 10

_PRIME = 0x9E3779B97F4A7C15
_P, _P2, _P4 = (np.uint64(pow(_PRIME, e, 1 << 64)) for e in (1, 2, 4))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _kmers(text: str) -> np.ndarray:
    """A 64-bit hash of each run of K code points; a shorter text is one run, padded."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(codes) < K:
        codes = np.concatenate([codes, np.zeros(K - len(codes), np.uint64)])
    two = codes[:-1] + codes[1:] * _P
    four = two[:-2] + two[2:] * _P2
    return _mix(four[: len(codes) - K + 1] + two[4 : 4 + len(codes) - K + 1] * _P4)


def _numbered(kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of k-mer and occurrence number, position), sorted by k-mer and position."""
    n = len(kmers)
    low = np.uint64(max(1, n.bit_length()))
    mixed = np.sort(((kmers >> low) << low) | np.arange(n, dtype=np.uint64))
    kmer, position = mixed >> low, (mixed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kmer[1:], kmer[:-1], out=new[1:])
    at = np.arange(n)
    number = at - np.maximum.accumulate(np.where(new, at, 0))
    return _mix(kmers[position] + number.astype(np.uint64) * _P), position


def signature(text: str | None) -> np.ndarray:
    """CELLS numbers of 16 bits; all zero for an empty text."""
    if not text:
        return np.zeros(CELLS, np.uint16)
    kmers = _kmers(text)
    with np.errstate(over="ignore"):
        hashes, position = _numbered(kmers)
        bits = np.uint64(CELLS.bit_length() - 1)
        tried = [CANDIDATES * CELLS / len(hashes), 1.0]
        for share in tried[tried[0] >= 0.5 :]:
            if share < 1:
                chosen = np.flatnonzero((hashes << bits) < np.uint64(share * 2.0**64))
            else:
                chosen = np.arange(len(hashes))
            chosen = chosen[np.argsort(hashes[chosen], kind="stable")]
            cell = (hashes[chosen] >> (np.uint64(64) - bits)).astype(np.int64)
            count = np.bincount(cell, minlength=CELLS)
            if share >= 1 or count.min() >= TAKEN:
                break
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        filled = count > 0
        a = position[chosen[np.minimum(first, len(chosen) - 1)]]
        b = np.where(count > 1, position[chosen[np.minimum(first + 1, len(chosen) - 1)]], a)
        early, late = np.minimum(a, b), np.maximum(a, b)
        tuples = _mix(kmers[early] * _P + _mix(kmers[late]))
        # An empty cell takes the value of the next cell that has one.
        full = np.flatnonzero(filled)
        source = full[np.searchsorted(full, np.arange(CELLS)) % len(full)]
        value = _mix(tuples[source] + ((source - np.arange(CELLS)) % CELLS).astype(np.uint64))
    return ((value >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of cells that agree."""
    return float(np.mean(a == b))


def spelled(sig: np.ndarray) -> str:
    """Four hexadecimal digits for each cell."""
    return sig.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each whole text; NULL is empty."""
    kind = dict(docs.dtypes)[id_col]

    def make(rows: dict[str, list]) -> dict:
        return {
            "doc_id": rows["doc_id"],
            "n_chars": [len(t) for t in rows["text"]],
            "fingerprint": [spelled(signature(t)) for t in rows["text"]],
        }

    chosen = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_rows(chosen, make, f"doc_id {kind}, n_chars bigint, fingerprint string")


def _place(id_col: str) -> Column:
    """What rows are ordered by, downwards: the exact id, NULL as the last, then the text's hash."""
    return F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.col("tie"))


def with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows sorted by descending id inside ranges, each range ending with the next one's first row.

    Columns: range, edge (the added row), n (rows of the same id and text, which are one here),
    doc_id, text.  The ranges hold about RANGE_BYTES of text each and are cut between exact
    (id, hash of the text), so they follow the corpus and no kind of id falls together.
    Only one small row per range is collected.  After the last range comes the first row of all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = _once(rows).withColumn("place", _place("doc_id"))
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    ranges = min(MOST_RANGES, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES))
    keys = rows.select("place").repartitionByRange(int(ranges), "place").withColumn("_bucket", F.spark_partition_id())
    firsts = keys.groupBy("_bucket").agg(F.min("place").alias("place")).orderBy("place")
    cuts = [r["place"] for r in firsts.collect()][1:]
    if cuts:
        kind = rows.schema["doc_id"].dataType
        literal = F.array(
            *[F.struct(F.lit(c["known"]).alias("known"), F.lit(c["id"]).cast(kind).alias("id"), F.lit(c["tie"]).alias("tie")) for c in cuts]
        )
        rows = rows.withColumn("range", -F.size(F.filter(literal, lambda c: c <= F.col("place"))))
    else:
        rows = rows.withColumn("range", F.lit(0))
    tops = rows.groupBy("range").agg(F.max("place").alias("top")).orderBy("range").collect()
    follows = [(r["top"], tops[i - 1]["range"]) for i, r in enumerate(tops)]
    marks = StructType().add("top", rows.schema["place"].dataType).add("before", "integer")
    table = spark.createDataFrame(follows, marks).withColumns({"top_id": F.col("top.id"), "top_tie": F.col("top.tie")}).drop("top")
    at_top = F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("tie") == F.col("top_tie"))
    marked = rows.join(F.broadcast(table), at_top, "left")
    here = F.struct(F.col("range"), F.lit(False).alias("edge"))
    there = F.struct(F.col("before").alias("range"), F.lit(True).alias("edge"))
    dealt = marked.withColumn("_to", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    return (
        dealt.select("_to.range", "_to.edge", "n", "place", "doc_id", "text")
        .repartition(max(1, len(cuts) + 1), "range")
        .sortWithinPartitions("range", "edge", F.desc("place"))
    )


def _once(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, tie) with those of the same id and text as one, and their number ``n``.

    Only the repeated are grouped, and before they are shuffled, so a third of all rows may be one.
    """
    again = rows.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = store(again.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "n"))
    if not again.rows:
        return rows.withColumn("n", F.lit(1).cast("bigint"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
    marked = rows.join(lookup(again.df, again.small), same, "left").drop("_id", "_tie")
    single = marked.filter("n is null").withColumn("n", F.lit(1).cast("bigint"))
    grouped = marked.filter("n is not null").groupBy("doc_id", "tie").agg(F.first("text").alias("text"), F.first("n").alias("n"))
    return single.unionByName(grouped)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  The next document is that of the next
    smaller id (rows of one id in an order of their texts' hashes, NULL ids last), and
    the first again after the last.  A single row follows itself.
    """
    kind = dict(docs.dtypes)[id_col]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = (
        f"times bigint, doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    columns = ["range", "edge", "n", "doc_id", "text"]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for part in parts:
            out = []
            for where, edge, n, doc_id, text in zip(*(part.column(c).to_pylist() for c in columns)):
                sig = signature(text)
                if waiting is not None and waiting[0] == where:
                    out.append((1, *_compared(*waiting[1:], text, sig)))
                waiting = None if edge else (where, doc_id, text, sig)
                if n > 1 and not edge:  # all but the last of its copies are followed by one of them
                    out.append((n - 1, *_compared(*waiting[1:], text, sig)))
            yield pa.RecordBatch.from_pydict(dict(zip(["times", *names], zip(*out) if out else [[]] * (1 + len(names)))), schema=arrow)

    made = with_following(docs, id_col, text_col).select(*columns).mapInArrow(batches, schema)
    return made.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select(*names)


def _compared(doc_id, text: str, sig: np.ndarray, next_text: str, next_sig: np.ndarray) -> tuple:
    new_text = edited(text, next_text)
    new_sig = signature(new_text)
    digest = hashlib.sha256(new_text.encode("utf-8", "surrogatepass")).hexdigest()
    return (
        doc_id,
        len(text),
        digest,
        spelled(sig),
        spelled(new_sig),
        likeness(sig, new_sig),
        likeness(sig, next_sig),
    )
