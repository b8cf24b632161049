"""Source divergence audit: how far each source's use of terms is from every other source of its language.

Arrow computes the term counts of a task's texts (lower-casing, splitting, dictionary codes and
hash aggregation, no Python strings); Spark sums them.  The counts of the terms a language keeps
are then dealt into columnar shards of terms, each holding every source's count of its
terms as one integer matrix; a shard gives one partial sum per pair of sources and its ten
farthest terms per source, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from likeness.llm.common import stored, text_of
from likeness.plans.materialise import keyed_join, store

# What separates terms: all ASCII characters but letters.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
TOP = 10
# Characters of text that Arrow splits at a time, and distinct counts a task holds before it sends them on.
SPLIT_CHARS = 4 << 20
HELD = 400_000
# Terms in a shard times sources of its language.
SHARD_CELLS = 1 << 18
SCALE = 1_000_000_000

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with few characters each; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SPLIT_CHARS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _term_counts(batch: pa.RecordBatch) -> pa.Table:
    """(group, term, n, docs) of a few texts; ``group`` is the dictionary code of (lang, source)."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), GAP)
    terms, doc = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
    real = pc.greater(pc.binary_length(terms), 0)
    codes = pc.dictionary_encode(terms.filter(real))
    each = pa.table({"doc": doc.filter(real), "code": codes.indices})
    in_doc = each.group_by(["doc", "code"]).aggregate([([], "count_all")])
    of = pc.take(batch.column("group"), in_doc["doc"])
    found = pa.table({"group": of, "code": in_doc["code"], "n": in_doc["count_all"]})
    found = found.group_by(["group", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    return pa.table(
        {
            "group": found["group"],
            "term": pc.take(codes.dictionary, found["code"].combine_chunks()),
            "n": found["n_sum"],
            "docs": found["count_all"],
        }
    )


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) per task of a table (lang, source, text), none of it NULL.

    Each (lang, source) also has a row without term, so that groups without any term are known.
    """
    arrow = to_arrow_schema(StructType.fromDDL(_COUNTS))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            both = pa.concat_tables(held).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            return both.rename_columns(["group", "term", "n", "docs"])

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            sent = pa.table(
                [pc.take(langs, table["group"]), pc.take(sources, table["group"]), table["term"], table["n"], table["docs"]],
                schema=arrow,
            )
            yield from sent.combine_chunks().to_batches(max_chunksize=50_000)

        for part in parts:
            for few in _slices(part):
                names = zip(few.column("lang").to_pylist(), few.column("source").to_pylist())
                codes = pa.array([groups.setdefault(g, len(groups)) for g in names], pa.int32())
                held.append(_term_counts(pa.record_batch([few.column("text"), codes], ["text", "group"])))
                if sum(map(len, held)) > HELD:
                    held = [merged()]
                    if len(held[0]) > HELD // 2:
                        yield from out(held[0])
                        held = []
        if held:
            yield from out(merged())
        none = pa.nulls(len(groups), pa.string())
        zero = pa.array([0] * len(groups), pa.int64())
        empty = pa.table({"group": pa.array(range(len(groups)), pa.int32()), "term": none, "n": zero, "docs": zero})
        yield from out(empty)

    return docs.select("lang", "source", "text").mapInArrow(batches, _COUNTS)


# -------------------------------------------------------------- exact shares


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (count + 2) / total) without overflow: long division by thousands.

    Exact for totals below 9e15.
    """
    rest = counts + 2
    found = rest // totals * SCALE
    rest = rest % totals
    for power in (1_000_000, 1_000, 1):
        rest = rest * 1_000
        found += rest // totals * power
        rest = rest % totals
    return found + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); both are at most 1e9 + 1, so the square fits."""
    return (p - q) ** 2 // (p + q)


def _shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Partial sums of every pair of sources, and each source's farthest terms, of one shard."""
    lang = key[0].as_py()
    marks = table.filter(pc.is_null(table["term"]))
    rows = table.filter(pc.is_valid(table["term"]))
    names = sorted({s for s in marks["source"].to_pylist() if s is not None}, key=lambda s: s.encode())
    place = {s: i for i, s in enumerate(names)}
    total = np.ones(len(names) + 1, np.int64)
    for s, t in zip(marks["source"].to_pylist(), marks["n"].to_pylist()):
        total[len(names) if s is None else place[s]] = t
    terms = sorted(rows["term"].unique().to_pylist(), key=lambda t: t.encode())
    at = pc.index_in(rows["term"], pa.array(terms, pa.string())).to_numpy()
    of = np.array([place[s] for s in rows["source"].to_pylist()], np.int64)
    counts = np.zeros((len(names) + 1, len(terms)), np.int64)
    np.add.at(counts, (of, at), rows["n"].to_numpy())
    counts[-1] = counts[:-1].sum(axis=0)
    # A language that keeps no term has totals of 0, and nothing to divide.
    p = shares(counts, np.maximum(total, 1)[:, None])
    out: dict[str, list] = {"lang": [], "source": [], "part": [], "item": [], "value": []}

    def add(source: str, part: str, items: list[str], values: np.ndarray) -> None:
        n = len(items)
        for name, column in (("lang", [lang] * n), ("source", [source] * n), ("part", [part] * n), ("item", items), ("value", values.tolist())):
            out[name].extend(column)

    for i, source in enumerate(names):
        sums = gaps(p[i], p[:-1]).sum(axis=1)
        add(source, "pair", [s for j, s in enumerate(names) if j != i], np.delete(sums, i))
        far = np.flatnonzero((counts[i] > 0) & (p[i] > p[-1]))
        values = gaps(p[i, far], p[-1, far])
        best = np.argsort(-values, kind="stable")[:TOP]
        add(source, "term", [terms[j] for j in far[best]], values[best])
    return pa.table(out, schema=pa.schema([(k, pa.int64() if k == "value" else pa.string()) for k in out]))


_PARTS = "lang string, source string, part string, item string, value bigint"


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of sources and the terms that make it.

    NULL texts, languages and sources count as ''.  Repeated rows count each time.  Part
    ``pair`` has every other source of the language, part ``term`` the ten farthest of the
    source's own terms.  An empty table gives no rows; other columns are not read.
    """
    texts = docs.select(
        text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text")
    )
    counts = stored(
        partial_counts(texts).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    kept = stored(
        counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_docs).select("lang", "term")
    )
    rows = stored(
        counts.filter("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"], "left_semi")
    )
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = counts.filter("term is null").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(size, "lang", "left").select(
        "lang",
        F.coalesce("v", F.lit(0)).alias("v"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) * (F.col("sources") + 1) / SHARD_CELLS)).cast("int").alias("shards"),
    )
    langs = store(langs)
    used = rows.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    per = groups.join(used, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    whole = per.groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("source"), "n")
    heads = langs.df.select("lang", "v", "shards")
    # Each shard also gets every group's total (and the language's), as rows without term.
    marks = per.unionByName(whole).join(heads, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source",
        F.lit(None).cast("string").alias("term"), (F.col("n") + 2 * F.col("v")).alias("n"),
    )
    dealt = keyed_join(rows, langs.df.select("lang", "shards"), {"lang": "lang"}, langs.small).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term", "n"
    )
    parts = dealt.unionByName(marks).groupBy("lang", "shard").applyInArrow(_shard, _PARTS)
    merged = stored(parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    order = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    ranked = merged.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= TOP)).select(
        "lang", "source", "part", "item", "value", "rank"
    )
