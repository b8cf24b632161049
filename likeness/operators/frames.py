"""Frame layer: schema checks, tokens, samples, splits and stacking."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.functions.draws import TWO_52, hash_hex
from likeness.functions.ordering import beside_rank, first_n
from likeness.functions.packing import joined_texts, split_texts

MISSING = "__MISSING__"


def assert_features(df: DataFrame, features: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """Columns must equal ``features`` in the same order (``ignore`` names id columns)."""
    got = [c for c in df.columns if c not in set(ignore)]
    wanted = list(features)
    if got != wanted:
        missing, extra = [c for c in wanted if c not in got], [c for c in got if c not in wanted]
        if missing or extra:
            raise ValueError(f"the table lacks the columns {missing} and has {extra} beside the features")
        place = next(i for i, (a, b) in enumerate(zip(got, wanted)) if a != b)
        raise ValueError(f"column {place} is {got[place]!r} where the features have {wanted[place]!r}; reorder with select()")
    return df


def resolve_features(features=None, model=None, real: DataFrame | None = None, ignore=()) -> list[str]:
    """Explicit list, else the model's, else the real table's columns."""
    if features is not None:
        return list(features)
    if model is not None:
        return list(model.features)
    if real is not None:
        return [c for c in real.columns if c not in set(ignore)]
    raise ValueError("no features: pass a list, a model or a real table")


def project_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *features)


def drop_ids(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.drop(*ids)


def rename_prefix(df: DataFrame, prefix: str = "x", keep: Sequence[str] = ()) -> DataFrame:
    """Positional names ``x0, x1, ...``; ``keep`` columns retain theirs."""
    free = [c for c in df.columns if c not in set(keep)]
    names = {c: f"{prefix}{i}" for i, c in enumerate(free)}
    return df.withColumnsRenamed(names)


def rename_like(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.toDF(*other.columns)


def round_to_int(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Half-to-even rounding, then the integer as a token."""
    return df.withColumns(
        {c: F.bround(F.col(c).cast("double"), 0).cast("bigint").cast("string") for c in columns}
    )


def token(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("string")


def tokenise(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Every feature as a string token; NULL becomes the missing symbol ``''``."""
    return df.select(*keep, *[F.coalesce(token(c), F.lit("")).alias(c) for c in features])


def pack(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), out: str = "toks") -> DataFrame:
    return tokenise(df, features, keep).select(*keep, F.array(*features).alias(out))


def normalise_missing(
    df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), missing: str = MISSING
) -> DataFrame:
    return df.select(
        *keep, *[F.coalesce(F.nullif(token(c), F.lit("")), F.lit(missing)).alias(c) for c in features]
    )


def head_tail_split(df: DataFrame, n: int, order: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """First ``n`` rows in ``order`` (a unique numeric column), and the rest.

    Both sides are plain scans filtered by one scalar, so neither needs a join.  Rows
    without an order value are never among the first.
    """
    edge = first_n(df.select(order), F.col(order), [order], n).agg(F.max(order).alias("m")).scalar()
    head = df.filter(F.col(order) <= edge)
    return head, df.filter(F.coalesce(F.col(order) > edge, F.lit(True)))


def sample_n(df: DataFrame, n: int, seed=0, id_col: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows if fewer), layout-independent."""
    h = hash_hex(seed, "sample", id_col)
    key = F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(TWO_52)
    return first_n(df, key, [id_col], n)


def balanced_sample(
    real: DataFrame,
    synth: DataFrame,
    max_rows: int | None,
    seed=0,
    id_col: str = "row_id",
    equal: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Cap both sides; ``equal`` also cuts both to the smaller side."""
    if max_rows is None:
        return real, synth
    n_real = n_synth = max_rows
    if equal:
        n_real = n_synth = min(real.count(), synth.count(), max_rows)
    return sample_n(real, n_real, seed, id_col), sample_n(synth, n_synth, seed, id_col)


def label_union(
    datasets: Mapping[str, DataFrame], features: Sequence[str], keep: Sequence[str] = ("row_id",), out="dataset"
) -> DataFrame:
    """Stack tables under a label; duplicates stay (UNION ALL)."""
    stacked = None
    for name, df in datasets.items():
        part = df.select(F.lit(name).alias(out), *[token(k).alias(k) for k in keep], *features)
        stacked = part if stacked is None else stacked.unionByName(part)
    if stacked is None:
        raise ValueError("no datasets to stack")
    return stacked


def discretise(df: DataFrame, widths: Mapping[str, float]) -> DataFrame:
    """Fixed-width bands as integer tokens."""
    return df.withColumns(
        {c: F.floor(F.col(c) / F.lit(float(w))).cast("bigint").cast("string") for c, w in widths.items()}
    )


def quantile_edges(df: DataFrame, columns: Sequence[str], bands: int, error: float = 1e-3) -> dict[str, list[float]]:
    """Band edges fitted once on real data; reuse them on the synthetic side."""
    probs = [i / bands for i in range(1, bands)]
    cuts = df.approxQuantile(list(columns), probs, error)
    return {c: sorted(set(q)) for c, q in zip(columns, cuts)}


def discretise_by_edges(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Band index = number of edges at or below the value; NULL stays NULL."""
    out = {}
    for c, cuts in edges.items():
        passed = sum((F.when(F.col(c) >= F.lit(float(e)), 1).otherwise(0) for e in cuts), F.lit(0))
        out[c] = F.when(F.col(c).isNotNull(), passed.cast("string"))
    return df.withColumns(out)


def from_rows(
    spark: SparkSession, rows: Iterable[Sequence] | DataFrame, features: Sequence[str], array_col: str = "toks"
) -> DataFrame:
    """Array-like rows to named columns, each row checked for its width.

    A DataFrame with an array column is unpacked in place on the executors; a
    local iterable is for small inputs only.
    """
    n = len(features)
    if isinstance(rows, DataFrame):
        wrong = F.raise_error(F.concat(F.lit(f"expected width {n}, got "), F.size(array_col).cast("string")))
        checked = rows.withColumn(array_col, F.when(F.size(array_col) == n, F.col(array_col)).otherwise(wrong))
        keep = [c for c in rows.columns if c != array_col]
        return checked.select(*keep, *[F.col(array_col)[i].alias(f) for i, f in enumerate(features)])
    listed = [tuple(None if v is None else str(v) for v in r) for r in rows]
    for r in listed:
        if len(r) != n:
            raise ValueError(f"expected rows of width {n}, got {len(r)}")
    return spark.createDataFrame(listed, T.StructType([T.StructField(f, T.StringType()) for f in features]))


def permute_column(df: DataFrame, column: str, seed="s", id_col: str = "row_id") -> DataFrame:
    """Replace one column by its value in the row at the same rank of another hash order.

    Keeps every marginal and breaks the dependence.
    """
    return permute_columns(df, [column], seed, id_col)


def permute_columns(df: DataFrame, columns: Sequence[str], seed="s", id_col: str = "row_id") -> DataFrame:
    """As :func:`permute_column` for several columns, which move together."""
    columns = list(columns)
    kinds = {f.name: f.dataType for f in df.schema if f.name != id_col}
    moved, kept = ([c for c, kind in kinds.items() if isinstance(kind, T.StringType) and (c in columns) == m] for m in (True, False))
    more = [c for c in columns if c not in moved]
    rows = df.select(*[c for c in df.columns if c not in (*kept, *columns)], joined_texts([F.col(c) for c in kept]).alias("_texts"))
    others = F.struct(*more) if more else F.lit(None).cast("int")
    values = df.select(id_col, joined_texts([F.col(c) for c in moved]).alias("_value"), others.alias("_more"))
    met = beside_rank(rows, id_col, values, seed, ("to", "from"))
    back = dict(zip([*kept, *moved], split_texts(F.col("_texts"), len(kept)) + split_texts(F.col("_value"), len(moved))))
    back |= {c: F.col("_more").getField(c) for c in more}
    return met.select(*[back.get(c, F.col(c)).alias(c) for c in df.columns])
