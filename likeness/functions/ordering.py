"""Exact ranks, running totals and quantiles without a one-task global sort.

A window over a whole table, or over one of two strata, puts an unbounded
group into one task.  Each helper here cuts the order into buckets that are a
function of the key alone, sums the buckets (a partial aggregation), and adds
each bucket's offset to a window that only spans one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from likeness.functions.draws import as_col, hash_hex
from likeness.functions.packing import long_key, short_key
from likeness.plans.materialise import store

# Up to this many rows `orderBy().limit()` keeps a bounded heap per task.
TOP_N_ROWS = 100_000

_SCALE = 1024


def running_total(
    df: DataFrame,
    bucket: str,
    order: Sequence,
    value: str,
    out: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the same ``by`` group.

    ``bucket`` must be monotone in ``order``; ``bucket`` and ``by`` must not be null.
    """
    by = list(by)
    sizes = df.groupBy(*by, bucket).agg(F.sum(value).alias("_size"))
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        local.join(offsets, [*by, bucket])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside")
    )


def hash_rank(
    df: DataFrame,
    id_col: str,
    seed,
    name: str,
    out: str = "rank",
    by: Sequence[str] = (),
    digits: int = 4,
) -> DataFrame:
    """1-based rank in ``md5(seed|name|id)`` order inside each ``by`` group.

    The first ``digits`` hex digits are the bucket, so buckets are even and no
    key can be hot; the offsets table has at most ``16**digits`` rows per group.
    The shuffle carries the bucket alone: the hash is computed again where the rows arrive.
    """
    by = list(by)
    digest = hash_hex(seed, name, id_col)
    keyed = df.withColumn("_bucket", hash_bucket(digest, digits))
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*by, "_bucket").orderBy("_hash", id_col)
    local = keyed.repartition(*by, "_bucket").withColumn("_hash", digest)
    local = local.withColumn("_inside", F.row_number().over(inside)).drop("_hash")
    ranked = local.join(offsets, [*by, "_bucket"]).withColumn(out, F.col("_offset") + F.col("_inside"))
    return ranked.select(*df.columns, out)


def hash_bucket(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def bucket_offsets(buckets: DataFrame) -> DataFrame:
    """(_bucket, _size, _offset): rows of each ``_bucket`` and of those before it."""
    sizes = buckets.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size")).filter("_bucket is not null")
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))


def beside_rank(
    rows: DataFrame, id_col: str, values: DataFrame, seed, names: tuple[str, str], digits: int = 4
) -> DataFrame:
    """``rows`` with ``_value`` and ``_more``: those of the row of ``values`` at the same rank of another hash order.

    The orders are those of :func:`hash_rank` under the two ``names``; both sides have the same ids.  ``values`` has
    the id, a text ``_value`` and a struct ``_more``, ``rows`` the id and any columns, one of them the text ``_texts``.
    A rank names a bucket of the first order and a place in it, so the values go to
    where the rows are sorted and the rows are shuffled once.
    """
    to, at = (hash_hex(seed, name, id_col) for name in names)
    # The rest of the hash orders as the hash and its id do; it and the text are one value, of fewer bytes.
    rest = 16 - digits // 2
    tied = F.concat(F.unhex(F.substring(at, 2 * (digits // 2) + 1, 2 * rest)), F.col("_value").cast("binary"))
    keyed = values.select(hash_bucket(at, digits).alias("_bucket"), tied.alias("_hash"), "_more")
    offsets = bucket_offsets(keyed)
    inside = W.partitionBy("_bucket").orderBy("_hash")
    local = keyed.repartition("_bucket").withColumn("_inside", F.row_number().over(inside))
    text = F.substring("_hash", rest + 1, 1 << 30).cast("string")
    ranked = local.join(F.broadcast(offsets), "_bucket").select(
        (F.col("_offset") + F.col("_inside") - 1).alias("_idx"), text.alias("_texts"), "_more"
    )

    cuts = store(bucket_offsets(rows.select(hash_bucket(to, digits).alias("_bucket")))).df
    total = F.lit(cuts.agg(F.sum("_size")).first()[0] or 1)
    cells = F.lit(16**digits)
    first, last = (guide_cell(c, cells, total) for c in (F.col("_offset"), F.col("_offset") + F.col("_size") - 1))
    guide = cuts.withColumn("_cell", F.explode(F.sequence(first, last)))
    placed = ranked.withColumn("_cell", guide_cell(F.col("_idx"), cells, total)).join(F.broadcast(guide), "_cell")
    place = (F.col("_idx") - F.col("_offset")).cast("int").alias("_place")
    placed = placed.filter("_idx >= _offset and _idx < _offset + _size").select("_bucket", place, "_texts", "_more")

    short = dict(rows.dtypes)[id_col] == "string"
    key = long_key(F.col(id_col)) if short else F.col(id_col)
    own = rows.withColumn("_bucket", hash_bucket(to, digits)).filter("_bucket is not null")
    own = own.withColumn(id_col, short_key(F.col(id_col))) if short else own
    # Rows have no place yet, values no id.
    both = own.unionByName(placed, allowMissingColumns=True).repartition("_bucket")
    both = both.withColumn(id_col, key).withColumn("_own", F.col("_place").isNull())
    both = both.withColumn("_hash", hash_hex(seed, names[0], id_col))
    found = F.row_number().over(W.partitionBy("_bucket", "_own").orderBy("_hash")) - F.lit(1)
    both = both.withColumn("_place", F.when(F.col("_own"), found).otherwise(F.col("_place"))).drop("_hash")
    value = F.struct("_texts", "_more")
    met = both.withColumn(
        "_met", F.first(F.when(~F.col("_own"), value), ignorenulls=True).over(W.partitionBy("_bucket", "_place"))
    )
    return met.filter("_own").select(*rows.columns, F.col("_met._texts").alias("_value"), F.col("_met._more").alias("_more"))


def first_n(df: DataFrame, key: Column, tiebreak: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows smallest by (numeric ``key``, ``tiebreak``); NULL keys are the largest.

    Small ``n`` is a top-n.  Beyond ``TOP_N_ROWS`` the boundary is located by
    narrowing a histogram, one aggregation of at most 1024 groups per round;
    rows below the boundary bin are a plain filter and only the bin is sorted.
    """
    keyed = df.withColumn("_key", key.cast("double"))
    if n <= TOP_N_ROWS:
        return keyed.orderBy(F.col("_key").asc_nulls_last(), *tiebreak).limit(n).drop("_key")
    low, high, known = keyed.agg(F.min("_key"), F.max("_key"), F.count("_key")).first()
    if known <= n:
        rest = keyed.filter(F.col("_key").isNull()).orderBy(*tiebreak).limit(n - known)
        return keyed.filter(F.col("_key").isNotNull()).unionByName(rest).drop("_key")
    taken, inside = 0, None
    while low < high:
        width = (high - low) / _SCALE
        cell = F.least(F.floor((F.col("_key") - low) / width), F.lit(_SCALE - 1))
        span = keyed.filter(F.col("_key").between(low, high))
        counts = (
            span.groupBy(cell.alias("cell"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi"))
            .orderBy("cell")
            .collect()
        )
        before = taken
        for row in counts:
            if before + row["n"] >= n:
                break
            before += row["n"]
        else:
            return df  # fewer than n rows in all
        taken, inside = before, row["n"]
        low, high = row["lo"], row["hi"]
        if inside <= TOP_N_ROWS:
            break
    edge = keyed.filter(F.col("_key").between(low, high)).orderBy("_key", *tiebreak).limit(n - taken)
    return keyed.filter(F.col("_key") < low).unionByName(edge).drop("_key")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    bins: int = 4096,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of a score in [0, 1], one row per ``by`` group.

    Equal scores collapse into counts before any shuffle of the order, so a
    score shared by a third of the rows is one row here.  ``weight`` names a
    count column when the input is already collapsed.
    """
    by = list(by)
    # Stored because the order is read more than once and the scores may be dear.
    counts = store(
        df.groupBy(*by, value)
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
        .filter(F.col(value).isNotNull())
        .withColumn("_bin", F.floor(F.col(value) * bins))
    ).df
    ranked = running_total(counts, "_bin", [value], "_n", "_lo", by)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    placed = ranked.join(totals, by) if by else ranked.withColumn(
        "_total", totals.select("_total").scalar()
    )
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for tag, pos in (("f", F.floor(at)), ("c", F.ceil(at))):
            hit = (F.col("_lo") <= pos) & (pos < F.col("_lo") + F.col("_n"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{tag}_{name}"))
    flat = placed.groupBy(*by).agg(F.first("_total").alias("_total"), *picks)
    out = [F.col(b) for b in by]
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_f_{name}"), F.col(f"_c_{name}")
        out.append((lo + (at - F.floor(at)) * (hi - lo)).alias(name))
    return flat.select(*out)


def inverse_cdf_guide(
    counts: DataFrame, by: Sequence[str], token: str = "token", n: str = "n", digits: int = 2
) -> DataFrame:
    """Lay each group's token counts end to end as ``[lo, hi)`` and add guide cells.

    Token order is by md5 of the token, so the running total is bucketed.  A
    draw ``idx`` in ``[0, total)`` looks only at cell ``idx * k div total``,
    which on average holds fewer than two tokens: an equi-join, no range scan.
    """
    by = list(by)
    keyed = counts.withColumn("_hash", F.md5(F.col(token))).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    placed = running_total(keyed, "_bucket", ["_hash", token], n, "lo", by)
    totals = counts.groupBy(*by).agg(F.sum(n).alias("total"), F.count(F.lit(1)).alias("k"))
    joined = placed.join(totals, by).withColumn("hi", F.col("lo") + F.col(n))
    first = guide_cell(F.col("lo"), F.col("k"), F.col("total"))
    last = guide_cell(F.col("hi") - 1, F.col("k"), F.col("total"))
    return joined.select(
        *by, F.explode(F.sequence(first, last)).alias("cell"), token, "lo", "hi"
    )


def ranged(df: DataFrame, *order) -> DataFrame:
    """``df``, stored, with ``_bucket``: the number of its range of ``order``, for :func:`running_total`."""
    return store(df.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id())).df


def token_order_guide(counts: DataFrame, by: Sequence[str], token: str = "token", n: str = "n") -> DataFrame:
    """Like :func:`inverse_cdf_guide` with tokens in their own order.

    The order is cut into ranges of (group, token), whose numbers are the buckets, so a
    group with very many tokens spreads over tasks.
    """
    by = list(by)
    cut = ranged(counts, *by, token)
    placed = running_total(cut, "_bucket", [token], n, "lo", by)
    totals = cut.groupBy(*by).agg(F.sum(n).alias("total"), F.count(F.lit(1)).alias("k"))
    joined = placed.join(totals, by).withColumn("hi", F.col("lo") + F.col(n))
    first = guide_cell(F.col("lo"), F.col("k"), F.col("total"))
    last = guide_cell(F.col("hi") - 1, F.col("k"), F.col("total"))
    return joined.select(*by, F.explode(F.sequence(first, last)).alias("cell"), token, "lo", "hi")


def guide_cell(idx: Column, k: Column, total: Column) -> Column:
    # decimal keeps idx * k exact where a bigint product could overflow
    product = idx.cast("decimal(20,0)") * k.cast("decimal(18,0)")
    return F.floor(product / total.cast("decimal(20,0)")).cast("bigint")


def draw_index(u: Column, total) -> Column:
    """``floor(u * total)``, kept inside the range at the top end."""
    t = as_col(total)
    return F.least(F.floor(u * t.cast("double")), t - 1).cast("bigint")
