"""Mix sources to target weights by repeating whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from likeness.functions.draws import uniform
from likeness.functions.ordering import ranged, running_total
from likeness.llm.common import SPACE, text_of
from likeness.plans.materialise import keyed_join, store

WEIGHTS = (5, 2, 1)
MOST = 3.0
WORD = SPACE.replace("[", "[^", 1)
# Draws of a source are counted in so many cells, at whose edges its threshold may lie.
CELLS = 4096


def word_count(text: str | Column) -> Column:
    """Maximal runs of other characters than ASCII white space; NULL has none."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST
) -> DataFrame:
    """source, source_size, n_docs, target, rate from rows of (source, source_size, n_docs), one a source.

    Sources in code-point order, NULL last, get the weights in turn.  A target never
    exceeds ``most`` times its source; what is cut off goes to the other sources by
    weight.  In the order of cap over weight, the sources before one are capped when it
    is reached, so running sums give the shared level at each: no rounds.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    one = sizes.withColumn("_one", F.lit(1).cast("bigint"))
    placed = running_total(ranged(one, F.col("source").asc_nulls_last()), "_bucket", [F.col("source").asc_nulls_last()], "_one", "place")
    table = placed.select(
        "source",
        "source_size",
        "n_docs",
        F.get(turn, F.pmod("place", F.lit(len(weights))).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(most))).alias("cap"),
    ).withColumn("ratio", F.col("cap") / F.col("weight"))
    table = ranged(table, "ratio", "source")
    order = ["ratio", F.col("source").asc_nulls_last()]
    sums = running_total(running_total(table, "_bucket", order, "cap", "capped"), "_bucket", order, "weight", "spent")
    total, of_all = table.agg(F.sum("source_size"), F.sum("weight")).first()
    reached = (F.lit(float(total or 0)) - F.col("capped")) / (F.lit(float(of_all or 1)) - F.col("spent"))
    # The first source that the level leaves below its cap; among equal ratios the first has the highest level.
    free = sums.select("ratio", (-reached).alias("less")).filter("-less < ratio")
    first = free.agg(F.min(F.struct("ratio", "less")).alias("f")).first()["f"]
    target = F.least(F.col("cap"), F.col("weight") * F.lit(-float(first["less"]) if first else 0.0))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most))))
    return table.select(
        "source", "source_size", "n_docs", target.alias("target"), F.coalesce(rate, F.lit(0.0)).alias("rate")
    )


def mix(
    docs: DataFrame,
    carry: Sequence[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST,
    seed: int = 0,
) -> DataFrame:
    """Decisions for each row of ``docs``: doc (a struct of ``carry``), size, source_size, target, rate, copies.

    A document is taken floor(rate) times, and once more if its own draw, a hash of the
    seed, its id and its text, is below its source's threshold.  The threshold is the edge of a
    cell of draws, next to the rate's fraction, at which the words below it come nearest
    to the target; with the fraction itself a small source would miss it by several percent.

    NULL texts have size 0; NULL is a source of its own, the last; an empty table gives
    an empty result.  Rows of one id and text share their draw, so reruns agree.
    """
    carry = list(carry or docs.columns)
    named = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col).cast("binary")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        F.floor(uniform(seed, "mix", named) * CELLS).cast("int").alias("cell"),
    )
    # At most CELLS rows a source, from here on.
    cells = store(rows.groupBy("source", "cell").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))).df
    sizes = cells.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n_docs"))
    targets = store(source_targets(sizes, weights, most).withColumn("key", _source_key()))
    inside = W.partitionBy("key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    below = cells.withColumn("key", _source_key()).drop("source").withColumn("below", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    wanted = (F.col("rate") - F.floor("rate")) * F.col("source_size")
    edge = below.join(targets.df, "key").groupBy("key").agg(
        F.min(
            F.least(
                F.struct(F.abs(F.col("below") - wanted).alias("miss"), F.col("cell").alias("edge")),
                F.struct(F.abs(F.col("below") + F.col("size") - wanted).alias("miss"), (F.col("cell") + 1).alias("edge")),
            )
        ).alias("best")
    )
    plan = store(targets.df.drop("source").join(edge, "key").select("key", "source_size", "n_docs", "target", "rate", F.col("best.edge").alias("edge")))
    total = plan.df.agg(F.sum("n_docs")).first()[0]
    keyed = rows.withColumn("_key", _source_key()).drop("source")
    joined = keyed_join(keyed, plan.df, {"_key": "key"}, plan.small, "n_docs", total)
    extra = (F.col("cell") < F.col("edge")).cast("int")
    return joined.select(
        "doc", "size", "source_size", "target", "rate", (F.floor("rate") + extra).cast("int").alias("copies")
    )


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes it: every row as many times as it has copies, all columns kept."""
    mixed = mix(docs, **options).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
