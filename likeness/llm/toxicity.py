"""Toxicity by a classifier chain of linear models.

Each category has a logistic model over words and word beginnings, and every model
but the first also sees the probabilities of the categories before it.  For
training these are out-of-fold predictions, so a later model learns from
probabilities of the quality it will meet on new texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import stored, text_of

# Documented bounds of the fit: labelled rows, and features chosen on them.  Both
# are parameters of fit_chain(); scoring has no bound.
MAX_ROWS = 20_000
MAX_FEATURES = 4096
MIN_ROWS = 5
FOLDS = 3
STEM = 5
PENALTY = 1e-3


def features_of(text: str | Column) -> Column:
    """Distinct lower-case words, and the beginnings of longer ones marked with ``^``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_of(text)), F.lit(r"\p{L}+"), F.lit(0)))
    stems = F.transform(F.filter(words, lambda w: F.length(w) > STEM), lambda w: F.concat(F.lit("^"), F.substring(w, 1, STEM)))
    return F.concat(words, F.array_distinct(stems))


@dataclass(frozen=True)
class Chain:
    """Fitted models in order; a model is None where the training rows had one class (then ``rate``)."""

    categories: tuple[str, ...]
    vectors: CountVectorizerModel | None
    models: tuple
    rates: tuple[float, ...]

    def score(self, rows: DataFrame, upto: int | None = None) -> DataFrame:
        """Add a column ``p_<category>`` for each category to rows with ``_words``."""
        names = self.categories[:upto]
        if self.vectors is None:
            return rows.withColumns({f"p_{c}": F.lit(r) for c, r in zip(names, self.rates)})
        out = self.vectors.transform(rows)
        for i, c in enumerate(names):
            out = _probability(out, self.models[i], names[:i], c, self.rates[i])
        return out.drop("_vector")


def _assembled(rows: DataFrame, before: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=["_vector", *[f"p_{c}" for c in before]], outputCol="_features").transform(rows)


def _probability(rows: DataFrame, model, before: Sequence[str], name: str, rate: float) -> DataFrame:
    if model is None:
        return rows.withColumn(f"p_{name}", F.lit(rate))
    made = model.transform(_assembled(rows, before))
    return made.withColumn(f"p_{name}", vector_to_array("_probability")[1]).drop("_features", "_probability")


def _fit(rows: DataFrame, before: Sequence[str], name: str):
    known = rows.filter(F.col(name).isNotNull()).withColumn("_label", F.col(name).cast("double"))
    if known.agg(F.count_distinct("_label")).first()[0] < 2:
        return None
    learner = LogisticRegression(
        featuresCol="_features",
        labelCol="_label",
        probabilityCol="_probability",
        rawPredictionCol="",
        predictionCol="",
        regParam=PENALTY,
        maxIter=60,
    )
    return learner.fit(_assembled(known, before))


def _vocabulary(rows: DataFrame, categories: Sequence[str], most: int) -> list[str]:
    """The words whose presence says most about any category, by information over the training rows."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    seen = rows.select(F.explode("_words").alias("word"), *categories).groupBy("word")
    counts = seen.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories])
    gains = []
    for c in categories:
        rate = (total[c] or 0) / max(1, total["n"])
        inside = (F.coalesce(F.col(c), F.lit(0)) + rate) / (F.col("n") + 1.0)
        # How far the rate with the word is from the rate overall, in bits, over all rows with it.
        bits = inside * F.log2(inside / F.lit(max(rate, 1e-9))) + (1 - inside) * F.log2(
            F.greatest(1 - inside, F.lit(1e-9)) / F.lit(max(1 - rate, 1e-9))
        )
        gains.append(F.col("n") * F.when(inside > 0, bits).otherwise(F.lit(0.0)))
    best = counts.filter(F.col("n") >= MIN_ROWS).withColumn("gain", F.greatest(*gains) if len(gains) > 1 else gains[0])
    return [r["word"] for r in best.orderBy(F.desc("gain"), "word").limit(most).select("word").collect()]


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES,
    folds: int = FOLDS,
) -> Chain:
    """Fit one model per category in order, on at most about ``max_rows`` labelled rows.

    The rows are chosen and dealt to folds by a hash of the text, so equal texts share
    a fold.  Labels are 0 or 1; a row repeated in ``labels`` counts as its largest
    label, a missing one is left out of that category's fit.  Without labelled rows
    or without two classes a category has its rate (0 for none) as probability.
    """
    marks = labels.groupBy(F.col(id_col).alias("_id")).agg(*[F.max(c).alias(c) for c in categories])
    known = marks.filter(F.col("_id").isNotNull())
    share = min(1.0, max_rows / max(1, known.count()))
    text = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    place = F.pmod(F.xxhash64("_text"), F.lit(1 << 20))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "_text"), F.lit(folds)).cast("int")
    rows = stored(
        text.filter(place < int(share * (1 << 20)))
        .join(known, "_id")
        .select(features_of("_text").alias("_words"), fold.alias("_fold"), *categories)
    )
    words = _vocabulary(rows, categories, max_features)
    rates = tuple(
        float(r or 0.0) for r in rows.agg(*[F.avg(F.col(c).cast("double")) for c in categories]).first()
    )
    if not words:
        return Chain(tuple(categories), None, (None,) * len(categories), rates)
    vectors = CountVectorizerModel.from_vocabulary(
        words, inputCol="_words", outputCol="_vector"
    ).setBinary(True)
    train = stored(vectors.transform(rows).drop("_words"))
    models: list = []
    for i, c in enumerate(categories):
        models.append(_fit(train, categories[:i], c))
        if i == len(categories) - 1:
            break
        parts = None
        for k in range(folds):
            outside = _fit(train.filter(F.col("_fold") != k), categories[:i], c)
            part = _probability(train.filter(F.col("_fold") == k), outside, categories[:i], c, rates[i])
            parts = part if parts is None else parts.unionByName(part)
        train = stored(parts)
    return Chain(tuple(categories), vectors, tuple(models), rates)


def with_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str] = ("quality", "toxic"),
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """doc (a struct of the ``carry`` columns) and ``p_<category>`` for every row of ``docs``; NULL text is empty."""
    chain = fit_chain(docs, labels, categories, id_col, text_col, **options)
    carry = list(carry or docs.columns)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), features_of(text_col).alias("_words")
    )
    return chain.score(rows).select("doc", *[f"p_{c}" for c in categories])


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` without those whose probability of ``toxic`` reaches the threshold; all columns kept."""
    scored = with_toxicity(docs, labels, **options)
    return scored.filter(F.col("p_toxic") < threshold).select("doc.*")
