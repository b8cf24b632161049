import random

import pytest

from likeness.llm import toxicity


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    clean = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    bad = ["vilestuff", "vilething", "grimwort"]
    rows, labels = [], []
    for i in range(700):
        toxic, poor = i % 9 == 0, i % 7 == 0
        body = [rng.choice(clean) for _ in range(60)]
        if toxic:
            body[3:5] = rng.sample(bad, 2)
        if poor:
            body += ["lorem", "ipsum"]
        rows.append((i, " ".join(body), "en", "s", 1))
        if i < 400:
            labels.append((i, int(not poor), int(toxic)))
    return rows, labels


DOCS = "doc_id bigint, text string, lang string, doc string, p_toxic bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_documents_are_told_apart(spark, corpus):
    rows, labels = corpus
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    scored = toxicity.with_toxicity(docs, marks, carry=["doc_id"]).collect()
    assert len(scored) == len(rows)
    wrong = [r for r in scored if r.doc.doc_id >= 400 and (r.p_toxic >= 0.5) != (r.doc.doc_id % 9 == 0)]
    assert len(wrong) <= 3
    left = toxicity.drop_toxic(docs, marks)
    assert left.columns == docs.columns
    assert abs(left.count() - sum(i % 9 != 0 for i in range(700))) <= 3


def test_later_models_see_earlier_probabilities(spark, corpus):
    rows, labels = corpus
    chain = toxicity.fit_chain(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), ("quality", "toxic"))
    features = len(chain.vectors.vocabulary)
    assert [m.numFeatures for m in chain.models] == [features, features + 1]


def test_odd_tables(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None), *rows[:20], rows[3]], DOCS)
    # One class only, NULL and repeated labels: the rate is the probability.
    marks = spark.createDataFrame([(i, 1, 0) for i in range(15)] + [(3, None, None), (4, 1, 0), (None, 0, 1)], LABELS)
    scored = toxicity.with_toxicity(docs, marks).collect()
    assert len(scored) == 23 and {r.p_toxic for r in scored} == {0.0} and {r.p_quality for r in scored} == {1.0}
    none = spark.createDataFrame([], LABELS)
    assert toxicity.drop_toxic(docs, none).count() == 23
    assert toxicity.drop_toxic(spark.createDataFrame([], DOCS), marks).count() == 0
