"""One query per operator, over the whole of its table, and the SQL it must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm import (
    chat_format,
    context_mixing,
    divergence,
    exact_dedup,
    html_text,
    lattice,
    license_scan,
    mixing,
    order_minhash,
    packing,
    simhash,
    spelling,
    toxicity,
)
from likeness.llm.common import read

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the mixture and under the unigram base."""
    return context_mixing.score_documents(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), VOCABULARY)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal but for white space."""
    found = exact_dedup.find_copies(read(spark, sf_dir, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select(
        "doc.doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
        "rate",
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return license_scan.scan(read(spark, sf_dir, "documents"), license_scan.template_table(spark))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and the components of those within two bits."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "component_size",
    )


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return order_minhash.compare_with_edits(read(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as linked, ordered, validated tool traffic in canonical JSON."""
    events = chat_format.conversation_events(read(spark, sf_dir, "conversations"))
    return chat_format.format_chats(events, chat_format.REPLY_SCHEMA)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each category for every document, and whether it counts as toxic."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.with_toxicity(docs, labels, carry=["doc_id"])
    return scored.select(
        "doc.doc_id", "p_quality", "p_toxic", (F.col("p_toxic") >= 0.5).cast("int").alias("toxic")
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_text.extract(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language, and the terms that set a source apart."""
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings with a cosine of 0.9 or more, and their components."""
    return lattice.similar_vectors(read(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words one edit apart in all documents, and the form each goes back to."""
    return spelling.group_variants(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_context_mixing,
        op2_best_fit_packing,
        op3_exact_dedup,
        op4_source_mixing,
        op5_license_scan,
        op6_simhash_near_dedup,
        op7_order_minhash,
        op8_chat_format,
        op9_toxicity,
        op10_html_text,
        op11_source_divergence,
        op12_lattice_near_dedup,
        op13_spelling_variants,
    )
}

_SPACE = r"[\x20\x09-\x0D]+"

ORACLE = {
    "op3_exact_dedup": rf"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
        )
        SELECT doc_id, text_sha256, keep_id, group_size, doc_id = keep_id AS kept FROM d JOIN g USING (text_sha256)
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ), kept AS (
            SELECT lang, term FROM d GROUP BY lang, term HAVING count(DISTINCT i) >= 10
        ), sizes AS (
            SELECT lang, count(*) AS v FROM kept GROUP BY lang
        ), groups AS (
            SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
        ), counts AS (
            SELECT lang, source, term, count(*) AS n FROM d JOIN kept USING (lang, term) GROUP BY ALL
        ), dense AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
            FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), p AS (
            SELECT lang, source, term, n,
                   1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
            FROM dense JOIN sizes USING (lang)
        ), q AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
            FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL) JOIN sizes USING (lang)
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q)
            FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
        WHERE part = 'pair' OR rank <= 10
    """,
}
