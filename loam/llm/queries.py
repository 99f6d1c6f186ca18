"""Registered queries of the text operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import (bpe, decontaminate, decontaminate_sql, exact_dedup, katz, language, line_quality, manifest_sql, merkle, mixing,
                      mixing_sql, pii, secret_scan, simhash, suffix_dedup, whitening)
from loam.llm.common import dropped, held_out
from loam.sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op2_decontaminate", decontaminate_sql.sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that contaminates it, over every row of documents."""
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"),
                                      any_case=True)


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and structurally confirmed secrets in every whole text of documents."""
    return secret_scan.digests(secret_scan.find_secrets(read_table(spark, sf_dir, "documents")))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text of documents that a 200-byte string occurring elsewhere covers."""
    return suffix_dedup.digests(suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")))


@query("op5_katz_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz back-off and add-one scores of every whole text, learned from six of seven folds of documents."""
    docs = read_table(spark, sf_dir, "documents")
    out = held_out("doc_id", 7)
    model = katz.fit(docs.where(~out), least=1)
    scored = katz.score(model, docs)
    dropped(model.table)  # its answers are written
    return scored.select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score")


@query("op6_line_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text by a field over its lines, learned from three of four folds of labels."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = held_out("doc_id", 4)
    model = line_quality.fit(docs, labels.where(~out))
    scored = docs.select("doc_id", out.alias("held_out"), line_quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= line_quality.THRESHOLD).cast("int"))


#: Key of the registered query only; who uses the operator passes a secret one.
PII_KEY = b"registered query"


@query("op7_pii_pseudonyms")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents with its personal values replaced, and what was replaced."""
    found = pii.pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", F.size("pii_spans").cast("long").alias("n_values"), F.concat_ws(",", F.transform(
        "pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))).alias("spans"), "text")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by cross-parsing, learned from three of four folds of documents."""
    docs = read_table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4)
    model = language.fit(docs.where(~out))
    return language.predict(model, docs).withColumn("held_out", out) \
        .select("doc_id", "held_out", "lang_pred", "score")


#: The vocabulary that the encoding query is asked to use.
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Token counts and digests of every document under the asked vocabulary and pattern."""
    import public_tokenizers

    return bpe.digests(bpe.encode_documents(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN))


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text of documents, and the bytes decoded from them."""
    return bpe_digests(read_table(spark, sf_dir, "documents"))


@query("op10_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates by block naming over every row and whole text of documents."""
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents")).drop("row")


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components (4-word shingles, at most 4 differing bits) over every row of documents."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")) \
        .select("doc_id", "fingerprint", "component_id")


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector of embeddings on the eight leading unit-variance components."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


@query("op12_source_mix", mixing_sql.sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of the sources at weights 1, 2, 3 takes."""
    return mixing.mix(read_table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest", manifest_sql.sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every row of documents, and the check after tampering."""
    return merkle.manifest(read_table(spark, sf_dir, "documents"))
