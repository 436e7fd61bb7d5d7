"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, language_id, line_dedup, merkle, mixing, ngram_join, quality_mil, vector_search
from .bpe_codec import encode_and_decode
from .common import crc_mod, read
from .quality_rules import quality_rules
from .secret_scan import secret_scan
from .token_counts import token_counts

TOKENIZER = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(TOKENIZER), carry=["doc_id"]).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_mil.fit(docs, labels, crc_mod("doc_id", 5) != 0)
    return quality_mil.quality_score(docs, model, carry=["doc_id"]).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, crc_mod("doc_id", 3) != 1)
    return language_id.language_id(docs, model, carry=["doc_id"]).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode_and_decode(docs, path, packed=True, carry=["doc_id"])
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan(docs, carry=["doc_id"]).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "novelty")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    rows = decontamination.decontaminate(docs, benchmark, carry=["doc_id"])
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return merkle.merkle_manifest(docs, altered=merkle.lowered(docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_mixing, op3_quality_mil, op4_vector_search, op5_ngram_join, op6_line_dedup, op7_language_id, op8_bpe_codec, op9_quality_rules, op10_secret_scan,
        op11_filter_audit, op12_decontamination, op13_merkle_manifest,
    )
}
#: SQL twins; the others can't be said in SQL and are tested against brute force, round trips or held-out rows.
ORACLES = {"op2_mixing": mixing.SQL, "op4_vector_search": vector_search.SQL, "op11_filter_audit": filter_audit.SQL, "op12_decontamination": decontamination.SQL, "op13_merkle_manifest": merkle.SQL}
