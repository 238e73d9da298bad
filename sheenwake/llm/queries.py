"""The queries of this subpackage: thin uses of the operators on whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (bloom_lm, decontaminate, divergence, licenses, ngram_join, pii, prefix_trie, quality, secrets,
               sentencepiece_fst, severity, token_files, whitening)
from .common import remainder, table


def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return divergence.apply_rules(docs, divergence.references(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "char_distance", "word_distance")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_bloom_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, model = bloom_lm.train_and_score(docs.withColumn("held_out", bloom_lm.held_out()), ~F.col("held_out"))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score", F.col("lm_score").alias("score"))


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.fit(docs))

    def count(kind: str):
        k = pii.KINDS.index(kind)
        return F.size(F.filter("pii_spans", lambda x: x["base"] & (x["kind"] == k))).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE),
                        F.sha2(pii.digest(base_only=True).cast("binary"), 256).alias("base_sha256"), pii.digest().alias("spans"))


def op5_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = severity.fit(docs, table(spark, sf_dir, "labels"))
    return severity.score(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "expected_severity", "toxic_probability", "grade",
        (F.col("toxic_probability") >= 0.5).cast("int").alias("toxic"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_files.new_folder(spark)
    files = token_files.write_token_files(docs, folder)
    return token_files.read_documents(files, folder, dict(docs.dtypes)["doc_id"])


def op7_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece_fst.decode(sentencepiece_fst.encode(docs))
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepiece_fst.SPACE), F.lit(" "))
    return both.select("doc_id", "piece_ids", F.size("piece_ids").cast("bigint").alias("n_pieces"), same.alias("restored"))


def op8_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.share_heads(*prefix_trie.numbered(table(spark, sf_dir, "conversations"))))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    return (whitening.whiten(rows, model)
            .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"),
                    F.col("deviation").try_cast("bigint").alias("deviation"), "whitened",
                    F.element_at(explained, F.col("at") + 1).alias("explained"),
                    F.lit(model.identity_error).cast("double").alias("identity_error")))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs))

    def count(kind: str):
        k = secrets.KINDS.index(kind)
        return F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.digest(base_only=True).cast("binary"), 256)
                        .alias("base_sha256"), secrets.digest().alias("spans"), count("novel"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_divergence_rules, op2_benchmark_decontamination, op3_bloom_lm_score, op4_weak_supervision_pii,
           op5_toxicity_severity, op6_token_files, op7_sentencepiece_fst, op8_license_join, op9_ngram_jaccard,
           op10_pu_quality, op11_conversation_trie, op12_embedding_whitening, op13_secret_scan]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Plain SQL of the queries that SQL can express; the pipeline's, where it has one, under its name."""
    out: dict[str, str] = {}
    if corpus_pipeline.ORACLE_SQL is not None:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
