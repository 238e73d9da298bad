"""From raw documents to encoded training text in five stages, each one operator of ``sheenwake.llm``.

Every stage takes (spark, docs, sf_dir), reads all its predecessor kept and returns the columns of documents,
the last one the ids of the pieces as well. ``run`` writes each stage's result as Parquet in the shared
folder and reads it again as the next one's input.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheenwake.llm import decontaminate, ngram_join, pii, quality, sentencepiece_fst
from sheenwake.llm.common import table
from sheenwake.session import cut_lineage


def _with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a key of (id, text) that every row has; those without an id come last in its order.

    Rows of equal id and text have one key; two hashes stand for the text, 128 bits together.
    """
    lost = F.col("doc_id").isNull()
    return docs.withColumn("_row", F.struct(
        lost.alias("lost"), F.coalesce("doc_id", F.lit(0).cast(dict(docs.dtypes)["doc_id"])).alias("id"),
        F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two")))


def _anti(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the given rows; both have ``_row``."""
    return docs.join(rows.select(F.col("_row").alias("_gone")), F.col("_row") == F.col("_gone"), "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="_score").where(F.col("_score") >= quality.ACCEPT).drop("_score")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id in each group of near copies; rows that repeat it once.

    Rows without an id are compared as well and give way to those with one. Where an id stands on several
    texts, each text is kept or dropped for itself. Texts without words belong to no group; those without an
    id all stay.
    """
    docs = _with_row(docs)
    groups = cut_lineage(ngram_join.jaccard_groups(docs, "_row"))
    rows = groups.groupBy("_row").agg(
        F.min("class_id").alias("class_id"), F.count("*").alias("n"), F.max("n_copies").alias("n_copies"))
    once = _anti(docs, rows.where("class_id <> _row"))
    # a text without words is its only copy, however often it occurs
    repeated = rows.where("class_id = _row and n > 1 and (not _row.lost or n_copies > 1)").select("_row")
    # the few rows that occur several times go apart, so that texts are shuffled for these alone
    single = _anti(once, repeated)
    several = once.join(repeated, "_row", "left_semi").dropDuplicates(["_row"])
    return single.unionByName(several).drop("_row")


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; only the text that holds one goes, with an id or without."""
    docs = _with_row(docs)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), "_row")
    return _anti(docs, found.select("_row").distinct()).drop("_row")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; n_chars follows the new text."""
    masked = pii.mask(pii.spans(docs, pii.fit(docs)))
    changed = F.size("pii_spans") > 0
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked.drop("pii_spans")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces."""
    return sentencepiece_fst.encode(docs)


STAGES = [("quality classifier", keep_good), ("n-gram Jaccard join", keep_one_of_each_group),
          ("benchmark decontamination", drop_test_items), ("personal data", mask_personal_data),
          ("SentencePiece encoding", encode)]

#: The classifiers, the hashing join and the piece lattice are not SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
