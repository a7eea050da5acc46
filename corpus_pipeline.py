"""Corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), decides on all rows its predecessor kept, and returns the columns of
``documents``; the last one adds token counts and digests. ``run`` writes every stage's rows in the shared folder and
reads them again for the next, so a stage that is lost costs nothing of those before it. Every call of ``run`` takes a new
folder: to go on after a failure, call the remaining ``STAGES`` on what the last one has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintshelf.llm import bpe, decontaminate, jaccard, langid, lines
from tintshelf.llm.common import stored, table, text_hash
from tintshelf.llm.queries import vocabulary_path
from tintshelf.session import new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which the learned languages explain letters no better than chance, go."""
    judged = langid.identify(docs, langid.learn(docs))
    return judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("fit") > 0)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines and of passages go; documents with nothing left of what they had go as well."""
    out = lines.dedup_lines(docs, passages=True).filter((F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, of equal rows one."""
    judged = jaccard.near_duplicates(docs).filter(~F.col("kept")).select("doc_id", F.col("th").alias("_nd_th"))
    key = lambda df: df.withColumn("_nd_id", F.coalesce("doc_id", F.lit(0))).withColumn("_nd_null", F.col("doc_id").isNull())
    names = ["_nd_id", "_nd_null", "_nd_th"]
    gone = stored(key(judged).select(*names).distinct())
    here = key(docs.withColumn("_nd_th", text_hash(F.col("text"))))
    return here.join(gone, names, "left_anti").dropDuplicates(names).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_documents(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontamination),
    ("bpe", tokens),
]

#: Mixture inference and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
