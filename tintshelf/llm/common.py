"""Helpers of the training-data operators: tables, words, stored frames and joins that a hot key does not stall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintshelf.operators.numbering import checkpointed

#: Everything in ASCII that is neither a digit nor a lower-case letter; a word is a run of anything else.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder; the path goes to Spark's reader as it is."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null counts as empty."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, NO_WORD), "")


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read from a checkpoint in the folder that all executors share.

    Lost executors do not cost the work before it, and the plan after it starts from a plain scan: a join on these
    rows has an exchange of its own on either side, which adaptive execution can split where one key is hot.
    """
    return checkpointed(df)


def text_hash(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart; null is not the empty text."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def plain(df: DataFrame, *needed: str) -> DataFrame:
    """Only the named columns, so that further columns of the caller cannot clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in needed])
