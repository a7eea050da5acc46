"""Multi-step plans: folder import and colour matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintshelf.operators import colorcards as K
from tintshelf.operators import imports as I
from tintshelf.streaming.readings import average_readings


def folder_import(files: DataFrame, existing: DataFrame, hash_index: DataFrame, mode: str = "text_first") -> tuple[DataFrame, DataFrame]:
    """files(root, path, text, content) to (manifest, one-row summary): propose, allocate, drop known content."""
    hashed = I.with_content_hash(files).drop("content")
    prepared = I.allocate_names(I.propose_codes(hashed, mode), existing)
    manifest = I.import_manifest(prepared, hash_index)
    return manifest, I.import_summary(prepared, manifest)


def match_readings(readings: DataFrame, cards: DataFrame, k: int = 12, samples: int = 3) -> DataFrame:
    """Average the readings of each device and find the nearest cards of every mean."""
    means = average_readings(readings, samples)
    named = means.select(F.concat_ws("/", "device_id", "group_no").alias("reading_id"), "l", "a", "b")
    return K.nearest_colors(named, cards, k)
