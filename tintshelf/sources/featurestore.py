"""Incremental feature store: features of images in hash buckets, recomputed for new and changed images only.

Every stored row carries the signature (name, size, whole seconds) of the file its features were made from. A refresh joins
the signatures with the current listing, computes the images whose signature is new, drops those whose file is gone, and
commits one version in which only the touched buckets are new files (``buckets.BucketStore``). Features of other settings
lie in a folder of their own, so other settings make every image new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tintshelf.operators.numbering import checkpointed
from tintshelf.sources.buckets import BucketStore
from tintshelf.sources.files import signature
from tintshelf.sources.records import settings_key

ADDED, CHANGED, REMOVED, KEPT = "added", "changed", "removed", "kept"


class FeatureStore:
    """Features (image_name, signature, + ``columns``) made with ``settings``; at most one row per image."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict, columns: str = "style_code string, embedding array<double>", buckets: int = 256):
        schema = f"image_name string, signature string, {columns}"
        self.columns = ["image_name", "signature", *T._parse_datatype_string(columns).names]
        self.rows = BucketStore(spark, f"{folder.rstrip('/')}/settings={settings_key(settings)}", {"features": ("image_name", schema)}, buckets)

    def read(self) -> DataFrame:
        return self.rows.read("features").drop("_file", "signature")

    def compare(self, files: DataFrame) -> DataFrame:
        """(image_name, signature, action) of the listing (image_name, size, modified) and of stored images that are gone.

        Of several files of one name the largest signature counts; only names and signatures are read from the store.
        """
        now = files.groupBy("image_name").agg(F.max(signature(F.col("image_name"), F.col("size"), F.col("modified"))).alias("signature"))
        old = self.rows.read("features").select("image_name", F.col("signature").alias("_old"))
        action = (
            F.when(F.col("signature").isNull(), REMOVED).when(F.col("_old").isNull(), ADDED)
            .when(F.col("_old") != F.col("signature"), CHANGED).otherwise(KEPT)
        )
        return now.join(old, "image_name", "full").select("image_name", "signature", action.alias("action"))

    def refresh(self, files: DataFrame, compute: Callable[[DataFrame], DataFrame], token: str | None = None) -> DataFrame:
        """Bring the store up to the listing ``files``; (image_name, signature, action) of every image as found before.

        ``compute`` gets (image_name, signature) of new and changed images and gives their rows with the store's columns;
        an image it leaves out has no features and is tried again by the next refresh. With the token of an earlier
        refresh nothing is done.
        """
        found = checkpointed(self.compare(files))
        if token is not None and self.rows.done(token):
            return found
        todo = found.filter(F.col("action").isin(ADDED, CHANGED)).select("image_name", "signature")
        fresh = checkpointed(compute(todo).join(todo.withColumnRenamed("signature", "_now"), "image_name").withColumn("signature", F.col("_now")).select(*self.columns))
        change = self.rows.merged("features", fresh, found.filter(F.col("action").isin(CHANGED, REMOVED)))
        if change[1] or token is not None:
            self.rows.replace({"features": change}, token)
        return found
