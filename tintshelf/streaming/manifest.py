"""Streams of import manifests and image contents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tintshelf.operators.catalog import Catalog
from tintshelf.functions import text as T
from tintshelf.operators.imports import apply_manifest
from tintshelf.operators.numbering import checkpointed
from tintshelf.sources.buckets import BucketStore
from tintshelf.sources.records import MANIFEST_SCHEMA

#: Tables of a stored catalog, their bucket keys and columns. A code's products, images and tags share a bucket number.
CATALOG_TABLES = {
    "products": ("style_code", "style_code string, cover_image string, note string, created_at timestamp, updated_at timestamp"),
    "images": ("style_code", "style_code string, image_name string, sort_order int"),
    "product_tags": ("style_code", "style_code string, tag string"),
    "tags": ("name", "name string"),
}

#: Bytes of a batch's names and codes, with 64 for each row, up to which they go to every task; stored images then need no shuffle.
SMALL_BATCH = 128_000_000


def _stored(batch: DataFrame) -> tuple[DataFrame, int, bool]:
    """The batch, read once and kept, its number of rows, and whether its names go to every task."""
    manifest = checkpointed(batch.select("style_code", "image_name", "tags"))
    size = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("style_code", "image_name")]
    got = manifest.agg(F.count("*").alias("n"), F.sum(size[0] + size[1] + 64).alias("bytes")).first()
    return manifest, got["n"], (got["bytes"] or 0) <= SMALL_BATCH


def manifest_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New manifest files as they are appended."""
    return spark.readStream.schema(MANIFEST_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option(
        "mode", "DROPMALFORMED"
    ).json(path)


def stream_manifest(
    manifests: DataFrame, load: Callable[[], Catalog], store: Callable[[Catalog, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Apply each batch of manifest rows to the current catalog version and store the next one.

    ``store`` gets the batch number, so a repeated batch can write the same version again: both steps of
    ``apply_manifest`` give the same tables when run twice.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        manifest, rows, small = _stored(batch)
        if rows:
            store(apply_manifest(load(), manifest, small)[0], batch_id)

    return manifests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class CatalogStore:
    """A catalog in hash buckets with one pointer for all its tables; manifest batches rewrite the buckets they touch."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.rows = BucketStore(spark, folder, CATALOG_TABLES, buckets)

    def load(self, version: int | None = None) -> Catalog:
        return Catalog(**{t: self.rows.read(t, version=version).drop("_file") for t in CATALOG_TABLES})

    def save(self, catalog: Catalog, token: str | None = None) -> int:
        """Replace the whole catalog."""
        every = list(range(self.rows.buckets))
        return self.rows.replace({t: (getattr(catalog, t), every) for t in CATALOG_TABLES}, token)

    def apply(self, manifest: DataFrame, token: str | None = None) -> bool:
        """``apply_manifest`` on the touched buckets alone; False, with nothing changed, if the token is known.

        Touched are the buckets of the codes that images and tags of the manifest go to, and of codes that hold one of
        its images now; for these only names and codes of the stored images are read.
        """
        if token is not None and self.rows.done(token):
            return False
        manifest, _, small = _stored(manifest)
        names = manifest.select("image_name").distinct()
        names = F.broadcast(names) if small else names
        goes = manifest.select(F.explode(F.array(T.strip(T.style_code_catalog(F.col("image_name"))), "style_code")).alias("style_code"))
        holds = self.rows.read("images").select("style_code", "image_name").join(names, "image_name", "left_semi").select("style_code")
        buckets = self.rows.touched(goes.unionByName(holds))
        part = Catalog(**{t: self.rows.read(t, None if t == "tags" else buckets).drop("_file") for t in CATALOG_TABLES})
        new = apply_manifest(part, manifest, small)[0]
        # old files stay as they are and each of these is read once, so nothing of them is stored in between
        changes = {t: (getattr(new, t), buckets) for t in ("products", "images", "product_tags")}
        fresh = checkpointed(new.tags.select("name").distinct().join(part.tags, "name", "left_anti"))
        self.rows.replace({**changes, "tags": self.rows.merged("tags", fresh)}, token)
        return True


def stream_manifest_buckets(manifests: DataFrame, store: CatalogStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply each batch of manifest rows to the buckets it touches. A batch that is repeated after a failure is known by
    its number and changes nothing, so every batch counts once."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, f"{checkpoint}#{batch_id}")

    return manifests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_dedup(files: DataFrame, time: str = "ts", delay: str = "7 days") -> DataFrame:
    """First arrival per content hash. State is bounded by the watermark: a copy later than ``delay`` passes again."""
    return files.withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"])
