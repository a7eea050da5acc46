"""File scans: image listings, change detection, decoded pixels."""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintshelf.functions import text as T


def _listing(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    # Content is never selected, so only the listing is read.
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    name = F.url_decode(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\+", "%2B"))
    return files.select("path", name.alias("image_name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def scan_images(
    spark: SparkSession, path: str, pattern: str = "*", suffixes: tuple[str, ...] = T.IMAGE_SUFFIXES,
    recursive: bool = False, variant: str = "search",
) -> DataFrame:
    """(path, image_name, size, modified) of images in path order.

    ``search`` skips dot files and falls back to every name when the pattern finds nothing; ``catalog`` skips
    ``MY-`` uploads; ``import`` takes all allowed suffixes.
    """
    allowed = [s.lower() if s.startswith(".") else f".{s.lower()}" for s in suffixes]

    def keep(df: DataFrame) -> DataFrame:
        df = df.filter(T.suffix_of(F.col("image_name")).isin(allowed))
        if variant == "search":
            df = df.filter(~F.startswith("image_name", F.lit(".")))
        if variant == "catalog":
            df = df.filter(~F.startswith("image_name", F.lit("MY-")))
        return df

    found = keep(_listing(spark, path, pattern, recursive))
    if variant == "search" and pattern != "*" and found.isEmpty():
        found = keep(_listing(spark, path, "*", recursive))
    return found.orderBy("path")


def signature(name: Column, size: Column, modified: Column) -> Column:
    """name|size|whole seconds."""
    return F.concat_ws("|", name, size.cast("string"), modified.cast("bigint").cast("string"))


def changed_files(current: DataFrame, previous: DataFrame, settings_key: str | None = None) -> DataFrame:
    """Files of ``current`` whose signature is not in ``previous(signature)``.

    With a ``settings_key``, only rows of ``previous`` of the same ``settings_key`` count: other settings make every
    file new.
    """
    if settings_key is not None:
        previous = previous.filter(F.col("settings_key") == settings_key)
    marked = current.withColumn("signature", signature(F.col("image_name"), F.col("size"), F.col("modified")))
    return marked.join(previous.select("signature"), "signature", "left_anti")


def removed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(image_name) of ``previous(signature)`` rows whose file is gone."""
    name = F.regexp_replace("signature", r"\|[^|]*\|[^|]*$", "")
    return previous.select(name.alias("image_name")).distinct().join(current.select("image_name"), "image_name", "left_anti")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, image struct) decoded by Spark's image source; unreadable files are dropped."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select(F.regexp_replace("image.origin", "^.*/", "").alias("image_id"), "image")


def to_pixels(images: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b): one row per pixel. The source stores rows of BGR(A) or gray bytes."""
    p = images.select("image_id", "image.*").select("image_id", "width", "height", "nChannels", "data")
    size = F.col("width") * F.col("nChannels")
    rows = p.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    rows = rows.select("image_id", "width", "nChannels", "y", F.substr("data", F.col("y") * size + 1, size).alias("row"))
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))

    def byte(channel: int) -> Column:
        at = F.col("x") * F.col("nChannels") + F.least(F.lit(channel), F.col("nChannels") - 1) + 1
        return F.ascii(F.decode(F.substr("row", at, F.lit(1)), "ISO-8859-1"))  # code point of the one byte

    return cells.select("image_id", "y", "x", byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def png_bytes(image: pd.DataFrame) -> bytes:
    """PNG file of the pixels (y, x, r, g, b) of one image."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    y, x = image["y"].to_numpy(), image["x"].to_numpy()
    width, height = int(x.max()) + 1, int(y.max()) + 1
    rows = np.stack([image[c].to_numpy() for c in "rgb"], axis=1).astype("uint8")[np.lexsort((x, y))].reshape(height, width * 3)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + r.tobytes() for r in rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


@cache
def _store(folder: str):
    """File system and path of a folder, looked up once a process."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_images(pixels: DataFrame, folder: str) -> int:
    """Write (image_name, y, x, r, g, b) as one PNG file per image; returns their number. ``folder`` is shared."""

    store, root = _store(folder)
    store.create_dir(root, recursive=True)

    def write(image: pd.DataFrame) -> pd.DataFrame:
        store, root = _store(folder)
        with store.open_output_stream(f"{root}/{image['image_name'].iloc[0]}") as out:
            out.write(png_bytes(image))
        return pd.DataFrame({"n": [1]})

    return pixels.groupBy("image_name").applyInPandas(write, "n int").agg(F.sum("n")).first()[0] or 0
