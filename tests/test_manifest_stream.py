"""Manifest batches of any length; stored images are not shuffled to meet a small batch."""

import time

import pytest
from pyspark.sql import functions as F

from checks.streams import _finish
from tintshelf.operators.catalog import Catalog, products_by_codes
from tintshelf.operators.maintenance import sync_catalog
from tintshelf.session import new_folder
from tintshelf.streaming import manifest as M


def _catalog(spark, folder):
    codes = spark.range(40).select(F.format_string("A%02d-%02d", F.col("id"), F.col("id")).alias("style_code"))
    products = codes.select("style_code", F.lit("").alias("cover_image"), F.lit("n").alias("note"))
    images = codes.select("style_code", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("sort_order")).select(
        "style_code", F.concat("style_code", F.lit("_"), "sort_order", F.lit(".jpg")).alias("image_name"), "sort_order")
    images.write.parquet(f"{folder}/images")
    tags = codes.select("style_code", F.lit("t").alias("tag"))
    return Catalog(products, spark.read.parquet(f"{folder}/images"), tags.select(F.col("tag").alias("name")).distinct(), tags)


def _files(spark):
    return spark.createDataFrame([("A01-01_3.jpg",), ("A01-01_0.jpg",), ("Z99-99_1.jpg",), ("MY-1_1.jpg",), (None,)], "image_name string")


def _stream(spark, folder, batches):
    row = spark.createDataFrame([("A01-01", "A01-01_9.jpg", ["x"])], "style_code string, image_name string, tags array<string>")
    for _ in range(batches):
        row.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(row.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_small_batch_needs_no_shuffle_of_images(spark):
    catalog, now = _catalog(spark, new_folder(spark)), F.lit("2024-01-01").cast("timestamp")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (a, _), (b, _) = (sync_catalog(_files(spark), catalog, now, small=s) for s in (False, True))
        assert "SortMergeJoin" in a.images._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in b.images._jdf.queryExecution().executedPlan().toString()
        for table in ("images", "products"):
            assert sorted(map(tuple, getattr(a, table).collect()), key=str) == sorted(map(tuple, getattr(b, table).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_stream_tells_small_batches(spark, monkeypatch, limit):
    folder, told, real = new_folder(spark), [], M.apply_manifest
    monkeypatch.setattr(M, "SMALL_BATCH", limit)
    monkeypatch.setattr(M, "apply_manifest", lambda c, m, small=None: told.append(small) or real(c, m, small))
    catalog, kept = _catalog(spark, folder), []
    _finish(M.stream_manifest(_stream(spark, folder, 1), lambda: catalog, lambda c, _: kept.append(c.images.count()), f"{folder}/state", availableNow=True))
    assert told == [limit > 0] and kept == [201]


def test_long_streams_are_waited_for(spark):
    """Longer than the limit in all, though batches go on ending."""
    folder = new_folder(spark)
    slow = _stream(spark, folder, 8).writeStream.foreachBatch(lambda df, _: (time.sleep(1), df.count()) and None)
    _finish(slow.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(), seconds=4)


def test_stuck_streams_are_an_error(spark):
    folder = new_folder(spark)
    stuck = _stream(spark, folder, 1).writeStream.foreachBatch(lambda df, _: time.sleep(9))
    with pytest.raises(TimeoutError):
        _finish(stuck.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(), seconds=2)


def test_documents_by_codes_read_images_once(spark):
    folder = new_folder(spark)
    catalog = _catalog(spark, folder)
    got = products_by_codes(catalog, spark.createDataFrame([(" A01-01 ",)] * 50 + [("A02-02",), ("",), (None,)], "style_code string"))
    assert [(r.style_code, r.image_count, len(r.images)) for r in got.collect()] == [("A01-01", 5, 5), ("A02-02", 5, 5)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
