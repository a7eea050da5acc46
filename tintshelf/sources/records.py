"""Record sources and sinks: labels, manifests, hash index, colour sheets, features, text index, models."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintshelf.functions import text as T
from tintshelf.operators.learn import PairModel

MANIFEST_SCHEMA = (
    "source_rel_path string, image_name string, style_code string, tags array<string>, "
    "imported_at string, manifest_job_id string"
)
HASH_INDEX_SCHEMA = "hash string, image_name string, indexed_at string"
SHEET_REQUIRED = ("名称", "L", "a", "b")
SHEET_OPTIONAL = {"备注": "note", "光源": "illuminant", "角度": "angle"}


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(query_image, style_code) of a JSON document with a ``labels`` list; blank codes are dropped."""
    doc = spark.read.schema("labels array<struct<query_image:string, style_code:string>>").json(path, multiLine=True)
    return doc.select(F.inline("labels")).withColumn("style_code", T.strip(F.col("style_code"))).filter("style_code <> ''")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query_image, style_code) of a JSON document with a ``query_gt`` map."""
    doc = spark.read.schema("query_gt map<string,string>").json(path, multiLine=True)
    return doc.select(F.explode("query_gt").alias("query_image", "style_code")).filter("trim(style_code) <> ''")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Import manifest lines; broken lines are skipped."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path, mode="DROPMALFORMED")


def write_manifest(rows: DataFrame, path: str, job_id: str) -> None:
    """Append manifest rows as JSON lines."""
    stamped = rows.withColumn("imported_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    stamped.withColumn("manifest_job_id", F.lit(job_id)).select(
        "source_rel_path", "image_name", "style_code", "tags", "imported_at", "manifest_job_id"
    ).write.mode("append").json(path)


def read_hash_index(spark: SparkSession, path: str) -> DataFrame:
    """(hash, image_name): broken or blank lines are skipped, the earliest entry of a hash counts."""
    rows = spark.read.schema(HASH_INDEX_SCHEMA).json(path, mode="DROPMALFORMED")
    rows = rows.filter("trim(hash) <> '' AND trim(image_name) <> ''")
    return rows.groupBy("hash").agg(F.min(F.struct("indexed_at", "image_name"))["image_name"].alias("image_name"))


def write_hash_index(rows: DataFrame, path: str) -> None:
    stamped = rows.select("hash", "image_name", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("indexed_at"))
    stamped.write.mode("append").json(path)


def load_color_sheet(sheet: DataFrame) -> DataFrame:
    """Tabular colour sheet to (name, note, illuminant, angle, l, a, b, spectral).

    Rows with a blank name or non-numeric Lab are dropped; every ``<n>nm`` column becomes a spectral point,
    without the cells that are empty or not numbers.
    """
    by_header = {c.strip(): c for c in sheet.columns}
    missing = [c for c in SHEET_REQUIRED if c not in by_header]
    if missing:
        raise ValueError(f"colour sheet lacks columns: {', '.join(missing)}")

    def cell(header: str):
        return F.col(f"`{by_header[header]}`")

    waves = [h for h in by_header if re.fullmatch(r"\d+nm", h)]
    points = [
        F.struct(F.lit(int(h[:-2])).alias("wavelength"), cell(h).try_cast("double").alias("value")) for h in waves
    ]
    spectral = F.array(*points) if points else F.array().cast("array<struct<wavelength:int,value:double>>")
    optional = [
        (cell(h).cast("string") if h in by_header else F.lit("")).alias(name) for h, name in SHEET_OPTIONAL.items()
    ]
    rows = sheet.select(
        T.strip(F.coalesce(cell("名称").cast("string"), F.lit(""))).alias("name"), *optional,
        *[cell(h).try_cast("double").alias(h.lower()) for h in ("L", "a", "b")],
        F.filter(spectral, lambda p: p["value"].isNotNull()).alias("spectral"),
    )
    return rows.filter("name <> '' AND l IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")


def settings_key(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


def write_features(features: DataFrame, path: str, settings: dict) -> None:
    """Store (image_name, view, style_code, embedding, ..) under the key of the settings that made them."""
    keyed = features.withColumn("settings_key", F.lit(settings_key(settings)))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("settings_key").parquet(path)


def read_features(spark: SparkSession, path: str, settings: dict) -> DataFrame:
    """Features of exactly these settings (a partition filter); no rows for other settings."""
    return spark.read.parquet(path).filter(F.col("settings_key") == settings_key(settings)).drop("settings_key")


def write_text_index(postings: DataFrame, idf: DataFrame, path: str) -> None:
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    idf.write.mode("overwrite").parquet(f"{path}/idf")


def read_text_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/idf")


MODEL_SCHEMA = "weights array<double>, intercept double, mean array<double>, std array<double>"


def save_model(spark: SparkSession, model: PairModel, path: str) -> None:
    row = (list(model.weights), model.intercept, list(model.mean), list(model.std))
    spark.createDataFrame([row], MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> PairModel:
    r = spark.read.schema(MODEL_SCHEMA).parquet(path).first()
    return PairModel(tuple(r["weights"]), r["intercept"], tuple(r["mean"]), tuple(r["std"]))


def write_training_report(metrics: DataFrame, path: str, config: dict) -> None:
    """One JSON line {metrics, config}."""
    rows = metrics.select(F.struct("*").alias("metrics"), F.from_json(F.lit(json.dumps(config)), "map<string,string>").alias("config"))
    rows.coalesce(1).write.mode("overwrite").json(path)


def read_training_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "metrics struct<samples:bigint,pos_rate:double,train_acc:double>, config map<string,string>"
    ).json(path)
