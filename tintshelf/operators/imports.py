"""Folder import as set operations: propose codes, allocate names, drop known content, write the manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintshelf.functions import text as T
from tintshelf.operators import maintenance as M
from tintshelf.operators.catalog import Catalog
from tintshelf.operators.numbering import number_within, running_sums
from tintshelf.session import spread_scan
from tintshelf.sources.featurestore import FeatureStore

# ---- fixed values: statuses and messages ---------------------------------------------------------------
OK, INVALID, FAILED = "ok", "invalid_style_code", "ocr_failed"
NO_CODE_TEXT = "OCR 未识别到款号"
BAD_CODE_TEXT = "识别款号必须以字母开头"


def _proposal(mode: str) -> Column:
    """struct<code, source>: from the file name first, or from the recognised text with the file name behind."""
    name = T.code_from_filename(F.col("source_name"), "nas")
    text = F.coalesce(F.col("text"), F.lit(""))

    def option(code: Column, source: str) -> Column:
        # the code is worked out once, however often it is used
        return T.let(code, lambda c: F.when(c != "", F.struct(c.alias("code"), F.lit(source).alias("source"))))

    marked = T.let(F.coalesce(T.extract_hash_code(text), F.lit("")), lambda c: F.when(T.is_effective_code(c, "first"), c).otherwise(F.lit("")))
    from_text = [
        option(marked, "normal"),
        option(T.extract_style_code(text, hash_suffix=False), "prefixed_fallback"),
        option(T.code_before_hash(text, "first"), "hash_prefix"),
    ]
    from_name = F.when(name["code"] != "", name)
    order = [from_name, *from_text] if mode == "filename_first" else [*from_text, from_name]
    return F.coalesce(*order, F.struct(F.lit("").alias("code"), F.lit("").alias("source")))


def propose_codes(files: DataFrame, mode: str = "text_first") -> DataFrame:
    """files(root, path, text) to one row per file with proposed code, status, error and tags.

    ``text`` is the recognised text of the image, an input here. ``path`` includes ``root``.
    """
    f = spread_scan(files, "path").withColumn("source_name", F.regexp_replace("path", "^.*/", ""))
    f = f.withColumn("found", _proposal(mode))
    code = T.clean_code(F.col("found.code"), "first")
    valid = code.rlike("^[A-Z0-9][A-Z0-9_-]{2,}$")
    has = F.col("found.code") != ""
    prefix = F.when(has, T.filename_prefix(F.col("found.code"), "nas")).otherwise(
        T.filename_prefix(T.stem_of(F.col("source_name")), "standard")
    )
    return f.select(
        F.expr("substring(path, length(root) + 2)").alias("source_rel_path"), "source_name",
        T.image_suffix(F.col("source_name")).alias("suffix"),
        code.alias("proposed_style_code"),
        prefix.alias("prefix"),
        F.when(valid, OK).when(has, INVALID).otherwise(FAILED).alias("status"),
        F.when(valid, "").when(has, BAD_CODE_TEXT).otherwise(NO_CODE_TEXT).alias("error"),
        F.col("found.source").alias("source"),
        T.tags_from_path(F.col("root"), F.col("path")).alias("tags"),
        T.tag_display_from_path(F.col("root"), F.col("path")).alias("tag_display"),
        *[c for c in files.columns if c not in ("root", "path", "text")],
    )


def allocate_names(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``proposed_filename`` = prefix_NNN.ext, numbered in path order behind the highest number in use.

    files(source_rel_path, prefix, suffix, ..), existing(image_name), of which image files count. Prefixes that differ only in case share
    a counter, so no name collides without regard to case. A prefix of any share of the files is numbered
    across partitions.
    """
    pattern = r"(?s)^(.*)_(\d+)\.[^.]+$"
    images = existing.filter(T.suffix_of(F.col("image_name")).isin(*T.IMAGE_SUFFIXES))
    used = images.select(
        F.lower(F.regexp_extract("image_name", pattern, 1)).alias("_fold"),
        (F.regexp_extract("image_name", pattern, 2).try_cast("bigint") + 1).alias("start"),
    ).filter(F.col("start").isNotNull()).groupBy("_fold").agg(F.max("start").alias("start"))
    f = number_within(files.withColumn("_fold", F.lower("prefix")), ["_fold"], ["source_rel_path"], "_nth")
    f = f.join(used, "_fold", "left")
    n = (F.coalesce("start", F.lit(0)) + F.col("_nth")).cast("string")
    padded = F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0"))
    return f.withColumn("proposed_filename", F.concat("prefix", F.lit("_"), padded, "suffix")).drop("_fold", "_nth", "start")


def with_content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256))


def dedup_by_content(files: DataFrame, hash_index: DataFrame) -> DataFrame:
    """files(source_rel_path, hash, ..) whose hash is not in hash_index(hash); of equal contents the first path.

    The winner of a hash is a partial-aggregated minimum, so many copies of one file do not meet in one task.
    """
    rest = [c for c in files.columns if c not in ("hash", "source_rel_path")]
    firsts = files.groupBy("hash").agg(F.min(F.struct("source_rel_path", *rest)).alias("_f"))
    kept = firsts.join(hash_index.select("hash"), "hash", "left_anti")
    return kept.select(*[F.col("hash") if c == "hash" else F.col(f"_f.{c}").alias(c) for c in files.columns])


def import_manifest(prepared: DataFrame, hash_index: DataFrame) -> DataFrame:
    """Rows to import: valid codes, new content. prepared is ``allocate_names`` output with ``hash``."""
    kept = dedup_by_content(prepared.filter(F.col("status") == OK), hash_index)
    return kept.select(
        "source_rel_path", F.col("proposed_filename").alias("image_name"),
        T.strip(T.style_code_catalog(F.col("proposed_filename"))).alias("style_code"), "tags", "hash",
    )


def import_summary(prepared: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: imported, duplicates, failed. They add up to the number of files."""
    rows = prepared.select(F.when(F.col("status") == OK, "good").otherwise("failed").alias("kind"))
    rows = rows.unionByName(manifest.select(F.lit("imported").alias("kind")))
    n = {k: F.count_if(F.col("kind") == k) for k in ("good", "failed", "imported")}
    return rows.agg(n["imported"].alias("imported"), (n["good"] - n["imported"]).alias("duplicates"), n["failed"].alias("failed"))


def apply_manifest(catalog: Catalog, manifest: DataFrame, small: bool = False) -> tuple[Catalog, DataFrame]:
    """Nightly follow-up: sync the catalog with the imported images, then add the manifest's tags to their products.

    ``small`` as in ``sync_catalog``.
    """
    synced, stats = M.sync_catalog(manifest.select("image_name"), catalog, small=small)
    return M.add_tag_rows(manifest.select("style_code", F.explode("tags").alias("tag")), synced), stats


def nightly_follow_up(
    catalog: Catalog, manifest: DataFrame, features: FeatureStore, files: DataFrame,
    compute: Callable[[DataFrame], DataFrame], token: str | None = None,
) -> tuple[Catalog, DataFrame, DataFrame]:
    """``apply_manifest``, then the third step: features of new, changed and removed images are brought up to date.

    ``files`` is the listing (image_name, size, modified) after the import, ``compute`` makes feature rows of
    (image_name, signature); the last table returned says what became of every image (``FeatureStore.refresh``).
    """
    return *apply_manifest(catalog, manifest), features.refresh(files, compute, token)


def scan_progress(files: DataFrame, every: int = 50) -> DataFrame:
    """Progress lines of a scan: files(job_id, source_rel_path, outcome) with outcome success/failed/renamed.

    Already renamed files are counted apart and not processed. A line follows the first, every ``every``-th
    and the last processed file: (job_id, processed, total, success, failed, already_renamed).
    """
    totals = files.groupBy("job_id").agg(
        F.count_if(F.col("outcome") != "renamed").alias("total"),
        F.count_if(F.col("outcome") == "renamed").alias("already_renamed"),
    )
    todo = files.filter(F.col("outcome") != "renamed").select(
        "job_id", "source_rel_path", F.lit(1).alias("one"),
        (F.col("outcome") == "success").cast("int").alias("good"), (F.col("outcome") == "failed").cast("int").alias("bad"),
    )
    run = running_sums(todo, ["job_id"], ["source_rel_path"], {"processed": "one", "success": "good", "failed": "bad"})
    run = run.join(totals, "job_id")
    shown = (F.col("processed") == 1) | (F.col("processed") % every == 0) | (F.col("processed") == F.col("total"))
    return run.filter(shown).select("job_id", "processed", "total", "success", "failed", "already_renamed")
