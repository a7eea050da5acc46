"""Vector search, score fusion and per-code ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintshelf.functions import text as T
from tintshelf.operators.blocks import Keep, similarity_join


def recall_size(k: int, multiplier: int, cap: int, n: int) -> int:
    """How many images to recall for k codes (a plan-time number)."""
    size = min(n, max(k * max(multiplier, 1), k))
    return min(size, cap) if cap > 0 else size


def recall_sizes(k: Column, multiplier: int, cap: Column, n: Column) -> Column:
    """``recall_size`` as a column."""
    size = F.least(n, k * max(multiplier, 1))
    return F.when(cap > 0, F.least(size, cap)).otherwise(size).cast("bigint")


def topk_vectors(queries: DataFrame, catalog: DataFrame, k: int, consensus: float = 0.0, **options) -> DataFrame:
    """k best catalog images per query by inner product: (query_id, image_name, score).

    Several rows per ``query_id`` are views of one query; they are fused per image as in ``fuse_views``
    before the cut, so the cut is exact.
    """
    keep = Keep(k=k, consensus=max(0.0, min(1.0, consensus)))
    pairs = similarity_join(queries, catalog.withColumnRenamed("image_name", "key"), keep, **options)
    return pairs.withColumnRenamed("key", "image_name")


def fuse_views(scores: DataFrame, weight: float = 0.0) -> DataFrame:
    """(query_id, view, image_name, score) to one score: max, or (1-w)*max + w*mean."""
    w = max(0.0, min(1.0, weight))
    top = F.max("score")
    fused = top if w <= 1e-6 else top * (1.0 - w) + F.avg("score") * w
    return scores.groupBy("query_id", "image_name").agg(fused.alias("score"))


def merge_ranked(primary: DataFrame, secondary: DataFrame, weight: float = 0.9) -> DataFrame:
    """Best of the primary score and the damped secondary score."""
    damped = secondary.withColumn("score", F.col("score") * max(0.0, weight))
    return primary.unionByName(damped).groupBy("query_id", "image_name").agg(F.max("score").alias("score"))


def rank_style_codes(ranked: DataFrame, top_n: int = 3, alpha: float = 0.7) -> DataFrame:
    """(query_id, image_name, score) to (query_id, style_code, best_image, raw_score)."""
    r = ranked.withColumn("style_code", T.style_code_search(F.col("image_name")))
    w = Window.partitionBy("query_id", "style_code").orderBy(F.desc("score"), "image_name")
    r = r.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max(1, top_n))
    best = F.max("score")
    return r.groupBy("query_id", "style_code").agg(
        F.substring_index(F.max(F.when(F.col("_rn") == 1, F.col("image_name"))), "@", 1).alias("best_image"),
        (best * alpha + F.avg("score") * (1.0 - alpha)).alias("raw_score"),
    )


def apply_hint_boost(codes: DataFrame, hints: DataFrame, boost: float) -> DataFrame:
    """``hints``: (query_id, hint_code), at most one per query. Adds ``boost`` to the code the hint names."""
    hit = T.normalize_code(F.col("style_code")) == F.col("hint_code")
    return (
        codes.join(hints, "query_id", "left")
        .withColumn("raw_score", F.col("raw_score") + F.when(hit, F.lit(boost)).otherwise(F.lit(0.0)))
        .drop("hint_code")
    )


def apply_code_prior(codes: DataFrame, prior: DataFrame) -> DataFrame:
    """``prior``: (query_id, code, boost) with normalised codes, one row per pair."""
    p = prior.select("query_id", F.col("code").alias("_code"), F.col("boost").alias("_boost"))
    return (
        codes.withColumn("_code", T.normalize_code(F.col("style_code")))
        .join(p, ["query_id", "_code"], "left")
        .withColumn("raw_score", F.col("raw_score") + F.coalesce(F.col("_boost"), F.lit(0.0)))
        .drop("_code", "_boost")
    )


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), z))))


def display_score(codes: DataFrame, scale: float = 8.0, bias: float = 0.72) -> DataFrame:
    """raw_score to the bounded ``score`` (4 dp) and the ordering ``rank_score`` (6 dp)."""
    prob = logistic((F.col("raw_score") - bias) * scale)
    return codes.withColumn("score", F.bround(F.least(F.lit(0.9999), prob), 4)).withColumn(
        "rank_score", F.bround("raw_score", 6)
    ).drop("raw_score")


def final_topk(codes: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "style_code")
    kept = codes.filter(F.col("rank_score") >= min_score)
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def label_memory_prior(
    queries: DataFrame, labels: DataFrame, threshold: float = 0.9, max_boost: float = 0.08, **options
) -> DataFrame:
    """Labels (style_code, embedding) near a query lift their code: linear ramp above the threshold, best per code.

    The best similarity per (query, code) is taken inside every block, and the ramp is monotone, so nothing
    but one row per pair leaves a task.
    """
    coded = labels.withColumn("key", T.normalize_code(F.col("style_code"))).filter(F.col("key") != "")
    best = similarity_join(queries, coded.select("key", "embedding"), Keep(floor=threshold), **options)
    ramp = F.least(F.lit(1.0), (F.col("score") - threshold) / max(1e-6, 1.0 - threshold))
    return best.select("query_id", F.col("key").alias("code"), (ramp * max_boost).alias("boost"))


def cap_unique_codes(ranked: DataFrame, top_n: int, max_codes: int) -> DataFrame:
    """Within the first ``top_n`` rows of a query keep the first row of each code, up to ``max_codes`` codes.

    Rows after ``top_n`` are untouched. ``rank`` is the position before the cut.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "image_name")
    r = ranked.withColumn("style_code", T.style_code_search(F.col("image_name"))).withColumn(
        "rank", F.row_number().over(order)
    )
    if max_codes <= 0:
        return r
    head = F.col("rank") <= top_n
    first = F.row_number().over(Window.partitionBy("query_id", "style_code").orderBy("rank")) == 1
    r = r.withColumn("_lead", (head & first).cast("int"))
    nth = F.sum("_lead").over(Window.partitionBy("query_id").orderBy("rank"))
    r = r.withColumn("_nth", nth)
    return r.filter(~head | ((F.col("_lead") == 1) & (F.col("_nth") <= max_codes))).drop("_lead", "_nth")


def first_per_code(rows: DataFrame, limit: int = 9) -> DataFrame:
    """Client list: first row per upper-cased code in rank order, at most ``limit``, numbered again."""
    r = rows.withColumn("_key", F.upper(T.strip(F.col("style_code")))).filter(F.col("_key") != "")
    w = Window.partitionBy("query_id", "_key").orderBy("rank")
    r = r.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return r.withColumn("rank", again).filter(F.col("rank") <= limit).drop("_key", "_rn")


def dedup_views(views: DataFrame) -> DataFrame:
    """(query_id, view, width, height, mean) without views of the same size and whole-number mean; the first stays."""
    key = ["query_id", "width", "height", "mean_level"]
    v = views.withColumn("mean_level", F.floor("mean").cast("int"))
    return v.groupBy(*key).agg(F.min("view").alias("view"))
