"""Ranking steps defined by settings only. Their semantics are fixed here and marked INFERRED."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintshelf.functions import text as T
from tintshelf.functions.vector import dot
from tintshelf.operators import ivf
from tintshelf.operators.numbering import checkpointed

# ---- fixed values: hybrid weights (clip, shape, color, stripe) per query mode --------------------------
MODE_WEIGHTS = {
    "default": (0.82, 0.06, 0.02, 0.10),
    "region": (0.48, 0.12, 0.05, 0.35),
    "strict_small": (0.56, 0.32, 0.0, 0.12),
    "strip": (0.30, 0.30, 0.10, 0.30),
}


def _ranked(rows: DataFrame, score: str = "score", tie: str = "image_name") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w))


def _margins(results: DataFrame) -> DataFrame:
    """(query_id, top1, margin) from (query_id, rank, rank_score); margin is top1 itself for a single row."""
    two = results.filter(F.col("rank") <= 2).groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("rank_score"))).alias("top1"),
        F.max(F.when(F.col("rank") == 2, F.col("rank_score"))).alias("top2"),
    )
    return two.select("query_id", "top1", F.bround(F.col("top1") - F.coalesce("top2", F.lit(0.0)), 6).alias("margin"))


def adaptive_second_pass(
    queries: DataFrame, first: DataFrame, search_again: Callable[[DataFrame], DataFrame],
    top1_below: float = 0.72, margin_below: float = 0.02,
) -> DataFrame:
    """INFERRED. Queries with a weak or tight first result are searched again; their new rows replace the old."""
    first = checkpointed(first)  # a whole search, used three times
    weak = _margins(first).filter((F.col("top1") < top1_below) | (F.col("margin") < margin_below)).select("query_id")
    second = search_again(queries.join(weak, "query_id", "left_semi"))
    return first.join(weak, "query_id", "left_anti").unionByName(second)


def confidence_band(
    queries: DataFrame, results: DataFrame, high: float = 0.10, medium: float = 0.03,
    margin_below: float = 0.06, top1_below: float = 0.78,
) -> DataFrame:
    """INFERRED. (query_id, top1, margin, band, is_ambiguous); a query without rows is low and ambiguous."""
    m = queries.select("query_id").distinct().join(_margins(results), "query_id", "left")
    band = F.when(F.col("margin") >= high, "high").when(F.col("margin") >= medium, "medium").otherwise("low")
    unsure = (F.col("margin") < margin_below) | (F.col("top1") < top1_below)
    return m.select("query_id", "top1", "margin", band.alias("band"), F.coalesce(unsure, F.lit(True)).alias("is_ambiguous"))


def consistency_boost(ranked: DataFrame, similarities: DataFrame, weight: float, top_n: int) -> DataFrame:
    """INFERRED. Rows up to ``top_n`` gain weight * similarity(query_id, image_name, sim); others are unchanged.

    One operator for shape, mask, stripe, pattern, checker and colour consistency.
    """
    r = _ranked(ranked).join(similarities, ["query_id", "image_name"], "left")
    gain = F.when(F.col("rank") <= top_n, F.coalesce("sim", F.lit(0.0)) * weight).otherwise(F.lit(0.0))
    return r.select("query_id", "image_name", (F.col("score") + gain).alias("score"))


def average_hash(grid: DataFrame) -> DataFrame:
    """INFERRED. grid(image_id, cell 0..63, value) to (image_id, hash): bit i is set where cell i exceeds the mean."""
    mean = grid.groupBy("image_id").agg(F.avg("value").alias("mean"))
    bit = F.when(F.col("value") > F.col("mean"), F.expr("shiftleft(1L, cast(cell as int))")).otherwise(F.lit(0).cast("bigint"))
    # Bits are disjoint, so OR is the sum without overflow trouble at bit 63.
    return grid.join(mean, "image_id").groupBy("image_id").agg(F.bit_or(bit).alias("hash"))


def hash_boost(ranked: DataFrame, query_hashes: DataFrame, image_hashes: DataFrame, weight: float = 0.06, top_n: int = 160) -> DataFrame:
    """INFERRED. Adds weight * (1 - hamming / 64) to the first rows; query_hashes(query_id, hash), image_hashes(image_name, hash)."""
    r = _ranked(ranked).filter(F.col("rank") <= top_n)
    pairs = r.join(query_hashes.withColumnRenamed("hash", "_q"), "query_id").join(
        image_hashes.withColumnRenamed("hash", "_i"), "image_name"
    )
    sims = pairs.select("query_id", "image_name", (F.lit(1.0) - F.bit_count(F.col("_q").bitwiseXOR(F.col("_i"))) / 64.0).alias("sim"))
    return consistency_boost(ranked, sims, weight, top_n)


def region_code_prior(region: DataFrame, min_score: float = 0.74, boost: float = 0.08, top_codes: int = 8, match_mode: str = "similar_style") -> DataFrame:
    """INFERRED. region(query_id, image_name, score): the best codes at or above ``min_score`` as (query_id, code, boost).

    In ``exact`` mode the boost is scaled by 0.45.
    """
    best = region.filter(F.col("score") >= min_score).groupBy(
        "query_id", T.normalize_code(T.style_code_search(F.col("image_name"))).alias("code")
    ).agg(F.max("score").alias("score"))
    amount = boost * (0.45 if match_mode == "exact" else 1.0)
    return _ranked(best, tie="code").filter(F.col("rank") <= top_codes).select("query_id", "code", F.lit(amount).alias("boost"))


def region_rescue(results: DataFrame, region: DataFrame, min_score: float = 0.74, top_codes: int = 8, match_mode: str = "similar_style") -> DataFrame:
    """INFERRED. Strong region codes missing from (query_id, style_code, rank_score) are appended. ``exact`` appends none."""
    base = results.select("query_id", "style_code", "rank_score")
    if match_mode == "exact":
        return base
    best = region.filter(F.col("score") >= min_score).groupBy(
        "query_id", T.style_code_search(F.col("image_name")).alias("style_code")
    ).agg(F.max("score").alias("score"))
    top = _ranked(best, tie="style_code").filter(F.col("rank") <= top_codes)
    lost = top.join(base, ["query_id", "style_code"], "left_anti")
    return base.unionByName(lost.select("query_id", "style_code", F.col("score").alias("rank_score")))


def seed_candidates(ranked: DataFrame, patterns: DataFrame, base: float, scale: float, min_score: float, max_injected: int) -> DataFrame:
    """INFERRED. patterns(query_id, image_name, score) at or above ``min_score`` seed base + scale * score.

    Known images take the larger score; of the others the best ``max_injected`` seeds enter.
    (query_id, image_name, score, seeded).
    """
    seeds = patterns.filter(F.col("score") >= min_score).select(
        "query_id", "image_name", (F.col("score") * scale + base).alias("seed")
    )
    lifted = ranked.join(seeds, ["query_id", "image_name"], "left").select(
        "query_id", "image_name", F.greatest("score", "seed").alias("score"), F.lit(False).alias("seeded")
    )
    fresh = seeds.join(ranked, ["query_id", "image_name"], "left_anti").withColumnRenamed("seed", "score")
    fresh = _ranked(fresh).filter(F.col("rank") <= max_injected).drop("rank").withColumn("seeded", F.lit(True))
    return lifted.unionByName(fresh)


def suppress_seeds(candidates: DataFrame, region: DataFrame, min_score: float = 0.68, min_hits: int = 3) -> DataFrame:
    """INFERRED. Seeded rows go for queries whose region recall already has ``min_hits`` rows of ``min_score``."""
    sure = region.filter(F.col("score") >= min_score).groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_hits)
    plain = candidates.filter(~F.col("seeded"))
    return plain.unionByName(candidates.filter("seeded").join(sure.select("query_id"), "query_id", "left_anti"))


def crop_ratio(rect: dict[str, Column], box: dict[str, Column], image: dict[str, Column]) -> Column:
    """struct<x,y,w,h>: screen rectangle to image ratios for an image fitted into a view; null under 20 px.

    rect(left, top, width, height), box(width, height), image(width, height).
    """
    fit = F.least(box["width"] / image["width"], box["height"] / image["height"])
    drawn = {"x": image["width"] * fit, "y": image["height"] * fit}
    pad = {"x": (box["width"] - drawn["x"]) / 2, "y": (box["height"] - drawn["y"]) / 2}
    lo = {"x": F.greatest(rect["left"], pad["x"]), "y": F.greatest(rect["top"], pad["y"])}
    hi = {
        "x": F.least(rect["left"] + rect["width"], pad["x"] + drawn["x"]),
        "y": F.least(rect["top"] + rect["height"], pad["y"] + drawn["y"]),
    }

    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    big = (rect["width"] >= 20) & (rect["height"] >= 20) & (hi["x"] - lo["x"] >= 20) & (hi["y"] - lo["y"] >= 20)
    out = F.struct(
        *[unit((lo[a] - pad[a]) / drawn[a]).alias(a) for a in "xy"],
        *[unit((hi[a] - lo[a]) / drawn[a]).alias(n) for a, n in (("x", "w"), ("y", "h"))],
    )
    return F.when(big & (image["width"] > 0) & (image["height"] > 0), out)


def _clamp(c: Column, low, high) -> Column:
    low, high = [v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high)]
    return F.greatest(low, F.least(high, c))


def expand_crop(r: Column, x_scale: float = 2.0, y_scale: float = 2.4) -> Column:
    """struct<x,y,w,h>: the ratio box grown about its centre and moved inside the image."""
    w, h = _clamp(r["w"] * x_scale, 0.01, 1), _clamp(r["h"] * y_scale, 0.01, 1)
    x = _clamp(r["x"] + r["w"] / 2 - w / 2, 0, F.lit(1.0) - w)
    y = _clamp(r["y"] + r["h"] / 2 - h / 2, 0, F.lit(1.0) - h)
    return F.when(r.isNotNull(), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def crop_mode(
    r: Column, min_w: float = 0.38, min_h: float = 0.38, min_area: float = 0.14,
    small_area: float = 0.10, small_growth: float = 1.6, strip_aspect: float = 1.8, strip_max_h: float = 0.42,
) -> Column:
    """INFERRED. struct<x,y,w,h,strict_small,strip>: a small box grown to the minimum sides and area.

    Both sides grow by the same factor to reach ``min_area``; a wide box (aspect >= ``strip_aspect``) keeps its
    height at ``strip_max_h`` or less. strict_small: area at most ``small_area`` before and at least
    ``small_growth`` times that after.
    """
    area = r["w"] * r["h"]
    strip = r["w"] >= r["h"] * strip_aspect
    w, h = F.greatest(r["w"], F.lit(min_w)), F.greatest(r["h"], F.lit(min_h))
    grow = F.sqrt(F.greatest(F.lit(1.0), F.lit(min_area) / (w * h)))
    w, h = _clamp(w * grow, 0.01, 1), _clamp(h * grow, 0.01, 1)
    h = F.when(strip, F.greatest(r["h"], F.least(h, F.lit(strip_max_h)))).otherwise(h)
    x = _clamp(r["x"] + r["w"] / 2 - w / 2, 0, F.lit(1.0) - w)
    y = _clamp(r["y"] + r["h"] / 2 - h / 2, 0, F.lit(1.0) - h)
    small = (area <= small_area) & (w * h >= area * small_growth)
    return F.when(r.isNotNull(), F.struct(
        x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), small.alias("strict_small"), strip.alias("strip")
    ))


def weights_for_query(queries: DataFrame) -> DataFrame:
    """INFERRED. Add ``weights`` array<double> for queries(mode, ..); unknown modes get the default."""
    spark = queries.sparkSession
    table = spark.createDataFrame([(m, list(w)) for m, w in MODE_WEIGHTS.items()], "mode string, weights array<double>")
    fallback = F.array(*[F.lit(w) for w in MODE_WEIGHTS["default"]])
    # One row per mode, fixed.
    return queries.join(F.broadcast(table), "mode", "left").withColumn("weights", F.coalesce("weights", fallback))


def pca_reduce(vectors: DataFrame, size: int = 128) -> DataFrame:
    """Planned only. (key, embedding) projected on the first ``size`` principal components."""
    v = vectors.select("key", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return PCA(k=size, inputCol="v", outputCol="p").fit(v).transform(v).select("key", vector_to_array("p").alias("embedding"))


def ivf_topk(queries: DataFrame, catalog: DataFrame, k: int, clusters: int | None = None, nprobe: int | None = None, **options) -> DataFrame:
    """Planned only. Approximate top-k by an index built for this call: (query_id, image_name, score).

    Cells follow the rows and a quarter of them is probed unless given; ``options`` are those of ``search_ivf``. Store an
    index that serves more than one call with ``ivf.write_ivf``.
    """
    index = ivf.build_ivf(catalog.withColumnRenamed("image_name", "key"), cells=clusters)
    if index is None:
        return queries.select("query_id", F.lit("").alias("image_name"), F.lit(0.0).alias("score")).limit(0)
    found = ivf.search_ivf(queries, index, k, nprobe or max(1, index.cells // 4), **options)
    return found.withColumnRenamed("key", "image_name")
