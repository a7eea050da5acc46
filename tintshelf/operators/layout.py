"""Print slots and garment measurements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------------------------------
MM_TO_PT = 2.83464567
PAPERS_MM = {"A4": (210, 297), "A5": (148, 210), "4R": (102, 152)}
TEMPLATES = {
    "single_full": (1, 1),
    "two_vertical": (2, 1),
    "two_horizontal": (1, 2),
    "grid_2x2": (2, 2),
    "grid_3x3": (3, 3),
}
# dimension, label, fallback in cm
DIMENSIONS = (
    ("bodyLength", "衣长", 68),
    ("shoulderWidth", "肩宽", 45),
    ("chestWidth", "胸宽", 52),
    ("hemWidth", "下摆宽", 50),
    ("leftSleeveLength", "左袖长", 22),
    ("rightSleeveLength", "右袖长", 22),
    ("neckWidth", "领宽", 18),
)
FALLBACK_CM = {name: cm for name, _, cm in DIMENSIONS}
DEFAULT_TEXT = "使用标准 T 恤比例"


def print_slots(spark: SparkSession) -> DataFrame:
    """(paper, template, slot, x, y, width, height) in points for every paper and template; slot 0 is top left."""
    papers = spark.createDataFrame([(p, w * MM_TO_PT, h * MM_TO_PT) for p, (w, h) in PAPERS_MM.items()], "paper string, page_w double, page_h double")
    layouts = spark.createDataFrame([(t, r, c) for t, (r, c) in TEMPLATES.items()], "template string, rows int, cols int")
    # 3 papers x 5 templates, both fixed.
    both = papers.withColumn("_k", F.lit(1)).join(F.broadcast(layouts.withColumn("_k", F.lit(1))), "_k")
    cells = both.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1)))
    width, height = F.col("page_w") / F.col("cols"), F.col("page_h") / F.col("rows")
    row = F.floor(F.col("slot") / F.col("cols"))
    return cells.select(
        "paper", "template", "slot",
        (F.col("slot") % F.col("cols") * width).alias("x"),
        ((F.col("rows") - 1 - row) * height).alias("y"),
        width.alias("width"), height.alias("height"),
    )


def assign_slots(placements: DataFrame, slots: int = 9) -> DataFrame:
    """placements(job_id, seq, image_id, slot_index) to (job_id, slot, image_id).

    A valid slot keeps the last image placed there; empty slots are filled by going round the used images in
    slot order, or round all images in placement order when no slot was valid.
    """
    p = placements.withColumn("image_id", F.trim(F.col("image_id"))).filter(F.col("image_id") != "")
    valid = p.filter(F.col("slot_index").between(0, slots - 1))
    taken = valid.groupBy("job_id", F.col("slot_index").alias("slot")).agg(
        F.max(F.struct("seq", "image_id"))["image_id"].alias("image_id")
    )
    by_slot = Window.partitionBy("job_id").orderBy("slot")
    used = taken.select("job_id", "image_id", (F.row_number().over(by_slot) - 1).alias("nth"))
    # Only the first ``slots`` images of a job can be used to fill it.
    by_seq = Window.partitionBy("job_id").orderBy("seq")
    loose = p.join(taken.select("job_id").distinct(), "job_id", "left_anti")
    loose = loose.select("job_id", "image_id", (F.row_number().over(by_seq) - 1).alias("nth")).filter(F.col("nth") < slots)
    used = used.unionByName(loose)
    counts = used.groupBy("job_id").agg(F.count("*").alias("n"))
    every = counts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    every = every.join(taken, ["job_id", "slot"], "left")
    gap = F.sum(F.col("image_id").isNull().cast("int")).over(by_slot) - 1
    gaps = every.withColumn("nth", F.when(F.col("image_id").isNull(), gap % F.col("n")))
    fill = used.select("job_id", "nth", F.col("image_id").alias("fill"))
    return gaps.join(fill, ["job_id", "nth"], "left").select(
        "job_id", "slot", F.coalesce("image_id", "fill").alias("image_id")
    )


def parse_measurements(text: Column) -> Column:
    """JSON object of numbers to map<string,double>; null for anything else."""
    return F.transform_values(F.from_json(text, "map<string,string>"), lambda _, v: v.try_cast("double"))


def latest_measurements(events: DataFrame) -> DataFrame:
    """events(garment_id, ts, payload JSON) to (garment_id, map of the latest value per known dimension)."""
    rows = events.select("garment_id", "ts", F.explode(parse_measurements(F.col("payload"))).alias("dim", "cm"))
    rows = rows.filter(F.col("dim").isin(*FALLBACK_CM) & F.col("cm").isNotNull())
    last = rows.groupBy("garment_id", "dim").agg(F.max(F.struct("ts", "cm"))["cm"].alias("cm"))
    return last.groupBy("garment_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "cm"))).alias("dims"))


def measurement_cm(dims: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(dims, F.lit(name)), F.lit(float(FALLBACK_CM[name])))


def measurements(garments: DataFrame) -> DataFrame:
    """One column per dimension, the fixed fallback where nothing was measured."""
    return garments.select("garment_id", *[measurement_cm(F.col("dims"), n).alias(n) for n in FALLBACK_CM])


def garment_params(garments: DataFrame) -> DataFrame:
    """garments(garment_id, 7 cm columns) to 16 shirt parameters in metres."""
    def metres(name: str) -> Column:
        return F.greatest(F.lit(1.0), F.col(name)) / 100.0

    base = garments.select(
        "garment_id",
        metres("bodyLength").alias("body"), metres("shoulderWidth").alias("shoulder"),
        metres("chestWidth").alias("chest"), metres("hemWidth").alias("hem"),
        ((metres("leftSleeveLength") + metres("rightSleeveLength")) / 2.0).alias("sleeve"),
        metres("neckWidth").alias("neck"),
    )
    body, sleeve = F.col("body"), F.col("sleeve")
    top = body / 2.0

    def at_least(floor: float, value: Column) -> Column:
        return F.greatest(F.lit(floor), value)

    return base.select(
        "*",
        top.alias("top_y"), (-top).alias("bottom_y"),
        (top - at_least(0.045, body * 0.08)).alias("shoulder_y"),
        (top - at_least(0.16, body * 0.29)).alias("underarm_y"),
        (F.col("shoulder") / 2.0).alias("shoulder_half"),
        (F.col("chest") / 2.0).alias("chest_half"),
        (F.col("hem") / 2.0).alias("hem_half"),
        at_least(0.12, sleeve * 1.06).alias("sleeve_reach"),
        at_least(0.09, sleeve * 0.68).alias("sleeve_drop"),
        at_least(0.055, sleeve * 0.36).alias("cuff_h"),
    )


def half_width_at(y: Column) -> Column:
    """Half width of the shirt at height ``y``, from the columns of ``garment_params``."""
    def along(low: str, high: str) -> Column:
        return (y - F.col(low)) / F.greatest(F.lit(1e-6), F.col(high) - F.col(low))

    def mix(a: Column, b: Column, t: Column) -> Column:
        return a * (F.lit(1.0) - t) + b * t

    low = along("bottom_y", "underarm_y")
    waist = F.lit(1.0) - F.sin(F.greatest(F.lit(0.0), F.least(F.lit(1.0), low)) * math.pi) * 0.035
    return (
        F.when(y <= F.col("underarm_y"), mix(F.col("hem_half"), F.col("chest_half"), low) * waist)
        .when(y <= F.col("shoulder_y"), mix(F.col("chest_half"), F.col("shoulder_half"), along("underarm_y", "shoulder_y")))
        .otherwise(mix(F.col("shoulder_half"), F.col("neck") * 0.45, along("shoulder_y", "top_y")) + F.col("body") * 0.015)
    )


def measurement_text(dims: Column) -> Column:
    """Measured values as text in fixed order, or the default sentence."""
    parts = [
        F.concat(F.lit(label + " "), F.format_string("%.1f", F.try_element_at(dims, F.lit(name))), F.lit(" cm"))
        for name, label, _ in DIMENSIONS
    ]
    parts = [F.when(F.try_element_at(dims, F.lit(d[0])).isNotNull(), p) for d, p in zip(DIMENSIONS, parts)]
    joined = F.concat_ws("，", *parts)
    return F.when(joined == "", F.lit(DEFAULT_TEXT)).otherwise(joined)


def proportion_scale(garments: DataFrame) -> DataFrame:
    """(garment_id, width, length, depth): measured over fallback, each clamped."""
    def ratio(names: tuple[str, ...], low: float, high: float) -> Column:
        measured = F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
        return F.greatest(F.lit(low), F.least(F.lit(high), measured / float(max(FALLBACK_CM[n] for n in names))))

    return garments.select(
        "garment_id",
        ratio(("shoulderWidth", "chestWidth", "hemWidth"), 0.72, 1.35).alias("width"),
        ratio(("bodyLength",), 0.72, 1.35).alias("length"),
        ratio(("chestWidth",), 0.78, 1.28).alias("depth"),
    )


def point_distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance of two points given by their coordinates (2 or 3)."""
    total = F.lit(0.0)
    for p, q in zip(a, b):
        total = total + (p - q) * (p - q)
    return F.sqrt(total)
