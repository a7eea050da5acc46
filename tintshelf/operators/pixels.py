"""Image jobs as aggregations over a pixel table (image_id, y, x, r, g, b).

Sums and counts are plain groupBy aggregates, so partial aggregation shrinks the data before the shuffle
and one huge image is no hot spot. Windows only run over rows or columns of an image (neighbours) or over
already aggregated bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintshelf.functions import color as C

HSV_BINS = (12, 4, 4)
#: Side of the tiles that neighbourhoods are read in; about 1.6 % of the pixels are sent twice.
TILE = 256
#: Ranges of scores per doubling that a quantile is counted in.
RANGES = 4096


def _per_image():
    return Window.partitionBy("image_id")


def gray(r: Column, g: Column, b: Column) -> Column:
    return C.luma(r, g, b)


def _gray() -> Column:
    return gray(F.col("r"), F.col("g"), F.col("b"))


def _not_white() -> Column:
    return F.least("r", "g", "b") < 240


def image_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")
    )


def _hsv_bin() -> Column:
    hsv = C.rgb_to_hsv(F.col("r") / 255.0, F.col("g") / 255.0, F.col("b") / 255.0)
    part = [
        F.least(F.floor(hsv[name] * bins), F.lit(bins - 1)).cast("int") for name, bins in zip("hsv", HSV_BINS)
    ]
    return part[0] * (HSV_BINS[1] * HSV_BINS[2]) + part[1] * HSV_BINS[2] + part[2]


def _share(count: Column) -> Column:
    return count / (F.sum(count).over(_per_image()) + 1e-8)


def hsv_histogram(pixels: DataFrame) -> DataFrame:
    """(image_id, bin, value): share of the pixels per hue/saturation/value bin; empty bins have no row."""
    counts = pixels.groupBy("image_id", _hsv_bin().alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("image_id", "bin", _share(F.col("n")).alias("value"))


def garment_color_histogram(pixels: DataFrame, top_rows: int = 24, min_pixels: int = 32) -> DataFrame:
    """As ``hsv_histogram`` over non-white pixels below the top strip; all pixels when fewer than ``min_pixels``."""
    inside = (_not_white() & (F.col("y") >= top_rows)).cast("int")
    counts = pixels.groupBy("image_id", _hsv_bin().alias("bin")).agg(
        F.count("*").alias("every"), F.sum(inside).alias("inside")
    )
    enough = F.sum("inside").over(_per_image()) >= min_pixels
    counts = counts.withColumn("n", F.when(enough, F.col("inside")).otherwise(F.col("every"))).filter("n > 0")
    return counts.select("image_id", "bin", _share(F.col("n")).alias("value"))


def _tiles(pixels: DataFrame, side: int, *more: Column) -> DataFrame:
    """Gray level ``c`` of every pixel in its tile (ty, tx) and, for border pixels, in the tiles next to it; ``own`` marks
    the first. The one exchange of pixels: whatever looks at neighbours afterwards works inside a tile, and an image may
    spread over as many tasks as it has tiles."""
    near = [F.array_distinct(F.array(*[F.floor(F.greatest(F.col(n) + d, F.lit(0)) / side).cast("int") for d in (-1, 0, 1)])) for n in "yx"]
    p = pixels.select("image_id", "y", "x", _gray().alias("c"), *more, near[0].alias("ty"), near[1].alias("tx"))
    p = p.withColumn("ty", F.explode("ty")).withColumn("tx", F.explode("tx")).repartition("image_id", "ty", "tx")
    return p.withColumn("own", (F.floor(F.col("y") / side) == F.col("ty")) & (F.floor(F.col("x") / side) == F.col("tx")))


def _neighbours(tiles: DataFrame) -> DataFrame:
    """Left, right and the rows above and below of every pixel; null at the border. No exchange: rows and columns lie in tiles."""
    row = Window.partitionBy("image_id", "ty", "tx", "y").orderBy("x")
    column = Window.partitionBy("image_id", "ty", "tx", "x").orderBy("y")
    p = tiles.withColumn("w", F.lag("c").over(row)).withColumn("e", F.lead("c").over(row))
    line = F.struct("w", "c", "e")
    return p.withColumn("up", F.lag(line).over(column)).withColumn("down", F.lead(line).over(column))


_INNER = "own AND w IS NOT NULL AND e IS NOT NULL AND up IS NOT NULL AND down IS NOT NULL"


def _lbp_bin(bins: int) -> Column:
    ring = ("up.w", "up.c", "up.e", "e", "down.e", "down.c", "down.w", "w")
    code = sum(((F.col(n) >= F.col("c")).cast("int") * (1 << i) for i, n in enumerate(ring)), F.lit(0))
    return F.floor(code * bins / 256).cast("int")


def _edge(bins: int) -> tuple[Column, Column]:
    """Bin of the direction and size of the gradient."""
    gx, gy = F.col("e") - F.col("w"), F.col("down.c") - F.col("up.c")
    turn = (F.atan2(gy, gx) + math.pi) / (2.0 * math.pi)
    return F.least(F.floor(turn * bins), F.lit(bins - 1)).cast("int"), F.sqrt(gx * gx + gy * gy)


def lbp_histogram(pixels: DataFrame, bins: int = 16, tile: int = TILE) -> DataFrame:
    """Local binary patterns of interior pixels, clockwise from the upper left, squeezed to ``bins``. Images are full grids."""
    p = _neighbours(_tiles(pixels, tile)).filter(_INNER).select("image_id", _lbp_bin(bins).alias("bin"))
    counts = p.groupBy("image_id", "bin").agg(F.count("*").alias("n"))
    return counts.select("image_id", "bin", _share(F.col("n")).alias("value"))


def edge_histogram(pixels: DataFrame, bins: int = 18, tile: int = TILE) -> DataFrame:
    """Edge directions of interior pixels weighted by gradient size. Images are full grids."""
    way, size = _edge(bins)
    p = _neighbours(_tiles(pixels, tile)).filter(_INNER).select("image_id", way.alias("bin"), size.alias("size"))
    sums = p.groupBy("image_id", "bin").agg(F.sum("size").alias("n"))
    return sums.select("image_id", "bin", _share(F.col("n")).alias("value"))


def structure_grid(pixels: DataFrame, size: int = 24) -> DataFrame:
    """(image_id, cell, value): z-scored block means of the whole-number gray level.

    INFERRED: equal to a smooth down-sampling only where the image is an exact multiple of the grid.
    """
    p = pixels.join(image_sizes(pixels), "image_id")
    cell = F.floor(F.col("y") * size / F.col("height")) * size + F.floor(F.col("x") * size / F.col("width"))
    means = p.groupBy("image_id", cell.cast("int").alias("cell")).agg(F.avg(F.floor(_gray())).alias("m"))
    z = (F.col("m") - F.avg("m").over(_per_image())) / (F.stddev_pop("m").over(_per_image()) + 1e-6)
    return means.select("image_id", "cell", z.alias("value"))


def stripe_spectrum(pixels: DataFrame, top_rows: int = 24, min_pixels: int = 64, keep: int = 24) -> DataFrame:
    """(image_id, axis, k, value): frequency magnitudes of the masked row and column brightness profiles.

    Each axis is scaled to sum 1, then both together to unit length. Frequencies past N/2 have no row.
    """
    fg = (_not_white() & (F.col("y") >= top_rows)).cast("double")
    p = pixels.select("image_id", "y", "x", _gray().alias("v"), fg.alias("fg"))

    def profile(axis: str) -> DataFrame:
        return p.groupBy("image_id", F.lit(axis).alias("axis"), F.col(axis).alias("n")).agg(
            F.sum(F.col("v") * F.col("fg")).alias("vf"), F.sum("fg").alias("f"),
            F.sum("v").alias("v"), F.count("*").alias("c"),
        )

    lines = profile("y").unionByName(profile("x"))
    per_axis = Window.partitionBy("image_id", "axis")
    masked = F.sum("f").over(per_axis) >= min_pixels
    level = F.when(masked, F.col("vf") / F.greatest(F.col("f"), F.lit(1.0))).otherwise(F.col("v") / F.col("c"))
    lines = lines.select("image_id", "axis", "n", level.alias("level"), F.count("*").over(per_axis).alias("len"))
    lines = lines.withColumn("level", F.col("level") - F.avg("level").over(per_axis))
    last = F.least(F.lit(keep), F.floor(F.col("len") / 2).cast("int"))
    waves = lines.filter(last >= 1).withColumn("k", F.explode(F.sequence(F.lit(1), last)))
    turn = F.col("k") * F.col("n") * (2.0 * math.pi) / F.col("len")
    spec = waves.groupBy("image_id", "axis", "k").agg(
        F.sum(F.col("level") * F.cos(turn)).alias("re"), F.sum(F.col("level") * F.sin(turn)).alias("im")
    ).withColumn("mag", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    spec = spec.withColumn("mag", F.col("mag") / (F.sum("mag").over(per_axis) + 1e-8))
    length = F.sqrt(F.sum(F.col("mag") * F.col("mag")).over(_per_image())) + 1e-8
    return spec.select("image_id", "axis", "k", (F.col("mag") / length).alias("value"))


def classic_feature(pixels: DataFrame, grid: int = 24, tile: int = TILE) -> DataFrame:
    """(image_id, embedding): 0.8*hsv, lbp, edge, 0.5*grid side by side, unit length.

    Pixels are exchanged once, into tiles; the sizes of images, a partial aggregate, meet them there. All four parts leave
    the tiles as sums per (image, part, bin). Images are full grids.
    """
    n_hsv, n_lbp, n_edge = math.prod(HSV_BINS), 16, 18
    total = n_hsv + n_lbp + n_edge + grid * grid
    sizes = image_sizes(pixels)
    for n, length in (("ty", "height"), ("tx", "width")):
        sizes = sizes.withColumn(n, F.explode(F.sequence(F.lit(0), F.floor((F.col(length) - 1) / tile).cast("int"))))
    p = _neighbours(_tiles(pixels, tile, _hsv_bin().alias("hsv"))).filter("own").join(sizes, ["image_id", "ty", "tx"])

    cell = F.floor(F.col("y") * grid / F.col("height")) * grid + F.floor(F.col("x") * grid / F.col("width"))
    way, size = _edge(n_edge)

    def entry(part: int, at: Column, value: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), at.cast("int").alias("bin"), value.cast("double").alias("value"))

    one = F.lit(1.0)
    always = [entry(0, F.col("hsv"), one), entry(3, cell, F.floor("c"))]
    inner = [entry(1, _lbp_bin(n_lbp), one), entry(2, way, size)]
    found = p.select("image_id", F.explode(F.when(F.expr(_INNER), F.array(*always, *inner)).otherwise(F.array(*always))).alias("e"))
    sums = found.groupBy("image_id", "e.part", "e.bin").agg(F.sum("e.value").alias("n"), F.count("*").alias("rows"))

    per_part = Window.partitionBy("image_id", "part")
    mean = F.col("n") / F.col("rows")
    z = (mean - F.avg(mean).over(per_part)) / (F.stddev_pop(mean).over(per_part) + 1e-6)
    share = F.col("n") / (F.sum("n").over(per_part) + 1e-8)
    weight = F.when(F.col("part") == 0, 0.8).otherwise(1.0)
    start = F.element_at(F.array(*[F.lit(v) for v in (0, n_hsv, n_hsv + n_lbp, n_hsv + n_lbp + n_edge)]), F.col("part") + 1)
    rows = sums.select("image_id", (F.col("bin") + start).alias("at"), F.when(F.col("part") == 3, z * 0.5).otherwise(share * weight).alias("value"))
    # At most ``total`` entries per image.
    cells = rows.groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("cells"),
        (F.sqrt(F.sum(F.col("value") * F.col("value"))) + 1e-8).alias("length"),
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(total - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("cells"), i), F.lit(0.0)) / F.col("length"),
    )
    return cells.select("image_id", dense.alias("embedding"))


def _boxes(sizes: DataFrame, boxes: list[tuple[Column, Column, Column, Column]]) -> DataFrame:
    named = [
        F.struct(*[c.cast("int").alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))]) for box in boxes
    ]
    one = F.array_distinct(F.array(*named))
    return sizes.select("image_id", F.posexplode(one).alias("view", "box")).select("image_id", "view", "box.*")


def crop_boxes(sizes: DataFrame, ratio: float = 0.75) -> DataFrame:
    """(image_id, view, x0, y0, x1, y1): whole image, four corners, centre; equal boxes once. Sides are 32+ px."""
    w, h, zero = F.col("width"), F.col("height"), F.lit(0)
    cw, ch = [F.greatest(F.lit(32), F.floor(side * ratio).cast("int")) for side in (w, h)]
    right, low = F.greatest(zero, w - cw), F.greatest(zero, h - ch)
    mx, my = [F.greatest(zero, F.floor((side - c) / 2).cast("int")) for side, c in ((w, cw), (h, ch))]
    corners = [(x, y, x + cw, y + ch) for x, y in ((zero, zero), (right, zero), (zero, low), (right, low), (mx, my))]
    return _boxes(sizes, [(zero, zero, w, h), *corners])


def header_boxes(sizes: DataFrame) -> DataFrame:
    w, h, zero = F.col("width"), F.col("height"), F.lit(0)
    return _boxes(sizes, [(zero, zero, F.floor(w * a), F.floor(h * b)) for a, b in ((0.65, 0.20), (0.80, 0.25), (1.0, 0.30))])


def label_boxes(sizes: DataFrame) -> DataFrame:
    w, h, zero = F.col("width"), F.col("height"), F.lit(0)
    out = []
    for a, rest, b in ((0.42, 0.58, 0.24), (0.52, 0.48, 0.34)):
        out += [(zero, zero, F.floor(w * a), F.floor(h * b)), (F.floor(w * rest), zero, w, F.floor(h * b))]
    return _boxes(sizes, out)


def crop_pixels(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels of every box, moved to the box origin: (image_id, view, y, x, r, g, b). A few boxes per image."""
    inside = "x >= x0 AND x < x1 AND y >= y0 AND y < y1"
    return pixels.join(boxes, "image_id").filter(inside).select(
        "image_id", "view", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "r", "g", "b"
    )


def label_roi(pixels: DataFrame) -> DataFrame:
    """(image_id, x0, y0, x1, y1): padded box around the red pixels, the whole image when there are none."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    red = (r > 160) & (g < 150) & (b < 150) & (r - g > 35) & (r - b > 20)
    m = pixels.groupBy("image_id").agg(
        (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"),
        *[f(F.when(red, F.col(c))).alias(n) for f, c, n in (
            (F.min, "x", "l"), (F.min, "y", "t"), (F.max, "x", "r"), (F.max, "y", "b"))],
    )
    px = F.greatest(F.lit(4), F.floor((F.col("r") - F.col("l") + 1) * 0.04).cast("int"))
    py = F.greatest(F.lit(4), F.floor((F.col("b") - F.col("t") + 1) * 0.10).cast("int"))
    return m.select(
        "image_id",
        F.greatest(F.lit(0), F.coalesce(F.col("l") - px, F.lit(0))).alias("x0"),
        F.greatest(F.lit(0), F.coalesce(F.col("t") - py, F.lit(0))).alias("y0"),
        F.least(F.col("w"), F.coalesce(F.col("r") + px + 1, F.col("w"))).alias("x1"),
        F.least(F.col("h"), F.coalesce(F.col("b") + py + 1, F.col("h"))).alias("y1"),
    )


def has_label(pixels: DataFrame, keys=("image_id",), share: float = 0.035) -> DataFrame:
    """(keys, share, has_label): enough label-red or label-blue pixels."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    red = (r > 170) & (g < 130) & (b < 130) & (r - g > 45) & (r - b > 35)
    blue = (b > 150) & (g > 90) & (r < 130) & (b - r > 45)
    m = pixels.groupBy(*keys).agg(F.avg((red | blue).cast("double")).alias("share"))
    return m.withColumn("has_label", F.col("share") > share)


def dominant_color(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b) in 0..1: mean of pixels that are neither near white nor light gray, else of all."""
    mx, mn = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    floor = ((mx > 236) & (mn > 215)) | ((mx - mn < 10) & (mx > 170))
    mean = [
        F.bround(F.coalesce(F.avg(F.when(~floor, F.col(c))), F.avg(c)) / 255.0, 4).alias(c) for c in "rgb"
    ]
    return pixels.groupBy("image_id").agg(*mean)


def foreground_box(pixels: DataFrame, padding: float = 0.06) -> DataFrame:
    """(image_id, x0, y0, x1, y1): padded bounding box of pixels unlike the sampled border; null-free, no row if empty."""
    p = pixels.join(image_sizes(pixels), "image_id")
    step_x = F.greatest(F.lit(1), F.floor(F.col("width") / 12).cast("int"))
    step_y = F.greatest(F.lit(1), F.floor(F.col("height") / 12).cast("int"))
    on_x = (F.col("x") % step_x == 0).cast("int")
    on_y = (F.col("y") % step_y == 0).cast("int")
    weight = (
        on_x * ((F.col("y") == 0).cast("int") + (F.col("y") == F.col("height") - 1).cast("int"))
        + on_y * ((F.col("x") == 0).cast("int") + (F.col("x") == F.col("width") - 1).cast("int"))
    )
    p = p.withColumn("weight", weight)
    back = p.groupBy("image_id").agg(
        *[F.floor(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).cast("int").alias(f"b{c}") for c in "rgb"]
    )
    p = p.join(back, "image_id")
    apart = sum((F.abs(F.col(c) - F.col(f"b{c}")) for c in "rgb"), F.lit(0)) / 3.0
    spread = (F.greatest("r", "g", "b") - F.least("r", "g", "b")).cast("double")
    threshold = F.greatest(F.lit(22.0), F.least(F.lit(58.0), spread * 0.35 + 26.0))
    alpha = F.when(apart < threshold, 0).otherwise(F.floor(F.least(F.lit(255.0), (apart - threshold) * 5.2)))
    box = p.filter(alpha > 28).groupBy("image_id", "width", "height").agg(
        F.min("x").alias("l"), F.min("y").alias("t"), F.max("x").alias("r"), F.max("y").alias("b")
    ).filter("l < r AND t < b")
    pad = F.floor(F.greatest("width", "height") * padding).cast("int")
    return box.select(
        "image_id",
        F.greatest(F.lit(0), F.col("l") - pad).alias("x0"),
        F.greatest(F.lit(0), F.col("t") - pad).alias("y0"),
        F.least(F.col("width"), F.col("r") + pad + 1).alias("x1"),
        F.least(F.col("height"), F.col("b") + pad + 1).alias("y1"),
    )


def _rim_stats(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height, mean and mean square of r, g, b over the rim), all from sums of lines.

    A pixel counts once for each side of the rim it lies on, so sums of whole rows and columns are enough: an image
    leaves width + height rows behind, and its size is known before the rim is.
    """
    lines = pixels.select("image_id", "r", "g", "b", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("int").alias("n")) for a in "yx"])).alias("line"))
    sums = lines.groupBy("image_id", "line.axis", "line.n").agg(
        F.count("*").alias("k"), *[F.sum(c).alias(f"s{c}") for c in "rgb"], *[F.sum(F.col(c) * F.col(c)).alias(f"t{c}") for c in "rgb"],
    )
    height, width = [F.max(F.when(F.col("axis") == a, F.col("n") + 1)).over(_per_image()) for a in "yx"]
    sums = sums.withColumn("height", height).withColumn("width", width)
    rim = F.greatest(F.lit(2), F.rint(F.least("height", "width") * 0.08).cast("int"))
    length = F.when(F.col("axis") == "y", F.col("height")).otherwise(F.col("width"))
    sums = sums.withColumn("on", (F.col("n") < rim).cast("int") + (F.col("n") >= length - rim).cast("int"))
    k = F.sum(F.col("k") * F.col("on"))
    return sums.groupBy("image_id", "height", "width").agg(
        *[(F.sum(F.col(f"s{c}") * F.col("on")) / k).alias(f"m{c}") for c in "rgb"], *[(F.sum(F.col(f"t{c}") * F.col("on")) / k).alias(f"q{c}") for c in "rgb"],
    )


def _quantile(values: DataFrame, at: float) -> DataFrame:
    """(image_id, cut): the exact quantile, between neighbours linear, of the non-null ``score`` >= 0 of every image.

    Scores are counted in ranges; the ranges that hold the two ranks are chosen from these counts and only their scores are
    counted by value. No image is sorted or held in one task: a window sees the ranges of an image (a few ten thousand at
    most) or the different scores of two of them.
    """
    v = values.filter("score IS NOT NULL").select("image_id", "score", F.floor(F.log2(F.col("score") + 1.0) * RANGES).alias("range"))
    upwards = Window.partitionBy("image_id").orderBy("range")
    counts = v.groupBy("image_id", "range").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(upwards) - F.col("n")).withColumn("place", (F.sum("n").over(_per_image()) - 1) * at)
    picked = counts.filter((F.col("before") <= F.ceil("place")) & (F.col("before") + F.col("n") > F.floor("place"))).drop("n")
    inside = v.join(picked, ["image_id", "range"]).groupBy("image_id", "score", "before", "place").agg(F.count("*").alias("n"))
    running = F.min("before").over(_per_image()) + F.sum("n").over(Window.partitionBy("image_id").orderBy("score"))
    inside = inside.withColumn("upto", running)
    low, high = [F.min(F.when(F.col("upto") > f("place"), F.col("score"))) for f in (F.floor, F.ceil)]
    ends = inside.groupBy("image_id").agg(low.alias("low"), high.alias("high"), F.first("place").alias("place"))
    share = F.col("place") - F.floor("place")
    between = (F.ceil("place") - F.col("place")) * F.col("low") + share * F.col("high")
    return ends.select("image_id", F.when((F.col("low") == F.col("high")) | (share == 0), F.col("low")).otherwise(between).alias("cut"))


def subject_score(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, score, subject): colour distance from the border weighted to the centre, and its mask.

    Pixels meet one row per image twice, its rim and its cut; the cut comes from counts (``_quantile``).
    """
    p = pixels.join(_rim_stats(pixels), "image_id")
    z2 = F.lit(0.0)
    for c in "rgb":
        # Whole-number sums, so the variance by squares loses nothing before the division.
        sigma = F.sqrt(F.greatest(F.lit(0.0), F.col(f"q{c}") - F.col(f"m{c}") * F.col(f"m{c}"))) / 255.0 + 1e-4
        z = (F.col(c) - F.col(f"m{c}")) / 255.0 / sigma
        z2 = z2 + z * z
    nx = (F.col("x") - (F.col("width") - 1) * 0.5) / F.greatest(F.lit(1.0), F.col("width") * 0.48)
    ny = (F.col("y") - (F.col("height") - 1) * 0.5) / F.greatest(F.lit(1.0), F.col("height") * 0.48)
    score = F.sqrt(z2) * (F.exp(-(nx * nx + ny * ny)) * 0.9 + 0.65)
    p = p.select("image_id", "y", "x", score.alias("score"))
    return p.join(_quantile(p, 0.72), "image_id", "left").withColumn(
        "subject", F.col("score") > F.greatest(F.lit(0.6), F.col("cut"))
    ).drop("cut")


def soft_mask(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column, feather: int) -> Column:
    """1 inside the box, falling to 0 over ``feather`` pixels outside it; 0 everywhere for an empty box."""
    zero = F.lit(0)
    dx = F.greatest(x0 - x, x - (x1 - 1), zero)
    dy = F.greatest(y0 - y, y - (y1 - 1), zero)
    inside = (dx == 0) & (dy == 0)
    far = F.sqrt((dx * dx + dy * dy).cast("double"))
    fall = F.greatest(F.lit(0.0), F.lit(1.0) - far / float(feather)) if feather > 0 else F.lit(0.0)
    empty = (x1 <= x0) | (y1 <= y0)
    return F.when(empty, F.lit(0.0)).when(inside, F.lit(1.0)).otherwise(fall)


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _target(hex_color: str):
    import colorsys

    bare = hex_color.strip().lstrip("#")
    if len(bare) != 6:
        raise ValueError("a target colour needs 6 hex digits")
    return colorsys.rgb_to_hsv(*[int(bare[i : i + 2], 16) / 255.0 for i in (0, 2, 4)])


def recolor_hsv(r: Column, g: Column, b: Column, mask: Column, target: str, strength: float, boost: float = 0.15) -> Column:
    """struct<r,g,b> in 0..1: hue moved to the target along the shorter arc, saturation blended, value kept."""
    th, ts, _ = _target(target)
    alpha = _unit(mask) * max(0.0, min(1.0, strength))
    hsv = C.rgb_to_hsv(r, g, b)
    arc = F.pmod(F.lit(th) - hsv["h"] + 0.5, F.lit(1.0)) - 0.5
    sat = hsv["s"] * (F.lit(1.0) - alpha) + alpha * (ts + (1.0 - ts) * boost)
    return C.hsv_to_rgb(hsv["h"] + arc * alpha, _unit(sat), hsv["v"])


def recolor_fabric(r: Column, g: Column, b: Column, mask: Column, target: str, strength: float) -> Column:
    """struct<r,g,b> in 0..1: target hue with the fabric's own light and shade; bright parts lose saturation."""
    th, ts, _ = _target(target)
    s = max(0.0, min(1.0, strength))
    share = 0.45 + 0.55 * s
    hsv = C.rgb_to_hsv(r, g, b)
    damp = F.lit(1.0) - _unit((hsv["v"] - 0.7) / 0.3) * 0.55
    sat = (hsv["s"] * (1.0 - share) + share * ts) * damp * (0.85 + 0.35 * s)
    sat = F.greatest(F.lit(0.0), F.least(F.lit(0.96), sat))
    new = C.hsv_to_rgb(F.lit(th), sat, _unit(hsv["v"] * (0.97 - 0.02 * s) + (0.03 + 0.02 * s)))
    alpha = _unit(F.pow(_unit(mask) * s, F.lit(0.85)) * (0.88 + 0.12 * s))
    return F.struct(*[
        _unit(c * (F.lit(1.0) - alpha) + new[n] * alpha).alias(n) for n, c in (("r", r), ("g", g), ("b", b))
    ])


def blend_background(original: dict[str, Column], edited: dict[str, Column], mask: Column) -> Column:
    """struct<r,g,b>: the edit inside the mask, untouched pixels outside; the mask has 256 levels."""
    alpha = F.floor(_unit(mask) * 255.0) / 255.0
    return F.struct(*[
        _unit(edited[n] * alpha + original[n] * (F.lit(1.0) - alpha)).alias(n) for n in "rgb"
    ])
