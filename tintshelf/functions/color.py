"""Colour functions (Column -> Column); everything stays in JVM column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: CIE / sRGB constants (D65) ------------------------------------------------------
WHITE_X, WHITE_Z = 0.95047, 1.08883
XYZ_TO_RGB = (
    (3.2406, -1.5372, -0.4986),
    (-0.9689, 1.8758, 0.0415),
    (0.0557, -0.2040, 1.0570),
)


def lab_to_rgb(l: Column, a: Column, b: Column, rounding: str = "even") -> Column:
    """struct<r,g,b> 0..255. ``even`` rounds ties to even, ``up`` rounds ties up."""
    fy = (l + 16.0) / 116.0

    def cube(v: Column) -> Column:
        return F.when(v > 6 / 29, F.pow(v, F.lit(3.0))).otherwise((v - 16 / 116) / 7.787)

    x, y, z = cube(a / 500.0 + fy) * WHITE_X, cube(fy), cube(fy - b / 200.0) * WHITE_Z

    def channel(row) -> Column:
        lin = x * row[0] + y * row[1] + z * row[2]
        v = F.when(lin > 0.0031308, F.pow(lin, F.lit(1 / 2.4)) * 1.055 - 0.055).otherwise(lin * 12.92) * 255
        n = F.rint(v) if rounding == "even" else F.floor(v + 0.5)
        return F.greatest(F.lit(0), F.least(F.lit(255), n.cast("int")))

    return F.struct(*[channel(row).alias(n) for row, n in zip(XYZ_TO_RGB, "rgb")])


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    def two(c: Column) -> Column:
        n = F.greatest(F.lit(0), F.least(F.lit(255), F.coalesce(c.cast("int"), F.lit(0))))
        return F.lpad(F.hex(n), 2, "0")

    return F.concat(two(r), two(g), two(b))


def lab_to_hex(l: Column, a: Column, b: Column, rounding: str = "even") -> Column:
    rgb = lab_to_rgb(l, a, b, rounding)
    return rgb_to_hex(rgb["r"], rgb["g"], rgb["b"])


def _chroma_weight(c: Column) -> Column:
    seventh = F.pow(c, F.lit(7.0))
    return F.sqrt(seventh / (seventh + float(25 ** 7)))


def _hue(ap: Column, b: Column) -> Column:
    deg = F.degrees(F.atan2(b, ap))
    return F.when((ap == 0) & (b == 0), F.lit(0.0)).when(deg < 0, deg + 360).otherwise(deg)


def _delta_e_stages():
    """CIEDE2000 (published formula, kL = kC = kH = 1) as stages; each names values the later ones reuse."""
    def cosd(x: Column) -> Column:
        return F.cos(F.radians(x))

    def spread(v):
        return F.pow(v["lm"] - 50, F.lit(2.0))

    yield {"g": lambda v: (F.lit(1.0) - _chroma_weight(
        (F.sqrt(v["a1"] * v["a1"] + v["b1"] * v["b1"]) + F.sqrt(v["a2"] * v["a2"] + v["b2"] * v["b2"])) / 2)) * 0.5 + 1}
    yield {"p1": lambda v: v["a1"] * v["g"], "p2": lambda v: v["a2"] * v["g"]}
    yield {
        "c1": lambda v: F.sqrt(v["p1"] * v["p1"] + v["b1"] * v["b1"]),
        "c2": lambda v: F.sqrt(v["p2"] * v["p2"] + v["b2"] * v["b2"]),
        "h1": lambda v: _hue(v["p1"], v["b1"]), "h2": lambda v: _hue(v["p2"], v["b2"]),
    }
    yield {
        "flat": lambda v: (v["c1"] * v["c2"]) == 0, "gap": lambda v: v["h2"] - v["h1"],
        "total": lambda v: v["h1"] + v["h2"], "lm": lambda v: (v["l1"] + v["l2"]) / 2, "cm": lambda v: (v["c1"] + v["c2"]) / 2,
    }
    yield {
        "dh": lambda v: F.when(v["flat"], 0.0).when(F.abs(v["gap"]) <= 180, v["gap"])
        .when(v["gap"] <= 0, v["gap"] + 360).otherwise(v["gap"] - 360),
        "hm": lambda v: F.when(v["flat"], v["total"]).when(F.abs(v["gap"]) <= 180, v["total"] / 2)
        .when(v["total"] < 360, (v["total"] + 360) / 2).otherwise((v["total"] - 360) / 2),
    }
    yield {
        "dl": lambda v: (v["l2"] - v["l1"]) / (F.lit(1.0) + spread(v) * 0.015 / F.sqrt(spread(v) + 20)),
        "dc": lambda v: (v["c2"] - v["c1"]) / (F.lit(1.0) + v["cm"] * 0.045),
        "t": lambda v: F.lit(1.0) - cosd(v["hm"] - 30) * 0.17 + cosd(v["hm"] * 2) * 0.24
        + cosd(v["hm"] * 3 + 6) * 0.32 - cosd(v["hm"] * 4 - 63) * 0.20,
        "rt": lambda v: -F.sin(F.radians(F.exp(-F.pow((v["hm"] - 275) / 25, F.lit(2.0))) * 60)) * _chroma_weight(v["cm"]) * 2,
    }
    yield {"dhh": lambda v: F.sqrt(v["c1"] * v["c2"]) * F.sin(F.radians(v["dh"] / 2)) * 2 / (F.lit(1.0) + v["cm"] * v["t"] * 0.015)}
    # The quadratic form is non-negative; greatest() only guards against rounding below 0.
    yield {"de": lambda v: F.sqrt(F.greatest(
        v["dl"] * v["dl"] + v["dc"] * v["dc"] + v["dhh"] * v["dhh"] + v["rt"] * v["dc"] * v["dhh"], F.lit(0.0)))}


_DE_INPUTS = ("l1", "a1", "b1", "l2", "a2", "b2")


def delta_e_2000(l1: Column, a1: Column, b1: Column, l2: Column, a2: Column, b2: Column) -> Column:
    """CIEDE2000 difference as one expression. Over many rows ``with_delta_e`` is far cheaper."""
    v = dict(zip(_DE_INPUTS, (l1, a1, b1, l2, a2, b2)))
    for stage in _delta_e_stages():
        v.update({name: fn(v) for name, fn in stage.items()})
    return v["de"]


def with_delta_e(df: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], name: str = "delta_e_00") -> DataFrame:
    """Add the CIEDE2000 difference of two Lab column triples, one projection per stage so nothing is computed twice."""
    v = {k: F.col(c) for k, c in zip(_DE_INPUTS, (*first, *second))}
    columns = df.columns
    for stage in _delta_e_stages():
        df = df.select("*", *[fn(v).alias(f"_de_{n}") for n, fn in stage.items()])
        v.update({n: F.col(f"_de_{n}") for n in stage})
    return df.select(*columns, F.col("_de_de").alias(name))


def normalize_hex(text: Column) -> Column:
    """Six upper-case hex digits, or null."""
    bare = F.upper(F.regexp_replace(text, "^#", ""))
    return F.when(bare.rlike("^[0-9A-F]{6}$"), bare)


def hex_to_rgb(text: Column) -> Column:
    """struct<r,g,b>, null when the text is not six hex digits."""
    h = normalize_hex(text)
    parts = [F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int").alias(n) for i, n in enumerate("rgb")]
    return F.when(h.isNotNull(), F.struct(*parts))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct<h,s,v> from channels in 0..1; h in 0..1."""
    mx, mn = F.greatest(r, g, b), F.least(r, g, b)
    d = mx - mn
    sextant = (
        F.when(d == 0, F.lit(0.0))
        .when(mx == r, F.pmod((g - b) / d, F.lit(6.0)))
        .when(mx == g, (b - r) / d + 2)
        .otherwise((r - g) / d + 4)
    )
    s = F.when(mx == 0, F.lit(0.0)).otherwise(d / mx)
    return F.struct((sextant / 6).alias("h"), s.alias("s"), mx.alias("v"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """struct<r,g,b> in 0..1 from h in turns (any real), s and v in 0..1."""
    six = F.pmod(h, F.lit(1.0)) * 6

    def channel(n: float) -> Column:
        k = F.pmod(six + n, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))

    return F.struct(channel(5.0).alias("r"), channel(3.0).alias("g"), channel(1.0).alias("b"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def is_dark(text: Column) -> Column:
    """True below luma 150; an unreadable colour counts as dark."""
    rgb = hex_to_rgb(text)
    return F.coalesce(luma(rgb["r"], rgb["g"], rgb["b"]) < 150, F.lit(True))


def ink_for(l: Column) -> Column:
    return F.when(F.coalesce(l, F.lit(0.0)) < 55, F.lit("#FFFFFF")).otherwise(F.lit("#0F172A"))
