"""Image jobs over all embeddings seen as 8 x 8 images."""

from pyspark.sql import functions as F

from checks.base import Data, query
from checks.color import HSV
from tintshelf.operators import pixels as P

GRAY = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"
BIN = f"{HSV}, binned AS (SELECT image_id, y, least(greatest(p.r, p.g, p.b), 999) AS _m, least(p.r, p.g, p.b) AS mn, " + (
    "least(floor(h * 12), 11)::INT * 16 + least(floor(s * 4), 3)::INT * 4 + least(floor(v * 4), 3)::INT AS bin FROM hsv JOIN pixels p USING (image_id, y, x))"
)


@query("gray", f"SELECT image_id, y, x, round({GRAY}, 6) AS level FROM pixels")
def _(d: Data):
    level = P.gray(F.col("r"), F.col("g"), F.col("b"))
    return d.pixels().select("image_id", "y", "x", F.round(level, 6).alias("level"))


def _r(df, c="value", n=6):
    return df.withColumn(c, F.round(c, n))


@query("hsv_histogram", f"WITH {BIN} SELECT image_id, bin, round(count(*) / (64 + 1e-8::DOUBLE), 6) AS value FROM binned GROUP BY ALL")
def _(d):
    return _r(P.hsv_histogram(d.pixels()))


@query("garment_color_histogram", f"""WITH {BIN}, n AS (SELECT image_id, bin, count(*) AS every, sum((mn < 240 AND y >= 4)::INT) AS inside FROM binned GROUP BY ALL),
    c AS (SELECT image_id, bin, CASE WHEN sum(inside) OVER (PARTITION BY image_id) >= 30 THEN inside ELSE every END AS k FROM n)
    SELECT image_id, bin, round(k / (sum(k) OVER (PARTITION BY image_id) + 1e-8::DOUBLE), 6) AS value FROM c WHERE k > 0""")
def _(d):
    return _r(P.garment_color_histogram(d.pixels(), top_rows=4, min_pixels=30))


def _near(dy, dx):
    return f"(SELECT c FROM lit n WHERE n.image_id = p.image_id AND n.y = p.y + ({dy}) AND n.x = p.x + ({dx}))"


_LIT = f"lit AS (SELECT image_id, y, x, {GRAY} AS c FROM pixels)"
_RING = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
_JOINS = " ".join(f"JOIN lit n{i} ON n{i}.image_id = p.image_id AND n{i}.y = p.y + ({dy}) AND n{i}.x = p.x + ({dx})" for i, (dy, dx) in enumerate(_RING))
_CODE = " + ".join(f"(n{i}.c >= p.c)::INT * {1 << i}" for i in range(8))


@query("lbp_histogram", f"""WITH {_LIT}, codes AS (SELECT p.image_id, (({_CODE}) * 16 // 256)::INT AS bin FROM lit p {_JOINS})
    SELECT image_id, bin, round(count(*) / (36 + 1e-8::DOUBLE), 6) AS value FROM codes GROUP BY ALL""")
def _(d):
    return _r(P.lbp_histogram(d.pixels()))


@query("edge_histogram", f"""WITH {_LIT}, g AS (SELECT p.image_id, n3.c - n7.c AS gx, n5.c - n1.c AS gy FROM lit p {_JOINS}),
    e AS (SELECT image_id, least(floor((atan2(gy, gx) + pi()) / (2 * pi()) * 18), 17)::INT AS bin, sum(sqrt(gx * gx + gy * gy)) AS n FROM g GROUP BY ALL)
    SELECT image_id, bin, round(n / (sum(n) OVER (PARTITION BY image_id) + 1e-8::DOUBLE), 6) AS value FROM e""")
def _(d):
    return _r(P.edge_histogram(d.pixels()))


@query("structure_grid", f"""WITH m AS (SELECT image_id, ((y // 2) * 4 + x // 2)::INT AS cell, avg(floor({GRAY})) AS m FROM pixels GROUP BY ALL)
    SELECT image_id, cell, round((m - avg(m) OVER w) / (stddev_pop(m) OVER w + 1e-6::DOUBLE), 6) AS value FROM m WINDOW w AS (PARTITION BY image_id)""")
def _(d):
    return _r(P.structure_grid(d.pixels(), 4))


_PROFILE = f"SELECT image_id, '{{axis}}' AS axis, {{axis}} AS n, sum({GRAY} * fg) AS vf, sum(fg) AS f, sum({GRAY}) AS v, count(*) AS c FROM fgd GROUP BY ALL"


@query("stripe_spectrum", f"""WITH fgd AS (SELECT *, (least(r, g, b) < 240 AND y >= 2)::INT AS fg FROM pixels),
    lines AS ({_PROFILE.format(axis='y')} UNION ALL {_PROFILE.format(axis='x')}),
    levels AS (SELECT image_id, axis, n, CASE WHEN sum(f) OVER (PARTITION BY image_id, axis) >= 40 THEN vf / greatest(f, 1) ELSE v / c END AS level FROM lines),
    centred AS (SELECT image_id, axis, n, level - avg(level) OVER (PARTITION BY image_id, axis) AS level FROM levels),
    spec AS (SELECT image_id, axis, k, sqrt(pow(sum(level * cos(2 * pi() * k * n / 8)), 2) + pow(sum(level * sin(2 * pi() * k * n / 8)), 2)) AS mag
      FROM centred, generate_series(1, 4) g(k) GROUP BY ALL),
    scaled AS (SELECT image_id, axis, k, mag / (sum(mag) OVER (PARTITION BY image_id, axis) + 1e-8::DOUBLE) AS mag FROM spec)
    SELECT image_id, axis, k::INT AS k, round(mag / (sqrt(sum(mag * mag) OVER (PARTITION BY image_id)) + 1e-8::DOUBLE), 6) AS value FROM scaled""")
def _(d):
    return _r(P.stripe_spectrum(d.pixels(), top_rows=2, min_pixels=40))


@query("classic_feature", f"""WITH {BIN}, {_LIT},
    h AS (SELECT image_id, bin AS at, 0.8::DOUBLE * count(*) / (64 + 1e-8::DOUBLE) AS value FROM binned GROUP BY ALL),
    codes AS (SELECT p.image_id, (({_CODE}) * 16 // 256)::INT AS bin FROM lit p {_JOINS}),
    lb AS (SELECT image_id, 192 + bin AS at, count(*) / (36 + 1e-8::DOUBLE) AS value FROM codes GROUP BY ALL),
    slope AS (SELECT p.image_id, n3.c - n7.c AS gx, n5.c - n1.c AS gy FROM lit p {_JOINS}),
    edges AS (SELECT image_id, least(floor((atan2(gy, gx) + pi()) / (2 * pi()) * 18), 17)::INT AS bin, sum(sqrt(gx * gx + gy * gy)) AS n FROM slope GROUP BY ALL),
    ed AS (SELECT image_id, 208 + bin AS at, n / (sum(n) OVER (PARTITION BY image_id) + 1e-8::DOUBLE) AS value FROM edges),
    cells AS (SELECT image_id, ((y // 2) * 4 + x // 2)::INT AS cell, avg(floor({GRAY})) AS mean FROM pixels GROUP BY ALL),
    gr AS (SELECT image_id, 226 + cell AS at, 0.5::DOUBLE * (mean - avg(mean) OVER w) / (stddev_pop(mean) OVER w + 1e-6::DOUBLE) AS value FROM cells WINDOW w AS (PARTITION BY image_id)),
    pieces AS (SELECT * FROM h UNION ALL SELECT * FROM lb UNION ALL SELECT * FROM ed UNION ALL SELECT * FROM gr),
    lengths AS (SELECT image_id, sqrt(sum(value * value)) + 1e-8::DOUBLE AS length FROM pieces GROUP BY image_id)
    SELECT l.image_id, i::INT AS at, round(coalesce(value, 0) / length, 6) AS value FROM lengths l CROSS JOIN generate_series(0, 241) s(i)
      LEFT JOIN pieces p ON p.image_id = l.image_id AND p.at = i""")
def _(d):
    """Every number of every image's vector."""
    f = P.classic_feature(d.pixels(), 4)
    return _r(f.select("image_id", F.posexplode("embedding").alias("at", "value")))


def _sizes(d: Data):
    """A large image per order."""
    return d.table("orders").select(
        F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 700 + 20).cast("int").alias("width"), (F.col("o_orderkey") % 500 + 20).cast("int").alias("height")
    )


_SIZES = "sizes AS (SELECT o_orderkey AS image_id, (o_custkey % 700 + 20)::INT AS w, (o_orderkey % 500 + 20)::INT AS h FROM orders)"


def _box_rows(boxes):
    return " UNION ALL ".join(f"SELECT image_id, {i} AS i, {x0} AS x0, {y0} AS y0, {x1} AS x1, {y1} AS y1 FROM c" for i, (x0, y0, x1, y1) in enumerate(boxes))


_CROPS = [("0", "0", "w", "h"), ("0", "0", "cw", "ch"), ("rx", "0", "rx + cw", "ch"), ("0", "ly", "cw", "ly + ch"), ("rx", "ly", "rx + cw", "ly + ch"), ("mx", "my", "mx + cw", "my + ch")]


@query("crop_boxes", f"""WITH {_SIZES}, c0 AS (SELECT *, greatest(32, floor(w * 0.72::DOUBLE)::INT) AS cw, greatest(32, floor(h * 0.72::DOUBLE)::INT) AS ch FROM sizes),
    c AS (SELECT *, greatest(0, w - cw) AS rx, greatest(0, h - ch) AS ly, greatest(0, floor((w - cw) / 2)::INT) AS mx, greatest(0, floor((h - ch) / 2)::INT) AS my FROM c0),
    b AS ({_box_rows(_CROPS)}), u AS (SELECT image_id, min(i) AS i, x0, y0, x1, y1 FROM b GROUP BY ALL)
    SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY i) - 1)::INT AS view, x0, y0, x1, y1 FROM u""")
def _(d):
    return P.crop_boxes(_sizes(d), 0.72)


_HEAD = [("0", "0", f"floor(w * {a}::DOUBLE)::INT", f"floor(h * {b}::DOUBLE)::INT") for a, b in ((0.65, 0.20), (0.80, 0.25), (1.0, 0.30))]
_LABEL = []
for _a, _b, _c in ((0.42, 0.58, 0.24), (0.52, 0.48, 0.34)):
    _LABEL += [("0", "0", f"floor(w * {_a}::DOUBLE)::INT", f"floor(h * {_c}::DOUBLE)::INT"), (f"floor(w * {_b}::DOUBLE)::INT", "0", "w", f"floor(h * {_c}::DOUBLE)::INT")]


def _numbered(rows):
    return f"b AS ({rows}), u AS (SELECT image_id, min(i) AS i, x0, y0, x1, y1 FROM b GROUP BY ALL) SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY i) - 1)::INT AS view, x0, y0, x1, y1 FROM u"


@query("header_boxes", f"WITH {_SIZES}, c AS (SELECT * FROM sizes), {_numbered(_box_rows(_HEAD))}")
def _(d):
    return P.header_boxes(_sizes(d))


@query("label_boxes", f"WITH {_SIZES}, c AS (SELECT * FROM sizes), {_numbered(_box_rows(_LABEL))}")
def _(d):
    return P.label_boxes(_sizes(d))


@query("crop_pixels", """WITH b(view, x0, y0, x1, y1) AS (VALUES (0, 0, 0, 3, 1), (1, 4, 0, 8, 1), (2, 0, 0, 4, 2), (3, 3, 0, 8, 2))
    SELECT image_id, view, y - y0 AS y, x - x0 AS x, r, g, b.b AS b FROM (SELECT image_id, y, x, r, g, pixels.b FROM pixels) AS b, b AS bx WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1""".replace("FROM pixels) AS b, b AS bx", "FROM pixels) AS b JOIN b AS bx ON true"))
def _(d):
    p = d.pixels()
    return P.crop_pixels(p, P.label_boxes(P.image_sizes(p)))


_RED = "(r > 160 AND g < 150 AND b < 150 AND r - g > 35 AND r - b > 20)"


@query("label_roi", f"""WITH m AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h, min(CASE WHEN {_RED} THEN x END) AS l, min(CASE WHEN {_RED} THEN y END) AS t,
      max(CASE WHEN {_RED} THEN x END) AS rr, max(CASE WHEN {_RED} THEN y END) AS bb FROM pixels GROUP BY image_id),
    p AS (SELECT *, greatest(4, floor((rr - l + 1) * 0.04::DOUBLE)::INT) AS px, greatest(4, floor((bb - t + 1) * 0.1::DOUBLE)::INT) AS py FROM m)
    SELECT image_id, coalesce(CASE WHEN l - px < 0 THEN 0 ELSE l - px END, 0) AS x0, coalesce(CASE WHEN t - py < 0 THEN 0 ELSE t - py END, 0) AS y0,
      coalesce(CASE WHEN rr + px + 1 > w THEN w ELSE rr + px + 1 END, w) AS x1, coalesce(CASE WHEN bb + py + 1 > h THEN h ELSE bb + py + 1 END, h) AS y1 FROM p""")
def _(d):
    return P.label_roi(d.pixels())


@query("has_label", """SELECT image_id, round(avg(((r > 170 AND g < 130 AND b < 130 AND r - g > 45 AND r - b > 35) OR (b > 150 AND g > 90 AND r < 130 AND b - r > 45))::INT), 6) AS share,
    avg(((r > 170 AND g < 130 AND b < 130 AND r - g > 45 AND r - b > 35) OR (b > 150 AND g > 90 AND r < 130 AND b - r > 45))::INT) > 0.035::DOUBLE AS has_label FROM pixels GROUP BY image_id""")
def _(d):
    return _r(P.has_label(d.pixels()), "share")


_FLOOR = "((greatest(r, g, b) > 236 AND least(r, g, b) > 215) OR (greatest(r, g, b) - least(r, g, b) < 10 AND greatest(r, g, b) > 170))"


@query("dominant_color", "SELECT image_id, " + ", ".join(
    f"round_even(coalesce(avg(CASE WHEN NOT {_FLOOR} THEN {c} END), avg({c})) / 255, 4)::DOUBLE AS {c}" for c in "rgb") + " FROM pixels GROUP BY image_id")
def _(d):
    return P.dominant_color(d.pixels())


@query("foreground_box", """WITH w AS (SELECT *, (y = 0)::INT + (y = 7)::INT + (x = 0)::INT + (x = 7)::INT AS k FROM pixels),
    back AS (SELECT image_id, floor(sum(r * k) / sum(k))::INT AS br, floor(sum(g * k) / sum(k))::INT AS bg, floor(sum(b * k) / sum(k))::INT AS bb FROM w GROUP BY image_id),
    a AS (SELECT *, (abs(r - br) + abs(g - bg) + abs(b - bb)) / 3.0::DOUBLE AS apart, greatest(22.0::DOUBLE, least(58.0::DOUBLE, (greatest(r, g, b) - least(r, g, b)) * 0.35::DOUBLE + 26.0::DOUBLE)) AS thr FROM pixels JOIN back USING (image_id)),
    f AS (SELECT image_id, min(x) AS l, min(y) AS t, max(x) AS rr, max(y) AS lo FROM a WHERE apart >= thr AND floor(least(255.0::DOUBLE, (apart - thr) * 5.2::DOUBLE)) > 28 GROUP BY image_id)
    SELECT image_id, greatest(0, l - 1) AS x0, greatest(0, t - 1) AS y0, least(8, rr + 2) AS x1, least(8, lo + 2) AS y1 FROM f WHERE l < rr AND t < lo""")
def _(d):
    return P.foreground_box(d.pixels(), padding=0.13)


_SC = "(SELECT image_id, " + ", ".join(
    f"sum({c} * k)::DOUBLE / sum(k) AS m{c}, sum({c} * {c} * k)::DOUBLE / sum(k) AS q{c}" for c in "rgb") + " FROM w GROUP BY image_id)"
_Z = " + ".join(f"pow(({c} - m{c}) / 255 / (sqrt(greatest(0, q{c} - m{c} * m{c})) / 255 + 1e-4::DOUBLE), 2)" for c in "rgb")


@query("subject_score", f"""WITH w AS (SELECT *, (y < 2)::INT + (y >= 6)::INT + (x < 2)::INT + (x >= 6)::INT AS k FROM pixels), st AS {_SC},
    s AS (SELECT image_id, y, x, sqrt({_Z}) * (0.65::DOUBLE + 0.9::DOUBLE * exp(-(pow((x - 3.5::DOUBLE) / 3.84::DOUBLE, 2) + pow((y - 3.5::DOUBLE) / 3.84::DOUBLE, 2)))) AS score FROM pixels JOIN st USING (image_id)),
    c AS (SELECT image_id, quantile_cont(score, 0.72) AS cut FROM s GROUP BY image_id)
    SELECT image_id, y, x, round(score, 6) AS score, score > greatest(0.6::DOUBLE, cut) AS subject FROM s JOIN c USING (image_id)""")
def _(d):
    return _r(P.subject_score(d.pixels()), "score")


def _mask(feather=3):
    box = [F.lit(v) for v in (2, 1, 5, 6)]
    return P.soft_mask(F.col("x"), F.col("y"), *box, feather)


_DX, _DY = "greatest(2 - x, x - 4, 0)", "greatest(1 - y, y - 5, 0)"
MASK = f"greatest(0.0::DOUBLE, 1 - sqrt({_DX} * {_DX} + {_DY} * {_DY}) / 3)"


@query("soft_mask", f"SELECT image_id, y, x, round({MASK}, 6) AS mask FROM pixels")
def _(d):
    return d.pixels().select("image_id", "y", "x", F.round(_mask(), 6).alias("mask"))


def _hsv_back(h, s, v):
    def channel(n):
        k = f"(({n} + ({h}) * 6) - 6 * floor(({n} + ({h}) * 6) / 6))"
        return f"(({v}) - ({v}) * ({s}) * greatest(0, least({k}, 4 - {k}, 1)))"

    return channel(5), channel(3), channel(1)


# Target FF5500: hue 1/18, saturation 1.
_ALPHA = f"({MASK} * 0.8::DOUBLE)"
_R1 = _hsv_back("nh", "ns", "v")


@query("recolor_hsv", f"""WITH {HSV}, a AS (SELECT *, {_ALPHA} AS al FROM hsv),
    t AS (SELECT *, (1.0::DOUBLE / 18 - h + 0.5) - floor(1.0::DOUBLE / 18 - h + 0.5) - 0.5 AS arc FROM a),
    n AS (SELECT image_id, y, x, v, h + arc * al AS nh, least(1, s * (1 - al) + al) AS ns FROM t)
    SELECT image_id, y, x, round({_R1[0]}, 5) AS r, round({_R1[1]}, 5) AS g, round({_R1[2]}, 5) AS b FROM n""")
def _(d):
    out = P.recolor_hsv(*[F.col(c) / 255.0 for c in "rgb"], _mask(), "#FF5500", 0.8)
    return d.pixels().select("image_id", "y", "x", out.alias("c")).select("image_id", "y", "x", *[F.round(f"c.{c}", 5).alias(c) for c in "rgb"])


_R2 = _hsv_back("1.0::DOUBLE / 18", "ns", "nv")
_SOFT = f"least(1.0::DOUBLE, pow({_ALPHA}, 0.85::DOUBLE) * (0.88::DOUBLE + 0.12::DOUBLE * 0.8::DOUBLE))"
FABRIC = f"""{HSV}, n AS MATERIALIZED (SELECT *, {_SOFT} AS al, greatest(0, least(0.96::DOUBLE, (s * (1 - 0.89::DOUBLE) + 0.89::DOUBLE) * (1 - 0.55::DOUBLE * greatest(0, least(1, (v - 0.7::DOUBLE) / 0.3::DOUBLE))) * 1.13::DOUBLE)) AS ns,
      least(1.0::DOUBLE, v * 0.954::DOUBLE + 0.046::DOUBLE) AS nv FROM hsv),
    fab AS MATERIALIZED (SELECT image_id, y, x, r * (1 - al) + {_R2[0]} * al AS r, g * (1 - al) + {_R2[1]} * al AS g, b * (1 - al) + {_R2[2]} * al AS b FROM n)"""


def _fabric():
    return P.recolor_fabric(*[F.col(c) / 255.0 for c in "rgb"], _mask(), "FF5500", 0.8)


@query("recolor_fabric", f"WITH {FABRIC} SELECT image_id, y, x, round(r, 5) AS r, round(g, 5) AS g, round(b, 5) AS b FROM fab")
def _(d):
    return d.pixels().select("image_id", "y", "x", _fabric().alias("c")).select("image_id", "y", "x", *[F.round(f"c.{c}", 5).alias(c) for c in "rgb"])


_BLENDED = ", ".join(f"round(f.{c} * m + p.{c} / 255.0::DOUBLE * (1 - m), 5) AS {c}" for c in "rgb")


@query("blend_background", f"""WITH {FABRIC}, p AS MATERIALIZED (SELECT image_id, y, x, r, g, b, floor({MASK} * 255) / 255 AS m FROM pixels)
    SELECT image_id, y, x, {_BLENDED} FROM fab f JOIN p USING (image_id, y, x)""")
def _(d):
    p = d.pixels().withColumn("e", _fabric())
    out = P.blend_background({c: F.col(c) / 255.0 for c in "rgb"}, {c: F.col(f"e.{c}") for c in "rgb"}, _mask())
    return p.select("image_id", "y", "x", out.alias("c")).select("image_id", "y", "x", *[F.round(f"c.{c}", 5).alias(c) for c in "rgb"])
