"""Colour functions and colour-card tables."""

from pyspark.sql import functions as F

from checks.base import Data, query
from tintshelf.functions import color as C
from tintshelf.operators import colorcards as K
from tintshelf.plans.flows import match_readings

LAB = ("l", "a", "b")


def _pivot(v):
    return f"(CASE WHEN {v} > 6.0::DOUBLE / 29 THEN pow({v}, 3) ELSE ({v} - 16.0::DOUBLE / 116) / 7.787::DOUBLE END)"


def lab_hex(source, key, cols="l, a, b"):
    """CTEs ending in ``hexed(key, hex)``."""
    def gamma(lin):
        v = f"(CASE WHEN {lin} > 0.0031308::DOUBLE THEN 1.055::DOUBLE * pow({lin}, 1.0::DOUBLE / 2.4) - 0.055::DOUBLE ELSE 12.92::DOUBLE * {lin} END)"
        return f"printf('%02X', greatest(0, least(255, round_even({v} * 255, 0)::INT)))"

    return f"""f AS (SELECT {key}, (l + 16) / 116 AS fy, a / 500 + (l + 16) / 116 AS fx, (l + 16) / 116 - b / 200 AS fz FROM {source}),
      xyz AS (SELECT {key}, {_pivot('fx')} * 0.95047::DOUBLE AS x, {_pivot('fy')} AS y, {_pivot('fz')} * 1.08883::DOUBLE AS z FROM f),
      lin AS (SELECT {key}, 3.2406::DOUBLE * x - 1.5372::DOUBLE * y - 0.4986::DOUBLE * z AS r, -0.9689::DOUBLE * x + 1.8758::DOUBLE * y + 0.0415::DOUBLE * z AS g,
        0.0557::DOUBLE * x - 0.2040::DOUBLE * y + 1.0570::DOUBLE * z AS b FROM xyz),
      hexed AS (SELECT {key}, {gamma('r')} || {gamma('g')} || {gamma('b')} AS hex FROM lin)"""


def delta_e(source, keys):
    """CTEs ending in ``de(keys, delta_e)`` from ``source(keys, l1, a1, b1, l2, a2, b2)``."""
    w = lambda c: f"sqrt(pow({c}, 7) / (pow({c}, 7) + pow(25.0, 7)))"
    hue = lambda a, b: f"(CASE WHEN {a} = 0 AND {b} = 0 THEN 0.0 WHEN atan2({b}, {a}) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END)"
    cosd = lambda x: f"cos(radians({x}))"
    return f"""e0 AS (SELECT {keys}, l1, b1, l2, b2, a1, a2, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS cb FROM {source}),
      e1 AS (SELECT *, a1 * (1 + 0.5 * (1 - {w('cb')})) AS p1, a2 * (1 + 0.5 * (1 - {w('cb')})) AS p2 FROM e0),
      e2 AS (SELECT *, sqrt(p1 * p1 + b1 * b1) AS c1, sqrt(p2 * p2 + b2 * b2) AS c2, {hue('p1', 'b1')} AS h1, {hue('p2', 'b2')} AS h2 FROM e1),
      e3 AS (SELECT {keys}, l1, l2, c1, c2, (c1 + c2) / 2 AS cm,
        CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 <= h1 THEN h2 - h1 + 360 ELSE h2 - h1 - 360 END AS dh,
        CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm FROM e2),
      e4 AS (SELECT {keys}, cm, hm, (l2 - l1) / (1 + 0.015::DOUBLE * pow((l1 + l2) / 2 - 50, 2) / sqrt(20 + pow((l1 + l2) / 2 - 50, 2))) AS dl,
        (c2 - c1) / (1 + 0.045::DOUBLE * cm) AS dc, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015::DOUBLE * cm * (1 - 0.17::DOUBLE * {cosd('hm - 30')}
          + 0.24::DOUBLE * {cosd('2 * hm')} + 0.32::DOUBLE * {cosd('3 * hm + 6')} - 0.20::DOUBLE * {cosd('4 * hm - 63')})) AS dhh FROM e3),
      de AS (SELECT {keys}, round(sqrt(greatest(0, dl * dl + dc * dc + dhh * dhh
        - sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) * 2 * {w('cm')} * dc * dhh)), 6) AS delta_e FROM e4)"""


@query("lab_to_hex", f"WITH {lab_hex('cards', 'card_key')} SELECT card_key, hex FROM hexed")
def _(d: Data):
    return d.cards().select("card_key", C.lab_to_hex(*[F.col(c) for c in LAB]).alias("hex"))


@query("lab_to_rgb", f"""WITH {lab_hex('readings', 'reading_id')} SELECT reading_id, ('0x' || hex[1:2])::INT AS r, ('0x' || hex[3:4])::INT AS g, ('0x' || hex[5:6])::INT AS b FROM hexed""")
def _(d):
    rgb = C.lab_to_rgb(*[F.col(c) for c in LAB])
    return d.readings().select("reading_id", *[rgb[n].alias(n) for n in "rgb"])


@query("delta_e_2000", f"""WITH pairs AS (SELECT reading_id, l AS l1, a AS a1, b AS b1, 100 - l AS l2, b AS a2, -a AS b2 FROM readings),
    {delta_e('pairs', 'reading_id')} SELECT reading_id, delta_e FROM de""")
def _(d):
    r = d.readings().select("reading_id", *LAB, (F.lit(100.0) - F.col("l")).alias("l2"), F.col("b").alias("a2"), (-F.col("a")).alias("b2"))
    return C.with_delta_e(r, LAB, ("l2", "a2", "b2"), "d").select("reading_id", F.round("d", 6).alias("delta_e"))


@query("hex_functions", """SELECT p_partkey, lpad(hex(p_partkey * 7919 % 16777216), 6, '0') AS hex, (p_partkey * 7919 % 16777216 // 65536)::INT AS r,
    (p_partkey * 7919 % 16777216 // 256 % 256)::INT AS g, (p_partkey * 7919 % 256)::INT AS b,
    0.299::DOUBLE * (p_partkey * 7919 % 16777216 // 65536) + 0.587::DOUBLE * (p_partkey * 7919 % 16777216 // 256 % 256) + 0.114::DOUBLE * (p_partkey * 7919 % 256) < 150 AS dark,
    CASE WHEN p_size < 55 THEN '#FFFFFF' ELSE '#0F172A' END AS ink FROM part""")
def _(d):
    raw = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0")))
    rgb = C.hex_to_rgb(raw)
    p = d.table("part").select("p_partkey", "p_size", raw.alias("raw"), *[rgb[n].alias(n) for n in "rgb"])
    return p.select(
        "p_partkey", C.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"), "r", "g", "b",
        C.is_dark(F.col("raw")).alias("dark"), C.ink_for(F.col("p_size")).alias("ink"),
    )


HSV = """u AS (SELECT image_id, y, x, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM pixels),
  m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM u),
  hsv AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN v = r THEN CASE WHEN g >= b THEN (g - b) / d ELSE (g - b) / d + 6 END
    WHEN v = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6 AS h, CASE WHEN v = 0 THEN 0.0 ELSE d / v END AS s FROM m)"""


@query("rgb_to_hsv", f"WITH {HSV} SELECT image_id, y, x, round(h, 9) AS h, round(s, 9) AS s, round(v, 9) AS v FROM hsv")
def _(d):
    hsv = C.rgb_to_hsv(*[F.col(n) / 255.0 for n in "rgb"])
    return d.pixels().select("image_id", "y", "x", *[F.round(hsv[n], 9).alias(n) for n in "hsv"])


@query("hsv_to_rgb", "SELECT image_id, y, x, r, g, b FROM pixels")
def _(d):
    hsv = C.rgb_to_hsv(*[F.col(n) / 255.0 for n in "rgb"])
    p = d.pixels().select("image_id", "y", "x", hsv.alias("c"))
    rgb = C.hsv_to_rgb(F.col("c.h"), F.col("c.s"), F.col("c.v"))
    return p.select("image_id", "y", "x", *[F.rint(rgb[n] * 255).cast("int").alias(n) for n in "rgb"])


# ---- card listings ------------------------------------------------------------------------------------------------


@query("list_libraries", """SELECT id, l.name, source_file, count(c.name) AS color_count, sort_order FROM libraries l
    LEFT JOIN cards c ON c.library_id = l.id GROUP BY ALL""")
def _(d):
    return K.list_libraries(d.store())


@query("list_cards", """SELECT library_id, l.name AS library_name, c.name, note, hex FROM cards c JOIN libraries l ON l.id = c.library_id
    WHERE (c.name ILIKE '%red%' OR note ILIKE '%red%' OR l.name ILIKE '%red%') ORDER BY l.sort_order, lower(l.name), lower(c.name), c.name LIMIT 300 OFFSET 20""")
def _(d):
    return K.list_cards(d.store(), keyword=" red ", limit=1000, offset=20).select("library_id", "library_name", "name", "note", "hex")


@query("list_favorites", """SELECT library_id, l.name AS library_name, c.name, created_at FROM favorites f JOIN cards c USING (library_id, name)
    JOIN libraries l ON l.id = c.library_id WHERE user_tag = 'u7' ORDER BY created_at DESC, library_id DESC, c.name DESC LIMIT 300""")
def _(d):
    return K.list_favorites(d.store(), " u7").select("library_id", "library_name", "name", "created_at")


_NEAR = f"""{{points}}, pairs AS (SELECT DISTINCT p.l AS l1, p.a AS a1, p.b AS b1, c.l AS l2, c.a AS a2, c.b AS b2, library_id, name FROM points p, cards c),
    {delta_e('pairs', 'l1, a1, b1, library_id, name')},
    best AS (SELECT l1, a1, b1, min({{{{'d': delta_e, 'lib': library_id, 'name': name}}}}, 3) AS top FROM de GROUP BY l1, a1, b1),
    flat AS (SELECT l1, a1, b1, unnest(top) AS t, generate_subscripts(top, 1) AS rank FROM best)
    SELECT p.reading_id, rank::INT AS rank, t.lib AS library_id, t.name AS name, t.d AS delta_e_00 FROM points p JOIN flat ON l = l1 AND a = a1 AND b = b1"""


@query("nearest_colors", "WITH " + _NEAR.format(points="points AS (SELECT reading_id, l, a, b FROM readings)").replace("{{", "{").replace("}}", "}"))
def _(d):
    return K.nearest_colors(d.readings(), d.cards(), 3)


AVERAGES = """nth AS (SELECT *, (row_number() OVER (PARTITION BY device_id ORDER BY ts, reading_id) - 1) // 3 AS group_no FROM readings),
    means AS (SELECT device_id, group_no, max(ts) AS ts, avg(l) AS l, avg(a) AS a, avg(b) AS b FROM nth GROUP BY ALL HAVING count(*) = 3)"""


MATCHED = f"WITH {AVERAGES}, " + _NEAR.format(
    points="points AS (SELECT device_id || '/' || group_no AS reading_id, l, a, b FROM means)").replace("{{", "{").replace("}}", "}")


@query("match_readings", MATCHED)
def _(d):
    return match_readings(d.readings(), d.cards(), 3)


# ---- card maintenance -----------------------------------------------------------------------------------------------


def _sheet(d: Data):
    """New rows for the even brands: every part of them, renamed by half, so names repeat."""
    p = d.table("part").join(d.cards().select(F.col("card_key").alias("p_partkey"), "library_id", *LAB), "p_partkey")
    return p.select(
        "library_id", F.col("p_partkey").alias("seq"), F.concat(F.lit(" "), "p_name").alias("name"), F.col("p_type").alias("note"),
        F.lit("D50").alias("illuminant"), F.lit(2.0).alias("angle"), *LAB, F.lit("").alias("hex"),
        F.array(*[F.struct(F.lit(w).alias("wavelength"), (F.col("p_partkey") % w).cast("double").alias("value")) for w in (400, 410)]).alias("spectral"),
    )


_EVEN = "sort_order % 2 = 0"


@query("replace_libraries", f"""WITH src AS (SELECT c.*, p_name FROM cards c JOIN part ON p_partkey = card_key),
    loaded AS (SELECT s.* FROM src s JOIN libraries l ON l.id = s.library_id WHERE {_EVEN}),
    last AS (SELECT library_id, p_name AS name, arg_max(card_key, card_key) AS card_key FROM loaded GROUP BY ALL),
    fresh AS (SELECT t.library_id, t.name, c.card_key, c.l, c.a, c.b FROM last t JOIN cards c USING (card_key)),
    {lab_hex('fresh', 'card_key')}
    SELECT library_id, name, hex, printf('400:%d|410:%d', card_key % 400, card_key % 410) AS spectral FROM fresh JOIN hexed USING (card_key)
    UNION ALL SELECT c.library_id, c.name, c.hex, '' FROM cards c JOIN libraries l ON l.id = c.library_id WHERE NOT ({_EVEN})""")
def _(d):
    s = d.store()
    libs = s.libraries.filter(_EVEN)
    rows = _sheet(d).join(libs.select(F.col("id").alias("library_id")), "library_id", "left_semi")
    return K.replace_libraries(s, libs, rows).cards.select("library_id", "name", "hex", _points())


@query("replace_libraries_favorites", f"""SELECT user_tag, library_id, f.name FROM favorites f JOIN libraries l ON l.id = f.library_id WHERE NOT ({_EVEN})""")
def _(d):
    s = d.store()
    libs = s.libraries.filter(_EVEN)
    rows = _sheet(d).join(libs.select(F.col("id").alias("library_id")), "library_id", "left_semi")
    return K.replace_libraries(s, libs, rows).favorites.select("user_tag", "library_id", "name")


def _points():
    point = lambda p: F.concat(p["wavelength"].cast("string"), F.lit(":"), p["value"].cast("int").cast("string"))
    return F.array_join(F.transform("spectral", point), "|").alias("spectral")


def _upserts(d: Data):
    """Each part goes to the library of its type: new libraries, names repeat, the last one counts."""
    return _sheet(d).select(
        "seq", F.col("note").alias("library_id"), F.concat(F.lit("Type "), "note").alias("library_name"), "name", "note",
        "illuminant", "angle", *LAB, "spectral",
    )


@query("upsert_cards", f"""WITH up AS (SELECT c.*, p_name, p_type FROM cards c JOIN part ON p_partkey = card_key),
    last AS (SELECT lower(p_type) AS library_id, p_name AS name, max(card_key) AS card_key FROM up GROUP BY ALL),
    fresh AS (SELECT t.library_id, t.name, c.card_key, c.l, c.a, c.b FROM last t JOIN cards c USING (card_key)),
    {lab_hex('fresh', 'card_key')}
    SELECT library_id, name, hex, 'D50' AS illuminant, printf('400:%d|410:%d', card_key % 400, card_key % 410) AS spectral FROM fresh JOIN hexed USING (card_key)
    UNION ALL SELECT library_id, name, hex, illuminant, '' FROM cards""")
def _(d):
    return K.upsert_cards(d.store(), _upserts(d)).cards.select("library_id", "name", "hex", "illuminant", _points())


@query("upsert_libraries", """SELECT id, name, sort_order FROM libraries UNION ALL
    SELECT lower(p_type), 'Type ' || p_type, ((SELECT max(sort_order) FROM libraries) + row_number() OVER (ORDER BY min(p_partkey)))::INT FROM part GROUP BY p_type""")
def _(d):
    r = _upserts(d).select("seq", F.col("library_id").alias("id"), F.col("library_name").alias("name"))
    return K.upsert_libraries(d.store(), r).libraries.select("id", "name", "sort_order")


def _likes(d: Data):
    """Everyone likes what they clicked."""
    n = d.table("part").agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    e = d.table("events").filter("event_type = 'click'").withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
    e = e.select(F.concat(F.lit("u"), "user_id").alias("user_tag"), F.expr("event_id % n").alias("card_key"), F.col("ts").alias("created_at"))
    return e.join(d.cards().select("card_key", "library_id", "name"), "card_key").drop("card_key")


LIKES = """likes AS (SELECT 'u' || user_id AS user_tag, library_id, name, min(ts) AS created_at FROM events
    JOIN cards ON card_key = event_id % (SELECT count(*) FROM part) WHERE event_type = 'click' GROUP BY ALL)"""


@query("add_favorites", f"""WITH {LIKES} SELECT user_tag, library_id, name, created_at FROM favorites UNION ALL
    SELECT user_tag, library_id, name, created_at FROM likes ANTI JOIN favorites USING (user_tag, library_id, name)""")
def _(d):
    return K.add_favorites(d.store(), _likes(d)).favorites


def _picks(d: Data):
    r = d.readings()
    named = F.when(F.col("reading_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("pick "), F.col("reading_id") % 100))
    return r.select(
        F.col("reading_id").alias("seq"), F.concat(F.lit("U-"), "device_id").alias("user_tag"), named.alias("name"), *LAB,
        F.when(F.col("reading_id") % 3 == 0, F.lit("#ff00aa")).otherwise(F.lit("")).alias("hex"), F.col("ts").alias("created_at"),
    )


@query("add_picked_favorites", f"""WITH {lab_hex('readings', 'reading_id')},
    picks AS (SELECT r.*, CASE WHEN reading_id % 3 = 0 THEN 'FF00AA' ELSE '' END AS picked, h.hex FROM readings r JOIN hexed h USING (reading_id)),
    named AS (SELECT 'my_color_u_' || device_id AS library_id, CASE WHEN reading_id % 2 = 0 THEN '取色 #' || CASE WHEN picked <> '' THEN picked ELSE hex END
      ELSE 'pick ' || (reading_id % 100) END AS name, reading_id, picked, hex FROM picks)
    SELECT library_id, name, CASE WHEN arg_max(picked, reading_id) <> '' THEN arg_max(picked, reading_id) ELSE arg_max(hex, reading_id) END AS hex
    FROM named GROUP BY ALL UNION ALL SELECT library_id, name, hex FROM cards""")
def _(d):
    return K.add_picked_favorites(d.store(), _picks(d)).cards.select("library_id", "name", "hex")


@query("remove_favorites", f"""WITH {LIKES} SELECT user_tag, library_id, name FROM favorites ANTI JOIN likes USING (user_tag, library_id, name)""")
def _(d):
    return K.remove_favorites(d.store(), _likes(d)).favorites.select("user_tag", "library_id", "name")


def _customised(d: Data):
    """The store with every third library made a custom one."""
    s = d.store()

    def fix(c):
        n = F.regexp_extract(c, r"(\d+)", 1).cast("int")
        return F.when(n % 3 == 0, F.concat(F.lit("custom_"), c)).otherwise(F.col(c)).alias(c)

    def swap(df, c):
        return df.select(*[fix(x) if x == c else F.col(x) for x in df.columns])

    return K.CardStore(swap(s.libraries, "id"), swap(s.cards, "library_id"), swap(s.favorites, "library_id"))


_CUSTOM = "regexp_extract({c}, '([0-9]+)', 1)::INT % 3 = 0"


@query("remove_cards", f"SELECT library_id, name FROM cards WHERE NOT (l > 40 AND {_CUSTOM.format(c='library_id')})".replace(
    "SELECT library_id", f"SELECT CASE WHEN {_CUSTOM.format(c='library_id')} THEN 'custom_' || library_id ELSE library_id END AS library_id"))
def _(d):
    s = _customised(d)
    return K.remove_cards(s, s.cards.filter("l > 40").select("library_id", "name")).cards.select("library_id", "name")


@query("remove_libraries", f"SELECT user_tag, library_id, name FROM favorites WHERE NOT ({_CUSTOM.format(c='library_id')})")
def _(d):
    s = _customised(d)
    return K.remove_libraries(s, s.libraries.select("id")).favorites.select("user_tag", "library_id", "name")
