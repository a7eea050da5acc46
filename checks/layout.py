"""Print slots over the orders of a customer, garment measurements over the events of a user."""

from pyspark.sql import functions as F

from checks.base import Data, query
from tintshelf.operators import layout as L

NAMES = list(L.FALLBACK_CM)


@query("print_slots", """WITH p(paper, w, h) AS (VALUES ('A4', 210 * 2.83464567::DOUBLE, 297 * 2.83464567::DOUBLE), ('A5', 148 * 2.83464567::DOUBLE, 210 * 2.83464567::DOUBLE), ('4R', 102 * 2.83464567::DOUBLE, 152 * 2.83464567::DOUBLE)),
    t(template, nrow, ncol) AS (VALUES ('single_full', 1, 1), ('two_vertical', 2, 1), ('two_horizontal', 1, 2), ('grid_2x2', 2, 2), ('grid_3x3', 3, 3)),
    n AS (SELECT p_partkey, ['A4', 'A5', '4R'][p_partkey % 3 + 1] AS paper, ['single_full', 'two_vertical', 'two_horizontal', 'grid_2x2', 'grid_3x3'][p_size % 5 + 1] AS template FROM part)
    SELECT p_partkey, slot::INT AS slot, round(slot % ncol * w / ncol, 6) AS x, round((nrow - 1 - slot // ncol) * h / nrow, 6) AS y, round(w / ncol, 6) AS width, round(h / nrow, 6) AS height
    FROM n JOIN p USING (paper) JOIN t USING (template), generate_series(0, 8) g(slot) WHERE slot < nrow * ncol""")
def _(d: Data):
    paper = F.element_at(F.array(*[F.lit(x) for x in L.PAPERS_MM]), (F.col("p_partkey") % 3 + 1).cast("int"))
    template = F.element_at(F.array(*[F.lit(x) for x in L.TEMPLATES]), F.col("p_size") % 5 + 1)
    jobs = d.table("part").select("p_partkey", paper.alias("paper"), template.alias("template"))
    rows = jobs.join(F.broadcast(L.print_slots(d.spark)), ["paper", "template"])  # 54 fixed slots
    return rows.select("p_partkey", "slot", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


@query("assign_slots", """WITH p AS (SELECT o_custkey AS job_id, o_orderkey AS seq, 'img' || o_orderkey AS image_id, CASE WHEN o_custkey % 5 = 0 THEN 99 ELSE o_orderkey % 11 END AS slot_index FROM orders),
    taken AS (SELECT job_id, slot_index AS slot, arg_max(image_id, seq) AS image_id FROM p WHERE slot_index BETWEEN 0 AND 8 GROUP BY ALL),
    used AS (SELECT job_id, image_id, row_number() OVER (PARTITION BY job_id ORDER BY slot) - 1 AS nth FROM taken UNION ALL
      SELECT job_id, image_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 FROM p WHERE job_id NOT IN (SELECT job_id FROM taken)),
    counts AS (SELECT job_id, count(*) AS n FROM used GROUP BY job_id),
    cells AS (SELECT c.job_id, n, g.slot, t.image_id, sum((t.image_id IS NULL)::INT) OVER (PARTITION BY c.job_id ORDER BY g.slot) - 1 AS gap FROM counts c CROSS JOIN generate_series(0, 8) g(slot) LEFT JOIN taken t ON t.job_id = c.job_id AND t.slot = g.slot)
    SELECT c.job_id, slot::INT AS slot, coalesce(c.image_id, u.image_id) AS image_id FROM cells c LEFT JOIN used u ON u.job_id = c.job_id AND u.nth = gap % n""")
def _(d):
    slot = F.when(F.col("o_custkey") % 5 == 0, F.lit(99)).otherwise((F.col("o_orderkey") % 11).cast("int"))
    p = d.table("orders").select(
        F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("img"), "o_orderkey").alias("image_id"), slot.alias("slot_index"),
    )
    return L.assign_slots(p, 9)


_NAME = "['bodyLength', 'shoulderWidth', 'chestWidth', 'hemWidth', 'leftSleeveLength', 'rightSleeveLength', 'neckWidth'][event_id % 7 + 1]"
_LAST = f"lasts AS (SELECT user_id AS garment_id, {_NAME} AS dim, arg_max(round(value, 2), ts) AS cm FROM events GROUP BY ALL)"
_WIDE = "wide AS (SELECT garment_id, " + ", ".join(f"coalesce(max(CASE WHEN dim = '{n}' THEN cm END), {c}.0)::DOUBLE AS {n}" for n, _l, c in L.DIMENSIONS) + " FROM lasts GROUP BY garment_id)"


def _wide(d: Data):
    return L.measurements(L.latest_measurements(d.measure_events()))


@query("measurements", f"WITH {_LAST}, {_WIDE} SELECT * FROM wide")
def _(d):
    return _wide(d)


def _m(n):
    return f"(greatest(1.0::DOUBLE, {n}) / 100)"


_PARAMS = f"""base AS (SELECT garment_id, {_m('bodyLength')} AS body, {_m('shoulderWidth')} AS shoulder, {_m('chestWidth')} AS chest, {_m('hemWidth')} AS hem,
      ({_m('leftSleeveLength')} + {_m('rightSleeveLength')}) / 2 AS sleeve, {_m('neckWidth')} AS neck FROM wide),
    params AS (SELECT *, body / 2 AS top_y, -body / 2 AS bottom_y, body / 2 - greatest(0.045::DOUBLE, body * 0.08::DOUBLE) AS shoulder_y, body / 2 - greatest(0.16::DOUBLE, body * 0.29::DOUBLE) AS underarm_y,
      shoulder / 2 AS shoulder_half, chest / 2 AS chest_half, hem / 2 AS hem_half, greatest(0.12::DOUBLE, sleeve * 1.06::DOUBLE) AS sleeve_reach, greatest(0.09::DOUBLE, sleeve * 0.68::DOUBLE) AS sleeve_drop,
      greatest(0.055::DOUBLE, sleeve * 0.36::DOUBLE) AS cuff_h FROM base)"""
_PNAMES = ("body", "shoulder", "chest", "hem", "sleeve", "neck", "top_y", "bottom_y", "shoulder_y", "underarm_y", "shoulder_half", "chest_half", "hem_half", "sleeve_reach", "sleeve_drop", "cuff_h")


@query("garment_params", f"WITH {_LAST}, {_WIDE}, {_PARAMS} SELECT garment_id, " + ", ".join(f"round({n}, 7) AS {n}" for n in _PNAMES) + " FROM params")
def _(d):
    return L.garment_params(_wide(d)).select("garment_id", *[F.round(n, 7).alias(n) for n in _PNAMES])


@query("half_width_at", f"""WITH {_LAST}, {_WIDE}, {_PARAMS}, ys AS (SELECT p.*, step, bottom_y + body * step / 20 AS yy FROM params p, generate_series(0, 20) g(step)),
    t AS (SELECT *, (yy - bottom_y) / greatest(1e-6::DOUBLE, underarm_y - bottom_y) AS t1, (yy - underarm_y) / greatest(1e-6::DOUBLE, shoulder_y - underarm_y) AS t2, (yy - shoulder_y) / greatest(1e-6::DOUBLE, top_y - shoulder_y) AS t3 FROM ys)
    SELECT garment_id, step::INT AS step, round(CASE WHEN yy <= underarm_y THEN (hem_half * (1 - t1) + chest_half * t1) * (1 - 0.035::DOUBLE * sin(greatest(0, least(1, t1)) * pi()))
      WHEN yy <= shoulder_y THEN chest_half * (1 - t2) + shoulder_half * t2 ELSE shoulder_half * (1 - t3) + neck * 0.45::DOUBLE * t3 + body * 0.015::DOUBLE END, 7) AS half FROM t""")
def _(d):
    p = L.garment_params(_wide(d)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(20))))
    p = p.withColumn("yy", F.col("bottom_y") + F.col("body") * F.col("step") / 20)
    return p.select("garment_id", "step", F.round(L.half_width_at(F.col("yy")), 7).alias("half"))


_LABELS = " ".join(f"WHEN '{n}' THEN '{label} '" for n, label, _c in L.DIMENSIONS)
_ORDER = " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _l, _c) in enumerate(L.DIMENSIONS))


@query("measurement_text", f"WITH {_LAST} SELECT garment_id, string_agg(CASE dim {_LABELS} END || printf('%.1f', floor(cm) + 0.3) || ' cm', '，' ORDER BY CASE dim {_ORDER} END) AS text FROM lasts GROUP BY garment_id")
def _(d):
    g = L.latest_measurements(d.measure_events())
    # Whole numbers plus 0.3 print the same way everywhere.
    dims = F.transform_values("dims", lambda _, v: F.floor(v) + F.lit(0.3))
    return g.select("garment_id", L.measurement_text(dims).alias("text"))


@query("proportion_scale", f"""WITH {_LAST}, {_WIDE} SELECT garment_id, round(greatest(0.72::DOUBLE, least(1.35::DOUBLE, greatest(shoulderWidth, chestWidth, hemWidth) / 52)), 7) AS width,
    round(greatest(0.72::DOUBLE, least(1.35::DOUBLE, bodyLength / 68)), 7) AS length, round(greatest(0.78::DOUBLE, least(1.28::DOUBLE, chestWidth / 52)), 7) AS depth FROM wide""")
def _(d):
    return L.proportion_scale(_wide(d)).select("garment_id", *[F.round(c, 7).alias(c) for c in ("width", "length", "depth")])


@query("point_distance", """SELECT reading_id, round(sqrt(pow(l - a, 2) + pow(a - b, 2) + pow(b - l, 2)), 6) AS d3, round(sqrt(pow(l - b, 2) + pow(a - b, 2)), 6) AS d2 FROM readings""")
def _(d):
    l, a, b = [F.col(c) for c in "lab"]
    return d.readings().select(
        "reading_id", F.round(L.point_distance([l, a, b], [a, b, l]), 6).alias("d3"), F.round(L.point_distance([l, a], [b, b]), 6).alias("d2")
    )
