"""Published CIEDE2000 pairs, colour conversions and the exact nearest-colour search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintshelf.functions import color as C
from tintshelf.operators import colorboxes
from tintshelf.operators.colorboxes import Shelf
from tintshelf.operators.colorcards import nearest_colors

# fixed values: pairs 1-8, 17, 25 of the published CIEDE2000 test data
SHARMA = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
    (50.0, 2.8361, -74.0200, 50.0, 0.0, -82.7485, 3.4412),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0),
    (50.0, -1.1848, -84.8006, 50.0, 0.0, -82.7485, 1.0),
    (50.0, -0.9009, -85.5211, 50.0, 0.0, -82.7485, 1.0),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, -1.0, 2.0, 50.0, 0.0, 0.0, 2.3669),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
]


def test_delta_e_published_pairs(spark):
    df = spark.createDataFrame(SHARMA, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    one = C.delta_e_2000(*[F.col(c) for c in ("l1", "a1", "b1", "l2", "a2", "b2")])
    rows = C.with_delta_e(df, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "staged").withColumn("one", one).collect()
    for r in rows:
        assert r["staged"] == pytest.approx(r["want"], abs=5e-5)
        assert r["one"] == pytest.approx(r["staged"], abs=1e-12)


def test_nearest_colors_equals_brute_force(spark):
    cards = spark.range(700).select(
        F.lit("lib").alias("library_id"), F.concat(F.lit("c"), "id").alias("name"),
        (F.col("id") * 37 % 101).cast("double").alias("l"),
        # A third of all cards share one colour, others reach past the usual gamut.
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 53 % 321 - 160.0).alias("a"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 71 % 321 - 160.0).alias("b"),
    ).withColumn("l", F.when(F.col("name").rlike("[05]$"), 50.0).otherwise(F.col("l")))
    readings = spark.range(60).select(
        F.col("id").alias("reading_id"), (F.col("id") * 13 % 100).cast("double").alias("l"),
        (F.col("id") * 29 % 260 - 130.0).alias("a"), (F.col("id") * 41 % 260 - 130.0).alias("b"),
    )
    got, by_join = (
        {(r["reading_id"], r["rank"]): (r["name"], r["delta_e_00"]) for r in nearest_colors(readings, cards, 7, max_broadcast_cards=most).collect()}
        for most in (1000, 10)
    )
    assert got == by_join
    pairs = readings.crossJoin(cards.select("name", *[F.col(c).alias(f"c{c}") for c in "lab"]))
    rows = C.with_delta_e(pairs, ("l", "a", "b"), ("cl", "ca", "cb")).select("reading_id", "name", F.round("delta_e_00", 6).alias("d")).collect()
    want = {}
    for reading in range(60):
        best = sorted((r["d"], r["name"]) for r in rows if r["reading_id"] == reading)[:7]
        want.update({(reading, i + 1): (n, d) for i, (d, n) in enumerate(best)})
    assert got == want


def test_hex_and_hsv(spark):
    r = spark.range(1).select(
        C.lab_to_hex(F.lit(100.0), F.lit(0.0), F.lit(0.0)).alias("white"), C.lab_to_hex(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("black"),
        C.normalize_hex(F.lit("#a0b1c2")).alias("h"), C.normalize_hex(F.lit("xyz")).alias("bad"),
        C.hsv_to_rgb(F.lit(1 / 3), F.lit(1.0), F.lit(1.0)).alias("green"),
    ).first()
    assert (r["white"], r["black"], r["h"], r["bad"]) == ("FFFFFF", "000000", "A0B1C2", None)
    assert tuple(round(v, 9) for v in r["green"]) == (0.0, 1.0, 0.0)


def test_pairs_per_reading_stay_level():
    """Ten times the cards cost each reading about as many comparisons."""
    r = np.random.default_rng(3)
    asked = np.c_[r.uniform(0, 100, 2000), r.uniform(-80, 80, (2000, 2))]
    pairs = []
    for n in (2000, 20_000):
        shelf = Shelf(np.c_[r.uniform(0, 100, n), r.uniform(-80, 80, (n, 2))])
        for part in shelf.chunks(asked):
            shelf.closest(asked[part], 3)
        pairs.append(shelf.scored / len(asked))
    assert pairs[1] < 1.6 * pairs[0] and pairs[1] < 0.03 * 20_000


def test_cards_beyond_reach_are_not_scored():
    """Inside a box, and of cards of one colour, only what a bound without angles leaves is scored."""
    r = np.random.default_rng(3)
    asked, shelf = np.c_[r.uniform(0, 100, 2000), r.uniform(-80, 80, (2000, 2))], Shelf(r.normal(size=(20_000, 3)) * [20, 40, 40] + [50, 0, 0])
    got = [shelf.closest(asked[part], 3) for part in shelf.chunks(asked)]
    assert shelf.scored < 400 * len(asked) and sum(len(g[0]) for g in got) == 3 * len(asked)
    x, y = (np.c_[r.uniform(0, 100, 200_000), r.uniform(-150, 150, (200_000, 2))] for _ in range(2))
    assert (colorboxes.pair_bound(x, y) <= colorboxes.delta_e_2000(x, y) + 1e-9).all()
