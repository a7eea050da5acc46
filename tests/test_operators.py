"""Operators on small frames, skewed where that matters, against plain Python."""

import difflib
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintshelf.operators import blocks
from tintshelf.operators.catalog import assemble_products
from tintshelf.operators.imports import allocate_names
from tintshelf.operators.layout import assign_slots
from tintshelf.operators.numbering import number_within
from tintshelf.operators.pixels import classic_feature, edge_histogram, lbp_histogram, subject_score
from tintshelf.operators.textindex import fuzzy_candidates, match_tokens
from tintshelf.operators.vectors import topk_vectors
from tintshelf.streaming.readings import average_readings


def test_number_within_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", (i * 7919) % 3001) for i in range(3000)]
    got = number_within(spark.createDataFrame(rows, "g string, o int"), ["g"], ["o"]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        want.update({(g, o): i for i, o in enumerate(sorted(o for x, o in rows if x == g))})
    assert {(r["g"], r["o"]): r["nth"] for r in got} == want


@pytest.mark.parametrize("bound", [20_000, 0])
def test_topk_with_copies(spark, monkeypatch, bound):
    monkeypatch.setattr(blocks, "CHUNK_ROWS", 64)
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(300, 8))
    vectors[:100] = vectors[0]  # a third of all rows are copies
    images = [(f"i{n:03d}", [float(x) for x in v]) for n, v in enumerate(vectors)]
    queries = [(n, [float(x) for x in vectors[n * 7]]) for n in range(40)]
    got = topk_vectors(
        spark.createDataFrame(queries, "query_id int, embedding array<double>"),
        spark.createDataFrame(images, "image_name string, embedding array<double>"), 9, max_broadcast_rows=bound,
    ).toPandas()
    for n, q in queries:
        scores = sorted(((-round(float(np.dot(v, q)), 12), name) for name, v in images))[:9]
        mine = got[got.query_id == n].sort_values(["score", "image_name"], ascending=[False, True])
        assert list(mine.image_name) == [name for _, name in scores]


def test_fuzzy_candidates_follow_the_matches(spark):
    """Words that share a common ending but too few letters do not meet, in a vocabulary of any size."""
    rng = random.Random(5)
    ends = ["ATION", "INGLY", "NESS", "MENT"]
    words = ["".join(rng.choice("ABCDEFGHIKLMNOPRSTUV") for _ in range(rng.randint(4, 6))) + rng.choice(ends) for _ in range(10_000)]
    asked = spark.createDataFrame([(w[:1] + w[2:],) for w in words[:200]], "query_token string")
    for size in (1_000, 10_000):
        vocab = spark.createDataFrame([(w, 1.0) for w in dict.fromkeys(words[:size])], "token string, idf double")
        met, matched = fuzzy_candidates(asked, vocab.select("token")).count(), match_tokens(asked, vocab, max_matches=size).count()
        assert 200 <= matched <= met <= 1.5 * matched


def test_match_tokens_equals_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("ABCDE12") for _ in range(rng.randint(1, 17))) for _ in range(400)} | {"ESESES", "EESES"}
    words = sorted(w for w in words if any(c.isalpha() for c in w))
    idf = {w: 1 + len(w) / 7 + i / 1000 for i, w in enumerate(words)}
    asked = sorted({w[:2] + w[3:] for w in words if len(w) > 5} | {w + "X" for w in words} | set(words[:20]))
    got = match_tokens(
        spark.createDataFrame([(w,) for w in asked], "query_token string"), spark.createDataFrame(list(idf.items()), "token string, idf double")
    ).collect()
    want = set()
    for q in asked:
        if q in idf:
            want.add((q, q))
            continue
        hits = []
        for w in words:
            if abs(len(w) - len(q)) > 3:
                continue
            if len(q) >= 6 and len(w) >= 6 and (q in w or w in q):
                ratio = min(len(q), len(w)) / max(len(q), len(w))
            else:
                ratio = difflib.SequenceMatcher(None, q, w).ratio()
            if ratio >= 0.78:
                hits.append((-ratio, -idf[w], w))
        want |= {(q, w) for _, _, w in sorted(hits)[:4]}
    assert {(r["query_token"], r["token"]) for r in got} == want


def test_allocate_names_shares_counter_across_case(spark):
    files = [("a/1.jpg", "AB", ".jpg"), ("a/2.jpg", "ab", ".png"), ("b/1.jpg", "AB", ".jpg"), ("c", "ZZ", ".jpg")]
    f = spark.createDataFrame(files, "source_rel_path string, prefix string, suffix string")
    e = spark.createDataFrame([("Ab_007.jpg",), ("ZZ.jpg",)], "image_name string")
    got = {r["source_rel_path"]: r["proposed_filename"] for r in allocate_names(f, e).collect()}
    assert got == {"a/1.jpg": "AB_008.jpg", "a/2.jpg": "ab_009.png", "b/1.jpg": "AB_010.jpg", "c": "ZZ_000.jpg"}


def test_assign_slots_fills_round(spark):
    p = [(1, 0, "a", 2), (1, 1, "b", 0), (1, 2, "c", 2), (2, 0, "x", 9), (2, 1, "y", -1)]
    got = assign_slots(spark.createDataFrame(p, "job_id int, seq int, image_id string, slot_index int"), 4).collect()
    rows = {(r["job_id"], r["slot"]): r["image_id"] for r in got}
    assert [rows[1, i] for i in range(4)] == ["b", "b", "c", "c"]
    assert [rows[2, i] for i in range(4)] == ["x", "y", "x", "y"]


def test_average_readings_skips_broken_and_incomplete(spark):
    rows = [(i, 1, datetime(2024, 1, 1, 0, 0, i), float(i), 0.0, float("nan") if i == 1 else 1.0) for i in range(6)]
    schema = "reading_id long, device_id long, ts timestamp, l double, a double, b double"
    got = average_readings(spark.createDataFrame(rows, schema)).collect()
    tied = [(9 - i, 1, datetime(2024, 1, 1), float(i), 0.0, 1.0) for i in range(6)]
    means = {r["group_no"]: r["l"] for r in average_readings(spark.createDataFrame(tied, schema)).collect()}
    assert means == {0: 4.0, 1: 1.0}  # readings of one time by their ids
    assert [(r["group_no"], round(r["l"], 6)) for r in got] == [(0, round((0 + 2 + 3) / 3, 6))]


def test_product_with_many_images_is_one_row(spark):
    n = 12_000
    products = spark.createDataFrame([("A-1", "", "x"), ("B-2", "", "y")], "style_code string, cover_image string, note string")
    images = spark.range(n).select(F.lit("A-1").alias("style_code"), F.concat(F.lit("A-1_"), "id").alias("image_name"), (n - F.col("id")).cast("int").alias("sort_order"))
    tags = spark.createDataFrame([("A-1", "t")], "style_code string, tag string")
    rows = {r["style_code"]: r for r in assemble_products(products, images, tags).collect()}
    assert len(rows) == 2 and rows["B-2"]["images"] == [] and rows["A-1"]["image_count"] == n
    assert [i["sort_order"] for i in rows["A-1"]["images"]] == list(range(1, n + 1))


def _image(spark, shades, width, height):
    rows = [(1, y, x, *shades(y, x)) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, "image_id bigint, y int, x int, r int, g int, b int")


def test_tiles_do_not_change_neighbourhood_features(spark):
    """Sides that divide the image, that do not, and one tile for all give the same rows."""
    rng = random.Random(11)
    pixels = _image(spark, lambda y, x: [rng.randrange(256) for _ in range(3)], 13, 8).cache()
    for feature in (lbp_histogram, edge_histogram):
        whole, *cut = [sorted((r["bin"], round(r["value"], 9)) for r in feature(pixels, tile=t).collect()) for t in (64, 4, 5, 1)]
        assert whole and cut == [whole] * 3
    whole, *cut = [np.array(classic_feature(pixels, 4, tile=t).first()["embedding"]) for t in (64, 4, 5)]
    assert all(np.allclose(whole, c, atol=1e-9) for c in cut)
    plan = classic_feature(pixels, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_subject_cut_is_the_exact_quantile(spark):
    """One flat image, one of noise and one whose colour is lost in places; no percentile in the plan."""
    rng = random.Random(12)
    for shades in (lambda y, x: (9, 9, 9), lambda y, x: [rng.randrange(256) for _ in range(3)], lambda y, x: (None if x == 3 else 7 * x, 5 * y, 80)):
        found = subject_score(_image(spark, shades, 11, 9).cache())
        rows = found.collect()
        scores = [r["score"] for r in rows if r["score"] is not None]
        cut = max(0.6, float(np.quantile(scores, 0.72)))
        assert len(rows) == 99 and all(r["subject"] is None if r["score"] is None else r["subject"] == (r["score"] > cut) or abs(r["score"] - cut) < 1e-12 for r in rows)
        assert "percentile" not in found._jdf.queryExecution().toString()
