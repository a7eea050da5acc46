"""Exact search that stops products early: the same rows, fewer multiplications on clustered vectors."""

import numpy as np
import pytest

from tintshelf.operators import blocks
from tintshelf.operators.blocks import Keep, similarity_join
from tintshelf.operators.vectors import topk_vectors


def _clustered(n, seed, spread=0.05, width=48):
    r = np.random.default_rng(seed)
    middle = np.random.default_rng(0).normal(size=(10, width))
    x = middle[r.integers(0, 10, n)] + spread * r.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _frame(spark, x, name, kind):
    return spark.createDataFrame([(i if kind == "bigint" else f"i{i:05d}", v.tolist()) for i, v in enumerate(x)], f"{name} {kind}, embedding array<double>")


def _exact(q, c, k, names):
    s = np.round(q @ c.T, 12)
    return {(i, names[j], s[i, j]) for i in range(len(q)) for j in sorted(range(len(c)), key=lambda j: (-s[i, j], names[j]))[:k]}


@pytest.mark.parametrize("k", [1, 20])
def test_same_rows_fewer_products(spark, k):
    q, c = _clustered(120, 1), _clustered(12_000, 2)
    names = [f"i{i:05d}" for i in range(len(c))]
    sc = spark.sparkContext
    made, every = sc.accumulator(0), sc.accumulator(0)
    catalog = _frame(spark, c, "key", "string").coalesce(2)
    got = similarity_join(_frame(spark, q, "query_id", "bigint"), catalog, Keep(k=k), counters=(made, every)).collect()
    want = {(a, b): s for a, b, s in _exact(q, c, k, names)}
    assert len(got) == len(want) and all(abs(want[r.query_id, r.key] - r.score) < 1e-9 for r in got)
    assert every.value >= q.size * len(c) and made.value < 0.5 * every.value


def test_floor_and_views(spark):
    q, c = _clustered(60, 3), _clustered(6000, 4)
    views = _frame(spark, q, "query_id", "bigint").unionByName(_frame(spark, q[::-1].copy(), "query_id", "bigint"))
    catalog = _frame(spark, c, "image_name", "string").coalesce(1)
    s = np.maximum(q @ c.T, q[::-1] @ c.T) * 0.7 + (q + q[::-1]) @ c.T / 2 * 0.3
    got = sorted((r.query_id, r.score) for r in topk_vectors(views, catalog, 5, 0.3).collect())
    assert [i for i, _ in got] == [i for i in range(len(q)) for _ in range(5)]
    assert np.allclose([v for _, v in got], np.sort(s, axis=1)[:, -5:].ravel(), atol=1e-9)
    floor = similarity_join(_frame(spark, q, "query_id", "bigint"), catalog.withColumnRenamed("image_name", "key"), Keep(floor=0.97))
    assert floor.count() == int((np.round(q @ c.T, 12) >= 0.97).sum())


def test_no_axes_where_vectors_have_none():
    r = np.random.default_rng(5)
    assert blocks.leading_axes(r.normal(size=(5000, 32))) is None
    assert blocks.leading_axes(np.zeros((0, 8))) is None
    axes = blocks.leading_axes(_clustered(500, 6))
    assert axes.shape[1] <= 12 and np.allclose(axes.T @ axes, np.eye(axes.shape[1]))


def test_scale_and_ties(spark):
    """Vectors of very different length, zero vectors, and a third of the catalog the same vector."""
    c = _clustered(3000, 7) * np.where(np.arange(3000) % 5 == 0, 1e6, 1.0)[:, None]
    c[:1000] = c[1001]
    c[2990:] = 0
    q = np.vstack([_clustered(30, 8), np.zeros((1, 48)), c[1001:1002]])
    names = [f"i{i:05d}" for i in range(len(c))]
    got = topk_vectors(_frame(spark, q, "query_id", "bigint"), _frame(spark, c, "image_name", "string").coalesce(1), 7).collect()
    want = {i: sorted(zip(-np.round(q[i] @ c.T, 3), names, strict=True))[:7] for i in range(len(q))}
    for i in range(len(q)):
        mine = sorted((-r.score, r.image_name) for r in got if r.query_id == i)
        assert np.allclose([a for a, _ in mine], [a for a, _ in want[i]], rtol=1e-9, atol=1e-3)
