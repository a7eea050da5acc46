"""The way of similarity joins for large query sides: final rows from every task, the same as by brute force."""

import numpy as np
import pytest
from pyspark.sql.functions import col, count_if, countDistinct, spark_partition_id

from tintshelf.operators import blocks, ivf
from tintshelf.operators.blocks import Keep, prepare_sides, similarity_join, within_code_join


def _frame(spark, x, name, kind, codes=None):
    rows = [(i if kind == "bigint" else f"i{i:05d}", v.tolist(), *([codes[i]] if codes else [])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} {kind}, embedding array<double>" + (f", {'query_code' if kind == 'bigint' else 'code'} string" if codes else ""))


def _vectors(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 16))
    x[: n // 10] = x[0]  # copies
    x[-3:-1] = 0
    x[n // 2] *= 1e6
    x[n // 2 + 1] *= 1e-9
    return x


def _best(scores, k, names):
    return {(i, names[j], s[j]) for i, s in enumerate(scores) for j in sorted(np.flatnonzero(s > -np.inf), key=lambda j: (-s[j], names[j]))[:k]}


@pytest.mark.parametrize("k", [1, 7, 90])
def test_tasks_give_final_rows(spark, monkeypatch, k):
    """No candidates leave a task: what the blocks give are the k best rows, of vectors without any structure."""
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 64)
    q, c = _vectors(500, 1), _vectors(3000, 2)
    names = [f"i{i:05d}" for i in range(len(c))]
    sides = prepare_sides(_frame(spark, q, "query_id", "bigint"), _frame(spark, c, "key", "string"))
    got = blocks._by_blocks(*sides, Keep(k=k)).collect()
    assert len(got) == k * len(q)
    want = {(i, n): s for i, n, s in _best(np.round(q @ c.T, 12), k, names)}
    assert {(int(r.query_id), r.key) for r in got} == set(want)
    assert all(np.isclose(r.score, want[int(r.query_id), r.key], rtol=1e-9, atol=1e-11) for r in got)


def test_codes_self_and_views(spark):
    x = _vectors(400, 3)
    names, codes = [f"i{i:05d}" for i in range(400)], [f"c{i % 7}" for i in range(400)]
    other = np.array(codes)[:, None] != np.array(codes)[None, :]
    s = np.round(x @ x.T, 12)
    q, c = _frame(spark, x, "query_id", "bigint", codes), _frame(spark, x, "key", "string", codes)
    got = similarity_join(q, c, Keep(k=9), max_broadcast_rows=0).collect()
    assert {(r.query_id, r.key) for r in got} == {(i, n) for i, n, _ in _best(np.where(other, s, -np.inf), 9, names)}
    named = q.selectExpr("format_string('i%05d', query_id) AS query_id", "embedding", "query_code")
    got = within_code_join(named, c, Keep(k=9, skip_self=True)).collect()
    inside = np.where(other | np.eye(400, dtype=bool), -np.inf, s)
    assert {(r.query_id, r.key) for r in got} == {(names[i], n) for i, n, _ in _best(inside, 9, names)}
    two = _frame(spark, x, "query_id", "bigint").unionByName(_frame(spark, x[::-1].copy(), "query_id", "bigint"))
    got = similarity_join(two, c.drop("code"), Keep(k=9, consensus=0.3), max_broadcast_rows=0).collect()
    fused = np.maximum(x @ x.T, x[::-1] @ x.T) * 0.7 + 0.3 * (x + x[::-1]) @ x.T / 2
    for i in range(400):
        assert np.allclose(sorted(r.score for r in got if r.query_id == i), np.sort(fused[i])[-9:], rtol=1e-9, atol=1e-9)


def test_floor_gives_one_row_for_each_key(spark):
    """Rows of a key that span chunks and files count once, with their best score."""
    q, c = _vectors(50, 4), np.random.default_rng(5).normal(size=(9000, 16))
    keys = np.where(np.arange(9000) % 3 == 0, "a", np.char.add("k", (np.arange(9000) % 11).astype(str)))
    catalog = spark.createDataFrame([(str(k), v.tolist()) for k, v in zip(keys, c, strict=True)], "key string, embedding array<double>").repartition(5)
    got = similarity_join(_frame(spark, q, "query_id", "bigint"), catalog, Keep(floor=2.0), max_broadcast_rows=0).collect()
    s = np.round(q @ c.T, 12)
    want = {(i, str(k)): s[i, keys == k].max() for i in range(50) for k in np.unique(keys) if s[i, keys == k].max() >= 2.0}
    assert len(got) == len(want) and all(np.isclose(want[r.query_id, r.key], r.score, rtol=1e-9) for r in got)


def test_numbers_that_are_none(spark):
    """Not a number never counts; beyond the range of single precision the rows are the same."""
    c = _vectors(200, 6)
    c[5, 3], c[6] = np.nan, c[7] * 1e30
    q = _frame(spark, np.vstack([c[20:30], c[30:40] * 1e30]), "query_id", "bigint")
    got = similarity_join(q, _frame(spark, c, "key", "string"), Keep(k=5), max_broadcast_rows=0).collect()
    with np.errstate(invalid="ignore"):
        s = np.vstack([c[20:30], c[30:40] * 1e30]) @ c.T
    s[np.isnan(s)] = -np.inf
    for i in range(20):
        assert np.allclose(sorted(r.score for r in got if r.query_id == i), np.sort(s[i])[-5:], rtol=1e-9)


def test_full_probe_writes_no_candidates(spark):
    x = np.random.default_rng(8).normal(size=(600, 16))
    index = ivf.build_ivf(_frame(spark, x, "key", "string"), cells=6)
    found = ivf.search_ivf(_frame(spark, x[:40], "query_id", "bigint"), index, 5, 6, rescore=10**6)
    assert "about" not in found._jdf.queryExecution().analyzed().toString()
    names = [f"i{i:05d}" for i in range(600)]
    assert {(r.query_id, r.key) for r in found.collect()} == {(i, n) for i, n, _ in _best(np.round(x[:40] @ x.T, 12), 5, names)}


def test_every_block_has_a_task_of_its_own(spark, monkeypatch):
    """Blocks that share a task would sort several copies of the catalog there while other tasks stand idle."""
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 32)
    dealt, real = [], blocks._streamed
    monkeypatch.setattr(blocks, "_streamed", lambda rows, *rest: dealt.append(rows) or real(rows, *rest))
    q, c = _vectors(500, 1), _vectors(300, 2)
    blocks._by_blocks(*prepare_sides(_frame(spark, q, "query_id", "bigint"), _frame(spark, c, "key", "string").coalesce(1)), Keep(k=3))
    at = dealt[0].groupBy(spark_partition_id().alias("task")).agg(countDistinct("qc").alias("blocks"), count_if(col("side") == 1).alias("rows")).collect()
    assert len(at) >= 7 and all(r.blocks == 1 and r.rows == 300 for r in at)


def test_full_probe_sends_each_row_once_to_a_block(spark, monkeypatch):
    """Where all cells are probed, cells decide nothing: rows in three cells went to the blocks of each."""
    x = np.random.default_rng(9).normal(size=(400, 16))
    index = ivf.build_ivf(_frame(spark, x, "key", "string"), cells=6)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 50)
    monkeypatch.setattr(blocks, "_fits", lambda *_: False)
    dealt, real = [], blocks._streamed
    monkeypatch.setattr(blocks, "_streamed", lambda rows, *rest: dealt.append(rows) or real(rows, *rest))
    found = ivf.search_ivf(_frame(spark, x, "query_id", "bigint"), index, 5, 6, rescore=10**6)
    at = dealt[0].agg(countDistinct("cell", "qc").alias("blocks"), count_if(col("side") == 1).alias("rows")).first()
    assert at["blocks"] == 8 and at["rows"] == 8 * 400
    assert {(r.query_id, r.key) for r in found.collect()} == {(i, n) for i, n, _ in _best(np.round(x @ x.T, 12), 5, [f"i{i:05d}" for i in range(400)])}


def test_views_are_fused_without_reduceat_down_columns(monkeypatch):
    """Queries of any number of views; the scores are those of reduceat, which took most of a tile's time."""
    r = np.random.default_rng(2)
    for counts in ([4] * 9, [1, 3, 2, 7, 1], [1], [1, 70, 2]):
        q = object.__new__(blocks._Queries)
        q.counts = np.array(counts)
        q.starts = np.cumsum(q.counts) - q.counts
        x = r.normal(size=(sum(counts), 11))
        want = 0.7 * np.maximum.reduceat(x, q.starts, axis=0) + 0.3 * np.add.reduceat(x, q.starts, axis=0) / q.counts[:, None]
        assert np.allclose(q.fuse(x, 0.3), want, atol=1e-14) and np.array_equal(q.fuse(x, 0.0), np.maximum.reduceat(x, q.starts, axis=0))
    q.counts, q.starts, calls = np.full(128, 4), np.arange(128) * 4, []

    class Counted:
        def __init__(self, join):
            self.join = join

        def __call__(self, *args, **options):
            return self.join(*args, **options)

        def reduceat(self, *args, **options):
            calls.append(args)
            return self.join.reduceat(*args, **options)

    monkeypatch.setattr(blocks.np, "maximum", Counted(np.maximum))
    q.fuse(r.normal(size=(512, 64)), 0.2)
    assert not calls
