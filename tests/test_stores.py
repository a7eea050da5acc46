"""Versioned bucket store, incremental features, bucketed catalogs, the stored inverted-file index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintshelf.operators import ivf
from tintshelf.operators.catalog import Catalog
from tintshelf.operators.imports import apply_manifest
from tintshelf.operators.learn import mine_positives
from tintshelf.operators.vectors import topk_vectors
from tintshelf.plans.search import SearchSettings, search_styles
from tintshelf.session import new_folder
from tintshelf.sources.buckets import BucketStore
from tintshelf.sources.featurestore import FeatureStore
from tintshelf.streaming.manifest import CatalogStore


def _rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def test_bucket_store_versions(spark):
    store = BucketStore(spark, new_folder(spark), {"t": ("k", "k string, v int")}, buckets=16)
    assert store.read("t").count() == 0 and store.versions() == []
    first = spark.createDataFrame([(str(i), i) for i in range(200)] + [(None, -1)], "k string, v int")
    assert store.replace({"t": (first, list(range(16)))}, "one") == 1
    files = {r.k: r._file for r in store.read("t").collect()}
    change = store.merged("t", spark.createDataFrame([("7", 70)], "k string, v int"), spark.createDataFrame([("8",)], "k string"))
    assert store.replace({"t": change}, "two") == 2
    want = [(k, 70 if k == "7" else v) for k, v in [(None, -1), *((str(i), i) for i in range(200))] if k != "8"]
    assert _rows(store.read("t"), "k", "v") == sorted(want, key=str)
    assert _rows(store.read("t", version=1), "k", "v") == _rows(first, "k", "v")
    moved = {r.k for r in store.read("t").collect() if files[r.k] != r._file}
    assert "7" in moved and len(moved) < 60 and len(change[1]) <= 2
    assert store.done("one") and store.done("two") and not store.done("three")
    with pytest.raises(ValueError):
        store.replace({"t": (first, [0])})
    assert store.current()["version"] == 2
    # of two writers from one version the second fails, and the first one's rows stand
    late = store.current()
    store.replace({"t": store.merged("t", spark.createDataFrame([("9", 90)], "k string, v int"))})
    with pytest.raises(RuntimeError):
        store._commit({**late, "version": late["version"] + 1})
    assert dict(_rows(store.read("t"), "k", "v"))["9"] == 90


def test_feature_refresh(spark):
    calls = []

    def compute(todo):
        calls.append(sorted(r.image_name for r in todo.collect()))
        made = todo.filter("image_name <> 'broken'").withColumns({"style_code": F.lit("c"), "embedding": F.array(F.split("signature", r"\|")[1].cast("double"))})
        return made.drop("signature")

    def listing(rows):
        return spark.createDataFrame(rows, "image_name string, size bigint, s bigint").select("image_name", "size", F.timestamp_seconds("s").alias("modified"))

    folder = new_folder(spark)
    store = FeatureStore(spark, folder, {"model": 1}, buckets=8)
    one = listing([("a", 1, 0), ("b", 2, 0), ("broken", 3, 0), ("a", 1, 0)])
    assert _rows(store.refresh(one, compute), "image_name", "action") == [("a", "added"), ("b", "added"), ("broken", "added")]
    two = listing([("a", 1, 0), ("b", 5, 9), ("broken", 3, 0), ("n", 4, 0)])
    assert _rows(store.refresh(two, compute, "x"), "image_name", "action") == [("a", "kept"), ("b", "changed"), ("broken", "added"), ("n", "added")]
    assert calls == [["a", "b", "broken"], ["b", "broken", "n"]]
    assert _rows(store.read(), "image_name", F.col("embedding")[0]) == [("a", 1.0), ("b", 5.0), ("n", 4.0)]
    store.refresh(one, compute, "x")  # a repeated request
    assert len(calls) == 2 and store.read().count() == 3
    assert _rows(store.refresh(listing([]), compute), "action") == [("removed",)] * 3
    assert store.read().count() == 0
    assert FeatureStore(spark, folder, {"model": 2}, buckets=8).read().count() == 0


def _catalog(spark):
    products = spark.createDataFrame([("A", "A_001.jpg", "n"), ("B", "moved.jpg", "")], "style_code string, cover_image string, note string")
    images = spark.createDataFrame([("A", "A_001.jpg", 1), ("B", "C_001.jpg", 0), ("B", "B_002.jpg", 2)], "style_code string, image_name string, sort_order int")
    tags = spark.createDataFrame([("x",), ("unused",)], "name string")
    return Catalog(products, images, tags, spark.createDataFrame([("A", "x")], "style_code string, tag string"))


def test_catalog_store_same_as_whole(spark):
    """Three batches on touched buckets give what ``apply_manifest`` gives on the whole catalog."""
    store = CatalogStore(spark, new_folder(spark), buckets=37)
    whole = _catalog(spark)
    store.save(whole)
    schema = "style_code string, image_name string, tags array<string>"
    batches = [
        [("A", "A_002.jpg", ["y", " x "]), ("D", "D_001.jpg", [])],
        [("C", "C_001.jpg", ["z"])],  # held by B until now
        [("B", "B_000.jpg", ["y"]), ("ZZ", "MY-1.jpg", ["q"]), ("A", "A_002.jpg", ["y"])],
    ]
    for n, rows in enumerate(batches):
        manifest = spark.createDataFrame(rows, schema)
        whole = apply_manifest(whole, manifest)[0]
        before = {r.style_code: r._file for r in store.rows.read("products").select("style_code", "_file").collect()}
        assert store.apply(manifest, f"b{n}")
        assert not store.apply(manifest, f"b{n}")
        after = {r.style_code: r._file for r in store.rows.read("products").select("style_code", "_file").collect()}
        if n == 0:  # buckets of A and D alone are new files
            near = set(store.rows.touched(manifest.select("style_code"))) & set(store.rows.touched(spark.createDataFrame([("B",)], "k string")))
            assert not near and before["B"] == after["B"] and before["A"] != after["A"]
    got = store.load()
    for table, names in {"products": ["style_code", "cover_image", "note"], "images": ["style_code", "image_name", "sort_order"], "product_tags": ["style_code", "tag"], "tags": ["name"]}.items():
        assert _rows(getattr(got, table), *names) == _rows(getattr(whole, table), *names), table


def _vectors(spark, x, name="key"):
    return spark.createDataFrame([(f"i{i:05d}_1.jpg", v.tolist()) for i, v in enumerate(x)], f"{name} string, embedding array<double>")


def test_ivf_index(spark):
    r = np.random.default_rng(1)
    middle = r.normal(size=(12, 32))
    x = middle[r.integers(0, 12, 1500)] + 0.4 * r.normal(size=(1500, 32))
    x[:500] = middle[0] + 0.01 * r.normal(size=(500, 32))  # a third in one place
    folder = new_folder(spark)
    ivf.write_ivf(ivf.build_ivf(_vectors(spark, x), parts=8), folder)
    index = ivf.read_ivf(spark, folder)
    assert index.cells == 152 and index.codes.select("key").distinct().count() == 1500
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1500, 15)], "query_id bigint, embedding array<double>")
    found = ivf.search_ivf(queries, index, 10, index.cells // 4).withColumnRenamed("key", "image_name")
    exact = topk_vectors(queries, _vectors(spark, x, "image_name"), 10)
    assert ivf.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    same = exact.join(found.withColumnRenamed("score", "s"), ["query_id", "image_name"])
    assert same.filter(F.abs(F.col("s") - F.col("score")) > 1e-9).count() == 0
    # every cell and every row scored again: the exact rows, also for queries of several views
    views = queries.unionByName(queries.withColumn("embedding", F.transform("embedding", lambda v: v + 0.1)))
    every = ivf.search_ivf(views, index, 10, index.cells, rescore=1000, consensus=0.3)
    assert _rows(every, "query_id", "key", F.round("score", 8)) == _rows(topk_vectors(views, _vectors(spark, x, "image_name"), 10, 0.3), "query_id", "image_name", F.round("score", 8))


def test_ivf_small_and_empty(spark):
    one = _vectors(spark, np.ones((3, 16)))
    index = ivf.build_ivf(one)
    q = spark.createDataFrame([(1, [1.0] * 16), (2, None)], "query_id bigint, embedding array<double>")
    assert _rows(ivf.search_ivf(q, index, 2, 1), "query_id", "key", "score") == [(1, "i00000_1.jpg", 16.0), (1, "i00001_1.jpg", 16.0)]
    assert ivf.build_ivf(one.limit(0)) is None
    with pytest.raises(ValueError):
        ivf.build_ivf(_vectors(spark, np.ones((3, 10))))
    got = search_styles(q.filter("query_id = 1"), one.withColumnRenamed("key", "image_name"), SearchSettings(top_k=2), index=index, nprobe=5)
    assert got.count() > 0


def test_all_positives_by_default(spark):
    items = spark.createDataFrame([(f"p{i}", "big", [float(i), 1.0]) for i in range(120)] + [("solo", "s", [1.0, 1.0])], "image_name string, style_code string, clip array<double>")
    assert mine_positives(items).count() == 120 * 119 + 1
    assert mine_positives(items, per_image=5).count() == 120 * 5 + 1


def test_index_search_shuffles_no_candidates(spark, monkeypatch):
    """Blocks of queries meet codes and vectors; what they find does not depend on the blocks."""
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 32))
    x[600:] = x[:300]  # equal vectors
    index = ivf.build_ivf(_vectors(spark, x), cells=30, parts=8)
    index.codes.write.parquet(folder := f"{new_folder(spark)}/codes")
    index = ivf.IvfIndex(index.centres, index.books, spark.read.parquet(folder), index.vectors)
    # two views of every query but the first
    rows = [(i, x[i].tolist()) for i in range(120)] + [(i, (x[i] + 0.3).tolist()) for i in range(1, 120)]
    queries = spark.createDataFrame(rows, "query_id bigint, embedding array<double>")
    one = ivf.search_ivf(queries, index, 5, 8, rescore=4, consensus=0.25)
    assert "about" not in one._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr("tintshelf.operators.blocks.LEAST_BLOCK", 10)
    monkeypatch.setattr(ivf, "MAX_SHORT", 20 * 16)  # 16 queries a block
    many = ivf.search_ivf(queries, index, 5, 8, rescore=4, consensus=0.25)
    got = _rows(many, "query_id", "key", "score")
    assert got == _rows(one, "query_id", "key", "score") and len(got) == 600
    # the same by hand: candidates by the code of the nearest probed cell
    where = {c: {} for c in range(30)}
    for c in index.codes.collect():
        where[c.cell][c.key] = (np.frombuffer(bytes(c.code), np.uint8), c.nearer)
    for i in (0, 7, 119):
        views = np.array([v for q, v in rows if q == i])
        probed = {c for v in views for c in np.argsort(-(index.centres @ v), kind="stable")[:8]}
        about = {key: (views @ (index.centres[c] + index.books[np.arange(8), code].ravel())).max() for c in probed for key, (code, nearer) in where[c].items() if not probed & set(nearer)}
        cut = sorted(about.values())[-20]
        best = []
        for key in about:
            if about[key] >= cut - 1e-9:
                s = views @ x[int(key[1:6])]
                best.append((-round(0.75 * s.max() + 0.25 * s.mean(), 12), key))
        assert np.allclose(sorted(-s for q, _, s in got if q == i), [s for s, _ in sorted(best)[:5]])
