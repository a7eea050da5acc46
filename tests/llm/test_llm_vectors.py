import numpy as np
from pyspark.sql import functions as F

from tintshelf.llm import components, vectors
from tintshelf.llm.oracles import ORACLES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def _rows(n=240, size=24):
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, size))
    rows = []
    for i in range(n):
        v = centres[i % 12] + r.normal(size=size) * r.choice([0.02, 0.1, 0.2])
        rows.append((i, [float(x) for x in np.float32(v)], int(i % 3)))
    rows += [(n + k, rows[k][1], rows[k][2]) for k in range(20)]
    rows += [(n + 30, rows[0][1], 2), (n + 31, rows[0][1], None), (n + 32, None, 0), (n + 33, [], 0), (n + 34, [0.0] * size, 0), (n + 35, [1.0, 0.0], 0), (n + 36, [2.0, 0.0], 0)]
    rows += [(n + 37, [None] + [1.0] * (size - 1), 0), (n + 38, [float("nan")] + [1.0] * (size - 1), 0), (n + 39, [float("inf")] * size, 0), (n + 40, [3e38] * size, 0), (n + 41, [1e-30] * size, 0)]
    return rows


def test_links_like_sql(docs, same_rows, monkeypatch):
    df = docs(_rows(), SCHEMA)
    given = df.select("vec_id", "embedding", "label")
    expected = ORACLES["op10_embedding_dedup"]
    good = given.filter(F.col("embedding").isNotNull())
    rows = {r["vec_id"]: tuple(r) for r in vectors.near_vectors(df).collect()}
    x = {r["vec_id"]: (np.array([v if v is not None else np.nan for v in r["embedding"]], dtype=float), r["label"]) for r in good.collect()}
    links = {i: set() for i in rows}
    for i, (v, a) in x.items():
        for j, (w, b) in x.items():
            if i < j and a is not None and a == b and len(v) == len(w) and len(v) and np.isfinite(v).all() and np.isfinite(w).all() and v.any() and w.any():
                v2, w2 = v / np.abs(v).max(), w / np.abs(w).max()
                if v2 @ w2 / np.sqrt(v2 @ v2) / np.sqrt(w2 @ w2) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert rows[i] == (i, len(links[i]), min(seen), i == min(seen))
    assert "list_dot_product" in expected and sum(map(len, links.values())) > 200
    monkeypatch.setattr(vectors, "BLOCK", 5)
    monkeypatch.setattr(vectors, "SAMPLE", 60)
    assert {r["vec_id"]: tuple(r) for r in vectors.near_vectors(df).collect()} == rows
    assert vectors.near_vectors(docs([], SCHEMA)).count() == 0


def test_equal_rows_and_null_ids(docs):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [2.0, 4.0], 0), (5, [9.0, -9.0], 0)]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.near_vectors(docs(rows, SCHEMA)).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("5", 0, "5", True), ("None", 2, "1", False)]


def test_doubles_of_any_size(docs):
    r = np.random.default_rng(3)
    base = r.normal(size=(6, 16))
    sizes = [1.0, 1e-200, 1e200, 1e-300, 1e300, 5e-324 * 2**60]
    rows = [(i * 10 + k, [float(x) for x in v * z], 1) for i, v in enumerate(base) for k, z in enumerate(sizes)]
    got = {row["vec_id"]: tuple(row) for row in vectors.near_vectors(docs(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {i * 10 + k: (i * 10 + k, len(sizes) - 1, i * 10, k == 0) for i in range(6) for k in range(len(sizes))}


def test_bound_drops_no_pair():
    r = np.random.default_rng(9)
    for size in (1, 3, 8, 40):
        x = r.normal(size=(80, size)) * np.exp(-np.arange(size) / 5)
        x[40:] = x[:40] + r.normal(size=(40, size)) * 0.05
        y = x / np.linalg.norm(x, axis=1, keepdims=True)
        y = y @ vectors.principal_axes(list(x))[size]
        near = (y @ y.T) >= 0.98
        i, j = vectors.candidate_pairs(y, y, 0.98)
        assert near.sum() >= 80 and {*zip(*np.nonzero(near), strict=True)} <= {*zip(i, j, strict=True)}
        good = vectors.linked(x, i, j, 0.98)
        assert {*zip(i[good], j[good], strict=True)} == {*zip(*np.nonzero(near), strict=True)}


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)] + [(200, 201), (201, 202), (202, 200)]
    got = {r["v"]: r["c"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)} | {k: 200 for k in range(200, 203)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
