"""Fitted operators: principal axes, clustered search, the re-ranker."""

import numpy as np
from pyspark.sql import functions as F

from tintshelf.operators import learn
from tintshelf.operators.learn import train_reranker
from tintshelf.operators.ranking import ivf_topk, pca_reduce
from tintshelf.operators.vectors import topk_vectors

EMBEDDINGS = "/root/testdata/sf0.001/embeddings.parquet"


def test_reduced_vectors_keep_the_variance(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12)) * np.linspace(3, 0.1, 12)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "key int, embedding array<double>")
    got = np.array([r["embedding"] for r in pca_reduce(df, 4).orderBy("key").collect()])
    centred = got - got.mean(axis=0)
    cov = centred.T @ centred / (len(x) - 1)
    eigen = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(np.diag(cov), eigen[:4], rtol=1e-6)  # the variances of the first axes
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-8)  # axes at right angles


def test_clustered_search_finds_most(spark):
    e = spark.read.parquet(EMBEDDINGS).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    queries = e.select(F.col("vec_id").alias("query_id"), "embedding")
    images = e.select(F.col("vec_id").cast("string").alias("image_name"), "embedding")
    exact = {tuple(r) for r in topk_vectors(queries, images, 10).select("query_id", "image_name").collect()}

    def recall(nprobe):
        found = {tuple(r) for r in ivf_topk(queries, images, 10, clusters=16, nprobe=nprobe).select("query_id", "image_name").collect()}
        return len(exact & found) / len(exact)

    assert recall(16) == 1.0 and recall(12) >= 0.9


def test_reranker_separates(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 10))
    y = (x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=600) * 0.2 > 0).astype(float)
    pairs = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y, strict=True)], "label double, features array<double>")
    model = train_reranker(pairs)
    scored = pairs.select("label", model.probability(F.col("features")).alias("p")).toPandas()
    assert ((scored.p > 0.5) == (scored.label > 0.5)).mean() >= 0.93
    # a plain logistic fit of the same rows, by Newton steps, agrees
    z = np.c_[(x - np.array(model.mean)) / np.array(model.std), np.ones(600)]
    w = np.zeros(11)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        pull = np.r_[np.full(10, 1e-4 * 600), 0]
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
    assert np.abs(scored.p.to_numpy() - 1 / (1 + np.exp(-z @ w))).max() < 0.05


def test_pairs_of_a_code_are_counted_in_blocks(spark, monkeypatch):
    """As many pairs as the square of a code's images: no row is made of them, and the figures are those of the rows."""
    monkeypatch.setattr(learn, "CODE_ROWS", 20)
    r = np.random.default_rng(3)
    rows = [(f"i{i:03d}", "a" if i < 70 else "b" if i < 89 else "c", *[r.normal(size=w).tolist() for w in (4, 3, 2, 5)]) for i in range(90)]
    items = spark.createDataFrame(rows, "image_name string, style_code string, clip array<double>, shape array<double>, color array<double>, stripe array<double>")
    views = items.crossJoin(spark.range(2).selectExpr("cast(id as int) view"))
    negatives = learn.mine_hard_negatives(items, 5)
    model = learn.PairModel((1.5, 0.75, -0.25, 0.5, 0.125, 0.25, -0.5, 0.375, 0.625, -0.125), -0.5, tuple(np.linspace(-0.3, 0.4, 10)), tuple(np.linspace(0.2, 0.9, 10)))
    with monkeypatch.context() as m:
        m.delattr(learn, "_code_pairs")
        got = learn.code_metrics(views, items, negatives, model, 1)
    pairs = learn.training_pairs(views, items, None, negatives, 1)
    assert got.collect() == learn.training_metrics(pairs, model).collect() and got.first()["samples"] == 2 * (70 * 69 + 19 * 18 + 1) + 90 * 5
    none = learn.code_metrics(views.limit(0), items, negatives.limit(0), model).first()
    assert tuple(none) == (0, None, None)


def test_pairs_meet_vectors_in_blocks(spark, monkeypatch):
    """Features of given pairs: vectors go out once a block, and a stored list is not made again."""
    monkeypatch.setattr(learn, "LEAST_BLOCK", 7)
    r = np.random.default_rng(6)
    sizes = (4, 3, 2, 5)
    rows = [(f"i{i:03d}", *[r.normal(size=w).tolist() for w in sizes]) for i in range(60)]
    schema = "image_name string, clip array<double>, shape array<double>, color array<double>, stripe array<double>"
    items = spark.createDataFrame([*rows, rows[3]], schema)  # one name twice
    views = spark.createDataFrame([(n, v, *x) for n, *x in rows[:50] for v in range(3)], "image_name string, view int" + schema[17:])
    pairs = sorted({(f"i{a:03d}", f"i{b:03d}") for a, b in r.integers(0, 70, (400, 2))} | {("i001", "i003"), (None, "i001")}, key=str)
    of = spark.createDataFrame(pairs, "image_name string, partner string")
    got = learn.training_pairs(views, items, of, of, 2, stored=True)
    assert "Join" not in (plan := got._jdf.queryExecution().analyzed().toString()) and "MapInArrow" not in plan
    vec = {n: [np.array(v) for v in x] for n, *x in rows}
    want = []
    for a, b in pairs:
        if a in vec and a < "i050" and b in vec:
            clip, shape, color, stripe = (x @ y for x, y in zip(vec[a], vec[b], strict=True))
            f = [clip, clip, shape, color, stripe, clip - shape, shape - color, stripe - color, clip * stripe, shape * stripe]
            want += [(label, *np.round(f, 9)) for label, n in ((1.0, 3), (0.0, 2)) for _ in range(n * (2 if b == "i003" else 1))]
    assert sorted((x.label, *np.round(x.features, 9)) for x in got.collect()) == sorted(want) and len(want) > 500
