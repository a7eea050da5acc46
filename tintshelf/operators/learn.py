"""Pair features, mining of training pairs, the linear re-ranker and its evaluation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintshelf.functions import text as T
from tintshelf.functions.vector import dot
from tintshelf.operators.blocks import CHUNK_ROWS, LEAST_BLOCK, TILE_ROWS, TILE_VALUES, Keep, by_block, similarity_join, within_code_join
from tintshelf.operators.blocks import _rows as vector_rows
from tintshelf.operators.numbering import checkpointed
from tintshelf.operators.vectors import cap_unique_codes, logistic
from tintshelf.session import spread

MODALITIES = ("clip", "shape", "color", "stripe")


def pair_features(pairs: DataFrame, base: str = "base") -> DataFrame:
    """Replace q_clip.. and c_clip.. columns by ``features``, array<double> of 10.

    Base score, four similarities, three differences, two products; each similarity is computed once.
    """
    sims = pairs.select("*", *[dot(F.col(f"q_{m}"), F.col(f"c_{m}")).alias(f"s_{m}") for m in MODALITIES])
    return sims.withColumn("features", _features(F.col(base))).drop(*[f"{side}_{m}" for side in "qcs" for m in MODALITIES])


def _features(base: Column) -> Column:
    clip, shape, color, stripe = [F.col(f"s_{m}") for m in MODALITIES]
    return F.array(
        base, clip, shape, color, stripe,
        clip - shape, shape - color, stripe - color, clip * stripe, shape * stripe,
    )


@dataclass(frozen=True)
class PairModel:
    """Standardising linear model over the 10 pair features."""

    weights: tuple[float, ...]
    intercept: float
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def probability(self, features: Column) -> Column:
        z = F.lit(self.intercept)
        for i, (w, m, s) in enumerate(zip(self.weights, self.mean, self.std)):
            z = z + (F.get(features, F.lit(i)) - m) / s * w
        return logistic(z)

    def products(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Factors of the similarities, of those that the last one is multiplied with, and what is added: the sum is zero at
        probability 0.5."""
        w = np.array(self.weights) / np.array(self.std)
        plain = np.array([w[0] + w[1] + w[5], w[2] - w[5] + w[6], w[3] - w[6] - w[7], w[4] + w[7]])
        return plain, np.array([w[8], w[9], 0.0, 0.0]), float(self.intercept - w @ np.array(self.mean))


def mine_positives(items: DataFrame, per_image: int | None = None) -> DataFrame:
    """(image_name, partner): images of the same code; an image alone pairs with itself.

    items(image_name, style_code, clip). All partners by default, as many as the square of a code's images; with
    ``per_image`` the so many closest by clip, for fits on codes that hold a large share of all images.
    """
    if per_image is None:
        rows = items.select("image_name", "style_code").distinct()
        near = rows.join(rows.withColumnRenamed("image_name", "partner"), "style_code").filter(F.col("image_name") != F.col("partner"))
        near = near.select("image_name", "partner")
    else:
        q = items.select(F.col("image_name").alias("query_id"), F.col("style_code").alias("query_code"), F.col("clip").alias("embedding"))
        c = items.select(F.col("image_name").alias("key"), F.col("style_code").alias("code"), F.col("clip").alias("embedding"))
        near = within_code_join(q, c, Keep(k=per_image, skip_self=True)).select(
            F.col("query_id").alias("image_name"), F.col("key").alias("partner")
        )
    alone = items.groupBy("style_code").agg(F.count("*").alias("n"), F.first("image_name").alias("image_name"))
    alone = alone.filter("n = 1").select("image_name", F.col("image_name").alias("partner"))
    return near.unionByName(alone)


def mine_hard_negatives(items: DataFrame, k: int = 16, **options) -> DataFrame:
    """(image_name, partner): the k most similar images of other codes by clip.

    There is no random fill for short lists: a list is short only when it already holds every image of
    another code, so a fill could only repeat rows.
    """
    q = items.select(F.col("image_name").alias("query_id"), F.col("style_code").alias("query_code"), F.col("clip").alias("embedding"))
    c = items.select(F.col("image_name").alias("key"), F.col("style_code").alias("code"), F.col("clip").alias("embedding"))
    return similarity_join(q, c, Keep(k=k), **options).select(
        F.col("query_id").alias("image_name"), F.col("key").alias("partner")
    )


def labelled_pairs(labels: DataFrame, items: DataFrame, k: int = 24, **options) -> tuple[DataFrame, DataFrame]:
    """Positives and hard negatives (image_name, partner) of labelled queries(image_name, style_code, clip).

    Positives are all images of the labelled code, negatives the ``k`` images of other codes most similar by clip.
    A query counts only if its code has images and another code has some too.
    """
    asked = labels.withColumn("style_code", T.strip(F.coalesce("style_code", F.lit("")))).filter("style_code <> ''")
    q = asked.join(items.select("style_code").distinct(), "style_code", "left_semi")
    near = similarity_join(
        q.select(F.col("image_name").alias("query_id"), F.col("style_code").alias("query_code"), F.col("clip").alias("embedding")),
        items.select(F.col("image_name").alias("key"), F.col("style_code").alias("code"), F.col("clip").alias("embedding")),
        Keep(k=k), **options,
    )
    negatives = checkpointed(near.select(F.col("query_id").alias("image_name"), F.col("key").alias("partner")))
    positives = q.select("image_name", "style_code").join(items.select("style_code", F.col("image_name").alias("partner")), "style_code")
    positives = positives.join(negatives.select("image_name"), "image_name", "left_semi").select("image_name", "partner")
    return positives, negatives


#: Views of one code that meet its items in one task.
CODE_ROWS = 2048


def _code_sides(views: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with style_code, part and the number n of a code's items: they meet by code, so vectors go out once a block."""
    plan = items.groupBy("style_code").agg(F.count("*").alias("n"), F.ceil(F.count("*") / CODE_ROWS).cast("int").alias("parts"))
    q = views.join(plan, "style_code").withColumn("part", F.pmod(F.xxhash64("image_name", "view"), F.col("parts")).cast("int"))
    c = items.join(plan, "style_code").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return q.drop("parts"), c.drop("parts")


def _code_pairs(views: DataFrame, items: DataFrame) -> DataFrame:
    """Every positive as in ``mine_positives``, with q_ and c_ columns."""
    q, c = _code_sides(views, items)
    q = q.select("style_code", "part", "image_name", "n", *[F.col(m).alias(f"q_{m}") for m in MODALITIES])
    c = c.select("style_code", "part", F.col("image_name").alias("partner"), *[F.col(m).alias(f"c_{m}") for m in MODALITIES])
    pairs = spread(q, "style_code", "part").join(spread(c, "style_code", "part"), ["style_code", "part"])
    return pairs.filter((F.col("image_name") != F.col("partner")) | (F.col("n") == 1)).drop("style_code", "part", "n")


class _Tally:
    """A block of a code's views: its pairs with the code's items, and those that the model calls positive, counted in tiles."""

    def __init__(self, model: PairModel):
        self.model, self.parts, self.names, self.n, self.right = model, [], None, 0, 0

    def add(self, names, codes, counts, rows) -> None:
        self.parts.append((names, rows))
        self.layout = codes[0]

    def _build(self) -> None:
        names, rows = (np.concatenate(x) for x in zip(*self.parts))
        order, self.parts = np.argsort(names, kind="stable"), []
        self.names, rows = names[order], rows[order]
        *widths, n = map(int, self.layout.split(","))
        self.alone, self.ends = n == 1, np.cumsum(widths)
        plain, last, self.add_up = self.model.products()
        self.q = (rows * np.repeat(plain, widths), (rows * np.repeat(last, widths))[:, : self.ends[1]], rows[:, self.ends[2] :])

    def feed(self, keys, codes, vectors):
        if self.names is None:
            if not self.parts:
                return
            self._build()
        two, three = self.ends[1], self.ends[2]
        for i in range(0, len(keys), CHUNK_ROWS):
            c, names = vectors[i : i + CHUNK_ROWS], keys[i : i + CHUNK_ROWS]
            start, stop = (np.searchsorted(self.names, names, side=s) for s in ("left", "right"))
            for lo in range(0, len(self.names), TILE_ROWS):
                plain, last, stripe = (x[lo : lo + TILE_ROWS] for x in self.q)
                z = plain @ c.T + (last @ c[:, :two].T) * (stripe @ c[:, three:].T)
                right = z >= -self.add_up
                if not self.alone:  # an image is no partner of itself
                    first, n = np.clip(start - lo, 0, len(z)), np.clip(stop - lo, 0, len(z)) - np.clip(start - lo, 0, len(z))
                    row = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    right[row, np.repeat(np.arange(len(n)), n)] = False
                    self.n -= len(row)
                self.n += right.size
                self.right += int(np.count_nonzero(right))
        yield from ()

    def finish(self):
        yield pa.RecordBatch.from_arrays([pa.array([self.n], pa.int64()), pa.array([self.n], pa.int64()), pa.array([self.right], pa.int64())], names=["n", "positive", "right"])


def code_metrics(views: DataFrame, items: DataFrame, negatives: DataFrame, model: PairModel, negative_views: int = 3) -> DataFrame:
    """As ``training_metrics`` of ``training_pairs`` with all images of the same code as positives, which are counted inside
    blocks of a code and never written: they grow with the square of its images."""
    layout = F.concat_ws(",", *[F.size(m) for m in MODALITIES], "n").alias("code")
    side = lambda df, k: df.select(F.col("style_code").alias("cell"), F.col("part").alias("qc"), F.lit(k).alias("side"), F.col("image_name").alias("key"), layout, F.lit(1).alias("views"), F.concat(*MODALITIES).alias("vec"))
    q, c = _code_sides(views, items)
    dealt = spread(side(q, 0).unionByName(side(c, 1)), "cell", "qc").sortWithinPartitions("cell", "qc", "side", "key")
    near = by_block(dealt, lambda: _Tally(model), "n bigint, positive bigint, right bigint")
    far = training_pairs(views, items, negatives.select("image_name", "partner").limit(0), negatives, negative_views)
    far = far.agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("positive"), F.count_if(model.probability(F.col("features")) < 0.5).alias("right"))
    got = near.unionByName(far).agg(*[F.sum(c).alias(c) for c in ("n", "positive", "right")])
    share = lambda c: F.bround(F.try_divide(F.col(c).cast("double"), F.col("n").cast("double")), 4)
    return got.select(F.col("n").alias("samples"), share("positive").alias("pos_rate"), share("right").alias("train_acc"))


#: Views of one block that pairs are multiplied in.
GATHER_ROWS = 65_536


def _pair_products(views: DataFrame, items: DataFrame, marked: DataFrame, negative_views: int) -> DataFrame:
    """(label, s_clip, ..) of marked(image_name, partner, label): a block of views meets its pairs and the items in the order of
    their keys, so vectors go out once a block, not once a pair."""
    cores, n = views.sparkSession.sparkContext.defaultParallelism, views.count()
    nq = max(1, -(-n // max(1, min(GATHER_ROWS, max(-(-n // cores), LEAST_BLOCK)))))
    widths = [F.size(m) for m in MODALITIES]
    block = F.pmod(F.xxhash64("image_name"), F.lit(nq)).cast("int")
    none = {"name": F.lit(None).cast("string"), "number": F.lit(0.0), "widths": F.array().cast("array<int>"), "vec": F.lit(None).cast("array<double>")}
    row = lambda df, qc, side, kind, key, **given: df.filter(F.col(key).isNotNull()).select(
        qc.alias("qc"), F.lit(side).alias("side"), F.col(key).alias("key"), F.lit(kind).alias("kind"), *[given.get(c, v).alias(c) for c, v in none.items()])
    every = F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))
    sides = [
        row(views, block, 0, 0, "image_name", number=F.col("view").cast("double"), widths=F.array(*widths), vec=F.concat(*MODALITIES)),
        row(marked.filter("image_name IS NOT NULL"), block, 1, 0, "partner", name=F.col("image_name"), number=F.col("label")),
        row(items.repartition(cores), every, 1, 1, "image_name", vec=F.concat(*MODALITIES)),
    ]
    dealt = sides[0].unionByName(sides[1]).unionByName(sides[2])

    def run(batches):
        asked, known, waiting = [], None, None
        for batch in batches:
            side = batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(side[1:] != side[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                key, kind, name, number = (part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4, 5))
                if side[lo] == 0:
                    asked.append((key, number, vector_rows(part.column(7), len(key))))
                    layout = part.column(6)[0].as_py()
                    continue
                if not asked and known is None:
                    continue
                if known is None:  # rows come in the order of their names
                    names, view, stack = (np.concatenate(x) for x in zip(*asked))
                    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
                    known, count, asked = pd.Index(names[first]), np.diff(np.r_[first, len(names)]), []
                    cut = np.cumsum([0, *layout[:-1]])
                    waiting = key[:0], name[:0], number[:0]
                pairs = [np.concatenate([w, x[kind == 0]]) for w, x in zip(waiting, (key, name, number))]
                here = key[kind == 1]
                vectors = vector_rows(part.column(7).filter(pa.array(kind == 1)), len(here))
                start, stop = (np.searchsorted(pairs[0], here, side=s) for s in ("left", "right"))
                at, ci = _ranges(start, stop - start)
                own = known.get_indexer(pairs[1])[at]
                at, ci, own = at[own >= 0], ci[own >= 0], own[own >= 0]
                qi, which = _ranges(first[own], count[own])
                label, ci = pairs[2][at][which], ci[which]
                counts = (label == 1.0) | (view[qi] < negative_views)
                qi, ci, label = qi[counts], ci[counts], label[counts]
                step = max(1, TILE_VALUES // stack.shape[1])
                for i in range(0, len(qi), step):
                    sims = np.add.reduceat(stack[qi[i : i + step]] * vectors[ci[i : i + step]], cut, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(label[i : i + step]), *map(pa.array, np.ascontiguousarray(sims.T))], names=["label", *[f"s_{m}" for m in MODALITIES]])
                last = np.searchsorted(pairs[0], key[-1], side="left")  # items of this key may follow
                waiting = tuple(x[last:] for x in pairs)

    dealt = dealt.repartitionById(nq, F.col("qc")).sortWithinPartitions("qc", "side", "key", "kind")
    return dealt.mapInArrow(run, "label double, " + ", ".join(f"s_{m} double" for m in MODALITIES))


def _ranges(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers start, start + 1, .. of every range of n, and the range of each."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.arange(len(n)), n)


def training_pairs(
    views: DataFrame, items: DataFrame, positives: DataFrame | None, negatives: DataFrame, negative_views: int = 3, stored: bool = False
) -> DataFrame:
    """(label, features): positives with every view of the image, negatives with its first views.

    views(image_name, view, clip, shape, color, stripe) are the query side, items(image_name, ...) the other. Without
    ``positives`` all images of the same code count; both sides then have style_code. ``stored``: the products of the given
    pairs are written once, for pairs that are read several times.
    """
    if positives is None:
        near = _code_pairs(views, items).withColumn("label", F.lit(1.0))
        near = pair_features(near.withColumn("base", dot(F.col("q_clip"), F.col("c_clip"))))
        none = negatives.select("image_name", "partner").limit(0)
        far = training_pairs(views, items, none, negatives, negative_views, stored)
        return near.select("label", "features").unionByName(far.select("label", "features"))
    marked = positives.withColumn("label", F.lit(1.0)).unionByName(negatives.withColumn("label", F.lit(0.0)))
    sims = _pair_products(views, items, marked, negative_views)
    return (checkpointed(sims) if stored else sims).select("label", _features(F.col("s_clip")).alias("features"))


def train_reranker(pairs: DataFrame, regularization: float = 1e-4, max_iter: int = 200) -> PairModel:
    """Fit the re-ranker on (label, features). Statistics and fit are distributed; ten numbers reach the driver."""
    size = 10
    stats = pairs.agg(
        *[F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(size)],
        *[F.stddev_pop(F.col("features")[i]).alias(f"s{i}") for i in range(size)],
    ).first()
    mean = tuple(float(stats[f"m{i}"]) for i in range(size))
    std = tuple(float(stats[f"s{i}"]) + 1e-6 for i in range(size))
    z = F.array(*[(F.col("features")[i] - mean[i]) / std[i] for i in range(size)])
    fit = LogisticRegression(
        featuresCol="z", labelCol="label", regParam=regularization, elasticNetParam=0.0,
        standardization=False, maxIter=max_iter,
    ).fit(pairs.select("label", array_to_vector(z).alias("z")))
    return PairModel(tuple(float(w) for w in fit.coefficients), float(fit.intercept), mean, std)


def rerank(
    ranked: DataFrame,
    query_modal: DataFrame,
    catalog_modal: DataFrame,
    model: PairModel,
    top_n: int = 20,
    weight: float = 0.35,
    max_unique_codes: int = 0,
) -> DataFrame:
    """Blend the model's probability into the first ``top_n`` scores of each query; (query_id, image_name, score).

    The blended score is what later steps rank by; the rest keeps its score. query_modal(query_id, view, 4 parts)
    and catalog_modal(image_name, view, 4 parts) hold a few views each; the best view pair counts.
    """
    cut = cap_unique_codes(ranked, top_n, max_unique_codes)
    head = cut.filter(F.col("rank") <= top_n)
    q = query_modal.select("query_id", *[F.col(m).alias(f"q_{m}") for m in MODALITIES])
    c = catalog_modal.select(F.col("image_name").alias("_file"), *[F.col(m).alias(f"c_{m}") for m in MODALITIES])
    pairs = (
        head.select("query_id", "image_name", F.substring_index("image_name", "@", 1).alias("_file"), F.col("score").alias("base"))
        .join(q, "query_id").join(c, "_file")
    )
    p = pair_features(pairs).groupBy("query_id", "image_name").agg(
        F.max(model.probability(F.col("features"))).alias("p")
    )
    blend = F.when(
        (F.col("rank") <= top_n) & F.col("p").isNotNull(), F.col("score") * (1.0 - weight) + F.col("p") * weight
    ).otherwise(F.col("score"))
    return cut.join(p, ["query_id", "image_name"], "left").select("query_id", "image_name", blend.alias("score"))


def training_metrics(pairs: DataFrame, model: PairModel) -> DataFrame:
    """One row: samples, pos_rate, train_acc at 0.5, 4 places."""
    right = ((model.probability(F.col("features")) >= 0.5).cast("double") == F.col("label")).cast("double")
    return pairs.agg(
        F.count("*").alias("samples"),
        F.bround(F.avg("label"), 4).alias("pos_rate"),
        F.bround(F.avg(right), 4).alias("train_acc"),
    )


def ranking_eval(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: queries, hit rate at k and mean reciprocal rank (0 for a miss). The definition is ours."""
    hit = results.filter(F.col("rank") <= k).join(truth, ["query_id", "style_code"]).groupBy("query_id").agg(
        F.min("rank").alias("at")
    )
    return truth.select("query_id").join(hit, "query_id", "left").agg(
        F.count("*").alias("queries"),
        F.avg(F.when(F.col("at").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"),
        F.avg(F.coalesce(F.lit(1.0) / F.col("at"), F.lit(0.0))).alias("mrr"),
    )
