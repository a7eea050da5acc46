"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded down the tree.

Every element gets the probability of being main text from features of its own, of its subtree (size, density, links),
of its attributes, depth, siblings and ancestors. Decoding picks for each element one of keep, drop or mixed so that what
is kept or dropped holds for everything below it: sums over subtrees from the leaves up, then choices from the root down.
So no kept element has a dropped part unless the element says mixed, and no dropped one has a kept part.

The trees are fitted by Spark's gradient boosting on layouts with known parts (``layouts``), filled with texts of at most
about ``SAMPLE`` of the pages drawn by hash; every page is extracted from its whole html.

Defined cases: null, empty or textless html gives the empty text; so does every page if there is no page to learn from that
holds text; broken markup is closed where it must be; equal rows come back as often as given; null page_id and url stay;
an empty table gives no rows; columns of the caller that are named like ours are replaced, others stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tintshelf.llm import dom
from tintshelf.llm.layouts import Layout

#: Bound of the pages that lend their texts, layouts made of each, shape of the trees.
SAMPLE, LAYOUTS, TREES, DEPTH = 200, 8, 25, 6
#: What a mixed element costs against keeping or dropping it whole, in nats.
MIXED = 2.0
_ADVERT = list(dom.HINTS).index("advert")
#: A page of which nothing is kept is decoded once more with the odds of main text raised so many times.
DOUBT = 5.0


class Trees:
    """Fitted trees as arrays: feature (-1 in leaves), threshold, children, value."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], weights: list[float]):
        self.trees, self.weights = trees, weights

    @classmethod
    def of(cls, model) -> Trees:
        trees = []
        for tree in model._java_obj.trees():
            rows: list[list[float]] = []

            def walk(node, rows=rows) -> int:
                at = len(rows)
                rows.append([-1, 0.0, 0, 0, node.prediction()])
                if node.subtreeDepth() > 0:
                    split = node.split()
                    rows[at][:2] = [split.featureIndex(), split.threshold()]
                    rows[at][2] = walk(node.leftChild())
                    rows[at][3] = walk(node.rightChild())
                return at

            walk(tree.rootNode())
            f, t, a, b, v = (np.array(c) for c in zip(*rows, strict=True))
            trees.append((f.astype(int), t, a.astype(int), b.astype(int), v))
        return cls(trees, list(model.treeWeights))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        every = np.arange(len(x))
        for (feature, threshold, low, high, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), dtype=int)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                left = x[every, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(left, low[at], high[at]), at)
            margin += weight * value[at]
        return np.clip(1 / (1 + np.exp(-2 * margin)), 0.01, 0.99)


#: Words from which on a block without ``<p>`` counts as running text.
RUNNING = 8


def _texts(page: str) -> list[str]:
    """Running texts of a page: of its paragraphs, else of its blocks of some length, else of all its blocks."""
    root = dom.parse(page)
    order = dom.nodes(root)
    marked = [" ".join(" ".join(c for c in n.children if isinstance(c, str)).split()) for n in order if n.tag == "p"]
    blocks = dom.block_texts(root, {id(n) for n in order})
    return [t for t in marked if t] or [t for t in blocks if t.count(" ") + 1 >= RUNNING] or blocks


def _examples(frames: Iterator[pd.DataFrame], layouts: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        xs, ys = [], []
        for page in frame["html"]:
            texts = _texts(page)
            if not texts:
                continue
            for k in range(layouts):
                root = dom.parse(Layout(texts, zlib.crc32(page.encode("utf-8", "replace")) * layouts + k).page())
                order, x = dom.features(root)
                keep: dict[int, float] = {}
                for n in order:
                    mark = n.attrs.get("data-keep")
                    keep[id(n)] = float(mark) if mark else keep.get(id(n.parent), 0.0)
                xs += x.tolist()
                ys += [keep[id(n)] for n in order]
        if xs:
            yield pd.DataFrame({"x": pd.Series(xs, dtype=object), "label": pd.Series(ys, dtype=np.float64)})


def learn(pages: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees from the texts of a bounded sample of (html); None if it holds no text."""
    given = pages.select("html").filter("html IS NOT NULL")
    n = given.count()
    drawn = given.filter(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < min(1.0, sample / max(n, 1)) * 1_000_000)
    layouts = LAYOUTS * -(-min(sample, SAMPLE) // max(min(n, sample), 1))  # of a small table about as many as of a large one
    rows = drawn.mapInPandas(lambda frames: _examples(frames, layouts), "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(8).cache()
    try:
        kinds = rows.select("label").distinct().count()
        if kinds < 2:
            return None
        return Trees.of(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=7, featureSubsetStrategy="0.5", cacheNodeIds=False).fit(rows))
    finally:
        rows.unpersist()


def decode(order: list[dom.Node], p: np.ndarray) -> set[int]:
    """Ids of the kept elements: the best choice of keep, drop and mixed that holds down the tree.

    Choices are made for blocks, for any other element that holds one, and for inline adverts; the text of other inline
    elements belongs to their block and shares its fate.
    """
    index = {id(n): i for i, n in enumerate(order)}
    m = len(order)
    parent = [index[id(n.parent)] if n.parent is not None else -1 for n in order]
    inline = [n.tag not in dom.BLOCK and not (n.hints and n.hints[_ADVERT]) for n in order]
    inline[0] = False
    for i in range(m - 1, 0, -1):  # children come after their parents
        if not inline[i]:
            inline[parent[i]] = False
    size = [sum(len(c.strip()) for c in n.children if isinstance(c, str)) for n in order]
    for i in range(m - 1, 0, -1):
        if inline[i]:
            size[parent[i]] += size[i]
            size[i] = 0
    size = np.array(size)
    weight = np.where(size > 0, 1 + np.log1p(size), 0.0)
    own_keep, own_drop = weight * np.log(p), weight * np.log(1 - p)
    # an element that only wraps another one has nothing to be mixed of
    parts = np.bincount(np.array(parent[1:], dtype=int), minlength=m) + (size > 0)
    keep, drop, mixed = own_keep.copy(), own_drop.copy(), np.maximum(own_keep, own_drop) - np.where(parts > 1, MIXED, 0.0)
    for i in range(m - 1, 0, -1):
        q = parent[i]
        keep[q] += keep[i]
        drop[q] += drop[i]
        mixed[q] += max(keep[i], drop[i], mixed[i])
    chosen, state = set(), [""] * m
    for i in range(m):
        above = state[parent[i]] if i else "mixed"
        if above != "mixed":
            state[i] = above
        elif inline[i]:
            state[i] = "keep" if id(order[parent[i]]) in chosen else "drop"
        else:
            state[i] = "drop" if drop[i] >= max(keep[i], mixed[i]) else "keep" if keep[i] >= mixed[i] else "mixed"
        if state[i] == "keep" or (state[i] == "mixed" and own_keep[i] > own_drop[i]):
            chosen.add(id(order[i]))
    return chosen


def main_texts(pages: list[str | None], trees: Trees | None) -> list[str]:
    """Main texts of some pages: their elements go through the trees together."""
    parsed = [dom.features(dom.parse(h)) if h and trees is not None else None for h in pages]
    found = [x for x in parsed if x is not None]
    p = trees.probability(np.concatenate([x for _, x in found])) if found else np.empty(0)
    out, at = [], 0
    for one in parsed:
        if one is None:
            out.append("")
            continue
        order, x = one
        odds = p[at : at + len(x)]
        at += len(x)
        text = dom.block_texts(order[0], decode(order, odds))
        if not text:  # rather a doubtful article than none
            text = dom.block_texts(order[0], decode(order, odds * DOUBT / (odds * DOUBT + 1 - odds)))
        out.append("\n".join(text))
    return out


#: Characters of html whose elements are judged together (at least one page).
GROUP_CHARS = 2_000_000


_ADDED = T.StructType().add("text", "string").add("n_chars", "long")


def extract_text(pages: DataFrame, trees: Trees | None) -> DataFrame:
    """The rows of ``pages`` with ``text``, the blocks of the main text joined by line feeds, and ``n_chars``."""
    docs = pages.drop(*_ADDED.names)
    at, sent = docs.columns.index("html"), docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, texts, group, chars = batch.column(at).to_pylist(), [], [], 0
            for h in pages:
                if group and chars + len(h or "") > GROUP_CHARS:
                    texts += main_texts(group, sent.value)
                    group, chars = [], 0
                group.append(h)
                chars += len(h or "")
            texts += main_texts(group, sent.value)
            new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *_ADDED.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *_ADDED.fields]))
