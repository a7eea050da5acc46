"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned onto principal axes, largest variance first. A cosine of ``threshold`` or more
means a distance of at most sqrt(2 - 2 threshold), so vectors are dealt to cells of that width on the first axes, and each
also to the neighbouring cells below: two vectors that can link meet in just one cell. A cell is cut into blocks and each
pair of blocks is one task's work: inner products grow over the leading dimensions first, what is left of a pair is at
most the product of the norms of the two remainders, and pairs that cannot reach the threshold any more are dropped.
Those that stay are computed in double precision from the vectors as given.

The axes only order the work: any rotation gives the same links, so they are fitted on at most about ``SAMPLE`` vectors.

Defined cases: vectors link only if labels are equal and not null and lengths are equal; vectors that are null, empty, zero
or hold null or non-finite components link with nothing; equal vectors of one label are one class, compared once and
counted with their number (rows that repeat a vec_id count as vectors of their own); null vec_id comes last among ids; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintshelf.llm.common import stored
from tintshelf.llm.components import components, tile_links

THRESHOLD, SAMPLE = 0.98, 10_000
#: Axes that make the cells, members of a block, dimensions of the steps (each later step is as long as all before it).
GRID, BLOCK, STEP = 1, 512, 8
#: Far above the rounding of sums in single precision. Pairs that are looked at together, and the share of a tile's pairs
#: below which pairs are followed one by one.
SLACK, PAIRS, SPARSE = 1e-4, 50_000, 0.05


def principal_axes(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each length in the sample an orthonormal matrix whose columns fall in variance."""
    out = {}
    for size in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == size], dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[size] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


def _tails(y: np.ndarray) -> np.ndarray:
    """Norm of what is left of each row from every dimension on."""
    left = np.sqrt(np.maximum(0, np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]))
    return np.c_[left, np.zeros(len(y))]


def candidate_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of the pairs whose inner product can reach the threshold, by leading dimensions.

    The bounds are single precision; ``SLACK`` is far above its rounding, so no pair is dropped for it.
    """
    size, at = a.shape[1], 0
    a, b, tail_a, tail_b = (x.astype(np.float32) for x in (a, b, _tails(a), _tails(b)))
    total, low = np.zeros((len(a), len(b)), dtype=np.float32), np.float32(threshold - SLACK)
    while True:
        upto = min(size, max(2 * at, STEP))
        total += a[:, at:upto] @ b[:, at:upto].T
        i, j = np.nonzero(total >= low - np.multiply.outer(tail_a[:, upto], tail_b[:, upto]))
        at = upto
        if at >= size or len(i) < SPARSE * total.size:
            break
    sums = total[i, j]
    while at < size and len(i):  # few are left: each by itself
        upto = min(size, 2 * at)
        sums = sums + np.concatenate([np.einsum("kd,kd->k", a[i[k : k + PAIRS], at:upto], b[j[k : k + PAIRS], at:upto]) for k in range(0, len(i), PAIRS)])
        alive = sums >= low - tail_a[i, upto] * tail_b[j, upto]
        i, j, sums, at = i[alive], j[alive], sums[alive], upto
    return i, j


def linked(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of rows have a cosine of at least the threshold, in double precision."""
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), PAIRS):
        p, q = i[k : k + PAIRS], j[k : k + PAIRS]
        good[k : k + PAIRS] = np.einsum("kd,kd->k", x[p], x[q]) / (norm[p] * norm[q]) >= threshold
    return good


def _cells(axes: dict[int, np.ndarray], width: float):
    def run(frames):
        for frame in frames:
            rows = []
            for cls, label, size, copies, v in zip(frame["cls"], frame["label"], frame["size"], frame["copies"], frame["embedding"], strict=True):
                x = np.asarray(v, dtype=np.float64)
                x = x / np.abs(x).max()
                x = x / np.linalg.norm(x)
                y = x @ axes[len(x)][:, :GRID] if len(x) in axes else x[:GRID]
                own = np.zeros(GRID, dtype=np.int64)
                own[: len(y)] = np.floor(y / width).astype(np.int64)
                rows += [(cls, label, size, copies, v, own.tolist(), (own - np.array(o)).tolist()) for o in itertools.product((0, 1), repeat=GRID)]
            yield pd.DataFrame(rows, columns=["cls", "label", "size", "copies", "embedding", "own", "cell"])

    return run


def _tile(axes: dict[int, np.ndarray], threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cls", kind="stable")
        x = np.array(frame["embedding"].tolist(), dtype=np.float64)
        scale = np.abs(x).max(axis=1, keepdims=True)
        x /= scale
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        y = unit @ axes[x.shape[1]] if x.shape[1] in axes else unit
        own, cell = np.array(frame["own"].tolist()), np.array(frame["cell"].iloc[0])
        block, bi, bj = frame["block"].to_numpy(), frame["bi"].iloc[0], frame["bj"].iloc[0]
        p, q = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        i, j = candidate_pairs(y[p], y[q], threshold)
        i, j = p[i], q[j]
        if bi == bj:
            i, j = i[i < j], j[i < j]
        here = (np.minimum(own[i], own[j]) == cell).all(axis=1)
        i, j = i[here], j[here]
        good = linked(x, i, j, threshold)
        return tile_links(frame["cls"].to_numpy(), i[good], j[good], frame["copies"].to_numpy())

    return run


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    e = F.col("embedding")
    usable = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    usable = usable & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    numbers = F.transform(e, lambda v: v.cast("double"))
    code = F.concat(F.hex(F.xxhash64("label", numbers)), F.lit("-"), F.hex(F.xxhash64(F.lit("again"), "label", numbers)))
    rows = stored(embeddings.select("vec_id", F.when(usable, code).alias("cls"), F.when(usable, F.col("label")).alias("label"), F.when(usable, e).alias("embedding")))
    first = F.min(F.struct(F.col("vec_id").isNull().alias("late"), "vec_id"))
    classes = stored(
        rows.filter("cls IS NOT NULL").groupBy("cls").agg(first.alias("first"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .select("cls", "first.vec_id", "copies", "label", F.size("embedding").alias("size"), "embedding")
    )
    n = classes.count()
    drawn = classes.filter(F.pmod(F.xxhash64("cls"), F.lit(1_000_000)) < min(1.0, SAMPLE / max(n, 1)) * 1_000_000)
    axes = principal_axes([np.asarray(r["embedding"], dtype=np.float64) for r in drawn.select("embedding").collect()])

    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    kinds = dict(classes.dtypes)
    shape = f"cls string, label {kinds['label']}, size int, copies bigint, embedding {kinds['embedding']}, own array<bigint>, cell array<bigint>"
    dealt = stored(classes.drop("vec_id").mapInPandas(_cells(axes, width), shape))
    where = ["label", "size", "cell"]
    blocks = stored(dealt.groupBy(*where).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"), F.count("*").alias("m")).filter("m > 1").drop("m"))
    placed = dealt.join(blocks, where).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks")
    tiles = tiles.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other")
    linked = stored(tiles.groupBy(*where, "bi", "bj").applyInPandas(_tile(axes, threshold), "rep string, links bigint, near string"))

    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(linked.filter("near <> rep").select(F.col("rep").alias("a"), F.col("near").alias("b")))
    found = classes.select("cls", "vec_id", "copies").join(links, F.col("cls") == F.col("rep"), "left").join(comp, F.col("cls") == F.col("v"), "left")
    found = stored(found.select("cls", "vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("c", "cls").alias("comp")))
    lead = stored(found.groupBy("comp").agg(first.alias("first")).select("comp", F.col("first.vec_id").alias("component_id")))
    full = stored(found.join(lead, "comp").select("cls", "n_links", "component_id"))
    out = rows.select("vec_id", "cls").join(full, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
