"""Exact similarity joins between a query side and a catalog side, without a cross join.

Both sides are arrays of doubles; one query may have several views. Two physical ways, same rows:

* the query side is small (checked): it is broadcast once and the catalog is scanned in tiles, each partition
  returning only its own best rows. Products are first grown over the leading principal axes of the queries; what the
  norms of the remaining coordinates add cannot lift most pairs to the k-th best a query already holds in that task (or to
  the floor), and only the others are scored on all coordinates. Where vectors have no leading axes, or few pairs can be
  left out, tiles are scored whole, by matrix products of bounded size;
* otherwise queries are cut into blocks of bounded size. Every block meets the catalog in one task, as a stream sorted by
  key: products of tiles in single precision say, with a proven slack, which pairs are scored in double precision, and
  only the best rows so far are held. Each task gives final rows, so what is shuffled is the catalog once for each block
  (at least a thousand queries), never candidates. Every pair is scored: the work is queries x catalog, memory is not.

Scores are rounded to 12 places, so the block layout cannot change them; ties go to the smaller key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tintshelf.operators.numbering import checkpointed
from tintshelf.session import spread

PAIR_SCHEMA = "query_id string, key string, score double"
MAX_BROADCAST_VALUES = 8_000_000  # 64 MB of doubles
MAX_SCANNED = 400_000  # best rows (queries x k) that a task of the first way holds
#: Queries of one block, the fewest where cores are many, best rows it holds (queries x k), rows of a tile, blocks for each core.
MAX_BLOCK, LEAST_BLOCK, MAX_HELD, TILE_ROWS, BLOCKS_PER_CORE = 16_384, 1024, 2_000_000, 512, 2
CHUNK_ROWS = 4096
TILE_VALUES = 4_000_000  # scores of one product of tiles: 32 MB
PLACES = 12
MAX_VIEWS = 64  # of a query, that are joined one at a time


@dataclass(frozen=True)
class Keep:
    """What survives per query: the best ``k`` keys, or every key whose best score reaches ``floor``."""

    k: int | None = None
    floor: float | None = None
    consensus: float = 0.0
    skip_self: bool = False  # leave out the row whose key is the query id
    same_code: bool = False  # query_code must equal code; by default it must differ


def _matrix(column) -> np.ndarray:
    return np.asarray([np.asarray(v, dtype=np.float64) for v in column], dtype=np.float64)


class _Queries:
    """Query rows of one task as one stacked matrix plus the row offsets of each query."""

    def __init__(self, pdf: pd.DataFrame):
        self.ids = pdf["query_id"].to_numpy(dtype=object)
        self.codes = pdf["query_code"].to_numpy(dtype=object)
        views = [_matrix(v) for v in pdf["views"]]
        self.counts = np.array([len(v) for v in views])
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(int)
        self.stack = np.vstack(views) if views else np.zeros((0, 1))

    def tiles(self, rows: int):
        """Parts of at most ``rows`` stacked rows (one query at least)."""
        first = 0
        while first < len(self.ids):
            upto = max(first + 1, int(np.searchsorted(np.cumsum(self.counts[first:]), rows, side="right")) + first)
            part = object.__new__(_Queries)
            part.ids, part.codes, part.counts = self.ids[first:upto], self.codes[first:upto], self.counts[first:upto]
            start = self.starts[first]
            part.starts, part.stack = self.starts[first:upto] - start, self.stack[start : start + part.counts.sum()]
            yield part
            first = upto

    def _over_views(self, per_view: np.ndarray, join: np.ufunc) -> np.ndarray:
        """Rows of a query joined one view at a time, over all queries at once: ``reduceat`` down columns is many times slower."""
        if self.counts.max(initial=0) > MAX_VIEWS:
            return join.reduceat(per_view, self.starts, axis=0)
        out = per_view[self.starts]
        for view in range(1, self.counts.max(initial=0)):
            some = np.flatnonzero(self.counts > view)
            if len(some) == len(out):
                join(out, per_view[self.starts + view], out=out)
            else:
                out[some] = join(out[some], per_view[self.starts[some] + view])
        return out

    def fuse(self, per_view: np.ndarray, consensus: float) -> np.ndarray:
        top = self._over_views(per_view, np.maximum)
        if consensus <= 1e-6:
            return top
        mean = self._over_views(per_view, np.add) / self.counts[:, None]
        return (1.0 - consensus) * top + consensus * mean


def _best_pairs(queries: _Queries, keys, codes, vectors: np.ndarray, keep: Keep) -> pd.DataFrame:
    """Surviving (query, key, score) rows of one block pair, by matrix product."""
    order = np.argsort(keys, kind="stable")
    keys, codes, vectors = keys[order], codes[order], vectors[order]
    scores = np.round(queries.fuse(queries.stack @ vectors.T, keep.consensus), PLACES)
    if any(c is not None for c in queries.codes):
        scores[(queries.codes[:, None] == codes[None, :]) != keep.same_code] = -np.inf
    if keep.skip_self:
        scores[queries.ids[:, None] == keys[None, :]] = -np.inf
    if keep.floor is not None:
        mask = scores >= keep.floor
    else:
        mask = scores > -np.inf
        if scores.shape[1] > keep.k:
            kth = -np.partition(-scores, keep.k - 1, axis=1)[:, keep.k - 1 : keep.k]
            above = scores > kth
            level = (scores == kth) & mask
            room = keep.k - above.sum(axis=1, keepdims=True)
            mask &= above | (level & (np.cumsum(level, axis=1) <= room))
    qi, ci = np.nonzero(mask)
    out = pd.DataFrame({"query_id": queries.ids[qi], "key": keys[ci], "score": scores[qi, ci]})
    return _merge(out, keep)


#: Share of the squares that the leading axes hold, the most of all axes they may be, the share of pairs above which a
#: tile is scored whole, and the fewest rows of a task's first tile, which only serves to fill the queries' lists; tiles then
#: double, so that the k-th best is near its last value before most rows come.
LEADING, MOST_AXES, WHOLE_SHARE, FIRST_ROWS = 0.8, 0.5, 0.2, 128


def leading_axes(stack: np.ndarray) -> np.ndarray | None:
    """Orthonormal axes (width x axes) that hold most of the squares of these rows; None if that takes too many.

    They decide how much is left out, never which rows are found.
    """
    if not len(stack) or not np.isfinite(stack).all():
        return None
    values, axes = np.linalg.eigh(stack.T @ stack)
    share = np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
    n = int(np.searchsorted(share, LEADING)) + 1
    return axes[:, ::-1][:, :n].copy() if n <= MOST_AXES * stack.shape[1] else None


def _on_axes(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates, and a bound of the norm of the rest."""
    lead = x @ axes
    square = (x * x).sum(1)
    return lead, np.sqrt(np.maximum(square - (lead * lead).sum(1), 0) + 1e-12 * square)


def _pruned_pairs(queries: _Queries, q_axes, c_axes, keys, codes, vectors, keep: Keep, limit: np.ndarray) -> tuple[pd.DataFrame | None, int]:
    """As ``_best_pairs`` for pairs that can reach ``limit`` (one per query), and the multiplications; None if most can."""
    (q_lead, q_rest), (c_lead, c_rest) = q_axes, c_axes
    bound = queries.fuse(q_lead @ c_lead.T + q_rest[:, None] * c_rest[None, :], keep.consensus)
    work = q_lead.size * len(c_lead)
    alive = bound >= (limit - 1e-9 * (1 + np.abs(limit)))[:, None]
    if any(c is not None for c in queries.codes):
        alive &= (queries.codes[:, None] == codes[None, :]) == keep.same_code
    if keep.skip_self:
        alive &= queries.ids[:, None] != keys[None, :]
    if alive.mean() > WHOLE_SHARE:
        return None, work
    qi, ci = np.nonzero(alive)
    views = queries.counts[qi]
    first = np.cumsum(views) - views
    row = np.repeat(queries.starts[qi] - first, views) + np.arange(views.sum())
    scores = np.einsum("ij,ij->i", queries.stack[row], vectors[np.repeat(ci, views)])
    if len(qi):
        top = np.maximum.reduceat(scores, first)
        scores = top if keep.consensus <= 1e-6 else (1.0 - keep.consensus) * top + keep.consensus * np.add.reduceat(scores, first) / views
    scores = np.round(scores, PLACES)
    out = pd.DataFrame({"query_id": queries.ids[qi], "key": keys[ci], "score": scores})
    return _merge(out if keep.floor is None else out[out["score"] >= keep.floor], keep), work + len(row) * vectors.shape[1]


def _reach(rows: pd.DataFrame, queries: _Queries, k: int) -> np.ndarray:
    """The k-th best score of each query among merged rows; minus infinity where there are fewer."""
    kth = rows.groupby("query_id", sort=False)["score"].agg(["size", "min"])
    kth = kth[kth["size"] >= k]["min"]
    return kth.reindex(queries.ids).fillna(-np.inf).to_numpy(float)


def _merge(rows: pd.DataFrame, keep: Keep) -> pd.DataFrame:
    if keep.floor is not None:
        return rows.groupby(["query_id", "key"], as_index=False, sort=False)["score"].max()
    rows = rows.sort_values(["query_id", "score", "key"], ascending=[True, False, True])
    return rows.groupby("query_id", sort=False).head(keep.k)


def best_of(pairs: DataFrame, keep: Keep) -> DataFrame:
    if keep.floor is not None:
        return pairs.groupBy("query_id", "key").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return pairs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep.k).drop("_rn")


def _scan(queries: DataFrame, catalog: DataFrame, keep: Keep, counters=None) -> DataFrame:
    """Tiles of queries against tiles of catalog rows; a task holds one product of tiles and the best rows so far.

    ``counters``: two accumulators of multiplications made, and of those that scoring every pair takes.
    """
    whole = _Queries(queries.toPandas())
    shared = queries.sparkSession.sparkContext.broadcast((whole, leading_axes(whole.stack)))

    def best(batches):
        stacked, axes = shared.value
        tiles = list(stacked.tiles(TILE_VALUES // CHUNK_ROWS))
        on_axes = [_on_axes(t.stack, axes) for t in tiles] if axes is not None else []
        held: list[list[pd.DataFrame]] = [[] for _ in tiles]
        limits = [np.full(len(t.ids), -np.inf if keep.floor is None else keep.floor) for t in tiles]
        size = max(FIRST_ROWS, 2 * keep.k) if axes is not None and keep.floor is None else CHUNK_ROWS
        for pdf in batches:
            start = 0
            while start < len(pdf):
                part = pdf.iloc[start : start + size]
                start, size = start + size, min(CHUNK_ROWS, 2 * size)
                keys, codes, vectors = part["key"].to_numpy(object), part["code"].to_numpy(object), _matrix(part["vec"])
                c_axes = _on_axes(vectors, axes) if axes is not None else None
                made = c_axes[0].size * vectors.shape[1] if c_axes else 0
                for t, (tile, rows) in enumerate(zip(tiles, held, strict=True)):
                    every, found = tile.stack.size * len(vectors), None
                    if c_axes is not None and np.isfinite(limits[t]).mean() > 0.5:
                        found, work = _pruned_pairs(tile, on_axes[t], c_axes, keys, codes, vectors, keep, limits[t])
                        made += work
                    if found is None:
                        found = _best_pairs(tile, keys, codes, vectors, keep)
                        made += every
                    if counters is not None:
                        counters[1].add(every)
                    if keep.floor is not None:  # every row counts here, so hand them on instead of holding them
                        yield found
                        continue
                    rows.append(found)
                    if sum(map(len, rows)) > (1.25 if len(rows) > 1 else 0.5) * len(tile.ids) * keep.k:
                        rows[:] = [_merge(pd.concat(rows), keep)]
                        limits[t] = _reach(rows[0], tile, keep.k)
                if counters is not None:
                    counters[0].add(int(made))
        for rows in held:
            if rows:
                yield _merge(pd.concat(rows), keep)

    return catalog.mapInPandas(best, PAIR_SCHEMA)


class _Tile:
    """A tile of queries while catalog rows pass in the order of their keys; scores are first taken in single precision.

    A row is scored in double precision where the single product, and what it can be wrong by, may still count.
    """

    def __init__(self, queries: _Queries, codes: dict | None, keep: Keep):
        self.queries, self.keep = queries, keep
        self.plain = bool((queries.counts == 1).all())
        self.single = queries.stack.astype(np.float32)
        norm = np.sqrt((queries.stack * queries.stack).sum(1))
        self.norm = norm if self.plain else np.maximum.reduceat(norm, queries.starts)
        self.codes = None if codes is None else np.array([codes[c] for c in queries.codes])
        n = len(queries.ids)
        self.carry = (None, None)
        if keep.floor is None:
            self.scores, self.keys = np.full((n, keep.k), -np.inf), np.empty((n, keep.k), dtype=object)
            self.waiting, self.n_waiting = [], 0

    def _fused(self, products: np.ndarray) -> np.ndarray:
        return products if self.plain else self.queries.fuse(products, self.keep.consensus)

    def _leave_out(self, scores: np.ndarray, chunk: "_Chunk") -> None:
        """Pairs that do not count, and those without a number, get minus infinity."""
        if self.codes is not None:
            scores[(self.codes[:, None] == chunk.codes[None, :]) != self.keep.same_code] = -np.inf
        if self.keep.skip_self:
            scores[self.queries.ids[:, None] == chunk.keys[None, :]] = -np.inf
        scores[np.isnan(scores)] = -np.inf

    def _exact(self, qi: np.ndarray, ci: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        q, out, step = self.queries, [], max(1, TILE_VALUES // max(1, 2 * vectors.shape[1] * int(self.queries.counts.max())))
        for i in range(0, len(qi), step):
            rows, cols = qi[i : i + step], ci[i : i + step]
            views = q.counts[rows]
            first = np.cumsum(views) - views
            row = np.repeat(q.starts[rows] - first, views) + np.arange(views.sum())
            scores = np.einsum("ij,ij->i", q.stack[row], vectors[np.repeat(cols, views)])
            if not self.plain:
                top, w = np.maximum.reduceat(scores, first), self.keep.consensus
                scores = top if w <= 1e-6 else (1.0 - w) * top + w * np.add.reduceat(scores, first) / views
            out.append(np.round(scores, PLACES))
        return np.concatenate(out) if out else np.empty(0)

    def best(self, chunk: "_Chunk") -> None:
        """Hold the k best; of equal scores the earlier, which has the smaller key."""
        k, q = self.keep.k, self.queries
        single = chunk.finite and chunk.longest < 1e15 and bool((self.norm < 1e15).all())
        scores = self._fused(self.single @ chunk.single.T if single else q.stack @ chunk.vectors.T)
        limit = self.scores[:, -1]
        unit = (chunk.vectors.shape[1] + 16) * (2.0**-24 if single else 2.0**-53)
        with np.errstate(invalid="ignore", over="ignore"):
            slack = 2.0 * unit * self.norm * chunk.longest + 1e-12
        slack = np.where(np.isfinite(slack), slack, np.inf)
        low = limit - slack
        mask = scores >= low[:, None].astype(scores.dtype)
        if np.count_nonzero(mask) > 2 * k * len(q.ids):
            self._leave_out(scores, chunk)
            if scores.shape[1] > k:
                with np.errstate(invalid="ignore"):
                    reach = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - 2 * slack
                low = np.fmax(low, reach)
            mask = (scores >= low[:, None].astype(scores.dtype)) & (scores > -np.inf)
        qi, ci = np.nonzero(mask)
        if self.codes is not None:
            counts = (self.codes[qi] == chunk.codes[ci]) == self.keep.same_code
            qi, ci = qi[counts], ci[counts]
        if self.keep.skip_self and len(qi):
            other = q.ids[qi] != chunk.keys[ci]
            qi, ci = qi[other], ci[other]
        self.score(qi, ci, chunk.keys, chunk.vectors)

    def score(self, qi: np.ndarray, ci: np.ndarray, keys: np.ndarray, vectors: np.ndarray) -> None:
        """Hold what is among the k best of the pairs (qi, ci), the rows of ``keys`` and ``vectors`` coming in order."""
        k, q, limit = self.keep.k, self.queries, self.scores[:, -1]
        exact = self._exact(qi, ci, vectors)
        more = exact > limit[qi]
        if more.any():
            self.waiting.append((qi[more], keys[ci[more]], exact[more]))
            self.n_waiting += int(more.sum())
        if self.n_waiting > 0.5 * k * len(q.ids) or not np.isfinite(limit).all():
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        qi, keys, scores = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(qi, kind="stable")
        qi, keys, scores = qi[order], keys[order], scores[order]
        got = np.bincount(qi, minlength=len(self.scores))
        at = np.arange(len(qi)) - np.repeat(np.cumsum(got) - got, got)
        some = np.flatnonzero(got)
        row = np.cumsum(got > 0)[qi] - 1
        more, names = np.full((len(some), got.max()), -np.inf), np.empty((len(some), got.max()), dtype=object)
        more[row, at], names[row, at] = scores, keys
        more, names = np.hstack([self.scores[some], more]), np.hstack([self.keys[some], names])
        pick = np.argsort(-more, axis=1, kind="stable")[:, : self.keep.k]
        self.scores[some], self.keys[some] = np.take_along_axis(more, pick, 1), np.take_along_axis(names, pick, 1)

    def above(self, chunk: "_Chunk"):
        """Best score of every (query, key) that reaches the floor; the last key waits for the next chunk."""
        scores = self._fused(self.queries.stack @ chunk.vectors.T)
        self._leave_out(scores, chunk)
        top = np.maximum.reduceat(scores, chunk.starts, axis=1)
        keys = chunk.keys[chunk.starts]
        if self.carry[0] is not None and self.carry[0] == keys[0]:
            top[:, 0] = np.maximum(top[:, 0], self.carry[1])
        elif self.carry[0] is not None:
            yield self._reached(self.carry[1][:, None], np.array([self.carry[0]], dtype=object))
        self.carry = (keys[-1], top[:, -1].copy())
        if len(keys) > 1:
            yield self._reached(top[:, :-1], keys[:-1])

    def _reached(self, top: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        top = np.round(top, PLACES)
        qi, ki = np.nonzero(top >= self.keep.floor)
        return _pair_batch(self.queries.ids[qi], keys[ki], top[qi, ki])

    def finish(self):
        if self.keep.floor is not None:
            if self.carry[0] is not None:
                yield self._reached(self.carry[1][:, None], np.array([self.carry[0]], dtype=object))
            return
        self.settle()
        held = self.scores > -np.inf
        yield _pair_batch(np.repeat(self.queries.ids, held.sum(1)), self.keys[held], self.scores[held])


def _pair_batch(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.string()), pa.array(keys, pa.string()), pa.array(scores, pa.float64())], names=["query_id", "key", "score"]
    )


class _Chunk:
    """Catalog rows, in the order of their keys, against one block of queries."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, vectors: np.ndarray, known: dict | None):
        self.keys, self.vectors = keys, vectors
        self.single = vectors.astype(np.float32)
        self.finite = bool(np.isfinite(vectors).all())
        self.longest = float(np.sqrt((vectors * vectors).sum(1)).max()) if self.finite else np.inf
        self.codes = None if known is None else np.array([known.get(c, -1) for c in codes])
        self.starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def _rows(vec: pa.ListArray, views: int) -> np.ndarray:
    """So many vectors of one width that these lists hold."""
    if vec.null_count:
        raise ValueError("a vector is null")
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(views, -1)


class _Block:
    """One block of queries: first its own rows come, then the catalog's."""

    def __init__(self, keep: Keep, coded: bool):
        self.keep, self.coded = keep, coded
        self.parts, self.tiles, self.known = [], None, None

    def add(self, ids, codes, counts, stack) -> None:
        self.parts.append((ids, codes, counts, stack))

    def _build(self) -> None:
        whole = object.__new__(_Queries)
        whole.ids, whole.codes, whole.counts, whole.stack = (np.concatenate(x) for x in zip(*self.parts))
        whole.starts = np.cumsum(whole.counts) - whole.counts
        self.parts = []
        if self.coded and any(c is not None for c in whole.codes):
            self.known = {c: i for i, c in enumerate(dict.fromkeys(whole.codes))}
        self.tiles = [_Tile(t, self.known, self.keep) for t in whole.tiles(TILE_ROWS)]

    def feed(self, keys, codes, vectors):
        if self.tiles is None:
            if not self.parts:
                return
            self._build()
        for i in range(0, len(keys), CHUNK_ROWS):
            chunk = _Chunk(keys[i : i + CHUNK_ROWS], codes[i : i + CHUNK_ROWS], vectors[i : i + CHUNK_ROWS], self.known)
            for tile in self.tiles:
                if self.keep.floor is None:
                    tile.best(chunk)
                else:
                    yield from tile.above(chunk)

    def finish(self):
        for tile in self.tiles or []:
            yield from tile.finish()


def _streamed(dealt: DataFrame, keep: Keep, coded: bool) -> DataFrame:
    """Pairs of rows (cell, qc, side, key, code, views, vec), whose partitions are sorted by the first four."""
    return by_block(dealt, lambda: _Block(keep, coded), PAIR_SCHEMA)


def by_block(dealt: DataFrame, new_block, schema: str) -> DataFrame:
    """What blocks give for the rows of ``_streamed``: each gets its own rows by ``add``, the others by ``feed``."""

    def run(batches):
        at, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, qc, side, key, code, views, vec = batch.columns
            new = pc.not_equal(cell[1:], cell[:-1]).to_numpy(zero_copy_only=False) if batch.num_rows > 1 else np.empty(0, dtype=bool)
            for c in (qc.to_numpy(), side.to_numpy()):
                new = new | (c[1:] != c[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                here = (cell[lo].as_py(), qc[lo].as_py())
                if here != at:
                    if block is not None:
                        yield from block.finish()
                    at, block = here, new_block()
                n = hi - lo
                names, codes = (x.slice(lo, n).to_numpy(zero_copy_only=False) for x in (key, code))
                counts = views.slice(lo, n).to_numpy()
                rows = _rows(vec.slice(lo, n), int(counts.sum()))
                if side[lo].as_py() == 0:
                    block.add(names, codes, counts, rows)
                else:
                    yield from block.feed(names, codes, rows)
        if block is not None:
            yield from block.finish()

    return dealt.mapInArrow(run, schema)


_SIDES = ["cell", "qc", "side", "key", "code", "views", "vec"]


def _dealt(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Both sides as rows of one shape; ``queries`` have cell and qc, ``catalog`` has cell and the number ``nq`` of blocks."""
    left = queries.withColumns({"side": F.lit(0), "key": F.col("query_id"), "code": F.col("query_code"), "vec": F.flatten("views")})
    left = left.withColumn("views", F.size("views")).select(*_SIDES)
    right = catalog.withColumns({"qc": F.explode(F.sequence(F.lit(0), F.col("nq") - 1)), "side": F.lit(1), "views": F.lit(1)})
    return left.unionByName(right.select(*_SIDES))


def block_count(queries: DataFrame, most: int) -> int:
    """Blocks for queries(views): at most ``most`` queries in one, few enough to fit, enough for all cores; 0 without queries."""
    got = queries.agg(F.count("*").alias("n"), F.sum(F.aggregate("views", F.lit(0), lambda n, v: n + F.size(v))).alias("v")).first()
    n, values = got["n"], got["v"] or 0
    even = -(-n // (BLOCKS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism))
    most = min(MAX_BLOCK, most, MAX_BROADCAST_VALUES * n // max(values, 1))
    return -(-n // max(1, min(most, max(even, LEAST_BLOCK))))


def _by_blocks(queries: DataFrame, catalog: DataFrame, keep: Keep) -> DataFrame:
    """Every block of queries meets the whole catalog in one task, which holds that block and what it found so far."""
    nq = block_count(queries, MAX_HELD // (keep.k or 1))
    if not nq:
        return queries.sparkSession.createDataFrame([], PAIR_SCHEMA)
    q = queries.withColumns({"cell": F.lit(""), "qc": F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")})
    # a file of few row groups would repeat its rows for every block in a few tasks
    c = catalog.repartition(queries.sparkSession.sparkContext.defaultParallelism)
    dealt = _dealt(q, c.withColumns({"cell": F.lit(""), "nq": F.lit(nq)}))
    # the number of a block is that of its partition: hashed, several blocks and their copies of the catalog meet in one task
    return _streamed(dealt.repartitionById(nq, F.col("qc")).sortWithinPartitions("qc", "side", "key"), keep, True)


def chunk_counts(rows: DataFrame, name: str, size: int | None = None) -> DataFrame:
    return rows.groupBy("cell").agg(F.ceil(F.count("*") / (size or CHUNK_ROWS)).cast("int").alias(name))


def cell_join(routed: DataFrame, cells: DataFrame, keep: Keep, coded: bool = False) -> DataFrame:
    """Pairs inside cells: routed(cell, query_id, query_code, views) in blocks against all rows of cells(cell, key, code, vec)."""
    routed, cells = (x.withColumn("cell", F.col("cell").cast("string")) for x in (routed, cells))
    plan = chunk_counts(routed, "nq", max(1, min(CHUNK_ROWS, MAX_HELD // (keep.k or 1))))
    q = routed.join(plan, "cell").withColumn("qc", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int"))
    dealt = spread(_dealt(q, cells.join(plan, "cell")), "cell", "qc")
    return _streamed(dealt.sortWithinPartitions("cell", "qc", "side", "key"), keep, coded)


def prepare_sides(queries: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    no_code = F.lit(None).cast("string")
    q = queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        (F.col("query_code") if "query_code" in queries.columns else no_code).alias("query_code"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    c = catalog.select(
        F.col("key").cast("string").alias("key"),
        (F.col("code") if "code" in catalog.columns else no_code).alias("code"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    q = q.groupBy("query_id").agg(F.first("query_code").alias("query_code"), F.collect_list("vec").alias("views"))
    return q, c


def _fits(q: DataFrame, max_rows: int, k: int) -> bool:
    """One bounded job: the query side has at most ``max_rows`` rows, MAX_BROADCAST_VALUES numbers, MAX_SCANNED best rows."""
    max_rows = min(max_rows, MAX_SCANNED // k)
    values = F.aggregate("views", F.lit(0), lambda n, v: n + F.size(v))
    got = q.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(values).alias("v")).first()
    return got["n"] <= max_rows and (got["v"] or 0) <= MAX_BROADCAST_VALUES


def similarity_join(
    queries: DataFrame,
    catalog: DataFrame,
    keep: Keep,
    max_broadcast_rows: int = 20_000,
    counters=None,
) -> DataFrame:
    """(query_id, key, score) from queries(query_id, embedding[, query_code]) x catalog(key, embedding[, code]).

    Rows of a query with the same ``query_id`` are its views. Where ``query_code`` is given, catalog rows
    of that code are left out.
    """
    q, c = prepare_sides(queries, catalog)
    q = checkpointed(q)  # views are gathered once
    small = _fits(q, max_broadcast_rows, keep.k or 1)
    pairs = best_of(_scan(q, c, keep, counters), keep) if small else _by_blocks(q, c, keep)
    return pairs.withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))


def within_code_join(queries: DataFrame, catalog: DataFrame, keep: Keep) -> DataFrame:
    """As ``similarity_join``, but only rows of the query's own code compete, in the same blocks inside each code."""
    q, c = prepare_sides(queries, catalog)
    pairs = cell_join(q.withColumn("cell", F.col("query_code")), c.withColumn("cell", F.col("code")), keep)
    return pairs.withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))
