"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Items are short and documents long, so the MinHash of a whole document says nothing about an item inside it. The search
therefore works on the item's side: items are partitioned by the size of their shingle set, each partition has a bottom-k
MinHash signature of its own length, and every shingle of every document is looked up in the signatures. A partition of
items with up to ``u`` shingles takes k = u - ceil(c * u) + 1 smallest hashes (all of a smaller set): an item with a share of
at least ``c`` of its shingles in a document leaves fewer than k outside, so one of its k is met. Recall is 1 by count.
A document and an item that meet are compared on their full sets.

The item tables are sent to all tasks only up to ``BLOCK_SHINGLES`` shingles; more items are cut into blocks by hash, one
pass over the documents for each, with the same rows. No document is shuffled.

Defined cases: null and wordless texts and items match nothing; an item of fewer than five words is one shingle of all its
words and is looked for among the runs of as many words; equal documents come back as often as given, equal items count
once; null ids stay null;
an empty table on either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintshelf.llm.common import plain
from tintshelf.llm.shingles import WordHash, grams, shingle_set, words

SHINGLE, CONTAINED = 5, 0.8
#: Shingles of items (8 bytes each) that one pass over the documents carries to every task.
BLOCK_SHINGLES = 2_000_000
#: Upper ends of the size partitions grow by this factor.
GROWTH = 1.25


def signature_size(shingles: int, contained: float) -> int:
    """k of the partition that holds sets of ``shingles``: enough that a contained item cannot hide."""
    upper = 1
    while upper < shingles:
        upper = max(upper + 1, int(upper * GROWTH))
    return upper - math.ceil(contained * upper - 1e-9) + 1


class Items:
    """Signatures and sets of one block of items, for use inside tasks."""

    def __init__(self, rows: list[tuple[int | None, str | None]], n: int, contained: float):
        code = WordHash()
        self.ids, self.sets, self.least, self.n, self.contained = [], [], [], n, contained
        keys: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for item, text in rows:
            found = code(words(text))
            if not len(found):
                continue
            s = shingle_set(found, n)
            signature = s[: signature_size(len(s), contained)]  # hashes are sorted: the smallest
            of = keys.setdefault(min(n, len(found)), ([], []))
            of[0].append(signature)
            of[1].append(np.full(len(signature), len(self.ids)))
            self.ids.append(item)
            self.sets.append(s)
        self.keys = {}
        for m, (codes, owners) in keys.items():
            codes, owners = np.concatenate(codes), np.concatenate(owners)
            order = np.argsort(codes, kind="stable")
            self.keys[m] = (codes[order], owners[order])

    def search(self, found: np.ndarray) -> list[tuple[int, int, int]]:
        """(item index, shingles, shared) of the items that a text with these word hashes contains."""
        out = []
        for m, (codes, owners) in self.keys.items():
            here = grams(found, m)
            at = np.searchsorted(codes, here)
            at = at[codes[np.minimum(at, len(codes) - 1)] == here]
            if not len(at):  # most documents meet no item
                continue
            here = np.unique(here)
            at = np.searchsorted(here, codes)
            met = here[np.minimum(at, len(here) - 1)] == codes
            for k in np.unique(owners[met]):
                s = self.sets[k]
                at = np.searchsorted(here, s)
                shared = int((here[np.minimum(at, len(here) - 1)] == s).sum())
                if shared / len(s) >= self.contained:
                    out.append((int(k), len(s), shared))
        return out


def _blocks(items: DataFrame) -> list[list[tuple[int | None, str | None]]]:
    """The distinct items in blocks of at most ``BLOCK_SHINGLES`` shingles (a larger single item is a block of its own)."""
    bench = plain(items, "item_id", "text").distinct()
    most = F.greatest(F.ceil(F.length("text") / 2), F.lit(1))  # a word takes two characters at least
    n = 1
    while True:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        full = bench.groupBy(part.alias("part")).agg(F.sum(most).alias("size"), F.count("*").alias("rows"))
        if not full.filter((F.col("size") > BLOCK_SHINGLES) & (F.col("rows") > 1)).limit(1).count():
            return [[tuple(r) for r in bench.filter(part == b).collect()] for b in range(n)]
        n *= 2


def find_items(documents: DataFrame, items: DataFrame, contained: float = CONTAINED, n: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): the items of (item_id, text) inside each (doc_id, text)."""
    docs, out = plain(documents, "doc_id", "text"), None
    for rows in _blocks(items):
        sent = documents.sparkSession.sparkContext.broadcast(rows)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block, code = Items(sent.value, n, contained), WordHash()
            for batch in batches:
                got = [(i, *hit) for i, text in enumerate(batch.column(1).to_pylist()) for hit in block.search(code(words(text)))]
                at, item, size, shared = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array([block.ids[k] for k in item], pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(shared, pa.int64()),
                        pa.array([x / y for x, y in zip(shared, size, strict=True)], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"],
                )

        part = docs.mapInArrow(search, "doc_id bigint, item_id bigint, n_shingles bigint, n_shared bigint, containment double")
        out = part if out is None else out.unionAll(part)
    return out


def decontaminate(documents: DataFrame, items: DataFrame, contained: float = CONTAINED, n: int = SHINGLE) -> DataFrame:
    """The rows of ``documents``, with all columns, whose text contains no item. Rows are judged where they lie: no shuffle."""
    at = documents.columns.index("text")
    for rows in _blocks(items):
        sent = documents.sparkSession.sparkContext.broadcast(rows)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block, code = Items(sent.value, n, contained), WordHash()
            for batch in batches:
                yield batch.filter(pa.array([not block.search(code(words(t))) for t in batch.column(at).to_pylist()], pa.bool_()))

        documents = documents.mapInArrow(clean, documents.schema)
    return documents
