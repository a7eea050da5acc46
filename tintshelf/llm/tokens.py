"""Token counts of documents by a separator scan over flat token files.

A token file is nothing but token ids, little-endian, two or four bytes each, with an end-of-document id behind every
document: no index, no header. Files are listed by Spark and cut into blocks of bounded size whatever a file's length;
a task reads its block's bytes and finds the separators in one vectorised comparison. A document may span blocks: where
it starts is one past the last separator before, which is a running maximum over blocks, as its number in the file is a
running sum. Both are prefix scans in two steps (groups of blocks, then blocks in a group), so one file of any size is
never gathered in a task.

Defined cases: two separators in a row are an empty document of 0 tokens; tokens behind the last separator are a document
that is not closed; an empty file has no documents; bytes at the end that are no whole id are ignored; an empty folder of
files gives no rows. ``write_tokens``: null text counts as empty, rows are written as often as given, null doc_id stays
null, an empty table writes nothing, further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintshelf.llm.common import stored

#: Ids in a block, and blocks in a group of the scan.
BLOCK_IDS, GROUP_BLOCKS = 1 << 20, 1024


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def id_type(size: int) -> np.dtype:
    """Two bytes where all ids fit, else four."""
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def write_tokens(documents: DataFrame, folder: str, make_encoder: Callable[[], Callable[[list[str]], list]], end: int, size: int) -> DataFrame:
    """Write a token file for each partition of (doc_id, text); returns (file, ordinal, doc_id) of what was written.

    ``make_encoder`` runs in the task and gives a function from texts to lists of ids. A file gets its name only when it
    is complete, so a task that runs again, or twice, leaves one whole file.
    """
    kind = id_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        store, root = _opened(folder)
        name = f"tokens-{TaskContext.get().partitionId():07d}.bin"
        draft = f"{root}/_{name}.{uuid.uuid4().hex}"
        out, ordinal = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(draft)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for k in range(0, len(texts), 256):
                for ids in encode(texts[k : k + 256]):
                    out.write(np.append(np.asarray(ids, dtype=kind), kind.type(end)).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0)], names=["file", "ordinal", "doc_id"])
            ordinal += n
        if out is not None:
            out.close()
            if store.get_file_info(f"{root}/{name}").type.name == "File":
                store.delete_file(draft)  # another attempt was first, with the same bytes
            else:
                store.move(draft, f"{root}/{name}")

    return stored(documents.select("doc_id", "text").mapInArrow(run, "file string, ordinal bigint, doc_id bigint"))


def _scan(end: int, kind: np.dtype):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, block, start, stop in zip(frame["path"], frame["block"], frame["start"], frame["stop"], strict=True):
                store, name = _opened(path)
                with store.open_input_file(name) as f:
                    f.seek(start * kind.itemsize)
                    ids = np.frombuffer(f.read((stop - start) * kind.itemsize), dtype=kind)
                at = np.flatnonzero(ids == end).astype(np.int64) + start
                yield pd.DataFrame({"path": [path], "block": [block], "ends": [at], "n": [len(at)], "last": [at[-1] if len(at) else -1], "stop": [stop]})

    return run


def count_tokens(spark: SparkSession, folder: str, end: int, size: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in the token files of a folder."""
    kind = id_type(size)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", F.floor(F.col("length") / kind.itemsize).alias("ids"))
    cut = listed.filter("ids > 0").select("path", "ids", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("ids") - 1, F.lit(block_ids).cast("long"))).alias("block", "start"))
    blocks = cut.select("path", "block", "start", F.least(F.col("start") + block_ids, "ids").alias("stop")).repartition("path", "block")
    found = stored(blocks.mapInPandas(_scan(end, kind), "path string, block int, ends array<bigint>, n bigint, last bigint, stop bigint"))

    grouped = found.withColumn("grp", F.floor(F.col("block") / GROUP_BLOCKS))
    over = Window.partitionBy("path").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("path", "grp").agg(F.sum("n").alias("gn"), F.max("last").alias("glast"), F.max("stop").alias("gstop"))
    groups = groups.select("path", "grp", F.coalesce(F.sum("gn").over(over), F.lit(0)).alias("n0"), F.coalesce(F.max("glast").over(over), F.lit(-1)).alias("last0"))
    inside = Window.partitionBy("path", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        grouped.withColumn("n1", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("last1", F.coalesce(F.max("last").over(inside), F.lit(-1)))
        .join(groups, ["path", "grp"])
        .select("path", "ends", "n", "last", "stop", (F.col("n0") + F.col("n1")).alias("before"), F.greatest("last0", "last1").alias("carry"))
    )
    file = F.regexp_extract("path", r"([^/]*)$", 1)
    one = placed.select(file.alias("file"), "before", F.posexplode(F.zip_with(F.concat(F.array("carry"), "ends"), "ends", lambda a, b: F.struct(a.alias("prev"), b.alias("end")))).alias("k", "d"))
    closed = one.filter(F.col("d.end").isNotNull()).select(
        "file", (F.col("before") + F.col("k")).alias("ordinal"), (F.col("d.prev") + 1).alias("start"), (F.col("d.end") - F.col("d.prev") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    files = placed.groupBy(file.alias("file")).agg(F.sum("n").alias("ordinal"), F.max("last").alias("last"), F.max("stop").alias("stop"))
    rest = files.filter(F.col("stop") > F.col("last") + 1).select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("stop") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def ordinary_encoder(path: str, pattern: str) -> Callable[[], Callable[[list[str]], list]]:
    """Encoder of a public rank file without special tokens: their strings are ordinary text."""

    def make():
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [coder.encode_ordinary(t) for t in texts]

    return make
