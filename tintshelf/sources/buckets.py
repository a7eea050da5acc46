"""Versioned tables in hash buckets: a change rewrites the buckets it touches, and one pointer names what is current.

A store is a folder in any file system that Spark reads. Rows lie in ``data/<version>/bucket=<n>``, written once and never
changed. A version is a small file that says for every bucket which folder holds it; the version with the highest number is
current, and a version file is created only if none of its number is there, so readers see a change whole or not at all,
and of two writers that start from one version the second fails. A version can carry the token of the request or batch that
made it: ``done(token)`` tells a repeated batch to change nothing. What is held on the driver is one entry per bucket.
A version file gets its name by a rename; in stores where that is no single step, one writer at a time may commit.

The number of buckets is fixed when the store is made. It bounds the share of a table that one changed row rewrites.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket of a key: the first seven hex digits of its MD5, so that other engines find the same one."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 7), 16, 10).cast("bigint") % buckets).cast("int")


class BucketStore:
    """Tables ``{name: (key column, schema)}``; the key's value decides the bucket, null keys lie in bucket 0."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, str]], buckets: int = 256):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.keys = {name: key for name, (key, _) in tables.items()}
        self.schemas = {name: T._parse_datatype_string(schema) for name, (_, schema) in tables.items()}

    # -- version files -------------------------------------------------------------------------------------
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the committed versions, oldest first."""
        store, at = self._store(), self._path("versions")
        names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _read_version(self, number: int) -> dict:
        stream = self._store().open(self._path(f"versions/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict:
        """The current version: its number, the tokens up to it, and for each table the folder of each bucket."""
        known = self.versions()
        return self._read_version(known[-1]) if known else {"version": 0, "tokens": [], "at": {name: {} for name in self.keys}}

    def done(self, token: str) -> bool:
        """Whether a version of this token is committed (of the last ``TOKENS`` ones)."""
        return token in self.current()["tokens"]

    TOKENS = 1000

    def _commit(self, version: dict) -> None:
        store, final = self._store(), self._path(f"versions/{version['version']:012d}.json")
        hidden = self._path(f"versions/_{uuid.uuid4().hex}")
        out = store.create(hidden, False)
        out.write(bytearray(json.dumps(version, sort_keys=True).encode()))
        out.close()
        if store.exists(final) or not store.rename(hidden, final):
            store.delete(hidden, False)
            raise RuntimeError(f"another writer has committed version {version['version']} of {self.folder}")

    # -- rows ----------------------------------------------------------------------------------------------
    def read(self, table: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """Rows of all or some buckets of a table; ``_file`` is the file that holds a row."""
        at = (self.current() if version is None else self._read_version(version))["at"][table]
        wanted = at if buckets is None else {str(b) for b in buckets}
        paths = sorted(f"{self.folder}/{p}" for b, p in at.items() if b in wanted)
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table]).withColumn("_file", F.lit(None).cast("string"))
        return self.spark.read.schema(self.schemas[table]).parquet(*paths).withColumn("_file", F.col("_metadata.file_path"))

    def bucket(self, key: Column) -> Column:
        return F.coalesce(bucket_of(key, self.buckets), F.lit(0))

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys (first column): at most the number of buckets comes to the driver."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(keys.columns[0])).alias("b")).distinct().collect())

    def _write(self, table: str, rows: DataFrame, buckets: list[int], place: str) -> dict[str, str]:
        """Write the rows of some buckets; the folder of each that has rows."""
        place = f"{place}/{table}"
        n = max(1, min(len(buckets), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        out = rows.select(*self.schemas[table].names).withColumn(BUCKET, self.bucket(F.col(self.keys[table]))).repartition(n, BUCKET)
        out.sortWithinPartitions(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/{place}")
        names = [f.getPath().getName() for f in self._store().listStatus(self._path(place))]
        there = {x.removeprefix(f"{BUCKET}=") for x in names if x.startswith(f"{BUCKET}=")}
        stray = there - {str(b) for b in buckets}
        if stray:
            raise ValueError(f"rows of buckets that were not to be replaced: {sorted(stray)[:5]}")
        return {b: f"{place}/{BUCKET}={b}" for b in there}

    def replace(self, changes: dict[str, tuple[DataFrame, list[int]]], token: str | None = None) -> int:
        """Commit one version in which the given buckets of tables hold exactly the given rows, all others what they held.

        Rows may be read from this store: nothing is overwritten. Gives the number of the version.
        """
        old = self.current()
        number, at = old["version"] + 1, dict(old["at"])
        place = f"data/{number:012d}-{uuid.uuid4().hex[:8]}"
        for table, (rows, buckets) in changes.items():
            changed = {str(b) for b in buckets}
            kept = {b: p for b, p in at[table].items() if b not in changed}
            at[table] = kept | (self._write(table, rows, buckets, place) if buckets else {})
        tokens = old["tokens"] if token is None else [*old["tokens"], token][-self.TOKENS :]
        self._commit({"version": number, "tokens": tokens, "at": at})
        return number

    def merged(self, table: str, rows: DataFrame, gone: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
        """A change for ``replace``: rows (one per key) in place of those with their keys, without the keys of ``gone``.

        Only the touched buckets are read. Rows are evaluated more than once: hand in a stored frame.
        """
        key = self.keys[table]
        keys = rows.select(key) if gone is None else rows.select(key).unionByName(gone.select(key))
        buckets = self.touched(keys)
        kept = self.read(table, buckets).drop("_file").join(keys.distinct(), key, "left_anti")
        return kept.unionByName(rows.select(*self.schemas[table].names)), buckets
