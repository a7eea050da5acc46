"""Streams over the driver tables as file sources, drained once, next to their batch twins."""

from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks.base import Data, query
from checks.color import AVERAGES, MATCHED
from tintshelf.operators.catalog import Catalog
from tintshelf.streaming import manifest as M
from tintshelf.streaming import readings as S
from tintshelf.session import new_folder as work_folder


def _source(d: Data, name: str):
    return d.spark.readStream.schema(d.table(name).schema).parquet(f"{d.folder}/{name}*.parquet")


def _finish(running, seconds: int = 300) -> None:
    """Wait for a drained stream, however long its tables make it; one in which no task and no batch ends for ``seconds`` is an
    error, not a hang."""
    tracker, last = SparkSession.active().sparkContext.statusTracker(), None
    while not running.awaitTermination(seconds):
        stages = [(i, s.numCompletedTasks) for i in sorted(tracker.getActiveStageIds()) if (s := tracker.getStageInfo(i))]
        now = (p["batchId"] if (p := running.lastProgress) else None, stages)
        if now == last:
            running.stop()
            raise TimeoutError("the stream did not finish")
        last = now


def _drain(stream, folder: str):
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
    _finish(q.trigger(availableNow=True).start())
    return stream.sparkSession.read.parquet(f"{folder}/out")


def _live_readings(d: Data, folder: str, triggers: int):
    """The readings as a stream of ``triggers`` micro-batches of several files, hours out of order between them.

    A last reading weeks later, of a device of its own, lets the watermark pass all others.
    """
    readings = d.readings()
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = readings.agg(F.min(us), F.max(us)).first()
    late = F.pmod(F.xxhash64("reading_id"), F.lit(3 * 3_600_000_000))
    turn = F.least(F.lit(triggers - 1), F.floor((us + late - low) * triggers / (high - low + 1)))
    end = readings.limit(1).select(
        F.lit(-1).cast("bigint").alias("reading_id"), F.lit(-1).cast("bigint").alias("device_id"),
        F.timestamp_micros(F.lit(high + 30 * 86_400_000_000)).cast(readings.schema["ts"].dataType).alias("ts"), *[F.lit(0.0).alias(c) for c in "lab"],
    )
    for k in range(triggers):  # files are read in the order of their writing
        part = readings.filter(turn == k)
        (part.unionByName(end) if k == triggers - 1 else part).repartition(4).write.mode("append").parquet(f"{folder}/in")
    return d.spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")


_MEANS = f"WITH {AVERAGES} SELECT device_id, group_no, ts, round(l, 6) AS l, round(a, 6) AS a, round(b, 6) AS b FROM means"


def _shown(df):
    return df.select("device_id", "group_no", F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.round(c, 6).alias(c) for c in "lab"])


@query("average_readings", _MEANS)
def _(d):
    return _shown(S.average_readings(d.readings()))


@query("stream_average_readings", _MEANS)
def _(d):
    folder = work_folder(d.spark)
    return _shown(_drain(S.stream_average_readings(_live_readings(d, folder, 2), lateness="6 hours", width="10 days"), folder))


@query("recent_devices", """WITH e AS (SELECT user_id % 7 AS owner, 'd' || user_id AS device_id, 'n' || (user_id % 40) AS name, ts FROM events),
    i AS (SELECT owner, device_id, max(ts) AS ts FROM e GROUP BY ALL), n AS (SELECT owner, name, max(ts) AS ts FROM e GROUP BY ALL),
    k AS (SELECT DISTINCT e.* FROM e JOIN i USING (owner, device_id, ts) JOIN n USING (owner, name, ts))
    SELECT owner, (row_number() OVER (PARTITION BY owner ORDER BY ts DESC))::INT AS rank, device_id, name, ts FROM k QUALIFY rank <= 8""")
def _(d):
    e = d.table("events").select(
        (F.col("user_id") % 7).alias("owner"), F.concat(F.lit("d"), "user_id").alias("device_id"),
        F.concat(F.lit("n"), F.col("user_id") % 40).alias("name"), "ts",
    )
    return S.recent_devices(e)


@query("stream_dedup", "SELECT DISTINCT sha256(text) AS hash FROM documents")
def _(d):
    docs = _source(d, "documents").select(F.sha2("text", 256).alias("hash"), F.timestamp_seconds("doc_id").alias("ts"))
    return _drain(M.stream_dedup(docs), work_folder(d.spark)).select("hash")


def _manifest_rows(d: Data):
    """A new folder, and a stream of manifest rows in three files or more, one for each micro-batch."""
    folder = work_folder(d.spark)
    code = F.concat(F.lit("ST"), "lang", F.lit("-"), F.col("doc_id") % 100)

    def rows_of(docs):
        return docs.select(
            F.concat("lang", F.lit("/"), "doc_id").alias("source_rel_path"), F.concat(code, F.lit("_"), "doc_id", F.lit(".jpg")).alias("image_name"),
            code.alias("style_code"), F.array(F.concat(F.lit("category:"), "source")).alias("tags"),
        )

    schema = rows_of(d.table("documents")).schema
    rows_of(d.table("documents")).repartition(3).write.parquet(f"{folder}/in")
    rows = d.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return folder, rows


_MANIFEST_TAGS = r"""WITH rows AS (SELECT 'ST' || lang || '-' || (doc_id % 100) || '_' || doc_id || '.jpg' AS image_name, 'ST' || lang || '-' || (doc_id % 100) AS style_code, 'category:' || source AS tag FROM documents)
    SELECT style_code, tag FROM product_tags UNION SELECT style_code, tag FROM rows"""


@query("stream_manifest", _MANIFEST_TAGS)
def _(d):
    folder, rows = _manifest_rows(d)
    tables, versions = [f.name for f in fields(Catalog)], []

    def load():
        if not versions:
            return d.catalog()
        return Catalog(**{t: d.spark.read.parquet(f"{folder}/v{versions[-1]}/{t}") for t in tables})

    def store(catalog, batch_id):
        for t in tables:
            getattr(catalog, t).write.mode("overwrite").parquet(f"{folder}/v{batch_id}/{t}")
        versions.append(batch_id)

    _finish(M.stream_manifest(rows, load, store, f"{folder}/state", availableNow=True))
    return d.spark.read.parquet(f"{folder}/v{versions[-1]}/product_tags")


@query("stream_manifest_buckets", _MANIFEST_TAGS)
def _(d):
    """The same by a catalog in hash buckets; at the end every batch is handed in once more and changes nothing."""
    folder, rows = _manifest_rows(d)
    store = M.CatalogStore(d.spark, f"{folder}/catalog", buckets=64)
    store.save(d.catalog())
    _finish(M.stream_manifest_buckets(rows, store, f"{folder}/state", availableNow=True))
    last = store.rows.current()
    again = d.spark.read.schema(rows.schema).parquet(f"{folder}/in")
    if last["version"] < 4 or any(store.apply(again, t) for t in last["tokens"]) or store.rows.current() != last:
        raise ValueError("a repeated batch was not known")
    return store.load().product_tags


@query("match_stream", MATCHED)
def _(d):
    """The same rows as of the batch twin."""
    folder = work_folder(d.spark)
    live = _live_readings(d, folder, 1)
    _finish(S.match_stream(live, d.cards().drop("card_key"), f"{folder}/out", f"{folder}/state", k=3, lateness="6 hours", width="10 days", availableNow=True))
    return d.spark.read.parquet(f"{folder}/out").drop("batch")
