"""Colour-meter readings: batch and streaming averages, recent devices, matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tintshelf.operators.colorcards import nearest_colors
from tintshelf.operators.numbering import checkpointed, number_within

SAMPLES = 3
MEANS = "device_id bigint, group_no bigint, us bigint, l double, a double, b double, sample_count int"
ROWS = "us array<bigint>, reading_id array<bigint>, l array<double>, a array<double>, b array<double>"
COLUMNS = {"us": "int64", "reading_id": "int64", "l": "float64", "a": "float64", "b": "float64"}
#: A reading, and the number of a device's groups so far, as they lie in the state of a group of devices.
READING, DONE = np.dtype([("device_id", "<i8"), *COLUMNS.items()]), np.dtype([("device_id", "<i8"), ("done", "<i8")])
#: Groups of devices; each is one key of the state.
GROUPS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def valid_readings(readings: DataFrame) -> DataFrame:
    """Rows whose three values are finite numbers."""
    ok = F.lit(True)
    for c in "lab":
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return readings.filter(ok)


def average_readings(readings: DataFrame, n: int = SAMPLES) -> DataFrame:
    """readings(reading_id, device_id, ts, l, a, b): every n consecutive valid readings of a device become one mean.

    Readings of one time come in the order of their ids. An incomplete last group emits nothing; readings
    without a device are left out. Numbering crosses partitions, so a device may hold any share of the rows.
    """
    numbered = number_within(valid_readings(readings).filter("device_id IS NOT NULL"), ["device_id"], ["ts", "reading_id"])
    groups = numbered.groupBy("device_id", F.floor(F.col("nth") / n).alias("group_no")).agg(
        F.max("ts").alias("ts"), *[F.avg(c).alias(c) for c in "lab"], F.count("*").cast("int").alias("sample_count")
    )
    return groups.filter(F.col("sample_count") == n)


def _micros(span: str) -> int:
    return int(pd.Timedelta(span) / pd.Timedelta("1us"))


class AverageInOrder(StatefulProcessor):
    """Means of n consecutive readings of a device, in order of time and id across micro-batches.

    Arriving frames are put away one by one, cut by spans of ``width``: the rows of a span are chunks in map state and the
    span's end is an event-time timer. When the watermark passes it, no row of the span can come any more: its rows are read,
    put in order and folded behind the unfinished group. So no more than one frame or one span of one device is in memory.
    """

    def __init__(self, n: int, width: int, idle: int | None) -> None:
        self.n, self.width, self.idle = n, width, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "span bigint, chunk int", ROWS)
        self.chunks = handle.getMapState("chunks", "span bigint", "n int")
        self.open = handle.getValueState("open", f"done bigint, {ROWS}")

    def _end(self, span: int) -> int:
        """Milliseconds at which the span is over, rounded up."""
        return -(-(span + 1) * self.width // 1000)

    def _packed(self, part: pd.DataFrame) -> tuple:
        return tuple(part[c].tolist() for c in COLUMNS)

    def _span(self, at: int) -> int:
        """The span that is over at so many milliseconds, or the last one before."""
        span = at * 1000 // self.width - 1
        while self._end(span) > at:  # spans need not be whole milliseconds
            span -= 1
        return span

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for span, part in frame.groupby(frame["us"] // self.width):
                known = self.chunks.getValue((int(span),))
                n = known[0] if known else 0
                self.rows.updateValue((int(span), n), self._packed(part))
                self.chunks.updateValue((int(span),), (n + 1,))
                if n == 0:
                    self.handle.registerTimer(self._end(int(span)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        span = self._span(at)
        known = self.chunks.getValue((span,)) if self._end(span) == at else None
        done, *held = self.open.get() or (0, [], [], [], [], [])
        if known:
            done, held, out = self._fold(key, span, known[0], done, held)
            self.open.update((done, *held))
            if self.idle is not None and held[0]:
                self.handle.registerTimer(self._end((held[0][-1] + self.idle) // self.width))
            if out is not None:
                yield out
        elif held[0] and self.idle is not None and self._end((held[0][-1] + self.idle) // self.width) <= at:
            self.open.update((done, [], [], [], [], []))

    def _fold(self, key: tuple, span: int, chunks: int, done: int, held: list) -> tuple[int, list, pd.DataFrame | None]:
        """Read a span and take it out of the state; groups done, what is left unfinished, and the means."""
        parts = [self.rows.getValue((span, k)) for k in range(chunks)]
        fresh = pd.DataFrame({c: np.concatenate([np.asarray(p[i], dtype=t) for p in parts]) for i, (c, t) in enumerate(COLUMNS.items())})
        for k in range(chunks):
            self.rows.removeKey((span, k))
        self.chunks.removeKey((span,))
        fresh = fresh.sort_values(["us", "reading_id"])
        old = pd.DataFrame({c: np.asarray(v, dtype=t) for (c, t), v in zip(COLUMNS.items(), held, strict=True)})
        rows = pd.concat([old, fresh], ignore_index=True)
        # A long silence ends a run; its last, unfinished group is forgotten.
        silent = np.diff(rows["us"].to_numpy()) > (self.idle if self.idle is not None else np.iinfo(np.int64).max - 1)
        run = np.r_[0, np.cumsum(silent)]
        start = np.r_[0, np.flatnonzero(silent) + 1]
        length = np.diff(np.r_[start, len(rows)])
        whole = length // self.n
        nth = np.arange(len(rows)) - start[run]
        full = nth < (whole * self.n)[run]
        group = (np.cumsum(whole) - whole)[run] + nth // self.n
        left = rows[(run == run[-1]) & ~full]
        out = None
        if full.any():
            out = rows[full].groupby(group[full]).agg(us=("us", "max"), l=("l", "mean"), a=("a", "mean"), b=("b", "mean"))
            out.insert(0, "group_no", done + out.index.to_numpy())
            out.insert(0, "device_id", key[0])
            out["sample_count"] = self.n
        return done + int(whole.sum()), [left[c].tolist() for c in COLUMNS], out


class AverageInGroups(AverageInOrder):
    """The same means where a key of the state is a group of devices: calls of the state store follow groups, not devices.

    Frames have a ``device_id`` as well. A chunk is the bytes of its readings; a span of all devices of a group is folded at
    once, each device behind its own unfinished group. So one frame or one span of one group is in memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "span bigint, chunk int", "readings binary")
        self.chunks = handle.getMapState("chunks", "span bigint", "n int")
        self.open = handle.getValueState("open", "done binary, readings binary")

    def _packed(self, part: pd.DataFrame) -> tuple:
        out = np.empty(len(part), dtype=READING)
        for c in READING.names:
            out[c] = part[c].to_numpy()
        return (out.tobytes(),)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        span = self._span(expiredTimerInfo.getExpiryTimeInMs())
        known = self.chunks.getValue((span,))
        if not known:
            return
        done, held = (np.frombuffer(bytes(x), t) for x, t in zip(self.open.get() or (b"", b""), (DONE, READING), strict=True))
        parts = [np.frombuffer(bytes(self.rows.getValue((span, k))[0]), READING) for k in range(known[0])]
        for k in range(known[0]):
            self.rows.removeKey((span, k))
        self.chunks.removeKey((span,))
        done, held, out = self._fold_all(done, np.concatenate([held, *parts]), (span + 1) * self.width)
        self.open.update((done.tobytes(), held.tobytes()))
        if len(out):
            yield out

    def _fold_all(self, done: np.ndarray, rows: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
        """Groups done by device, what is left unfinished, and the means of all readings before ``end``."""
        rows = rows[np.lexsort((rows["reading_id"], rows["us"], rows["device_id"]))]
        device, us = rows["device_id"], rows["us"]
        other = device[1:] != device[:-1]
        # A long silence ends a run; its last, unfinished group is forgotten.
        silent = np.diff(us) > (self.idle if self.idle is not None else np.iinfo(np.int64).max - 1)
        run = np.r_[0, np.cumsum(other | silent)]
        start = np.r_[0, np.flatnonzero(other | silent) + 1]
        whole = np.diff(np.r_[start, len(rows)]) // self.n
        nth = np.arange(len(rows)) - start[run]
        full = nth < (whole * self.n)[run]
        first = np.r_[0, np.flatnonzero(other) + 1]  # of each device
        last = np.r_[first[1:], len(rows)] - 1
        ids, mine = device[first], np.r_[0, np.cumsum(other)]
        before = np.cumsum(whole) - whole
        group = before[run] - before[run[first]][mine] + nth // self.n

        known = np.union1d(done["device_id"], ids)
        now = np.zeros(len(known), dtype=DONE)
        now["device_id"] = known
        now["done"][np.searchsorted(known, done["device_id"])] = done["done"]
        at = np.searchsorted(known, ids)
        group += now["done"][at][mine]
        now["done"][at] += (before + whole)[run[last]] - before[run[first]]

        keep = ~full & (run == run[last][mine])
        if self.idle is not None:  # no reading that is still to come can follow these
            keep &= us[last][mine] >= end - self.idle
        ends = np.flatnonzero(full)[self.n - 1 :: self.n]
        means = {c: rows[c][full].reshape(-1, self.n).mean(axis=1) for c in "lab"}
        out = pd.DataFrame({"device_id": device[ends], "group_no": group[ends], "us": us[ends], **means, "sample_count": np.full(len(ends), self.n, dtype=np.int32)})
        return now, rows[keep], out


def stream_average_readings(
    readings: DataFrame, n: int = SAMPLES, lateness: str = "1 hour", width: str = "10 minutes", idle: str | None = None, groups: int = GROUPS
) -> DataFrame:
    """Streaming twin of ``average_readings``: the same rows, whatever files and triggers the readings come in.

    A reading may come up to ``lateness`` after a later one of any device; later than that, it is dropped. A mean is emitted
    once the watermark has passed the span of ``width`` its last reading lies in, so the newest readings wait for the stream to
    go on. Between readings of a device more than ``idle`` apart its unfinished group is forgotten (by default never).
    Readings without a time or a device are left out. State of a device: the readings of spans not over, and at most n - 1
    others. Devices lie in ``groups``, a fixed number for the life of a stream's state; a span of a group costs about a dozen
    calls of the state store, and its readings should fit in memory, also of the busiest device.

    State lies in RocksDB, which the session is told to use for streams started from now on.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    live = valid_readings(readings).select(
        "device_id", F.col("ts").cast("timestamp").alias("ts"), "reading_id", *[F.col(c).cast("double").alias(c) for c in "lab"]
    ).filter("ts IS NOT NULL AND device_id IS NOT NULL").withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))
    live = live.withColumn("device_group", F.pmod(F.xxhash64("device_id"), F.lit(groups)).cast("int"))
    processor = AverageInGroups(n, _micros(width), None if idle is None else _micros(idle))
    means = live.groupBy("device_group").transformWithStateInPandas(processor, MEANS, "Append", "EventTime")
    return means.select("device_id", "group_no", F.timestamp_micros("us").alias("ts"), *"lab", "sample_count")


def recent_devices(events: DataFrame, limit: int = 8) -> DataFrame:
    """events(owner, device_id, name, ts) to the owner's last ``limit`` devices, newest first.

    A sighting is replaced by a newer one with the same id or the same name; sightings without both do not count.
    """
    e = events.select(
        "owner", F.coalesce("device_id", F.lit("")).alias("device_id"), F.coalesce("name", F.lit("")).alias("name"), "ts"
    ).filter("device_id <> '' OR name <> ''")
    pairs = e.groupBy("owner", "device_id", "name").agg(F.max("ts").alias("ts"))
    by_id = pairs.groupBy("owner", "device_id").agg(F.max("ts").alias("ts"))
    by_name = pairs.groupBy("owner", "name").agg(F.max("ts").alias("ts"))
    left = pairs.join(by_id, ["owner", "device_id", "ts"], "left_semi").join(by_name, ["owner", "name", "ts"], "left_semi")
    w = Window.partitionBy("owner").orderBy(F.desc("ts"), "device_id", "name")
    return left.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(
        "owner", "rank", "device_id", "name", "ts"
    )


def match_stream(
    readings: DataFrame, cards: DataFrame, sink: str, checkpoint: str, k: int = 12, lateness: str = "1 hour", width: str = "10 minutes", **trigger
) -> StreamingQuery:
    """Average a reading stream and append each mean's k nearest cards to the Parquet ``sink``."""

    def match(batch: DataFrame, batch_id: int) -> None:
        # Means are written once: read again from the stream, they would fold the state again, and two tasks at once want one store.
        named = checkpointed(batch.select(F.concat_ws("/", "device_id", "group_no").alias("reading_id"), "l", "a", "b"))
        # The batch number is the folder: a repeated batch replaces its own rows.
        nearest_colors(named, cards, k).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    means = stream_average_readings(readings, lateness=lateness, width=width)
    return means.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(**trigger).start()
