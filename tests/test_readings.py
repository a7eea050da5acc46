"""Streamed averages against the batch twin and plain Python."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tintshelf.session import new_folder
from tintshelf.streaming import readings
from tintshelf.streaming.readings import AverageInGroups, AverageInOrder, average_readings, stream_average_readings

SCHEMA = "reading_id bigint, device_id bigint, ts timestamp, l double, a double, b double"


class _Cell:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Map(dict):
    def getValue(self, key):  # noqa: N802 - names of the state API
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        del self[key]


class _Handle:
    """State of one device in memory."""

    def __init__(self):
        self.timers, self.maps = set(), {}

    def getMapState(self, name, *_):  # noqa: N802
        return self.maps.setdefault(name, _Map())

    def getValueState(self, *_):  # noqa: N802
        return _Cell()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


class _At:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at


def _plain(rows, n, idle):
    out, held, last = [], [], None
    for us, rid, v in sorted(rows):
        if idle is not None and last is not None and us - last > idle:
            held = []
        last = us
        held.append((us, v))
        if len(held) == n:
            out.append((len(out), held[-1][0], sum(v for _, v in held) / n))
            held = []
    return out


@pytest.mark.parametrize("seed", range(30))
def test_spans_fold_as_one_sorted_run(seed):
    r = random.Random(seed)
    n, width, idle = r.choice([1, 2, 3, 5]), r.choice([1_000, 1_500, 7_000, 60_000]), r.choice([None, 0, 900, 4_000, 50_000])
    rows = [(r.randrange(-20_000, 200_000) if r.random() < 0.9 else 5_000, i, r.random()) for i in range(r.choice([1, 2, 40, 300]))]
    processor, handle = AverageInOrder(n, width, idle), _Handle()
    processor.init(handle)
    lateness, seen, mark, got, largest = 30_000, [], -(10**9), [], 0

    def fire(upto):
        while due := sorted(t for t in handle.timers if t <= upto):
            handle.timers.discard(due[0])
            for out in processor.handleExpiredTimer((7,), None, _At(due[0])):
                got.extend(zip(out["group_no"], out["us"], out["l"], strict=True))

    order = sorted(rows, key=lambda x: x[0] + r.randrange(lateness))
    while order:
        batch, order = order[:50], order[50:]
        frames = [pd.DataFrame([(us, i, v, v, v) for us, i, v in batch[k : k + 7]], columns=["us", "reading_id", "l", "a", "b"]) for k in range(0, len(batch), 7)]
        assert list(processor.handleInputRows((7,), iter(frames), None)) == []
        seen += batch
        mark = max(mark, (max(us for us, _, _ in seen) - lateness) // 1000)
        fire(mark)
        largest = max(largest, sum(len(v[0]) for v in handle.maps["rows"].values()))
    fire(10**9)
    want = _plain(rows, n, idle)
    assert [(int(g), int(us)) for g, us, _ in got] == [(g, us) for g, us, _ in want]
    assert all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(got, want, strict=True))
    assert not handle.maps["rows"] and not handle.maps["chunks"]
    assert processor.open.get()[0] == len(want) and len(processor.open.get()[1]) < n


def test_stream_equals_batch_over_triggers(spark):
    r = random.Random(5)
    rows = []
    for i in range(900):
        device = 1 if i % 3 == 0 else r.choice([2, 3, None])  # one device holds a third
        ts = pd.Timestamp("2024-03-01") + pd.Timedelta(seconds=r.randrange(40) * 60 if i % 5 == 0 else r.randrange(2400))
        rows.append((i, device, ts.to_pydatetime(), *[float("nan") if i % 97 == 0 else r.random() for _ in "lab"]))
    all_rows = spark.createDataFrame(rows, SCHEMA)
    folder = new_folder(spark)
    rows.sort(key=lambda x: x[2] + pd.Timedelta(seconds=r.randrange(240)))
    closing = [(10_000, 99, pd.Timestamp("2024-03-05").to_pydatetime(), 0.0, 0.0, 0.0)]
    for part in (rows[:300], rows[300:600], rows[600:], closing):
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(f"{folder}/in")
    # far too late, so dropped; no time, so left out
    spark.createDataFrame([(10_001, 1, rows[0][2], 1.0, 1.0, 1.0), (10_002, 1, None, 1.0, 1.0, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    means = stream_average_readings(live, lateness="5 minutes", width="7 minutes")
    q = means.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    names = ["device_id", "group_no", "ts", *[F.round(c, 9) for c in "lab"], "sample_count"]
    shown = lambda df: sorted(map(tuple, df.select(*names).collect()), key=str)
    got = shown(spark.read.parquet(f"{folder}/out"))
    assert got == shown(average_readings(all_rows)) and len(got) > 200


@pytest.mark.parametrize("seed", range(30))
def test_spans_of_many_devices_fold_as_sorted_runs(seed):
    r = random.Random(seed)
    n, width, idle = r.choice([1, 2, 3, 5]), r.choice([1_000, 1_500, 7_000, 60_000]), r.choice([None, 0, 900, 4_000, 50_000])
    devices = [r.randrange(-(2**62), 2**62) for _ in range(r.choice([1, 2, 9]))]
    rows = [(r.choice(devices), r.randrange(-20_000, 200_000) if r.random() < 0.9 else 5_000, i, r.random()) for i in range(r.choice([1, 2, 40, 300]))]
    processor, handle = AverageInGroups(n, width, idle), _Handle()
    processor.init(handle)
    lateness, mark, newest, got = 30_000, -(10**9), -(10**9), []

    def fire(upto):
        while due := sorted(t for t in handle.timers if t <= upto):
            handle.timers.discard(due[0])
            for out in processor.handleExpiredTimer((7,), None, _At(due[0])):
                got.extend(zip(out["device_id"], out["group_no"], out["us"], out["l"], strict=True))

    order = sorted(rows, key=lambda x: x[1] + r.randrange(lateness))
    while order:
        batch, order = order[:50], order[50:]
        frames = [pd.DataFrame([(d, us, i, v, v, v) for d, us, i, v in batch[k : k + 7]], columns=["device_id", "us", "reading_id", "l", "a", "b"]) for k in range(0, len(batch), 7)]
        assert list(processor.handleInputRows((7,), iter(frames), None)) == []
        newest = max(newest, *(us for _, us, _, _ in batch))
        mark = max(mark, (newest - lateness) // 1000)
        fire(mark)
    fire(10**9)
    want = {(d, g, us): v for d in devices for g, us, v in _plain([x[1:] for x in rows if x[0] == d], n, idle)}
    assert {x[:3] for x in got} == set(want) and len(got) == len(want)
    assert all(abs(v - want[d, g, us]) < 1e-12 for d, g, us, v in got)
    assert not handle.maps["rows"] and not handle.maps["chunks"]


def test_matching_folds_every_batch_once(spark, monkeypatch):
    """A batch that is read twice folds the state twice, and tasks that want the same store at once fail."""
    folder, seen = new_folder(spark), spark.sparkContext.accumulator(0)
    rows = [(i, i % 7, pd.Timestamp("2024-03-01").to_pydatetime() + pd.Timedelta(seconds=i), float(i % 50), 1.0, 2.0) for i in range(210)]
    closing = [(10_000, 99, pd.Timestamp("2024-03-05").to_pydatetime(), 0.0, 0.0, 0.0)]
    for part in (rows, closing):
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(f"{folder}/in")

    def counted(*args, **options):
        means = stream_average_readings(*args, **options)

        def count(frames):
            for frame in frames:
                seen.add(len(frame))
                yield frame

        return means.mapInPandas(count, means.schema)

    monkeypatch.setattr(readings, "stream_average_readings", counted)
    cards = spark.createDataFrame([("x", str(v), float(v), 0.0, 0.0) for v in range(50)], "library_id string, name string, l double, a double, b double")
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    q = readings.match_stream(live, cards, f"{folder}/out", f"{folder}/state", k=2, availableNow=True)
    assert q.awaitTermination(240)
    assert spark.read.parquet(f"{folder}/out").count() == 2 * 70 and seen.value == 70
