"""Streams that decide in order of time: late, repeated and out-of-order rows, forgetting, equality with the batch forms, and the bucketed table."""

import datetime as dt
import random

import pytest

from trackloom.operators import decisions, linking, matching
from trackloom.plans import streams
from trackloom.plans.registry import QUERIES
from trackloom.streaming import ordered
from trackloom.streaming.upsert import LatestTable

T0 = dt.datetime(2024, 1, 1)
PLACES = "seq int, ts timestamp, frame int, kind string, track_id long, team int, x double, y double"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def drained(spark, batches, schema, make, tmp_path):
    """The output over batches that come one after the other, in a checkpoint that is returned."""
    src, cp, out = (str(tmp_path / n) for n in ("in", "cp", "out"))
    rows = []
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(src)
        stream = make(spark.readStream.schema(schema).parquet(src))
        with streams._stateful(spark):
            stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/b={n}")).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(stream.schema).parquet(out).collect()
    return rows, cp


def test_late_repeated_and_unordered_rows(spark, tmp_path):
    ball = lambda s, x: (0, at(s), int(s * 5), "ball", None, None, x, 30.0)
    one = [ball(s / 5, 50.0) for s in range(12)]
    two = [ball(12 / 5, 0.0), ball(0.2, 99.0), (0, at(2.4), 12, "player", 7, 1, 1.0, 30.0), ball(12 / 5, 0.0), (9, at(100), 0, "ball", None, None, 1.0, 1.0)]
    random.Random(1).shuffle(one)
    make = lambda s: ordered.detect_events(s, "0 seconds", 30.0, (0.5, 104.5), 1000.0)
    got, _ = drained(spark, [one, [(9, at(2.2), 0, "player", 1, 1, 1.0, 1.0)], two, [(9, at(300), 0, "player", 1, 1, 1.0, 1.0)]], PLACES, make, tmp_path)
    kinds = sorted((r.type, r.frame, r.track_id) for r in got)
    assert kinds == [("goal", 12, 7), ("repeated", 12, None)]  # the row of 0.2 s is below the watermark, so Spark drops and counts it


def test_rows_for_a_decided_time_are_late(spark, tmp_path):
    """What comes within the watermark's delay but after its time was decided by a timer of another row is told apart."""

    class Now:
        def getCurrentWatermarkInMs(self):
            return int(at(5).replace(tzinfo=dt.UTC).timestamp() * 1000)

    class State:
        def __init__(self):
            self.x = None

        exists = lambda self: self.x is not None
        get = lambda self: self.x
        update = put = lambda self, v: setattr(self, "x", v)
        clear = lambda self: setattr(self, "x", None)
        iterator = lambda self: iter(self.x or [])
        updateValue = lambda self, k, v: None

    class Handle:
        timers: list = []  # noqa: RUF012
        getListState = getValueState = getMapState = lambda self, *a: State()
        listTimers = lambda self: list(self.timers)
        registerTimer = lambda self, t: self.timers.append(t)
        deleteTimer = lambda self, t: self.timers.remove(t)

    import pandas as pd

    p = ordered._Events(60.0, 0.5, 104.5, 15.0, 2.0, 2.0, 2.0, 5.0)
    p.init(Handle())
    frame = lambda *s: pd.DataFrame([(at(x), 1, "ball", None, None, 5.0, 5.0) for x in s], columns=["ts", "frame", "kind", "track_id", "team", "x", "y"])
    (first,) = p.handleInputRows((0,), iter([frame(4, 7)]), Now())
    assert len(first) == 0 and len(p.waiting.x) == 1 and p.handle.timers == [int(at(7).replace(tzinfo=dt.UTC).timestamp() * 1000) + 1]
    (second,) = p.handleInputRows((0,), iter([frame(3)]), Now())
    assert second["type"].tolist() == ["late"]


def test_idle_sequences_are_forgotten(spark, tmp_path):
    rows = [(s, at(i / 5), i, "ball", None, None, 5.0, 5.0) for s in (0, 1) for i in range(5)]
    make = lambda s: ordered.detect_events(s, "0 seconds", 10.0)
    more = [[(1, at(60 + i), 300 + i, "ball", None, None, 5.0, 5.0)] for i in range(2)]
    _, cp = drained(spark, [rows, *more], PLACES, make, tmp_path)
    with streams._stateful(spark):
        kept = lambda name: {r.seq for r in spark.read.format("statestore").option("path", cp).option("stateVarName", name).load().select("key.seq").collect()}
        assert kept("clock") <= {1} and kept("seen") <= {1}


@pytest.mark.parametrize("a,b", [("streamed_recovery", "interpolated_ball"), ("streamed_tracks", "linked_tracks")])
def test_streams_equal_batch(spark, sf, a, b):
    rows = lambda df: sorted(repr(r) for r in df.select("seq", *sorted(c for c in df.columns if c != "seq")).collect())
    want = QUERIES[b](spark, sf)
    if b == "linked_tracks":
        want = want.where("track_id is not null").select("seq", "det_id", "track_id")
    got = rows(QUERIES[a](spark, sf))
    assert got == rows(want) and len(got) > 50


def test_linking_of_stretches_equals_one_walk(spark):
    """Frames apart by more than a track may be out of sight are linked apart, with the same ids."""
    r = random.Random(3)
    rows, det = [], 0
    frame = 0
    for _ in range(60):
        frame += r.choice([1, 1, 1, 2, 31, 32, 90])
        for k in range(r.randint(1, 4)):
            x = 100.0 * k + r.random() * 20
            det += r.randint(1, 3)
            rows.append((0, frame, det, x, 0.0, x + 40, 80.0, "player", r.choice([0.05, 0.3, 0.7, 0.9])))
    df = spark.createDataFrame(rows, "seq int, frame int, det_id long, x1 double, y1 double, x2 double, y2 double, cls string, conf double")
    got = {x.det_id: x.track_id for x in matching.link_tracks(df, 30.0).collect()}
    import numpy as np

    linker, told = linking.Linker(30.0), {}
    for f in sorted({x[1] for x in rows}):
        mine = sorted(x[2:] for x in rows if x[1] == f)
        for _, d, n in linker.step(f, [m[0] for m in mine], np.array([m[1:5] for m in mine]), np.array([m[6] for m in mine])):
            told[d] = n
    name = {n: min(d for d, m in told.items() if m == n) + 1 for n in told.values()}
    assert got == {x[2]: name[told[x[2]]] if x[2] in told else None for x in rows}


def test_latest_table_rewrites_what_it_touches(spark, tmp_path):
    schema = "line_no long, box_id string, mode string, value string, recorded_utc timestamp"
    log = lambda a, b, boxes: spark.createDataFrame([(i, f"b{i % boxes}", "m", f"v{i}", None if i % 5 == 0 else at((i * 7) % 11)) for i in range(a, b)], schema)
    table = LatestTable(str(tmp_path / "t"), ["box_id"], ["recorded_utc", "line_no"], 16)
    table.merge(log(0, 2000, 1000), 0)
    table.merge(log(2000, 2010, 5), 1)
    before = table.versions(spark)
    assert 0 < sum(v == 1 for v in before.values()) <= 5
    table.merge(log(2000, 2010, 5), 1)  # runs again after a failure
    assert table.versions(spark) == before
    table.merge(log(2010, 2012, 2), 2)
    want = decisions.effective_state(log(0, 2000, 1000).union(log(2000, 2010, 5)).union(log(2010, 2012, 2)))
    assert {(r.box_id, r.value) for r in table.read(spark, log(0, 1, 1)).collect()} == {(r.box_id, r.value) for r in want.collect()}
    named = {(k, v) for n in (1, 2) for k, v in table.versions(spark, n).items()}
    there = {(int(b.name[7:]), int(v.name[2:])) for v in (tmp_path / "t/data").iterdir() if "=" in v.name for b in v.iterdir() if "=" in b.name}
    assert there == named


def test_repairs_are_the_latest_that_are_left(spark):
    rows = [(1, "a", "geometry", "1", at(1)), (2, "a", "geometry", "2", at(0)), (3, "a", "ball_case", "x", None), (4, "b", "geometry", "5", at(1)), (5, "b", "geometry", "RETRACT", at(2)), (6, "c", "other", "z", at(1))]
    got = decisions.latest_repairs(spark.createDataFrame(rows, "line_no long, box_id string, mode string, value string, recorded_utc timestamp")).collect()
    assert [tuple(r) for r in got] == [("a", "1", "x", 3)]


def test_possession_windows_count_unknown_frames(spark, tmp_path):
    frames = [(0, at(f / 5), f, 10.0, 10.0, 20.0, 20.0) if f % 3 else (0, at(f / 5), f, None, None, None, None) for f in range(60)]
    humans = [(0, at(f / 5), f, 1 + f % 2, "goalkeeper" if f % 10 == 1 else "player", 1 + f % 2, 5.0, 0.0, 25.0, 16.0) for f in range(60) if f != 4] + [(0, at(4 / 5), 4, 3, "referee", 1, 5.0, 0.0, 25.0, 16.0)]
    f = spark.createDataFrame(frames, "seq int, ts timestamp, frame int, x1 double, y1 double, x2 double, y2 double")
    h = spark.createDataFrame(humans, "seq int, ts timestamp, frame int, track_id long, cls string, team int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.start, r.unknown, r.team1, r.team2) for r in streams.run(ordered.possession_windows(streams.replayed(f), streams.replayed(h), "10 seconds", "20 seconds")).collect())
    of = lambda f: 0 if f % 3 == 0 or f == 4 or f % 10 == 1 else 1 + f % 2
    want = [(at(10 * w), *(sum(of(f) == t for f in range(50 * w, min(60, 50 * w + 50))) for t in (0, 1, 2))) for w in (0, 1)]
    assert got == want
