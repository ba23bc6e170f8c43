import datetime as dt

import pytest
from pyspark.sql import functions as F

from trackloom.operators import decisions, temporal
from trackloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "seq int, ts timestamp, track_id long, value double"


def rows():
    out = [(i % 2, T0 + dt.timedelta(milliseconds=400 * i), 1 + i % 3, float(i)) for i in range(60)]
    return out + [(0, None, 1, 1.0), (1, T0, 9, float("nan")), out[5]]


@pytest.fixture
def stream(spark, tmp_path):
    """The rows as a file stream of several batches."""

    def make(data, schema, files=3):
        src = str(tmp_path / "in")
        step = -(-len(data) // files)
        for k in range(files):
            spark.createDataFrame(data[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(src)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    return make


def drain(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def test_windows_equal_batch(spark, stream, tmp_path):
    s = stream(rows(), SCHEMA)
    got = drain(spark, jobs.windowed_counts(s.where("ts is not null and not isnan(value)"), "5 seconds"), "tumbling", tmp_path, "complete")
    batch = spark.createDataFrame(rows(), SCHEMA).where("ts is not null and not isnan(value)").groupBy("seq", F.window("ts", "5 seconds")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("seq", "window.start", "window.end", "n", "mean")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_clean_and_rejected(spark, stream, tmp_path):
    s = stream(rows(), SCHEMA)
    good = drain(spark, jobs.clean_events(s, ["seq", "ts", "track_id"], "1 hour"), "clean", tmp_path)
    bad = drain(spark, jobs.rejected_events(s), "bad", tmp_path)
    assert good.count() == 60 and sorted(r.reason for r in bad.collect()) == ["no_time", "not_finite"]


def test_sessions(spark, stream, tmp_path):
    data = [(0, T0 + dt.timedelta(seconds=x), 1, 0.0) for x in (0, 0.5, 1.2, 5, 5.5, 20, 100)]
    got = drain(spark, jobs.presence_sessions(stream(data, SCHEMA), "1 second", "1 second"), "sessions", tmp_path)
    assert sorted(r.n for r in got.collect()) == [1, 2, 3]  # the last session is still open


def test_possession_changes(spark, stream, tmp_path):
    hold = [(0, T0 + dt.timedelta(seconds=i), h, t) for i, (h, t) in enumerate([(5, 1), (5, 1), (7, 1), (9, 2), (9, 2), (5, 1)])]
    got = drain(spark, jobs.possession_changes(stream(hold, "seq int, ts timestamp, holder long, team int")), "changes", tmp_path)
    assert [(r.from_id, r.to_id, r.type) for r in sorted(got.collect(), key=lambda r: r.ts)] == [(5, 7, "pass"), (7, 9, "interception"), (9, 5, "interception")]


def test_links(spark, stream, tmp_path):
    boxes = []
    for i in range(6):
        t = T0 + dt.timedelta(milliseconds=100 * i)
        boxes += [(0, t, 10 * i + 1, 5.0 * i, 0.0, 5.0 * i + 20, 40.0), (0, t, 10 * i + 2, 300.0, 0.0, 320.0, 40.0)]
    boxes.append((0, T0 + dt.timedelta(seconds=9), 99, 300.0, 0.0, 320.0, 40.0))
    got = drain(spark, jobs.link_stream(stream(boxes, "seq int, ts timestamp, det_id long, x1 double, y1 double, x2 double, y2 double")), "links", tmp_path)
    of = {r.det_id: r.track_id for r in got.collect()}
    assert len(of) == 13 and len({of[10 * i + 1] for i in range(6)}) == 1 == len({of[10 * i + 2] for i in range(6)})
    assert len(set(of.values())) == 3


def test_latest_decisions_equal_batch(spark, stream, tmp_path):
    log = [(i, f"b{i % 4}", "m", f"v{i}", None if i % 5 == 0 else T0 + dt.timedelta(seconds=(i * 7) % 11)) for i in range(24)]
    schema = "line_no long, box_id string, mode string, value string, recorded_utc timestamp"
    q = jobs.latest_decisions(stream(log, schema), str(tmp_path / "state"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "state" / "v=2"))
    want = decisions.effective_state(spark.createDataFrame(log, schema))
    assert {(r.box_id, r.value) for r in got.collect()} == {(r.box_id, r.value) for r in want.collect()}


def test_ball_stream_equals_batch(spark, stream, tmp_path):
    frames = [(s, f, f in (9, 20)) for f in range(30) for s in (0, 1)]
    found = lambda s, f: [(x, 50.0, x + 8, 58.0, c) for x, c in ((5.0 * f + 7 * (f % 4), (5 + (f * 13 + s * 7) % 40) / 100), (400.0, 0.12)) if (f + s) % 5]
    box = "x1: double, y1: double, x2: double, y2: double, conf: double"
    data = [(s, f, T0 + dt.timedelta(seconds=f / 5), 0.2, cut, found(s, f)) for s, f, cut in frames]
    got = drain(spark, jobs.select_ball_stream(stream(data, f"seq int, frame int, ts timestamp, dt double, cut boolean, cands array<struct<{box}>>")), "balls", tmp_path)
    cands = spark.createDataFrame([(s, f, *c) for s, f, _ in frames for c in found(s, f)], "seq int, frame int, x1 double, y1 double, x2 double, y2 double, conf double")
    batch = temporal.select_ball(cands, spark.createDataFrame([(s, f, f / 5, 0.2, cut) for s, f, cut in frames], "seq int, frame int, ts double, dt double, cut boolean"))
    key = lambda df: sorted((r.seq, r.frame, r.state, r.x1, r.conf) for r in df.select("seq", "frame", "state", "x1", "conf").collect())
    plain = key(got.na.fill(-1.0))
    assert plain == key(batch.na.fill(-1.0)) and len({r[2] for r in plain}) == 3
