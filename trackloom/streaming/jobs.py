"""Structured Streaming forms of the batch operators.

Inputs are streaming DataFrames with an event time ``ts`` (timestamp) and their sequence ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.linking import buffered


def clean_events(stream: DataFrame, key: list[str], late: str = "10 seconds") -> DataFrame:
    """Rows with a time and finite numbers, each key once within the watermark; later ones than the watermark are dropped by what follows."""
    numbers = [f.name for f in stream.schema if f.dataType.simpleString() in ("double", "float")]
    ok = F.col("ts").isNotNull()
    for c in numbers:
        ok &= F.col(c).isNull() | ~(F.isnan(c) | (F.abs(c) == float("inf")))
    return stream.where(ok).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def rejected_events(stream: DataFrame) -> DataFrame:
    """What clean_events leaves out for its values, with the reason."""
    numbers = [f.name for f in stream.schema if f.dataType.simpleString() in ("double", "float")]
    bad = F.lit(False)
    for c in numbers:
        bad |= F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    return stream.withColumn("reason", F.when(F.col("ts").isNull(), "no_time").when(bad, "not_finite")).where("reason is not null")


def windowed_counts(stream: DataFrame, length: str, slide: str | None = None, late: str = "10 seconds") -> DataFrame:
    """seq, start, end, n, mean of value in tumbling windows (or sliding ones with ``slide``)."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = stream.withWatermark("ts", late).groupBy("seq", w).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return rows.select("seq", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def presence_sessions(stream: DataFrame, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Stretches in which a track is seen without a gap: seq, track_id, start, end, n."""
    rows = stream.withWatermark("ts", late).groupBy("seq", "track_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("seq", "track_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def possession_shares(stream: DataFrame, length: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Per window the frames in which each team had the ball, unknown ones apart (stream: seq, ts, team)."""
    count = lambda t: F.sum((F.col("team") == t).cast("int"))
    rows = stream.withWatermark("ts", late).groupBy("seq", F.window("ts", length)).agg(count(0).alias("unknown"), count(1).alias("team1"), count(2).alias("team2"))
    known = F.col("team1") + F.col("team2")
    return rows.select("seq", F.col("window.start").alias("start"), "unknown", "team1", "team2", F.when(known > 0, F.col("team1") / known).otherwise(0.0).alias("share1"))


class _PossessionChanges(StatefulProcessor):
    """Remembers who had the ball last; emits a row when another does."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, holder long, team int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["ts", "holder"])
        was = self.last.get() if self.last.exists() else None
        out = []
        for ts, holder, team in seen[["ts", "holder", "team"]].itertuples(index=False):
            if was is not None and ts <= was[0]:
                continue  # not after what was already seen
            if was is not None and holder != was[1]:
                out.append((key[0], ts, int(was[1]), int(holder), "pass" if team == was[2] else "interception"))
            was = (ts, int(holder), int(team))
        if was is not None:
            self.last.update(was)
        yield pd.DataFrame(out, columns=["seq", "ts", "from_id", "to_id", "type"])

    def close(self) -> None:
        pass


def possession_changes(stream: DataFrame) -> DataFrame:
    """Passes and interceptions from who has the ball (seq, ts, holder, team), with state per sequence."""
    return stream.groupBy("seq").transformWithStateInPandas(_PossessionChanges(), "seq int, ts timestamp, from_id long, to_id long, type string", "Append", "None")


class _Links(StatefulProcessor):
    """Live tracks of a sequence: place and time of the last box; those out of sight for too long end."""

    def __init__(self, least: float, ttl: float):
        self.least, self.ttl = least, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "id long", "ts double, x1 double, y1 double, x2 double, y2 double")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        live = {k[0]: tuple(v) for k, v in self.live.iterator()} if self.live.exists() else {}
        old = set(live)
        out = []
        seen = pd.concat(list(rows)).sort_values(["ts", "det_id"])
        for ts, part in seen.groupby("ts", sort=True):
            now = ts.timestamp()
            live = {i: v for i, v in live.items() if now - v[0] <= self.ttl}
            boxes = [(r.det_id, (r.x1, r.y1, r.x2, r.y2)) for r in part.itertuples()]
            earlier = [i for i, v in live.items() if v[0] < now]
            s = buffered(np.array([b for _, b in boxes], float), np.array([live[i][1:] for i in earlier], float).reshape(-1, 4), 0.3)
            pairs = sorted((-float(s[k, j]), earlier[j], k) for k, j in zip(*(x.tolist() for x in np.nonzero(s >= self.least))))
            of: dict[int, int] = {}
            used: set[int] = set()
            for _, i, k in pairs:
                if k not in of and i not in used:
                    of[k] = i
                    used.add(i)
            for k, (d, b) in enumerate(boxes):
                if k not in of:
                    n += 1
                    of[k] = n
                live[of[k]] = (now, *b)
                out.append((key[0], ts, int(d), of[k]))
        for i in old - set(live):
            self.live.removeKey((i,))
        for i, v in live.items():
            self.live.updateValue((i,), v)
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["seq", "ts", "det_id", "track_id"])

    def close(self) -> None:
        pass


def link_stream(stream: DataFrame, least: float = 0.2, ttl_seconds: float = 1.0) -> DataFrame:
    """seq, ts, det_id, track_id of a stream of boxes: greedy linking by buffered IoU to live tracks, which end after ttl_seconds out of sight."""
    return stream.groupBy("seq").transformWithStateInPandas(_Links(least, ttl_seconds), "seq int, ts timestamp, det_id long, track_id long", "Append", "None")


class _Ball(StatefulProcessor):
    """The last two anchors of a sequence's ball (time in microseconds, so that gaps are exact); decides each frame from them and its candidates."""

    def __init__(self, accept: float, floor: float, max_gap: float, gate: float, growth: float):
        self.accept, self.floor, self.max_gap, self.gate, self.growth = accept, floor, max_gap, gate, growth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("anchors", "at long, t0 long, x0 double, y0 double, t1 long, x1 double, y1 double")

    def _again(self, a, b, now: int, dt: float, weak: list) -> tuple | None:
        if b is None or not 0 < (now - b[0]) / 1e6 <= self.max_gap + 1e-9:
            return None
        move = (now - b[0]) / (b[0] - a[0]) if a is not None and b[0] > a[0] else 0.0
        px, py = (b[i] + ((b[i] - a[i]) * move if a is not None else 0.0) for i in (1, 2))
        reach = self.gate + self.growth * max(0, round((now - b[0]) / 1e6 / dt) - 1)
        near = [(((c[1] + c[3]) / 2 - px) ** 2 + ((c[2] + c[4]) / 2 - py) ** 2, *c) for c in weak]
        best = min(near, default=None)
        return best[1:] if best is not None and best[0] ** 0.5 <= reach else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.state.get() if self.state.exists() else (None,) * 7
        seen, a, b = was[0], (tuple(was[1:4]) if was[1] is not None else None), (tuple(was[4:7]) if was[4] is not None else None)
        out = []
        for r in pd.concat(list(rows)).sort_values("ts").itertuples():
            now = r.ts.value // 1000
            if seen is not None and now <= seen:
                continue  # not after what was already decided
            if r.cut:
                a = b = None
            cands = sorted((-c["conf"], c["x1"], c["y1"], c["x2"], c["y2"]) for c in (r.cands if r.cands is not None else ()) if c["conf"] >= self.floor)
            state, got = ("observed", cands[0]) if cands and -cands[0][0] >= self.accept else ("recovered_low_conf", self._again(a, b, now, r.dt, cands))
            if got is None:
                state = "unknown"
            else:
                a, b = b, (now, (got[1] + got[3]) / 2, (got[2] + got[4]) / 2)
            out.append((key[0], r.frame, r.ts, state, *(got[1:] if got else (None,) * 4), -got[0] if got else None))
            seen = now
        if seen is not None:
            self.state.update((seen, *(a or (None,) * 3), *(b or (None,) * 3)))
        yield pd.DataFrame(out, columns=["seq", "frame", "ts", "state", "x1", "y1", "x2", "y2", "conf"])

    def close(self) -> None:
        pass


def select_ball_stream(stream: DataFrame, accept: float = 0.25, floor: float = 0.10, max_gap: float = 0.6, gate: float = 60.0, growth: float = 40.0) -> DataFrame:
    """The ball of every frame of a stream (seq, frame, ts, dt, cut, cands: array of box and conf), by the rules of ``select_ball``; short gaps are not filled.

    A frame is one row.  State is two anchors a sequence; a frame not after the last one decided is skipped.
    """
    box = ", ".join(f"{c} double" for c in ("x1", "y1", "x2", "y2", "conf"))
    return stream.groupBy("seq").transformWithStateInPandas(_Ball(accept, floor, max_gap, gate, growth), f"seq int, frame int, ts timestamp, state string, {box}", "Append", "None")


def latest_decisions(stream: DataFrame, table: str, checkpoint: str):
    """A streaming query that keeps the latest decision of each box in the Parquet folder ``table``: order is (recorded_utc, line_no).

    Each micro-batch is merged with what is there into a new version of the folder; ``table``/v=<batch> of the highest batch is current, so
    a batch that runs again after a failure writes the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch
        if number > 0:
            new = batch.unionByName(spark.read.parquet(f"{table}/v={number - 1}").select(*batch.columns))
        best = new.groupBy("box_id").agg(F.max_by(F.struct(*batch.columns), F.struct("recorded_utc", "line_no")).alias("d"))
        best.select("d.*").write.mode("overwrite").parquet(f"{table}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
