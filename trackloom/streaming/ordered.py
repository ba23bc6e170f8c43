"""Stateful operators that decide the rows of a sequence in order of time, however they arrive.

A row waits in state until the watermark has passed its time; an event-time timer brings a sequence back when no new rows do.  What
comes for a time that is already decided goes to the output as ``late``, of equal times the first row counts and the others are
``repeated`` (operators say which rows can be equal).  A sequence without rows for ``idle`` seconds of event time is forgotten:
its timer clears all that it kept.
"""

from __future__ import annotations

import pickle
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.linking import Linker


def _plain(x, kind: str):
    """A value of a column of this type as state holds it."""
    if x is None or (isinstance(x, float) and x != x):
        return None
    if kind in ("int", "long"):
        return int(x)
    return [tuple(d.values()) for d in x] if kind.startswith("array<struct") else x


class InOrder(StatefulProcessor):
    """held: name and type of the input's columns besides seq and ts; out: the names of the output's."""

    held = ""
    out: tuple[str, ...] = ()

    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a batch's rows are one value: a call and a Row for each cost more than all that is decided from them
        self.waiting = handle.getListState("waiting", "rows binary")
        self.clock = handle.getValueState("clock", "decided long")
        self.open()

    def open(self) -> None:
        """Makes further state."""

    def load(self) -> None:
        """Reads what decide needs."""

    def save(self) -> None:
        """Writes it back."""

    def clear(self) -> None:
        """Forgets it."""

    def order(self, row: tuple) -> tuple:
        """Order of the rows of one time."""
        return tuple((x is not None, x) for x in row)

    def name(self, row: tuple):
        """What only one row of a time can have; None: any may be there."""
        return None

    def decide(self, seq: int, rows: list[tuple]) -> Iterator[tuple]:
        """Output rows for all rows of one time."""
        raise NotImplementedError

    def note(self, seq: int, row: tuple, kind: str) -> tuple | None:
        """The output row of a late or repeated row."""
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        stamps = new["ts"].astype("datetime64[us]").astype("int64").tolist()
        columns = [[_plain(x, kind) for x in new[c].tolist()] for c, kind in (n.split(" ", 1) for n in re.split(r", (?![^<]*>)", self.held))]
        yield self._advance(int(key[0]), list(zip(stamps, *columns)), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(int(key[0]), [], timerValues)

    def _advance(self, seq: int, new: list[tuple], timers) -> pd.DataFrame:
        watermark = timers.getCurrentWatermarkInMs() * 1000
        decided = self.clock.get()[0] if self.clock.exists() else None
        out = [self.note(seq, r, "late") for r in new if decided is not None and r[0] <= decided]
        all_ = [r for (kept,) in self.waiting.get() for r in pickle.loads(kept)] if self.waiting.exists() else []
        all_ += [r for r in new if decided is None or r[0] > decided]
        ready = sorted((r for r in all_ if r[0] < watermark), key=lambda r: (r[0], self.order(r)))
        rest = [r for r in all_ if r[0] >= watermark]
        if ready:
            self.load()
            a = 0
            while a < len(ready):
                b, named, mine = a, set(), []
                while b < len(ready) and ready[b][0] == ready[a][0]:
                    name = self.name(ready[b])
                    if name is not None and name in named:
                        out.append(self.note(seq, ready[b], "repeated"))
                    else:
                        named.add(name)
                        mine.append(ready[b])
                    b += 1
                out += self.decide(seq, mine)
                a = b
            decided = ready[-1][0]
            self.clock.update((decided,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        elif decided is not None and watermark > decided + self.idle * 1e6:
            if not ready:
                self.load()
            out += self.ended(seq)
            self.clear()
            self.waiting.clear()
            self.clock.clear()
            return self._frame(out)
        elif decided is not None:
            self.handle.registerTimer(int(decided // 1000 + self.idle * 1000) + 1)
        if ready:
            self.save()
        if ready or new:
            self.waiting.clear()
            if rest:
                self.waiting.put([(pickle.dumps(rest),)])
        return self._frame(out)

    def ended(self, seq: int) -> list[tuple]:
        """Output rows when a sequence is forgotten."""
        return []

    def _frame(self, out: list) -> pd.DataFrame:
        rows = [r for r in out if r is not None]
        frame = pd.DataFrame(rows, columns=list(self.out), dtype=object)
        if "ts" in frame:
            frame["ts"] = pd.to_datetime(frame["ts"].astype("int64"), unit="us")
        return frame

    def close(self) -> None:
        pass


# ---- events


class _Events(InOrder):
    """State: the last 10 ball positions and how many there were, who had the ball last and where, and each player's latest place."""

    held = "frame int, kind string, track_id long, team int, x double, y double"
    out = ("seq", "ts", "frame", "type", "side", "track_id", "team", "from_id", "value")

    def __init__(self, idle: float, left: float, right: float, shot: float, goal_near: float, shot_near: float, pass_near: float, pass_least: float):
        super().__init__(idle)
        self.left, self.right, self.shot, self.goal_near, self.shot_near, self.pass_near, self.pass_least = left, right, shot, goal_near, shot_near, pass_near, pass_least

    def open(self) -> None:
        self.balls = self.handle.getListState("balls", "ts long, x double, y double")
        self.seen = self.handle.getValueState("seen", "n long, track_id long, team int, x double, y double")
        self.players = self.handle.getMapState("players", "track_id long", "team int, x double, y double")

    def load(self) -> None:
        self.last = deque((tuple(b) for b in self.balls.get()) if self.balls.exists() else (), maxlen=10)
        self.n, *had = self.seen.get() if self.seen.exists() else (0, None, None, None, None)
        self.had = tuple(had) if had[0] is not None else None
        self.where = {k[0]: tuple(v) for k, v in self.players.iterator()} if self.players.exists() else {}
        self.moved: set[int] = set()

    def save(self) -> None:
        self.balls.clear()
        if self.last:
            self.balls.put(list(self.last))
        self.seen.update((self.n, *(self.had or (None,) * 4)))
        for k in self.moved:
            self.players.updateValue((k,), self.where[k])

    def clear(self) -> None:
        self.balls.clear()
        self.seen.clear()
        self.players.clear()

    def order(self, row: tuple) -> tuple:  # players before the ball, then by place
        return row[2] == "ball", row[3] or 0, row[5], row[6]

    def name(self, row: tuple):
        return row[2], row[3]

    def note(self, seq, row, kind):
        return seq, row[0], row[1], kind, None, row[3], None, None, None

    def _side(self, x: float) -> str | None:
        return "left" if x < self.left else "right" if x > self.right else None

    def _nearest(self, x: float, y: float) -> tuple:
        return min((((x - px) ** 2 + (y - py) ** 2) ** 0.5, k, team) for k, (team, px, py) in self.where.items()) if self.where else (np.inf, None, None)

    def decide(self, seq, rows):
        for ts, frame, kind, track, team, x, y in rows:
            if x is None or y is None or not np.isfinite(x + y):
                continue
            if kind != "ball":
                self.where[track] = (team, x, y)
                self.moved.add(track)
                continue
            before = self.last[-1] if self.last else None
            self.last.append((ts, x, y))
            self.n += 1
            d, who, of = self._nearest(x, y)
            said = lambda near: (who, of) if d < near else (None, None)  # noqa: B023, E731
            side = self._side(x)
            if side and before is not None and self._side(before[1]) is None and self.n >= 10:
                yield seq, ts, frame, "goal", side, *said(self.goal_near), None, None
            if self.n >= 5:
                five = list(self.last)[-5:]
                time = (ts - five[0][0]) / 1e6
                path = sum(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 for a, b in zip(five, five[1:]))
                if time > 0 and path / time > self.shot and abs(x - five[0][1]) > abs(y - five[0][2]):
                    yield seq, ts, frame, "shot", None, *said(self.shot_near), None, path / time
            if d < self.pass_near:
                if self.had is not None and self.had[0] != who and self.n >= 20:
                    length = ((x - self.had[2]) ** 2 + (y - self.had[3]) ** 2) ** 0.5
                    if length > self.pass_least:
                        yield seq, ts, frame, "pass" if self.had[1] == of else "interception", None, who, self.had[1], self.had[0], length
                self.had = (who, of, x, y)


def detect_events(stream: DataFrame, late: str = "10 seconds", idle: float = 60.0, zones: tuple[float, float] = (0.5, 104.5), shot_speed: float = 15.0, goal_near: float = 2.0, shot_near: float = 2.0, pass_near: float = 2.0, pass_least: float = 5.0) -> DataFrame:
    """Goals, shots, passes and interceptions of a stream of places in metres, by the rules of ``operators.events``, with late and repeated rows beside them.

    stream: seq, ts, frame, kind (ball or player), track_id, team, x, y.  Output: seq, ts, frame, type, side (goals), track_id and team (who did it; of a pass who got it, and
    the team that had it), from_id (who had it) and value (mean speed of a shot, length of a pass).
    """
    rows = stream.select("seq", "ts", "frame", "kind", "track_id", "team", "x", "y").withWatermark("ts", late)
    kinds = "seq int, ts timestamp, frame int, type string, side string, track_id long, team int, from_id long, value double"
    return rows.groupBy("seq").transformWithStateInPandas(_Events(idle, *zones, shot_speed, goal_near, shot_near, pass_near, pass_least), kinds, "Append", "EventTime")


# ---- the ball, with short gaps filled


class _Filled(InOrder):
    """State: the last two anchors, and the frames since the last one that are still unknown.

    A frame without a ball waits until the next anchor comes, a cut begins, or the time is over in which one could fill the gap.
    """

    held = "frame int, dt double, cut boolean, cands array<struct<x1: double, y1: double, x2: double, y2: double, conf: double>>"
    out = ("seq", "frame", "ts", "state", "x1", "y1", "x2", "y2", "conf")

    def __init__(self, idle: float, accept: float, floor: float, max_gap: float, gate: float, growth: float, fill: float):
        super().__init__(idle)
        self.accept, self.floor, self.max_gap, self.gate, self.growth, self.fill = accept, floor, max_gap, gate, growth, fill

    def open(self) -> None:
        box = "x1 double, y1 double, x2 double, y2 double"
        self.anchors = self.handle.getListState("anchors", f"ts long, {box}")
        self.unknown = self.handle.getListState("unknown", "ts long, frame int")

    def load(self) -> None:
        self.last = deque((tuple(a) for a in self.anchors.get()) if self.anchors.exists() else (), maxlen=2)
        self.open_ = [tuple(u) for u in self.unknown.get()] if self.unknown.exists() else []

    def save(self) -> None:
        for state, rows in ((self.anchors, list(self.last)), (self.unknown, self.open_)):
            state.clear()
            if rows:
                state.put(rows)

    def clear(self) -> None:
        self.anchors.clear()
        self.unknown.clear()

    def order(self, row: tuple) -> tuple:
        return (row[1],)

    def name(self, row: tuple):
        return ()  # a time has one frame

    def _again(self, now: int, dt: float, weak: list) -> tuple | None:
        b = self.last[-1] if self.last else None
        if b is None or not 0 < (now - b[0]) / 1e6 <= self.max_gap + 1e-9:
            return None
        a = self.last[0] if len(self.last) == 2 else b
        move = (now - b[0]) / (b[0] - a[0]) if b[0] > a[0] else 0.0
        middle = lambda p: ((p[0] + p[2]) / 2, (p[1] + p[3]) / 2)
        (ax, ay), (bx, by) = middle(a[1:]), middle(b[1:])
        px, py = bx + (bx - ax) * move, by + (by - ay) * move
        reach = self.gate + self.growth * max(0, round((now - b[0]) / 1e6 / dt) - 1)
        best = min(((((c[1] + c[3]) / 2 - px) ** 2 + ((c[2] + c[4]) / 2 - py) ** 2, *c) for c in weak), default=None)
        return best[1:] if best is not None and best[0] ** 0.5 <= reach else None

    def _release(self, seq: int) -> Iterator[tuple]:
        for ts, frame in self.open_:
            yield seq, frame, ts, "unknown", *(None,) * 5
        self.open_ = []

    def decide(self, seq, rows):
        ((now, frame, dt, cut, cands),) = rows
        if cut:
            yield from self._release(seq)
            self.last.clear()
        found = sorted((-c[4], *c[:4]) for c in cands or () if c[4] is not None and c[4] >= self.floor)
        state, got = ("observed", found[0]) if found and -found[0][0] >= self.accept else ("recovered_low_conf", self._again(now, dt, found))
        left = self.last[-1] if self.last else None
        gap = (now - left[0]) / 1e6 - dt if left else np.inf  # were an anchor here; it only grows from here on
        if got is None:
            self.open_.append((now, frame))
            if gap > self.fill + 1e-9:
                yield from self._release(seq)
            return
        box = got[1:]
        if 1e-9 < gap <= self.fill + 1e-9:
            for ts, at in self.open_:
                share = ((ts - left[0]) / 1e6) / ((now - left[0]) / 1e6)
                yield seq, at, ts, "interpolated_short_gap", *(a + (b - a) * share for a, b in zip(left[1:], box)), None
            self.open_ = []
        yield from self._release(seq)
        self.last.append((now, *box))
        yield seq, frame, now, state, *box, -got[0]

    def ended(self, seq):
        return list(self._release(seq))


def fill_ball_stream(stream: DataFrame, late: str = "2 seconds", idle: float = 10.0, accept: float = 0.25, floor: float = 0.10, max_gap: float = 0.6, gate: float = 60.0, growth: float = 40.0, fill: float = 0.4) -> DataFrame:
    """Both passes over a stream of frames (seq, frame, ts, dt, cut, cands: array of box and conf): the ball by the rules of ``select_ball``, and short gaps by those of ``interpolate_ball``.

    A frame's row comes when the watermark has passed it and its gap is decided: at the next anchor, or ``fill`` seconds after the last one.  Frames of a sequence that
    ends with a gap come when it is forgotten.  dt is taken to be the same for all frames of a gap.
    """
    box = ", ".join(f"{c} double" for c in ("x1", "y1", "x2", "y2", "conf"))
    rows = stream.select("seq", "ts", "frame", "dt", "cut", "cands").withWatermark("ts", late)
    return rows.groupBy("seq").transformWithStateInPandas(_Filled(idle, accept, floor, max_gap, gate, growth, fill), f"seq int, frame int, ts timestamp, state string, {box}", "Append", "EventTime")


# ---- tracks


#: Sequences that take their steps together, and boxes that a task sorts at once before they go there.
TOGETHER = 32
SORTED = 1 << 20
_NEVER, _NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_ZSTD = pa.Codec("zstd", 1)


def part_of(seq: str = "seq") -> Column:
    """The part of the sequences that take their steps together."""
    return F.floor(F.col(seq) / TOGETHER)


def _by_time(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes as a row for each part and time: one by one they would cost the stateful operator more than all that it decides."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        if any(rows[c].null_count for c in ("part", "ts", "seq", "frame", "det_id")):
            raise ValueError("a box without seq, ts, frame or det_id")
        part, ts, seq, frame, det = (rows[c].cast(pa.int64()).to_numpy() for c in ("part", "ts", "seq", "frame", "det_id"))
        cls = rows["cls"].combine_chunks().dictionary_encode("encode")
        classes, code = cls.dictionary.to_pylist(), cls.indices.to_numpy()
        order = np.lexsort((ts, part))
        part, ts = part[order], ts[order]
        edges = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(ts) != 0), True])
        ids = np.array([seq, frame, det, code], np.int64)[:, order]
        boxes = np.array([rows[c].to_numpy() for c in ("x1", "y1", "x2", "y2", "conf")], float)[:, order]
        cuts = list(zip(edges.tolist(), edges[1:].tolist()))
        first = edges[:-1]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[first]), pa.array(ts[first]).cast(pa.timestamp("us", "UTC")), pa.array(ts[first]), pa.array([classes] * len(cuts), pa.list_(pa.string())), *(pa.array([x[:, a:b].tobytes() for a, b in cuts], pa.binary()) for x in (ids, boxes))],
            ["part", "ts", "at", "classes", "ids", "boxes"],
        )

    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= SORTED:
            yield packed(held)
            held, count = [], 0
    if held:
        yield packed(held)


def _packed(*arrays: np.ndarray) -> bytes:
    return pickle.dumps([(a.dtype.str, a.shape, _ZSTD.compress(np.ascontiguousarray(a).tobytes(), asbytes=True)) for a in arrays])


def _unpacked(packed: bytes) -> list[np.ndarray]:
    return [np.frombuffer(bytearray(_ZSTD.decompress(x, 8 * int(np.prod(shape)), asbytes=True)), kind).reshape(shape) for kind, shape, x in pickle.loads(packed)]


class _Links(StatefulProcessor):
    """State of some sequences: their waiting rows, up to when each sequence and class is decided and what it waits for, the live tracks, and the boxes of those that aren't confirmed yet.

    Each sequence and class keeps the rules of ``InOrder`` by itself, but all take their steps together, a time of them all in each, as a step is some hundred array operations
    however few boxes there are.  A group is a sequence and class as one number.
    """

    def __init__(self, idle: float, linker: Linker):
        self.idle, self.linker = idle, linker

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")  # group, ts, frame and det_id; box and conf
        # groups: each one's number, its last decided time and its first waiting one; tracks: the linker's arrays and the early boxes' track, group, frame and det_id
        self.kept = handle.getValueState("kept", "classes array<string>, groups binary, n long, tracks binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self._advance(pd.concat(list(rows), ignore_index=True), timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(None, timerValues.getCurrentWatermarkInMs() * 1000)

    def _arrays(self, new: pd.DataFrame | None, classes: list) -> tuple[np.ndarray, np.ndarray]:
        """Rows as state holds them; their classes are added to ``classes``."""
        if new is None:
            return np.empty((4, 0), np.int64), np.empty((5, 0))
        named = [tuple(x) for x in new["classes"]]
        classes += [x for x in dict.fromkeys(x for names in dict.fromkeys(named) for x in names) if x not in classes]
        code = {names: np.array([classes.index(x) for x in names], np.int64) for names in dict.fromkeys(named)}
        each = [np.frombuffer(x, np.int64).reshape(4, -1) for x in new["ids"]]
        whole = np.concatenate([[(seq << 32) + code[names][of], np.full(len(of), at), frame, det] for (seq, frame, det, of), names, at in zip(each, named, new["at"])], 1)
        return whole, np.concatenate([np.frombuffer(x, float).reshape(5, -1) for x in new["boxes"]], 1)

    def _advance(self, new: pd.DataFrame | None, watermark: int) -> pd.DataFrame:
        classes, groups, n, tracks = self.kept.get() if self.kept.exists() else ((), None, 0, None)
        classes, out, early = list(classes), np.empty((4, 0), np.int64), np.empty((4, 0), np.int64)
        group, decided, first = _unpacked(groups)[0] if groups else np.empty((3, 0), np.int64)
        whole, part = self._arrays(new, classes)
        unseen = np.setdiff1d(whole[0], group)
        order = np.argsort(np.r_[group, unseen])
        group, decided, first = (np.r_[x, y][order] for x, y in ((group, unseen), (decided, np.full(len(unseen), _NEVER)), (first, np.full(len(unseen), _NONE))))
        on_time = whole[1] > decided[np.searchsorted(group, whole[0])]
        whole, part = whole[:, on_time], part[:, on_time]
        np.minimum.at(first, np.searchsorted(group, whole[0]), whole[1])
        ready = (first < watermark).any()
        if ready or ((first == _NONE) & (watermark > decided + self.idle * 1e6)).any():
            *tracks, early = _unpacked(tracks) if tracks else (early,)
            self.linker.start(n, tuple(tracks) or None)
            if ready:
                rows = [*(_unpacked(x) for (x,) in (self.waiting.get() if self.waiting.exists() else ())), (whole, part)]
                whole, part = (np.concatenate(x, 1) for x in zip(*rows))
                now = whole[1] < watermark
                np.maximum.at(decided, np.searchsorted(group, whole[0, now]), whole[1, now])
                out, early = self._linked(whole[:, now], part[:, now], early)
                whole, part = whole[:, ~now], part[:, ~now]
                first[:] = _NONE
                np.minimum.at(first, np.searchsorted(group, whole[0]), whole[1])
                self.waiting.clear()
            stay = (first < _NONE) | (watermark <= decided + self.idle * 1e6)
            group, decided, first = group[stay], decided[stay], first[stay]
            self.linker.keep(np.isin(self.linker.group, group))
            n, tracks = self.linker.count, _packed(*self.linker.tracks, early[:, np.isin(early[0], self.linker.n)])
        if whole.size:
            self.waiting.appendValue((_packed(whole, part),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if len(group):
            self.kept.update((classes, _packed(np.array([group, decided, first])), n, tracks))
            self.handle.registerTimer(int(np.where(first < _NONE, first // 1000, decided // 1000 + int(self.idle * 1000)).min()) + 1)
        else:
            self.waiting.clear()
            self.kept.clear()
        of, frame, det, name = out
        return pd.DataFrame({"seq": of >> 32, "cls": np.array(classes, object)[of & 0xFFFFFFFF], "frame": frame, "det_id": det, "track_id": name})

    def _linked(self, whole: np.ndarray, part: np.ndarray, early: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group, frame, det_id and track of the boxes that are told now, and the early boxes that are left."""
        order = np.lexsort((whole[2], whole[3], whole[0], whole[1]))
        order = order[np.r_[True, (np.diff(whole[[0, 1, 3]][:, order]) != 0).any(0)]]  # a box once in a time
        order = order[np.lexsort((whole[3, order], whole[2, order], whole[0, order], whole[1, order]))]
        (group, ts, frame, det), part = whole[:, order], part[:, order]
        begins = np.r_[True, (np.diff(ts) != 0) | (np.diff(group) != 0)]
        frame = frame[begins][np.cumsum(begins) - 1]
        confirmed = self.linker.hits >= self.linker.min_hits
        old, named = self.linker.n[confirmed], self.linker.name[confirmed]
        of = np.empty(len(ts), np.int64)
        edges = np.flatnonzero(np.r_[True, np.diff(ts) != 0, True]).tolist()
        for a, b in zip(edges, edges[1:]):
            of[a:b] = self.linker.advance(frame[a:b], group[a:b], det[a:b], part[:4, a:b], part[4, a:b])
        rows = np.concatenate([early, np.array([of, group, frame, det])[:, of > 0]], 1)
        each, at, back, size = np.unique(rows[0], return_index=True, return_inverse=True, return_counts=True)
        name, known = rows[3, at] + 1, np.isin(each, old)
        order = np.argsort(old)
        name[known] = named[order][np.searchsorted(old[order], each[known])]
        told = (known | (size >= self.linker.min_hits))[back]
        return np.array([*rows[1:, told], name[back[told]]]), rows[:, ~told]


def link_tracks_stream(stream: DataFrame, fps: float, late: str = "2 seconds", idle: float | None = None, **rules) -> DataFrame:
    """seq, cls, frame, det_id, track_id of a stream of boxes (seq, ts, frame, det_id, box, conf, cls), linked by the very steps of ``link_tracks``.

    A track is named when it has min_hits boxes, and its earlier ones come with it; boxes of no track don't come.  Names are the track's first det_id + 1.  A track ends after ``lost`` frames
    without a box (at 30 per second) as in the batch form, and a sequence is forgotten after as long a time.
    """
    linker = Linker(fps, **rules)
    rows = stream.select(part_of().alias("part"), "ts", "seq", "frame", "det_id", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "conf")), "cls")
    rows = rows.mapInArrow(_by_time, "part long, ts timestamp, at long, classes array<string>, ids binary, boxes binary").withWatermark("ts", late)
    quiet = idle if idle is not None else (linker.budget + 1) / fps
    return rows.groupBy("part").transformWithStateInPandas(_Links(quiet, linker), "seq int, cls string, frame int, det_id long, track_id long", "Append", "EventTime")


# ---- possession from two streams


def possession_windows(frames: DataFrame, humans: DataFrame, length: str = "10 seconds", late: str = "10 seconds", max_px: float = 70.0, apart: str = "1 second") -> DataFrame:
    """Per window the frames in which each team had the ball: seq, start, unknown, team1, team2, share1.

    frames: a stream of seq, ts, frame and the ball's box (null: no ball); humans: a stream of seq, ts, frame, track_id, cls, team and box.  The two are joined by sequence and frame within ``apart`` of each
    other's times, so both sides' state ends with the watermarks; a frame without anybody near the ball is unknown.  The nearest human wins by the rules of ``nearest_human``.
    """
    f = frames.select("seq", "ts", "frame", *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2"))).withWatermark("ts", late)
    h = humans.select(F.col("seq").alias("h_seq"), F.col("ts").alias("h_ts"), F.col("frame").alias("h_frame"), "track_id", "cls", "team", "x1", "x2", "y2").withWatermark("h_ts", late)
    bx, by = (F.col("b_x1") + F.col("b_x2")) / 2, (F.col("b_y1") + F.col("b_y2")) / 2
    foot = lambda c: F.sqrt(F.pow(F.col(c) - bx, 2) + F.pow(F.col("y2") - by, 2))
    d = F.least(foot("x1"), foot("x2"))
    near = f.join(h, (F.col("seq") == F.col("h_seq")) & (F.col("frame") == F.col("h_frame")) & (F.col("h_ts") >= F.col("ts") - F.expr(f"interval {apart}")) & (F.col("h_ts") <= F.col("ts") + F.expr(f"interval {apart}")) & (d < max_px), "leftOuter")
    rank = F.struct(d.alias("d"), F.when(F.col("cls") == "player", 0).otherwise(1).alias("r"), "track_id")
    # other classes are left out here, not by a filter: it would go below the watermark, which their rows move on, too
    best = F.min_by(F.struct("cls", "team"), F.when(F.col("cls").isin("player", "goalkeeper"), rank))
    per = near.groupBy("seq", "frame", F.window("ts", "1 second").alias("at")).agg(best.alias("b"))
    team = F.coalesce(F.when(F.col("b.cls") == "goalkeeper", 0).otherwise(F.col("b.team")), F.lit(0))
    of = lambda t: F.sum((team == t).cast("int"))
    rows = per.groupBy("seq", F.window(F.window_time("at"), length).alias("w")).agg(of(0).alias("unknown"), of(1).alias("team1"), of(2).alias("team2"))
    known = F.col("team1") + F.col("team2")
    return rows.select("seq", F.col("w.start").alias("start"), "unknown", "team1", "team2", F.when(known > 0, F.col("team1") / known).otherwise(0.0).alias("share1"))
