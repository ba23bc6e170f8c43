"""What the findings of round 4 were about, on small tables."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest_helpers import compare
from test_findings_r03 import _one_by_one, close_to_periods  # noqa: F401
from test_stateful import at, drained

from trackloom.operators.linking import Linker
from trackloom.plans import streams
from trackloom.plans.registry import ORACLE_SQL, QUERIES
from trackloom.streaming import ordered


@pytest.mark.parametrize("name", ["streamed_windows", "streamed_sliding"])
def test_windows_take_whole_seconds(spark, close_to_periods, name):  # noqa: F811
    assert compare(spark, close_to_periods, QUERIES[name], ORACLE_SQL[name]) > 0


BOXES = "seq int, ts timestamp, frame int, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls string"


def _boxes(seqs, frames, seed):
    """Boxes of sequences that count their frames from numbers of their own, and det_id -> track of the told ones."""
    r, rows, want = random.Random(seed), [], {}
    for seq in seqs:
        start = 1000 * (seq % 5)
        for f in range(frames):
            for k in range(r.choice([0, 1, 3, 5])):
                x, y = float(r.randrange(60) + 3 * f), float(r.randrange(3) * 20)
                rows.append((seq, at(f / 5), start + f, len(rows) * 7 % 10007, x, y, x + 40, y + 40, r.choice([0.05, 0.1, 0.3, 0.6, 0.9]), r.choice(["player", "ball", None])))
    assert len({b[3] for b in rows}) == len(rows)
    for key in {(b[0], b[9]) for b in rows}:
        mine = [b for b in rows if (b[0], b[9]) == key]
        of, frame = _one_by_one([(b[2], b[3], b[4:8], b[8]) for b in mine]), {b[3]: b[2] for b in mine}
        for d, n in of.items():
            all_ = [e for e, m in of.items() if m == n]
            if len(all_) > 1:
                want[d] = (*key, frame[d], min(all_, key=frame.get) + 1)
    return rows, want


def test_sequences_of_a_stream_are_linked_together_as_one_by_one(spark, tmp_path):
    """Rows out of order, repeated and late, over several batches; state and steps are shared by sequences."""
    rows, want = _boxes([*range(28, 68), 500], 30, 4)
    r, batches = random.Random(5), [[], [], []]
    for b in rows:
        f = round((b[1] - at(0)).total_seconds() * 5)
        batches[min(2, max(0, f // 10 + r.choice([0, 0, 0, 1])))].append(b)
    for b in batches:
        r.shuffle(b)
        b += b[:50]
    batches.insert(2, [])
    late = (30, at(1), 5001, 999_999, 0.0, 0.0, 40.0, 40.0, 0.9, "player")
    beat = lambda s: (-1, at(s), 0, -1, 0.0, 0.0, 1.0, 1.0, 0.9, None)
    batches = [b for b in batches if b] + [[beat(12)], [late, beat(13)]]
    make = lambda s: ordered.link_tracks_stream(s, 30.0, "4 seconds", 60.0)
    got, cp = drained(spark, batches, BOXES, make, tmp_path)
    assert len(got) == len({g.det_id for g in got}) and {g.det_id: (g.seq, g.cls, g.frame, g.track_id) for g in got} == want and len(want) > 500
    with streams._stateful(spark):
        keys = spark.read.format("statestore").option("path", cp).option("stateVarName", "waiting").option("batchId", 0).load().select("key").distinct().count()
    assert 2 <= keys <= 4  # parts of 32 sequences, not one for each sequence and class


class _State:
    """A value or a list that a stateful operator keeps."""

    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return self.x

    def update(self, v):
        self.x = v

    def appendValue(self, v):
        self.x = [*(self.x or []), v]

    def clear(self):
        self.x = None


class _Handle:
    def __init__(self):
        self.timers = []

    getListState = getValueState = lambda self, *a: _State()
    listTimers = lambda self: list(self.timers)
    registerTimer = lambda self, t: self.timers.append(t)
    deleteTimer = lambda self, t: self.timers.remove(t)


class _Watermark:
    def __init__(self, seconds):
        self.ms = int((pd.Timestamp(at(0)).value // 1000 + seconds * 1_000_000) // 1000)

    def getCurrentWatermarkInMs(self):
        return self.ms


def _sent(rows, size=200):
    """Boxes of one part as the stateful operator gets them."""
    flat = pd.DataFrame(rows, columns=[c.split()[0] for c in BOXES.split(", ")]).astype({"ts": "datetime64[us]"}).assign(part=0)
    return pd.concat([b.to_pandas() for b in ordered._by_time(iter(pa.Table.from_pandas(flat, preserve_index=False).to_batches(size)))])


def test_a_step_takes_all_sequences_of_a_part(monkeypatch):
    rows, want = _boxes(range(32), 40, 6)
    steps = []
    monkeypatch.setattr(Linker, "advance", lambda self, *a, f=Linker.advance: steps.append(1) or f(self, *a))
    monkeypatch.setattr(ordered, "SORTED", 500)
    packed = _sent(random.Random(1).sample(rows, len(rows)))
    assert len(packed) < len(rows) / 4
    p = ordered._Links(60.0, Linker(30.0))
    p.init(_Handle())
    told = [*p.handleInputRows((0,), iter([packed]), _Watermark(0)), *p.handleExpiredTimer((0,), _Watermark(5), None), *p.handleExpiredTimer((0,), _Watermark(20), None)]
    found = pd.concat(told)
    assert {d: (s, c, f, t) for s, c, f, d, t in found.itertuples(index=False)} == want and len(want) > 300
    assert len(steps) == len({b[1] for b in rows})  # one for each time, not one for each sequence, class and time


def test_a_quiet_sequence_is_forgotten_beside_a_live_one():
    box = lambda seq, s: (seq, at(s), int(5 * s), 100 * seq + int(5 * s), 0.0, 0.0, 40.0, 40.0, 0.9, "player")
    p, handle = ordered._Links(10.0, Linker(30.0)), _Handle()
    p.init(handle)
    told = list(p.handleInputRows((0,), iter([_sent([box(q, s) for q in (1, 2) for s in (1, 2)])]), _Watermark(3)))
    assert sorted(told[0]["det_id"]) == [105, 110, 205, 210] and handle.timers == [_Watermark(12).ms + 1]
    assert not len(next(p.handleInputRows((0,), iter([_sent([box(1, 1.5), box(1, 12)])]), _Watermark(3)))) and len(p.waiting.x) == 1  # 1.5 s is decided: late
    assert next(p.handleExpiredTimer((0,), _Watermark(13), None))["det_id"].tolist() == []
    assert np.unique(ordered._unpacked(p.kept.x[1])[0][0] >> 32).tolist() == [1]
    assert next(p.handleExpiredTimer((0,), _Watermark(30), None)).empty
    assert p.kept.x is None and p.waiting.x is None and not handle.timers
