"""Two-stage association of boxes to tracks, one frame after the other; the batch and the stream take the same steps.

A step takes a frame of many sequences at once, as its cost is that of some hundred array operations, however few boxes there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PAIRS = 1 << 19  # box and track pairs that are compared at once


def _grown(x: np.ndarray, r: float) -> np.ndarray:
    """Boxes (4 x n) grown by r of their width and height on every side."""
    return np.concatenate([x[:2] - (x[2:] - x[:2]) * r, x[2:] + (x[2:] - x[:2]) * r])


def _area(x: np.ndarray) -> np.ndarray:
    return (x[2] - x[0]) * (x[3] - x[1])


def buffered(a: np.ndarray, b: np.ndarray, r: float) -> np.ndarray:
    """IoU of all pairs of boxes of two arrays, each box grown by r of its width and height on every side; 0 for boxes apart."""
    a, b = _grown(a.T, r)[:, :, None], _grown(b.T, r)[:, None]
    side = np.minimum(a[2:], b[2:]) - np.maximum(a[:2], b[:2])
    both = np.where((side > 0).all(0), side[0] * side[1], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(both > 0, both / (_area(a) + _area(b) - both), 0.0)


def _scored(a: np.ndarray, first: np.ndarray, last: np.ndarray, b: np.ndarray, apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, IoU) of the boxes i of a and j of b, j from first[i] to before last[i], PAIRS at a time (one box's at least); without ``apart`` only of those that overlap."""
    many, areas = last - first, (_area(a), _area(b))
    ends = np.cumsum(many)
    at = 0
    while at < len(many):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        n = many[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(len(i)) + np.repeat(first[at:to] - (ends[at:to] - n - done), n)
        w = np.minimum(a[2][i], b[2][j]) - np.maximum(a[0][i], b[0][j])
        if not apart:
            near = np.flatnonzero(w > 0)
            i, j, w = i[near], j[near], w[near]
        h = np.minimum(a[3][i], b[3][j]) - np.maximum(a[1][i], b[1][j])
        if not apart:
            near = np.flatnonzero(h > 0)
            i, j, w, h = i[near], j[near], w[near], h[near]
        both = np.where((w > 0) & (h > 0), w * h, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            yield i, j, np.where(both > 0, both / (areas[0][i] + areas[1][j] - both), 0.0)
        at = to


def _best_first(s: np.ndarray, box: np.ndarray, track: np.ndarray, boxes: int, tracks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs taken in order (highest s, then lowest track, then lowest box) those whose sides are both free: in each round all that come first for both."""
    order = np.lexsort((box, track, -s))
    box, track = box[order], track[order]
    of_box, of_track, out = np.empty(boxes, np.int64), np.empty(tracks, np.int64), []
    while len(box):
        at = np.arange(len(box))
        of_box[box[::-1]] = of_track[track[::-1]] = at[::-1]  # the last value written is the first pair's
        first = (of_box[box] == at) & (of_track[track] == at)
        out.append((box[first], track[first]))
        gone_box, gone_track = np.zeros(boxes, bool), np.zeros(tracks, bool)
        gone_box[box[first]] = gone_track[track[first]] = True
        rest = ~(gone_box[box] | gone_track[track])
        box, track = box[rest], track[rest]
    return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in (list(zip(*out)) or [(), ()]))


class Linker:
    """The live tracks of sequences and classes, as arrays in order of group and number.

    Strong boxes link first to tracks' predicted places (buffered IoU times confidence of s1 or more), weak ones (over 0.1) only
    extend tracks (s2 or more); pairs are taken best first (ties: the older track, the smaller det_id).  A strong box of no track begins one.  A track
    is told from min_hits boxes on, its earlier boxes with it, and ends after ``lost`` frames (at 30 per second) without one.
    """

    def __init__(self, fps: float, high: float = 0.6, r1: float = 0.3, r2: float = 0.5, s1: float = 0.2, s2: float = 0.5, min_hits: int = 2, lost: int = 30):
        self.budget = max(1, -(-int(fps * lost) // 30))
        self.high, self.r1, self.r2, self.s1, self.s2, self.min_hits = high, r1, r2, s1, s2, min_hits
        self.start()
        self.early: dict[int, list[tuple]] = {}

    def start(self, count: int = 0, tracks: tuple[np.ndarray, ...] | None = None) -> None:
        """Goes on from the ``count`` and ``tracks`` of earlier steps."""
        self.count = count
        none = np.empty(0, np.int64)
        self.n, self.group, self.last, self.hits, self.name, self.at = tracks or (none, none, none, none, none, np.empty((8, 0)))  # at: box, velocity

    @property
    def tracks(self) -> tuple[np.ndarray, ...]:
        return self.n, self.group, self.last, self.hits, self.name, self.at

    def keep(self, which: np.ndarray) -> None:
        self.n, self.group, self.last, self.hits, self.name, self.at = self.n[which], self.group[which], self.last[which], self.hits[which], self.name[which], self.at[:, which]

    def _link(self, since: np.ndarray, group: np.ndarray, boxes: np.ndarray, which: np.ndarray, weight: np.ndarray | None, free: np.ndarray, r: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        if not len(which) or not len(free):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = self.at[:4, free] + self.at[4:, free] * since[free]
        first, last = (np.searchsorted(self.group[free], group[which], side) for side in ("left", "right"))
        found = []
        for i, j, s in _scored(_grown(boxes[:, which], r), first, last, _grown(at, r), least <= 0):
            s = s if weight is None else s * weight[which[i]]
            good = s >= least
            found.append((s[good], i[good], j[good]))
        i, j = _best_first(*(np.concatenate(x) for x in zip(*found)), len(which), len(free))
        return which[i], free[j]

    def advance(self, frame: int | np.ndarray, group: np.ndarray, ids: np.ndarray, boxes: np.ndarray, conf: np.ndarray) -> np.ndarray:
        """The track n of each box of a frame (0: none); boxes: 4 x n, in order of group and det_id.

        frame: that of all groups, or of each box, where every group has its own; then tracks of groups without a box stay as they are.
        """
        if isinstance(frame, np.ndarray):
            place = np.minimum(np.searchsorted(group, self.group), len(group) - 1)
            since = np.where(group[place] == self.group, frame[place] - self.last, 0)
        else:
            since = frame - self.last
        live = since <= self.budget
        self.keep(live)
        since = since[live]
        strong, weak = np.flatnonzero(conf >= self.high), np.flatnonzero((conf > 0.1) & (conf < self.high))
        free = np.ones(len(self.n), bool)
        box, track = self._link(since, group, boxes, strong, conf, np.flatnonzero(free), self.r1, self.s1)
        free[track] = False
        more = self._link(since, group, boxes, weak, None, np.flatnonzero(free), self.r2, self.s2)
        box, track = np.concatenate([box, more[0]]), np.concatenate([track, more[1]])
        out = np.zeros(len(ids), np.int64)
        out[box] = self.n[track]
        self.at[4:, track] = (boxes[:, box] - self.at[:4, track]) / np.maximum(1, since[track])
        self.at[:4, track] = boxes[:, box]
        self.last[track] += since[track]
        self.hits[track] += 1
        new = strong[out[strong] == 0]
        if len(new):
            out[new] = self.count + 1 + np.arange(len(new))
            self.count += len(new)
            self.n, self.group, self.name = (np.concatenate(x) for x in ((self.n, out[new]), (self.group, group[new]), (self.name, ids[new] + 1)))
            self.last, self.hits = np.concatenate([self.last, frame[new] if isinstance(frame, np.ndarray) else np.full(len(new), frame)]), np.concatenate([self.hits, np.ones(len(new), np.int64)])
            self.at = np.concatenate([self.at, np.concatenate([boxes[:, new], np.zeros((4, len(new)))])], 1)
            if (self.group[1:] < self.group[:-1]).any():
                self.keep(np.argsort(self.group, kind="stable"))
        return out

    def step(self, frame: int, ids: list[int], boxes: np.ndarray, conf: np.ndarray) -> list[tuple[int, int, int]]:
        """(frame, det_id, track) of the boxes of one group that are told now; boxes: in order of det_id."""
        found = self.advance(frame, np.zeros(len(ids), np.int64), np.array(ids, np.int64), np.asarray(boxes, float).reshape(-1, 4).T, np.asarray(conf, float)).tolist()
        place = {n: k for k, n in enumerate(self.n.tolist())}
        for n in [n for n in self.early if n not in place]:
            del self.early[n]
        out = []
        for n, det in zip(found, ids):
            if n and self.hits[place[n]] < self.min_hits:
                self.early.setdefault(n, []).append((frame, det))
            elif n:
                name = int(self.name[place[n]])
                out += [*((f, d, name) for f, d in self.early.pop(n, [])), (frame, det, name)]
        return out
