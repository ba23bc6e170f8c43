"""Forward Viterbi over the piece lattices of many chunks at once, as array passes.

The vocabulary is a trie whose edges lie in a hash table, (node, character) -> node, looked up for whole arrays.  All starts of
all chunks walk it together, one character a step, and leave at each end position the node of the piece of every length; then
the best and second best scores go from position to position for all chunks side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .pieces import SPACE, Pieces, load
from .text import Places

#: Characters (chunks times their width) of one pass.
CELLS = 60_000


class Trie:
    """Node 0 is the root and stands for "no piece" in the tables by node: score (-inf), id (-1) and bytes."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.longest = pieces, pieces.longest
        child: dict[int, int] = {}
        at_node: dict[int, tuple[float, int]] = {}
        for piece, found in pieces.normal.items():
            node = 0
            for c in piece:
                node = child.setdefault(node << 21 | ord(c), len(child) + 1)
            at_node[node] = found
        self.score, self.id = np.full(len(child) + 1, -np.inf), np.full(len(child) + 1, -1, np.int32)
        places = np.fromiter(at_node, np.int64, len(at_node))
        self.score[places] = [s for s, _ in at_node.values()]
        self.id[places] = [i for _, i in at_node.values()]
        self.edges = Places(2 * len(child))
        self.edges.learn(np.fromiter(child, np.uint64, len(child)))

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node by its character, 0 if there is none."""
        return self.edges.find(nodes.astype(np.uint64) << np.uint64(21) | chars) + 1


@lru_cache(maxsize=2)
def trie(path: str | None) -> Trie:
    return Trie(load(path))


def _pass(words: list[str], width: int, t: Trie) -> list[tuple[float, float, bytes]]:
    m, size = len(words), np.fromiter(map(len, words), np.int64, len(words)) + 1
    codes = np.frombuffer("".join([SPACE + w.ljust(width - 1, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    longest = min(t.longest, width)
    ends = np.zeros((longest + 1, width + 1, m), np.int32)  # by length and end, the node of the piece
    row, col = np.divmod(np.arange(m * width), width)
    keep = col < size[row]
    row, col = row[keep], col[keep]
    node = np.zeros(len(row), np.int32)
    for length in range(1, longest + 1):
        node = t.step(node, codes[row * width + col])
        col = col + 1
        here = node > 0
        row, col, node = row[here], col[here], node[here]
        is_piece = t.id[node] >= 0
        ends[length, col[is_piece], row[is_piece]] = node[is_piece]
        more = col < size[row]
        row, col, node = row[more], col[more], node[more]
        if not len(row):
            longest = length
            break
    best, second, back = np.zeros((width + 1, m)), np.full((width + 1, m), -np.inf), np.zeros((width + 1, m), np.int64)
    for b in range(1, width + 1):
        one, two, start = np.full(m, -np.inf), np.full(m, -np.inf), np.ones(m, np.int64)
        for length in range(min(longest, b), 0, -1):  # of equal scores the longest piece stays
            s = t.score[ends[length, b]]
            if length == 1:
                s = np.where(np.isinf(s), t.pieces.unknown, s)
            x = best[b - length] + s
            two = np.maximum(np.maximum(two, second[b - length] + s), np.minimum(one, x))
            better = x > one
            one = np.where(better, x, one)
            start[better] = length
        best[b], second[b], back[b] = one, two, start
    every = np.arange(m)
    ids, count, at, live = np.zeros((m, width), np.int32), np.zeros(m, np.int64), size.copy(), every
    while len(live):  # backwards from the ends, so that ids end at the right edge
        length = back[at[live], live]
        ids[live, width - 1 - count[live]] = t.id[ends[length, at[live], live]]
        count[live] += 1
        at[live] -= length
        live = live[at[live] > 0]
    bare = (ids < 0).any(1)
    raw, score, other = ids.astype("<i4").tobytes(), best[size, every], second[size, every]
    end = 4 * width * (every + 1)
    parts = [raw[a:b] for a, b in zip((end - 4 * count).tolist(), end.tolist())]
    for k in np.flatnonzero(bare).tolist():
        parts[k] = _spelled(SPACE + words[k], np.frombuffer(parts[k], "<i4"), t.pieces)
    return list(zip(score.tolist(), (score - other).tolist(), parts))


def _spelled(chunk: str, ids: np.ndarray, pieces: Pieces) -> bytes:
    """ids with the byte pieces of the characters that have no piece (-1)."""
    out, at = [], 0
    for i in ids.tolist():
        if i < 0:
            out += pieces.ids_of_unknown(chunk[at])
            at += 1
        else:
            out.append(i)
            at += len(pieces.text_of[i])
    return np.array(out, "<u4").tobytes()


def best_of(words: list[str], t: Trie) -> Iterator[tuple[list[str], list[tuple[float, float, bytes]]]]:
    """Of the chunk of each text between spaces, some at a time: best score, what the second best lacks (inf: there is none), ids of the best as bytes."""
    order = sorted(words, key=len)
    at = 0
    while at < len(order):  # chunks of like width together
        upto = min(len(order), at + max(1, CELLS // (len(order[at]) + 4)))
        while upto - at > 1 and (upto - at) * (len(order[upto - 1]) + 1) > 2 * CELLS:
            upto = (at + upto) // 2
        some = order[at:upto]
        yield some, _pass(some, len(some[-1]) + 1, t)
        at = upto
