"""SentencePiece encoding with N-best segmentations, and decoding (operator 2).

The piece lattice of a text has the characters' borders as nodes and vocabulary pieces as edges.  Forward Viterbi
gives the best score of every node; the N best segmentations come from an A* search backwards from the end,
whose estimate for what is left, that forward score, is exact, so only prefixes of results are expanded.  Equal
scores: the segmentation whose last piece is longest is first, then the one before it, and so on; the first
result is therefore what Viterbi itself gives when it keeps the earliest start of equal ones.

Spaces cut the lattice, as no piece crosses one, so a text's N best are made of its chunks' N best: its best is the
sum of bests, and another can only use the N - 1 cheapest deviations.  Forward search (``lattice``: all new chunks of a batch
of texts together) keeps the two best scores of a node, which gives each chunk's cheapest deviation; A* runs for the N - 1
chunks of a text where it is needed.  Chunks are remembered within a task.  Equal totals: the deviation at the earlier chunk is first.
A chunk longer than ``LONGEST`` goes by itself, in time and memory that grow with its length alone.

The model is a parameter: a .model file whose pieces and scores are read as a unigram vocabulary; characters without a
piece become byte pieces.  Texts are read whole.  Cases: null and empty texts have no pieces, one segmentation of score 0
and decode to ""; U+2581 in a text is read as a space, so it decodes as one; everything else decodes to itself.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import released
from .lattice import best_of, trie
from .pieces import SPACE, Pieces, decode, load
from .text import utf8

#: Segmentations of a text.
N = 3
#: Scores that differ by no more are equal.
EQUAL = 1e-9
#: Chunks of a generation (a task remembers two); the longest that it does; texts whose new chunks are searched together.
REMEMBER, LONGEST, TEXTS = 80_000, 64, 250


def into(chunk: str, end: int, pieces: Pieces) -> list[tuple[int, float, tuple[int, ...]]]:
    """(start, score, ids) of the pieces that end there, earliest start first."""
    get, out = pieces.normal.get, []
    for a in range(max(0, end - pieces.longest), end):
        if (p := get(chunk[a:end])) is not None:
            out.append((a, p[0], (p[1],)))
    if not (out and out[-1][0] == end - 1):
        out.append((end - 1, pieces.unknown, tuple(pieces.ids_of_unknown(chunk[end - 1]))))
    return out


def forward(chunk: str, pieces: Pieces) -> array:
    """The best score of every position."""
    get, longest, unknown = pieces.normal.get, pieces.longest, pieces.unknown
    best = array("d", [0.0])
    for b in range(1, len(chunk) + 1):
        p = get(chunk[b - 1])
        most = best[b - 1] + (p[0] if p else unknown)
        for a in range(b - longest if b > longest else 0, b - 1):
            if (p := get(chunk[a:b])) is not None and best[a] + p[0] > most:
                most = best[a] + p[0]
        best.append(most)
    return best


def a_star(chunk: str, best: array, n: int, pieces: Pieces) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (score, ids), backwards from the end.

    The estimate is exact: of the ways out of a node, one lacks nothing more, and of equal ones that of the longest piece is next in order.  So
    each result is a straight walk to the start, and only the n - 1 best branches off the walks so far can still be results.
    """
    walks: list[tuple[list[int], list[tuple[int, ...]]]] = []  # of each result: starts and ids of its pieces from the end
    open_: list[tuple[float, int, int, int, tuple[int, ...]]] = [(0.0, 0, 0, -1, ())]  # (what it lacks, walk, steps of it, then this start, ids), best first
    same: dict[tuple[int, int], int] = {}  # steps that two walks have in common
    out = []

    def earlier(x, y) -> bool:
        """Whether x is before y: the first start in which they differ decides."""
        if x[0] != y[0]:
            return x[0] < y[0]
        i = min(x[2], y[2], same.get((x[1], y[1]), len(chunk)))
        return (x[3] if i == x[2] else walks[x[1]][0][i]) < (y[3] if i == y[2] else walks[y[1]][0][i])

    while open_ and len(out) < n:
        lack, walk, steps, start, piece = open_.pop(0)
        starts, ids = ([*walks[walk][0][:steps], start], [*walks[walk][1][:steps], piece]) if walks else ([], [])
        mine = len(walks)
        walks.append((starts, ids))
        for w in range(mine):
            same[w, mine] = same[mine, w] = min(steps, same.get((w, walk), steps)) if w != walk else steps
        at = start if mine else len(chunk)
        while at:
            ways = into(chunk, at, pieces)
            lacks = [best[at] - best[a] - s for a, s, _ in ways]
            least = min(lacks)
            go = next(k for k, x in enumerate(lacks) if x <= least + EQUAL)
            for k, (a, _, piece) in enumerate(ways):
                if k != go:
                    x = (lack + (lacks[k] if lacks[k] > EQUAL else 0.0), mine, len(starts), a, piece)
                    if len(open_) + len(out) + 1 >= n and (not open_ or not earlier(x, open_[-1])):
                        continue
                    place = len(open_)
                    while place and earlier(x, open_[place - 1]):
                        place -= 1
                    open_.insert(place, x)
                    del open_[max(0, n - 1 - len(out)) :]
            at, _, piece = ways[go]
            starts.append(at)
            ids.append(piece)
        out.append((best[-1] - lack, tuple(i for piece in reversed(ids) for i in piece)))
    return out


class Encoder:
    """N best segmentations; text between spaces -> (score, what the second best lacks, ids of the best as bytes) is remembered within a task."""

    def __init__(self, path: str | None, n: int):
        self.trie, self.n = trie(path), n
        self.pieces = self.trie.pieces
        self.known: dict[str, tuple[float, float, bytes]] = {}
        self.before: dict[str, tuple[float, float, bytes]] = {}  # the generation before
        self.more: dict[str, list] = {}
        self.odd: set[str] = set()  # what its ids don't decode to

    def _check(self, words: list[str], ids: list[bytes]) -> None:
        decoded = b"".join(map(self.pieces.bytes_of.__getitem__, memoryview(b"".join(ids)).cast("I")))
        if decoded != b"".join([b" " + w.encode() for w in words]):
            if len(words) == 1:
                self.odd.update(words)
            else:
                for w, i in zip(words, ids):
                    self._check([w], [i])

    def _long(self, word: str) -> None:
        """Of one long chunk: the same, and its deviations."""
        chunk = SPACE + word
        found = a_star(chunk, forward(chunk, self.pieces), max(2, self.n), self.pieces)
        ids = [np.array(x, "<u4").tobytes() for _, x in found]
        self.more[word] = [(found[0][0] - s, x) for (s, _), x in zip(found[1:], ids[1:])][: self.n - 1]
        self.known[word] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else float("inf"), ids[0]
        self._check([word], [ids[0]])

    def learn(self, texts: list[list[str]]) -> None:
        """Makes all chunks of these texts known."""
        if len(self.known) > REMEMBER:
            self.known, self.before, self.more, self.odd = {}, self.known, {}, set()
        new, before = set().union(*texts).difference(self.known), self.before
        old = new.intersection(before)
        self.known.update(zip(old, map(before.__getitem__, old)))
        new -= old
        for words, found in best_of([w for w in new if len(w) <= LONGEST], self.trie):
            self.known.update(zip(words, found))
            self._check(words, [x[2] for x in found])
        self.long = [w for w in new if len(w) > LONGEST]
        for w in self.long:
            self._long(w)

    def forget_long(self) -> None:
        for w in self.long:
            del self.known[w], self.more[w]

    def deviations(self, word: str) -> list[tuple[float, bytes]]:
        """(what it lacks, ids) of the chunk's second to n-th best."""
        if (found := self.more.get(word)) is None:
            chunk = SPACE + word
            best = forward(chunk, self.pieces)
            found = self.more[word] = [(best[-1] - s, np.array(ids, "<u4").tobytes()) for s, ids in a_star(chunk, best, self.n, self.pieces)[1:]]
        return found

    def _best(self, words: list[str]) -> tuple[list[tuple[float, bytes]], bool]:
        """The n best (score, ids as little-endian unsigned 32-bit numbers) of the text of known words, and whether the best decodes to it."""
        found = list(map(self.known.__getitem__, words))
        base = [x[2] for x in found]
        total, first = sum([x[0] for x in found]), b"".join(base)
        out = [(total, first)]
        lacks, single = [x[1] for x in found], []
        for _ in range(min(self.n - 1, len(words))):
            least = min(lacks)
            if least == float("inf"):
                break
            p = lacks.index(least)
            lacks[p] = float("inf")
            single += [(x, p, r, ids) for r, (x, ids) in enumerate(self.deviations(words[p]), 1)]
        single = sorted(single)[: self.n - 1]
        sets = []
        for k in range(1, len(single) + 1):
            for some in combinations(single, k):
                if len({x[1] for x in some}) == k:
                    order = sorted(((x[1], x[2]) for x in some), reverse=True)
                    sets.append((sum(x[0] for x in some), order, some))
        for less, _, some in sorted(sets, key=lambda x: x[:2])[: self.n - 1]:
            parts, at, byte = [], 0, 0
            for _, p, _, other in sorted(some, key=lambda x: x[1]):
                end = byte + sum(map(len, base[at:p]))
                parts += [first[byte:end], other]
                at, byte = p + 1, end + len(base[p])
            out.append((total - less, b"".join([*parts, first[byte:]])))
        return out, not self.odd or self.odd.isdisjoint(words)

    def batch(self, texts: list[bytes]) -> Iterator[tuple[list[tuple[float, bytes]], bool]]:
        """For each text its n best (score, ids as little-endian unsigned 32-bit numbers), and whether the best decodes to it."""
        for at in range(0, len(texts), TEXTS):
            split = [t.decode().replace(SPACE, " ").split(" ") if t else [] for t in texts[at : at + TEXTS]]
            self.learn(split)
            for words in split:
                yield self._best(words) if words else ([(0.0, b"")], True)
            self.forget_long()

    def encode(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a text."""
        ((best, _),) = self.batch([text.encode()])
        return [(s, np.frombuffer(ids, "<u4").tolist()) for s, ids in best]


def encoded(docs: DataFrame, n: int = N, path: str | None = None) -> DataFrame:
    """Each row of docs as the struct ``row`` with nbest: array of (score, ids), best first."""
    kind = "array<struct<score:double,ids:array<int>>>"
    arrow = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, n)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                best = [[{"score": s, "ids": np.frombuffer(ids, "<i4")} for s, ids in found] for found, _ in encoder.batch(utf8(b.column("text")))]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(best, arrow)], ["row", "nbest"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, nbest {kind}")


def digest(docs: DataFrame, n: int = N, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score, and of each segmentation its score and the crc32 of its ids (little-endian unsigned 32-bit); decoded: the best ids decode to the text."""
    names = ["doc_id", "n_tokens", "score", "nbest_scores", "nbest_crc32", "decoded"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, n)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                count, score, scores, crc, same = [], [], [], [], []
                for best, decodes in encoder.batch(utf8(b.column("text"))):
                    count.append(len(best[0][1]) // 4)
                    score.append(best[0][0])
                    scores.append([s for s, _ in best])
                    crc.append([zlib.crc32(ids) for _, ids in best])
                    same.append(decodes)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count, pa.int64()), pa.array(score, pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array(crc, pa.list_(pa.int64())), pa.array(same, pa.bool_())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, score double, nbest_scores array<double>, nbest_crc32 array<bigint>, decoded boolean")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens (a column ids: array<int>) as the struct ``row`` with the column text that the ids stand for (null ids: null)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for b in batches:
            text = [None if ids is None else decode(ids, pieces) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(text, pa.string())], ["row", "text"])

    rows = tokens.select(F.struct(*tokens.columns).alias("row"), "ids")
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
