"""Token counts under a unigram vocabulary without making the tokens (operator 4).

An Aho-Corasick automaton over the vocabulary enumerates all pieces that occur in a text, by end position and longest
first; dynamic programming carries the best score and its piece count over the positions.  A later candidate replaces an
earlier one only if its score is higher, so of equal ones the earliest start stays: the tokenizer's own rule.  Characters
without a piece cost what the model charges for an unknown one and count as their UTF-8 bytes.

Spaces cut the text into chunks that no piece crosses; chunks are remembered within a task.  Scores of a chunk are
summed in double precision.  Cases: null and empty texts count 0; U+2581 counts as a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .jobs import released
from .pieces import Pieces, chunks, load
from .text import utf8

#: Chunks that a task remembers, and the longest that it does.
REMEMBER, LONGEST = 200_000, 64


@lru_cache(maxsize=2)
def automaton(path: str | None) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for piece, (score, _) in load(path).normal.items():
        found.add_word(piece, (len(piece), score))
    found.make_automaton()
    return found


def count_chunk(chunk: str, matches: ahocorasick.Automaton, pieces: Pieces) -> int:
    low, n = float("-inf"), len(chunk)
    score, count, single = [0.0] + [low] * n, [0] * (n + 1), -1
    at = 0  # positions before this are settled

    def settle(upto: int) -> None:
        """Give the positions up to here that no single-character piece reaches the way by an unknown character."""
        nonlocal at
        while at < upto:
            at += 1
            if single != at and score[at - 1] + pieces.unknown > score[at]:
                score[at] = score[at - 1] + pieces.unknown
                count[at] = count[at - 1] + len(chunk[at - 1].encode())

    for last, (length, s) in matches.iter(chunk):
        settle(last)
        end = last + 1
        x = score[end - length] + s
        if length == 1:
            single = end
        if x > score[end]:
            score[end] = x
            count[end] = count[end - length] + 1
    settle(n)
    return count[n]


class Counts(dict):
    """chunk -> number of pieces."""

    def __init__(self, path: str | None):
        self.matches, self.pieces = automaton(path), load(path)

    def __missing__(self, chunk: str) -> int:
        n = count_chunk(chunk, self.matches, self.pieces)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBER:
                self.clear()
            self[chunk] = n
        return n


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path)
        for b in batches:
            n = [sum(map(counts.__getitem__, chunks(t.decode()))) for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")
