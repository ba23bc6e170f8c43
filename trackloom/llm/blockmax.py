"""An inverted index in arrays with block maxima: the k largest sums of weighted impacts, with blocks left out by their bounds."""

from __future__ import annotations

import numpy as np

from .text import ranges


#: Terms in more than 1 of so many documents are common.
COMMON = 8


class BlockMax:
    """Postings by term (``docs`` ascending within a term, ``offsets`` of terms), and maxima of their blocks, whose width depends on the term.

    A rare term occurs once in a block at most times, so its blocks are single documents: its postings are their own maxima.  A common term has
    blocks of ``block`` documents, with a row of all documents and one of all block maxima.
    """

    def __init__(self, documents: int, offsets: np.ndarray, docs: np.ndarray, impact: np.ndarray, block: int, first: int):
        self.documents, self.size, self.first, self.blocks = documents, block, first, documents // block + 1
        df = np.diff(offsets)
        common = np.flatnonzero(df * COMMON > documents)
        self.row = np.full(len(df), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.full = np.zeros((len(common), self.blocks * block))
        at, which = ranges(offsets[common], offsets[common + 1])
        self.full[which, docs[at]] = impact[at]
        self.most = self.full.reshape(len(common), self.blocks, block).max(2) if len(common) else np.zeros((0, self.blocks))
        rare = np.ones(len(docs), bool)
        rare[at] = False
        df[common] = 0
        self.docs, self.impact, self.offsets = docs[rare].astype(np.int32), impact[rare], np.r_[0, np.cumsum(df)]

    def scores(self, of: np.ndarray, terms: np.ndarray, weight: np.ndarray, least: np.ndarray, k: int, places: int = 9) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores of queries x documents, least, documents read) for weighted terms of some queries (of: which, ascending), with a least score for each query.

        Documents whose bounds reach least are the pivots and have their whole score; of all others, the postings of common terms are skipped and the score is 0.
        least is the given one or, if that is larger, the k-th score of the ``first`` documents of highest bound, which are read before the others.
        """
        n, slack, width = len(least), 10.0**-places, self.blocks * self.size
        row = self.row[terms]
        common = np.flatnonzero(row >= 0)
        edge = np.searchsorted(of[common], np.arange(n + 1))
        rows = [(row[common[a:b]], weight[common[a:b]]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        post, which = ranges(self.offsets[terms], self.offsets[terms + 1])
        at = self.docs[post] if n == 1 else of[which] * width + self.docs[post]
        rare = np.bincount(at, self.impact[post] * weight[which], n * width).reshape(n, width)
        score, total = np.zeros((n, width)), 0
        for q, (r, w) in enumerate(rows):
            bound = rare[q] + (np.repeat(w @ self.most[r], self.size) + slack)
            done = np.zeros(0, np.int64)
            if least[q] <= 0 and self.documents > 2 * self.first:
                done = np.argpartition(-bound, self.first)[: self.first]
                score[q, done] = rare[q, done] + w @ self.full[np.ix_(r, done)]
                if self.documents > k:
                    least[q] = round(float(np.partition(score[q, done], -k)[-k]), places) if len(done) > k else 0.0
                bound[done] = -1.0
            pivots = np.flatnonzero(bound >= max(least[q], 2 * slack))
            score[q, pivots] = rare[q, pivots] + w @ self.full[np.ix_(r, pivots)]
            total += len(done) + len(pivots)
        return score[:, : self.documents], least, total

    def best(self, of: np.ndarray, terms: np.ndarray, weight: np.ndarray, least: np.ndarray, k: int, places: int = 9, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, document, rounded score, documents read): each query's documents that score least or more and reach its k-th score, ties whole.  skip: a document for each query that is none."""
        score, least, total = self.scores(of, terms, weight, least, k + (skip is not None), places)
        if skip is not None:
            score[np.arange(len(score)), skip] = 0.0
        if self.documents > k:
            least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k]) if skip is None else np.partition(score, -k, axis=1)[:, -k]
        query, docs = np.nonzero(score >= np.maximum(least - 2 * 10.0**-places, 10.0**-places)[:, None])
        return query, docs, np.round(score[query, docs], places), total
