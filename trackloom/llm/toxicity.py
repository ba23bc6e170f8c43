"""Toxicity scores from nearest labelled examples (operator 3).

An example is a labelled document as a TF-IDF vector; a document's score comes from its ``NEAREST`` examples by exact
cosine, found with a block-max inverted index: a common feature has the largest weight that it takes in each block of examples, so those and the
weights of rare features bound every cosine, and the postings of common features are not read for examples whose bound is below the last neighbour.  Votes are weighted
by distance and by what the example's class stands for in the labelled rows, and a logistic curve fitted on leave-one-out votes
turns them into probabilities.

Features are words ``[a-z\\x80-]+`` after lower-casing A-Z, and those beginnings of words (4 and 5 bytes) that the examples associate with the label (chi-squared
of ``LEAST_CHI2`` or more).  All words that occur in an example are in the index, with document frequencies counted over all
documents.  Words that aren't associated weigh ``PLAIN`` of their TF-IDF, so they decide among documents that hold nothing else.

What is learned is bounded, whatever the input: at most ``PER_CLASS`` labelled rows of each class (the first by a hash of
the id), on their whole texts.  That is the documented sample; every document is counted and scored, on its whole text.

Cases: null and empty texts have no features and get the share of toxic rows among examples without an associated feature, as does a text
that shares no feature with any example; rows with a null label, null id or held out are never learned from; equal
labelled texts count once, under their smallest id, and as toxic if any of them is; without labels of both classes every score is the share of toxic labels (0 without any).
Neighbours of equal cosine: by their heaviest feature (that of the smaller hash first), then by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut
from .blockmax import BlockMax
from .jobs import give_back, released
from .text import BASES, Places, Prefix, letter_words, utf8

#: Labelled rows of each class that are learned from.
PER_CLASS = 1500
#: What associates a feature with the label: documents of the sample, chi-squared; and the weight of the others.
LEAST_DOCUMENTS, LEAST_CHI2, PLAIN = 3, 20.0, 0.01
#: Neighbours that vote, examples in a block of the index, and examples read before the first threshold.
NEAREST, BLOCK, FIRST = 15, 16, 64
#: Weight of the featureless share among the votes; distance at which a vote halves twice.
PRIOR_VOTES, NEAR = 1.0, 0.05
#: Texts counted together, and texts scored together.
TEXTS, SCORED = 100, 25
#: Rows with crc32(doc_id as text) modulo FOLDS = 0 are held out.
FOLDS = 5
#: Slices in which document frequencies are added up, and lanes of tasks in the first step.
SLICES, LANES = 16, 64

#: Lengths of beginnings.
BEGINNINGS = 4, 5


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


class Hashes:
    """64-bit hashes of the words of texts and of their beginnings; the last bits tell them apart."""

    def __init__(self):
        self.prefix = Prefix(BASES[0])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, start, size, bytes) of each feature that occurs."""
        x, start, size, text = letter_words(texts)
        out = [(text, self.prefix(x, start, size) << np.uint64(2), start, size)]
        for k, n in enumerate(BEGINNINGS, 1):
            longer = np.flatnonzero(size > n)
            whole = np.full(len(longer), n)
            out.append((text[longer], self.prefix(x, start[longer], whole) << np.uint64(2) | np.uint64(k), start[longer], whole))
        return *(np.concatenate(c) for c in zip(*out)), x


class Features:
    """Counts of known features (sorted hashes) in texts."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.of = hashes, Hashes()
        self.places = Places(len(hashes) + 1)
        self.places.learn(hashes)

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, how often) of the features of each text, by text and place."""
        text, h, *_ = self.of(texts)
        at = self.places.find(h)
        hit = at >= 0
        key, n = np.unique(text[hit] * max(1, len(self.hashes)) + at[hit], return_counts=True)
        text, at = np.divmod(key, max(1, len(self.hashes)))
        return text, at, n


class Model:
    """The index over examples, and the curve from votes to scores.

    hashes: of all features, sorted; weight: of each; named: those associated with the label, by place; examples: (id, label, places, counts);
    share: of toxic rows without an associated feature; votes: weight of a vote, by class.
    """

    def __init__(self, hashes: np.ndarray, weight: np.ndarray, named: dict[int, str], examples: list, share: float, votes: tuple[float, float]):
        self.hashes, self.weight, self.named, self.share, self.weights, self.k = hashes, weight, named, share, votes, NEAREST
        self.associated = np.zeros(len(hashes), bool)
        self.associated[list(named)] = True
        examples = [x for x in examples if len(x[2])]
        size = [len(x[2]) for x in examples]
        of, at, w = self.vectors(np.repeat(np.arange(len(examples)), size), *(np.concatenate([x[c] for x in examples]) if examples else np.zeros(0, np.int64) for c in (2, 3)), len(examples))
        # like examples in the same block: by their heaviest feature
        heaviest = np.full(len(examples), -1)
        order = np.lexsort((at, w, of))
        heaviest[of[order]] = at[order]
        place = np.lexsort(([x[0] for x in examples], heaviest)) if examples else np.zeros(0, np.int64)
        self.ids, self.labels = (np.array([examples[k][c] for k in place], np.int64) for c in (0, 1))
        of = np.argsort(place)[of] if examples else of
        order = np.lexsort((of, at))
        self.index = BlockMax(len(examples), np.searchsorted(at[order], np.arange(len(hashes) + 1)), of[order].astype(np.int32), w[order], BLOCK, FIRST)
        self.curve = (1.0, 0.0)
        order = np.argsort(of, kind="stable")
        of, at, w = of[order], at[order], w[order]
        found: list[float] = []
        for k in range(0, len(examples), SCORED):
            a, b = np.searchsorted(of, [k, k + SCORED])
            n = min(SCORED, len(examples) - k)
            found += self.votes(of[a:b] - k, at[a:b], w[a:b], n, np.arange(k, k + n))[0].tolist()
        self.curve = self._fit(np.array(found), self.labels, np.array(votes)[self.labels]) if examples else (1.0, 0.0)

    def vectors(self, of: np.ndarray, at: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, weight) of unit vectors from counts."""
        w = (1 + np.log(np.maximum(n, 1))) * self.weight[at]
        norm = np.sqrt(np.bincount(of, w * w, rows))
        return of, at, w / norm[of]

    def nearest(self, of: np.ndarray, at: np.ndarray, w: np.ndarray, rows: int, skip: np.ndarray | None = None, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, example, cosine) of each row's k examples of highest cosine above 0, best first, ties by place; exact."""
        row, example, cosine, _ = self.index.best(of, at, w, np.zeros(rows), k, 12, skip)
        order = np.lexsort((example, -cosine, row))
        row, example, cosine = row[order], example[order], cosine[order]
        turn = np.arange(len(row)) - np.searchsorted(row, row)
        return row[turn < k], example[turn < k], cosine[turn < k]

    def votes(self, of: np.ndarray, at: np.ndarray, w: np.ndarray, rows: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's share of toxic votes, and (row, example) of the voters, best first."""
        row, example, cosine = self.nearest(of, at, w, rows, skip, self.k)
        vote = np.array(self.weights)[self.labels[example]] * NEAR / (1 - np.minimum(cosine, 1.0) + NEAR) * (self.k / np.maximum(1, np.bincount(row, minlength=rows))[row])
        toxic = PRIOR_VOTES * self.share + np.bincount(row, vote * self.labels[example], rows)
        return toxic / (PRIOR_VOTES + np.bincount(row, vote, rows)), row, example

    @staticmethod
    def _logit(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def _fit(self, votes, labels, weights) -> tuple[float, float]:
        """Slope and offset of the logistic curve, by Newton steps with a slight pull to (1, 0)."""
        x, y, w = np.stack([self._logit(np.array(votes)), np.ones(len(votes))], 1), np.array(labels, float), np.array(weights)
        sign, pull = 1 - 2 * y, np.array([1.0, 0.0])
        loss = lambda t: float(w @ np.logaddexp(0, sign * (x @ t)) + (t - pull) @ (t - pull) / 2)
        t = pull
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ t))
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (w * (p - y)) + (t - pull))
            for half in range(20):  # shorter steps where the curve bends
                if loss(t - step / 2**half) < loss(t):
                    t = t - step / 2**half
                    break
            else:
                break
        return float(t[0]), float(t[1])

    def score(self, of: np.ndarray, at: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
        """Of each row of counts: probability of the toxic label, ids of the examples that voted, and its heaviest associated features."""
        if not len(self.ids):
            return np.full(rows, self.share), [[]] * rows, [[]] * rows
        of, at, w = self.vectors(of, at, n, rows)
        share, row, example = self.votes(of, at, w, rows)
        score = 1 / (1 + np.exp(-(self.curve[0] * self._logit(share) + self.curve[1])))
        score[np.bincount(of, minlength=rows) == 0] = self.share
        near = [x.tolist() for x in np.split(self.ids[example], np.searchsorted(row, np.arange(1, rows)))]
        heavy: list[list] = [[] for _ in range(rows)]
        for k in np.flatnonzero(self.associated[at]).tolist():
            heavy[of[k]].append((-w[k], self.named[int(at[k])]))
        return score, near, [[f for _, f in sorted(x)[:5]] for x in heavy]


def _empty(share: float) -> Model:
    return Model(np.zeros(0, np.uint64), np.zeros(0), {}, [], share, (1.0, 1.0))


@released
def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, toxic, examples) of the beginnings of words in a batch of examples."""
    of = Hashes()
    for b in batches:
        toxic = b.column("toxic").to_numpy()
        for y in (0, 1):
            texts = [t for t, same in zip(utf8(b.column("text")), (toxic == y).tolist()) if same]
            text, h, *_ = of(texts)
            pairs = np.unique(np.stack([h[h & np.uint64(3) > 0], text[h & np.uint64(3) > 0].astype(np.uint64)]), axis=1)[0] if texts else h
            h, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n * y), pa.array(n * (1 - y))], ["h", "a", "b"])


def _vectors(beginnings: np.ndarray):
    """Counts of the words of each example, and of these beginnings (sorted)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Hashes()
        for b in batches:
            for i, y, text in zip(b.column("id").to_pylist(), b.column("toxic").to_pylist(), utf8(b.column("text"))):
                h, n = np.unique(of([text])[1], return_counts=True)
                keep = (h & np.uint64(3) == 0) | np.isin(h, beginnings)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([h[keep].tobytes()], pa.binary()), pa.array([n[keep].astype("<u4").tobytes()], pa.binary())], ["id", "toxic", "features", "n"])

    return run


def _names(wanted: np.ndarray):
    """(hash, name) of these features; a beginning is named with its length."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Hashes()
        for b in batches:
            found = {}
            for text in utf8(b.column("text")):
                _, h, start, size, x = of([text])
                hit = np.flatnonzero(np.isin(h, wanted))
                for k, a, n in zip(h[hit].tolist(), start[hit].tolist(), size[hit].tolist()):
                    found[k] = f"{n}:" * bool(k & 3) + x[a : a + n].tobytes().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array(list(found.values()), pa.string())], ["h", "feature"])

    return run


def _frequencies(hashes):
    """Of a task's documents, how many hold each feature (and how many there are), in slices."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, part = Features(hashes.value), None
        total = np.zeros(len(features.hashes) + 1, np.uint32)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                part = b.column("part")[0].as_py()
                found = features.counts(utf8(b.column("text")))
                total[:-1] += np.bincount(found[1], minlength=len(total) - 1).astype(np.uint32)
                total[-1] += b.num_rows
        if part is not None:
            slices = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in np.array_split(total.astype("<u8"), SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part % LANES] * SLICES, pa.int32()), pa.array(slices, pa.binary()), pa.array([x.nbytes for x in np.array_split(total.astype("<u8"), SLICES)], pa.int64())], ["slice", "lane", "blob", "size"])

    return run


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(pa.decompress(x, n, "zstd"), "<u8") for x, n in zip(group["blob"], group["size"]))
    return pd.DataFrame({"slice": [group["slice"].iloc[0]], "blob": [pa.compress(total.tobytes(), "zstd", asbytes=True)], "size": [total.nbytes]})


def document_frequencies(docs: DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents hold each of these features, and how many documents there are, over all of docs: a number for each feature reaches the driver."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hashes)
    rows = docs.select("text", F.spark_partition_id().alias("part")).mapInArrow(_frequencies(shared), "slice int, lane int, blob binary, size long")
    some = rows.groupBy("slice", "lane").applyInPandas(lambda g: _add(g), "slice int, blob binary, size long")
    total = {r["slice"]: np.frombuffer(pa.decompress(r["blob"], r["size"], "zstd"), "<u8") for r in some.groupBy("slice").applyInPandas(lambda g: _add(g), "slice int, blob binary, size long").collect()}
    shared.destroy()
    found = np.concatenate([total[i] for i in range(SLICES)]) if total else np.zeros(len(hashes) + 1, np.uint64)
    return found[:-1].astype(np.float64), int(found[-1])


def _chi2(a, b, n1: int, n0: int):
    """Of features that a toxic and b other examples hold."""
    return (n1 + n0) * (a * n0 - b * n1) ** 2 / (float(n0) * n1 * (a + b) * (n1 + n0 + 1 - a - b))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of the labelled rows that aren't held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(~held_out("id")).distinct()
    share = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_ = sum(share.values())
    if len(share) < 2:
        return _empty(share.get(1, 0) / max(1, all_))
    ids = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS) for y in (0, 1)]
    chosen = F.broadcast(ids[0].union(ids[1]))  # 2 * PER_CLASS rows of two numbers
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(chosen, "id").where("text is not null")
    sample = cut(sample.groupBy("text").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")))  # 2 * PER_CLASS texts at most
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n0 or not n1:
        return _empty(share[1] / all_)
    begun = sample.mapInArrow(_beginnings, "h long, a long, b long").groupBy("h").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    begun = begun.where((_chi2(F.col("a"), F.col("b"), n1, n0) >= LEAST_CHI2) & (F.col("a") + F.col("b") >= LEAST_DOCUMENTS)).select("h")
    beginnings = np.sort(begun.toArrow().column("h").to_numpy().view(np.uint64))
    rows = [(r.id, r.toxic, np.frombuffer(r.features, "<u8"), np.frombuffer(r.n, "<u4")) for r in sample.mapInArrow(_vectors(beginnings), "id long, toxic int, features binary, n binary").collect()]
    rows.sort(key=lambda r: r[0])
    toxic, size, n = np.array([r[1] for r in rows], np.float64), [len(r[2]) for r in rows], n0 + n1
    hashes, place = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
    place = place.astype(np.int32)
    both, a = np.bincount(place, minlength=len(hashes)).astype(float), np.bincount(place, np.repeat(toxic, size), len(hashes))
    associated = (_chi2(a, both - a, n1, n0) >= LEAST_CHI2) & (both >= LEAST_DOCUMENTS)
    df, documents = document_frequencies(docs, hashes)
    weight = (np.log((documents + 1) / (df + 1)) + 1) * np.where(associated, 1.0, PLAIN)
    wanted = hashes[associated]
    names = {r.h & (1 << 64) - 1: r.feature for r in sample.select("text").mapInArrow(_names(wanted), "h long, feature string").distinct().collect()}
    named = {int(p): names[h] for p, h in zip(np.flatnonzero(associated), wanted.tolist())}
    examples = [(i, y, p, c) for (i, y, _, c), p in zip(rows, np.split(place, np.cumsum(size)[:-1]))]
    stands = share[0] / n0, share[1] / n1  # labelled rows for each one of the sample
    scale = all_ / n
    bare = [sum(not associated[p].any() for _, y, p, _ in examples if y == c) * stands[c] for c in (0, 1)]
    model = Model(hashes, weight, named, examples, bare[1] / max(sum(bare), 1e-9), (stands[0] / scale, stands[1] / scale))
    give_back()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Each row of docs as the struct ``row`` with score, predicted, neighbours (ids of examples) and evidence (features)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["row", "score", "predicted", "neighbours", "evidence"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        features = Features(m.hashes)
        for whole in batches:
            for at in range(0, whole.num_rows, SCORED):
                b = whole.slice(at, SCORED)
                score, near, why = m.score(*features.counts(utf8(b.column("row").field("text"))), b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(near, pa.list_(pa.int64())), pa.array(why, pa.list_(pa.string()))], names)

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int, neighbours array<bigint>, evidence array<string>")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours and evidence of every row."""
    marked = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    found = scored(marked, fit(docs, labels))
    return found.select("row.doc_id", "row.held_out", "score", "predicted", "neighbours", "evidence")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, with all their columns."""
    return scored(docs, fit(docs, labels)).where("predicted = 0").select("row.*")
