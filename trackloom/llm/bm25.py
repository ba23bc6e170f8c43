"""Exact BM25 top-k search with block-max WAND pruning, by shard (operator 10).

Documents are indexed in shards of a bounded number of words: sorted term hashes with postings by document.  Global
statistics (rows, words, and the document frequencies of query terms) are added up by Spark, so every shard scores alike
and the k best of all shards' k best are the k best of all.

In a shard, a common term has the largest impact that it takes in each block of ``BLOCK`` neighbours; a rare one has blocks of one document, as
it would seldom occur twice in a wider one.  The bounds of a query's terms, added up by document, choose the pivots: the documents that can
reach the k-th score so far.  The postings of common terms, which are most, are read in those alone and skipped everywhere else.
This is WAND's rule for all documents of a shard in one array pass, in place of cursors that leap from pivot to pivot.  Without a
k-th score, the ``FIRST`` documents of highest bound are read before the others.  Scores are rounded to nine places, so equal documents tie wherever they lie.

A query's k-th score goes along: within a task from shard to shard, and from one rank of shards to the next.  Ranks are drawn by
a hash so that each is a ``WIDER``-th of the one after it; what a rank adds is then about WIDER * k rows for each query, however many shards there are.

The index is a table in the shared folder by rank, read once for each block of queries; a block holds at most
``QUERY_TERMS`` terms and is broadcast.  Queries are whole texts; each distinct term counts once.

Cases: words are ``[0-9a-z\\x80-]+`` after lower-casing A-Z; a query without words finds nothing; documents without any query term aren't
results; null ids are indexed but are no queries; equal rows are separate results; queries equal in id and text are one.
Ties: smaller doc_id first, null last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut
from .blockmax import BlockMax
from .jobs import released
from .text import WordHashes, utf8

#: BM25's constants, and results of a query.
K1, B, TOP = 1.2, 0.75, 10
#: Words and documents after which a shard is closed; documents of a block; documents read before the first threshold.
SHARD_WORDS, SHARD_DOCUMENTS, BLOCK, FIRST = 4_000_000, 10_000, 8, 64
#: How much wider each rank of shards is than the one searched before it, and the most ranks.
WIDER, RANKS = 4, 12
#: Query terms that are broadcast at once, and texts whose terms are taken together.
QUERY_TERMS, TEXTS = 600_000, 300

_SHARD = "rank int, part long, shard int, documents long, words long, ids binary, null_ids binary, sizes binary, terms binary, offsets binary, docs binary, tfs binary"


def _terms(texts: list[bytes], words: WordHashes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted term hashes, how often) of each text."""
    x, n = words(texts)
    return [np.unique(w, return_counts=True) for w in np.split(x, np.cumsum(n)[:-1])] if len(n) else []


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, number, part, held = WordHashes(alnum=True), 0, 0, 0
    ids: list = []
    each: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> pa.RecordBatch:
        n = np.array([len(t) for t, _ in each])
        h, tf, doc = np.concatenate([t for t, _ in each]), np.concatenate([c for _, c in each]), np.repeat(np.arange(len(each)), n)
        order = np.argsort(h, kind="stable")
        h, tf, doc = h[order], tf[order], doc[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        sizes = np.array([c.sum() for _, c in each], "<u4")
        blobs = (np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], np.uint8), sizes, h[first], np.r_[first, len(h)].astype("<u4"), doc.astype("<u2"), tf.astype("<u4"))
        names = [x.split()[0] for x in _SHARD.split(", ")]
        drawn = xxhash.xxh3_64_intdigest(np.array([part, number], "<i8").tobytes())
        rank = next((r for r in range(RANKS) if drawn % WIDER ** (r + 1)), RANKS)
        return pa.RecordBatch.from_arrays([pa.array([rank], pa.int32()), pa.array([part], pa.int64()), pa.array([number], pa.int32()), pa.array([len(each)], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names)

    for whole in batches:
        part = whole.column("part")[0].as_py() if whole.num_rows else part
        for at in range(0, whole.num_rows, TEXTS):
            b = whole.slice(at, TEXTS)
            for i, terms in zip(b.column("id").to_pylist(), _terms(utf8(b.column("text")), words)):
                ids.append(i)
                each.append(terms)
                held += int(each[-1][1].sum())
                if held >= SHARD_WORDS or len(each) >= SHARD_DOCUMENTS:
                    yield close()
                    number, held, ids, each = number + 1, 0, [], []
    if each:
        yield close()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for terms, offsets in zip(b.column("terms").to_pylist(), b.column("offsets").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.diff(np.frombuffer(offsets, "<u4").astype(np.int64)))], ["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes(alnum=True)
    for b in batches:
        found = [t for t, _ in _terms(utf8(b.column("text")), words)]
        n = [len(f) for f in found]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("id").to_numpy(), n)), pa.array(np.repeat(b.column("version").to_numpy(), n)), pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["id", "version", "term"])


def build(docs: DataFrame) -> DataFrame:
    """The index of docs: a row for each shard, in folders by rank."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.spark_partition_id().cast("long").alias("part"))
    return cut(rows.mapInArrow(released(_build), _SHARD), "rank")


class Shard:
    """A shard in memory: its ids, its terms, and their impacts as an index with block maxima."""

    def __init__(self, row: dict, mean: float):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.null, self.terms = get("ids", "<i8"), get("null_ids", np.uint8), get("terms", np.uint64)
        docs, tf = get("docs", "<u2"), get("tfs", "<u4").astype(np.float64)
        size = get("sizes", "<u4").astype(np.float64)
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[docs] / mean)) if len(tf) else tf
        self.index = BlockMax(len(self.ids), get("offsets", "<u4").astype(np.int64), docs, impact, BLOCK, FIRST)

    def find(self, at: np.ndarray, idf: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of the k best among the documents that score least or more for terms at these places, best first, and how many documents were read."""
        _, docs, final, total = self.index.best(np.zeros(len(at), np.int64), at, idf, np.array([least]), k)
        keep = final >= max(least, 1e-9)
        docs, final = docs[keep], final[keep]
        order = np.lexsort((self.ids[docs], self.null[docs], -final))[:k]
        return docs[order], final[order], total


class _Best:
    """A query's k best of the shards that a task has read: (score, null, id)."""

    __slots__ = ("ids", "least", "null", "score")

    def __init__(self, least: float):
        self.least, self.score, self.null, self.ids = least, np.zeros(0), np.zeros(0, np.uint8), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray, k: int) -> None:
        score, null, ids = np.r_[self.score, score], np.r_[self.null, null], np.r_[self.ids, ids]
        order = np.lexsort((ids, null, -score))[:k]
        self.score, self.null, self.ids = score[order], null[order], ids[order]
        if len(order) == k:
            self.least = max(self.least, float(self.score[-1]))


def _search(queries, mean: float, k: int):
    names = ["query_id", "version", "doc_id", "score"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, versions, cuts, terms, idf, least = queries.value
        best: dict[int, _Best] = {}
        for b in batches:
            for i in range(b.num_rows):
                (row,) = b.slice(i, 1).to_pylist()
                shard = Shard(row, mean)
                at = np.minimum(np.searchsorted(shard.terms, terms), max(0, len(shard.terms) - 1))
                known = shard.terms[at] == terms if len(shard.terms) else np.zeros(len(terms), bool)
                for q in range(len(ids)):
                    part = slice(cuts[q], cuts[q + 1])
                    mine = known[part]
                    if mine.any():
                        so_far = best.get(q)
                        docs, score, _ = shard.find(at[part][mine], idf[part][mine], k, so_far.least if so_far else least[q])
                        if len(docs):
                            if so_far is None:
                                so_far = best[q] = _Best(least[q])
                            so_far.add(score, shard.null[docs], shard.ids[docs], k)
        rows = sorted(best.items())
        for at in range(0, len(rows), 1000):
            some = rows[at : at + 1000]
            n = [len(x.ids) for _, x in some]
            null = np.concatenate([x.null for _, x in some]).astype(bool)
            which = np.repeat([q for q, _ in some], n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(versions[which]), pa.array(np.concatenate([x.ids for _, x in some]), mask=null), pa.array(np.concatenate([x.score for _, x in some]))], names)

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, doc_id and score of the k best rows of docs for each row (doc_id, text) of queries."""
    spark = docs.sparkSession
    index = build(docs)
    total = index.agg(F.sum("documents").alias("n"), F.sum("words").alias("w")).first()
    n, mean = total.n or 0, (total.w or 0) / max(1, total.n or 0) or 1.0
    ranks = sorted((r["rank"] for r in index.select("rank").distinct().collect()), reverse=True)  # RANKS + 1 at most
    asked = queries.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("version"), "text").where("id is not null and text is not null").dropDuplicates(["id", "version"])
    terms = cut(asked.mapInArrow(released(_query_terms), "id long, version long, term long"))
    wanted = terms.select("term").distinct()
    df = index.select("terms", "offsets").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).join(wanted, "term", "left_semi")
    weighed = cut(terms.join(df, "term").select("id", "version", "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    blocks = max(1, -(-weighed.count() // QUERY_TERMS))
    parts = []
    for i in range(blocks):
        rows = weighed if blocks == 1 else weighed.where(F.pmod(F.xxhash64("id", "version"), F.lit(blocks)) == i)
        table = rows.toArrow()
        ids, versions, term, idf = (table.column(c).to_numpy() for c in ("id", "version", "term", "idf"))
        order = np.lexsort((term.view(np.uint64), versions, ids))
        ids, versions, term, idf = ids[order], versions[order], term[order].view(np.uint64), idf[order]
        cuts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1])]) if len(ids) else np.zeros(0, np.int64)
        least, mine = np.zeros(len(cuts)), []
        for rank in ranks:
            shared = spark.sparkContext.broadcast((ids[cuts], versions[cuts], np.r_[cuts, len(ids)], term, idf, least))
            mine.append(cut(index.where(F.col("rank") == rank).mapInArrow(_search(shared, mean, k), "query_id long, version long, doc_id long, score double")))
            shared.destroy()
            if rank != ranks[-1]:
                least = _kth(reduce(DataFrame.unionAll, mine), ids[cuts], versions[cuts], k)
        parts += mine
    found = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], "query_id long, version long, doc_id long, score double")
    best = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _kth(found: DataFrame, ids: np.ndarray, versions: np.ndarray, k: int) -> np.ndarray:
    """The k-th score so far of each query of a block (0: there are fewer): one number a query of the block reaches the driver."""
    of = Window.partitionBy("query_id", "version").orderBy(F.desc("score"))
    table = found.withColumn("place", F.row_number().over(of)).where(F.col("place") == k).select("query_id", "version", "score").toArrow()
    least = dict(zip(zip(table.column("query_id").to_pylist(), table.column("version").to_pylist()), table.column("score").to_pylist()))
    return np.array([least.get(x, 0.0) for x in zip(ids.tolist(), versions.tolist())])


def neighbours(docs: DataFrame, k: int = TOP) -> DataFrame:
    """The k best rows for each row whose id is divisible by 100, by its whole text."""
    return search(docs, docs.where(F.col("doc_id") % 100 == 0), k)
