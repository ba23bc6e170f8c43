"""Exact ranked lexical search of all documents for each benchmark item by dense matrix products (operator 13).

A document's impact for a term and an item's weight for it are integers, so scores are products of two integer matrices: documents x terms and terms x
items.  Both are made dense tile by tile, over the compact vocabulary of a tile of items alone, and multiplied by BLAS in float64.  A tile of
the vocabulary ends before any item's weights times the largest impact could reach 2**53, so every partial sum is an exact integer in
whatever order BLAS adds; tiles are added up as 64-bit integers.

1. Items are cut into terms; blocks of at most ``BLOCK_PAIRS`` (item, term) pairs (or one item) go to the driver and are broadcast, a block at a time.
2. One pass over the documents writes their counts of the block's terms as tiles of ``DOCUMENTS`` rows: a table far smaller than the texts.  It also has the
   figures that weights need: documents and terms over all rows, and document frequencies.
3. A pass over that table multiplies.  A task keeps each item's 20 best so far; of a tile, what reaches both the tile's 20th score and the
   task's is kept with all its ties, and then ordered by id.  Tasks' results are merged in two steps, by lanes of tasks and over all.

Documents are never shuffled; results are 20 rows an item and task.  Terms are told apart by 63-bit hashes.

Cases: null has no terms; documents without terms aren't counted and never found; an item without terms finds nothing; items equal in id and text are one, those that
share an id alone are ranked each for itself; repeated documents are separate results; equal scores: smaller doc_id first, null last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import running_sums
from ..plans.storage import cut
from .jobs import released
from .text import Places, WordHashes, utf8

#: Results of an item.
TOP = 20
#: Length normalisation in hundredths, impact at saturation, and what it multiplies frequency and length by.
B, UNIT, TF, LENGTH = 25, 1_000_000_000, 1000, 12
#: Every impact is below this, as m is 75 or more.
LARGEST = UNIT // TF
#: Whole numbers below this are exact in float64.
EXACT = 1 << 53
#: (item, term) pairs that are broadcast at once; items and terms of a tile of weights.
BLOCK_PAIRS, ITEMS, TERMS = 200_000, 32, 1024
#: Documents of a tile, and counts after which it ends before that; texts cut into words together.
DOCUMENTS, COUNTS, TEXTS = 1024, 1_000_000, 300
#: Lanes in which the results of tasks are merged first.
LANES = 64

_TILE = "part int, documents long, terms long, ids binary, nulls binary, sizes binary, offsets binary, places binary, counts binary"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes(alnum=True)
    for b in batches:
        x, n = words(utf8(b.column("text")))
        each = [np.unique(w, return_counts=True) for w in np.split(x, np.cumsum(n)[:-1])] if len(n) else []
        of = np.repeat(np.arange(len(each)), [len(t) for t, _ in each])
        terms, q = (np.concatenate([e[k] for e in each]) if each else np.zeros(0, np.int64) for k in (0, 1))
        at = pa.array(of)
        yield pa.RecordBatch.from_arrays([b.column("item_id").take(at), b.column("version").take(at), pa.array(terms.astype(np.int64)), pa.array(q, pa.int64())], ["item_id", "version", "term", "q"])


def _tiles(vocabulary):
    names = [x.split()[0] for x in _TILE.split(", ")]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        places, words = Places(len(terms) + 1), WordHashes(alnum=True)
        places.learn(terms)
        held: list[tuple] = []
        part = rows = counts = 0

        def close() -> pa.RecordBatch:
            ids, null, size, of, place, tf = (np.concatenate(c) for c in zip(*held))
            blobs = (ids.astype("<i8"), null.astype(np.uint8), size.astype("<u4"), np.r_[0, np.cumsum(of)].astype("<u4"), place.astype("<u4"), tf.astype("<u4"))
            numbers = [pa.array([part], pa.int32()), pa.array([int((size > 0).sum())], pa.int64()), pa.array([int(size.sum())], pa.int64())]
            return pa.RecordBatch.from_arrays([*numbers, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names)

        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                part = b.column("part")[0].as_py()
                x, n = words(utf8(b.column("text")))
                found = places.find(x)
                hit = np.flatnonzero(found >= 0)
                key, tf = np.unique(np.repeat(np.arange(len(n)), n)[hit] * (len(terms) + 1) + found[hit], return_counts=True)
                of, place = np.divmod(key, len(terms) + 1)
                ids = b.column("id")
                held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), n, np.bincount(of, minlength=len(n)), place, tf))
                rows, counts = rows + b.num_rows, counts + len(place)
                if rows + TEXTS > DOCUMENTS or counts >= COUNTS:
                    yield close()
                    held, rows, counts = [], 0, 0
        if held:
            yield close()

    return run


def _frequencies(size: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for places in b.column("places").to_pylist():
                total += np.bincount(np.frombuffer(places, "<u4"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "df"])

    return run


class Weights:
    """The items of a block as tiles of dense weights.

    of: item of each pair (ascending); place: its term; value: weight times how often the item has the term.  tiles: by tile of items, a list of (terms, weights: terms x items),
    so that no item's weights in one of them, each times LARGEST, add up to EXACT.
    """

    def __init__(self, items: int, of: np.ndarray, place: np.ndarray, value: np.ndarray):
        self.items, self.tiles = items, []
        most = (EXACT - 1) // LARGEST
        for first in range(0, items, ITEMS):
            a, b = np.searchsorted(of, [first, first + ITEMS])
            # a weight that would pass the bound by itself is dealt to several tiles
            pairs = [(p, i, v) for p, i, v in zip(place[a:b].tolist(), (of[a:b] - first).tolist(), value[a:b].tolist()) if v]
            tiles: list[tuple[list[int], np.ndarray]] = []
            column: dict[int, int] = {}
            rows: list[np.ndarray] = []
            total = [0] * ITEMS
            width = min(ITEMS, items - first)

            def close() -> None:
                if rows:
                    tiles.append((np.fromiter(column, np.int64, len(column)), np.array(rows)))  # noqa: B023
                column.clear()  # noqa: B023
                rows.clear()  # noqa: B023
                total[:] = [0] * ITEMS  # noqa: B023

            for p, i, v in sorted(pairs):
                while v:
                    if total[i] >= most or (p not in column and len(column) >= TERMS):
                        close()
                    take = min(v, most - total[i])
                    if p not in column:
                        column[p] = len(rows)
                        rows.append(np.zeros(width))
                    rows[column[p]][i] += take
                    total[i] += take
                    v -= take
            close()
            self.tiles.append((first, width, tiles))

    def scores(self, documents: int, vocabulary: int, of: np.ndarray, place: np.ndarray, impact: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first item, scores: documents x items, int64) of each tile of items, for the impacts of a tile of documents."""
        column = np.full(vocabulary, -1, np.int64)
        for first, width, tiles in self.tiles:
            total = np.zeros((documents, width), np.int64)
            for terms, weights in tiles:
                column[terms] = np.arange(len(terms))
                at = column[place]
                mine = np.flatnonzero(at >= 0)
                dense = np.zeros((documents, len(terms)))
                dense[of[mine], at[mine]] = impact[mine]
                total += (dense @ weights).astype(np.int64)
                column[terms] = -1
            yield first, total


class Best:
    """Each item's k best (score, null, id) so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.held: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64))] * items

    def add(self, first: int, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """scores: of documents (null, ids) for the items from ``first`` on."""
        n, width = scores.shape
        least = self.least[first : first + width]
        if n > self.k:
            least = np.maximum(least, np.partition(scores, n - self.k, axis=0)[n - self.k])
        item, doc = np.nonzero((scores >= least).T)
        edge = np.searchsorted(item, np.arange(width + 1))
        for j in np.flatnonzero(np.diff(edge)).tolist():
            d = doc[edge[j] : edge[j + 1]]
            score, no, i = (np.r_[old, new] for old, new in zip(self.held[first + j], (scores[d, j], null[d], ids[d])))
            order = np.lexsort((i, no, -score))[: self.k]
            self.held[first + j] = score[order], no[order], i[order]
            if len(order) == self.k:
                self.least[first + j] = score[order[-1]]


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNIT * tf // (TF * tf + LENGTH * m)


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of n terms, by the mean length."""
    return 100 - B + B * n * documents // max(1, terms)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _search(shared, documents: int, terms: int, k: int):
    names = ["item", "lane", "doc_id", "score"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, vocabulary, of, place, value = shared.value
        weights, best, lane = Weights(items, of, place, value), Best(items, k), 0
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                lane = row["part"] % LANES
                get = lambda name, kind: np.frombuffer(row[name], kind)  # noqa: B023, E731
                ids, null, size, offsets = get("ids", "<i8"), get("nulls", np.uint8), get("sizes", "<u4").astype(np.int64), get("offsets", "<u4").astype(np.int64)
                doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
                impact = impacts(get("counts", "<u4").astype(np.int64), lengths(size, documents, terms)[doc])
                for first, total in weights.scores(len(ids), vocabulary, doc, get("places", "<u4").astype(np.int64), impact):
                    best.add(first, total, null, ids)
        n = [len(s) for s, _, _ in best.held]
        score, null, ids = (np.concatenate([h[c] for h in best.held]) if items else np.zeros(0, np.int64) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(items), n), pa.int32()), pa.array(np.full(len(ids), lane), pa.int32()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], names)

    return run


def _first(found: DataFrame, by: list[str], k: int, rank: str = "rank") -> DataFrame:
    return found.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col(rank) <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("version"), "text").where("text is not null").dropDuplicates(["item_id", "version"])
    pairs = cut(asked.mapInArrow(released(_item_terms), "item_id long, version long, term long, q long"))
    sized = pairs.groupBy("item_id", "version").agg(F.count(F.lit(1)).alias("pairs"))
    if pairs.count() > BLOCK_PAIRS:
        sized = running_sums(sized.withColumn("all", F.lit(1)), ["all"], [F.asc("version"), F.asc("item_id")], {"total": "pairs"}).withColumn("block", F.floor((F.col("total") - F.col("pairs")) / BLOCK_PAIRS))
        pairs = cut(pairs.join(sized.select("item_id", "version", "block"), (pairs["version"] == sized["version"]) & pairs["item_id"].eqNullSafe(sized["item_id"])).select(pairs["*"], "block"))
        blocks = sorted(r.block for r in pairs.select("block").distinct().collect())
    else:
        pairs, blocks = pairs.withColumn("block", F.lit(0)), [0]
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.spark_partition_id().alias("part"))
    out = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for block in blocks:
        mine = pairs.where(F.col("block") == block).toArrow()  # BLOCK_PAIRS and one item's pairs at most
        if not mine.num_rows:
            continue
        item, version = mine.column("item_id").fill_null(0).to_numpy(), mine.column("version").to_numpy()
        missing = mine.column("item_id").is_null().to_numpy()
        term, q = mine.column("term").to_numpy().view(np.uint64), mine.column("q").to_numpy()
        order = np.lexsort((term, version, item, missing))
        item, version, missing, term, q = (x[order] for x in (item, version, missing, term, q))
        of = np.cumsum(np.r_[False, (item[1:] != item[:-1]) | (version[1:] != version[:-1]) | (missing[1:] != missing[:-1])])
        start = np.searchsorted(of, np.arange(of[-1] + 1))
        vocabulary, place = np.unique(term, return_inverse=True)
        tiles = cut(rows.mapInArrow(_tiles(spark.sparkContext.broadcast(vocabulary)), _TILE))
        size = tiles.agg(F.sum("documents").alias("n"), F.sum("terms").alias("l")).first()
        documents, terms = size.n or 0, size.l or 0
        counted = tiles.select("places").mapInArrow(_frequencies(len(vocabulary)), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()  # a number for each term of the block
        df = np.zeros(len(vocabulary), np.int64)
        df[counted.column("place").to_numpy()] = counted.column("df").to_numpy()
        value = np.array([weight(documents, n) for n in df.tolist()], np.int64)[place] * q
        shared = spark.sparkContext.broadcast((int(of[-1]) + 1, len(vocabulary), of, place, value))
        found = tiles.mapInArrow(_search(shared, documents, terms, k), "item int, lane int, doc_id long, score long")
        found = _first(_first(found, ["item", "lane"], k).drop("rank"), ["item"], k)
        names = spark.createDataFrame([(k_, None if no else i) for k_, (i, no) in enumerate(zip(item[start].tolist(), missing[start].tolist()))], "item int, item_id long")
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # an item for each pair of the block at most
    return reduce(DataFrame.unionAll, out)


#: DuckDB SQL for the query's rows.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
REPORT_SQL = rf"""
WITH i AS MATERIALIZED (SELECT row_number() OVER () iid, item_id, regexp_extract_all({_LOWER}, '{_TERMS}') w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS MATERIALIZED (SELECT iid, item_id, term, count(*) q FROM (SELECT iid, item_id, unnest(w) term FROM i) GROUP BY ALL),
d AS MATERIALIZED (SELECT row_number() OVER () rid, doc_id, regexp_extract_all({_LOWER}, '{_TERMS}') w FROM documents),
s AS MATERIALIZED (SELECT count(*) n, CAST(sum(len(w)) AS BIGINT) l FROM d WHERE len(w) > 0),
x AS MATERIALIZED (SELECT rid, term, count(*) tf FROM (SELECT rid, unnest(w) term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
t AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) w FROM x, s GROUP BY term),
m AS (SELECT rid, doc_id, 75 + 25 * len(d.w) * n // l m FROM d, s WHERE len(d.w) > 0),
p AS (SELECT iid, item_id, doc_id, rid, CAST(sum(q * t.w * (1000000000 * tf // (1000 * tf + 12 * m))) AS BIGINT) score FROM q JOIN t USING (term) JOIN x USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) rank, doc_id, score FROM r WHERE rank <= 20
"""
