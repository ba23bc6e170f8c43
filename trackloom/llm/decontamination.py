"""Benchmark passages in documents, by a prefix-filtered set join (operator 1).

Each benchmark item is cut into windows of ``WINDOW`` words (a shorter item is one window).  A window is the
set of its word shingles of ``SHINGLE`` words; an occurrence contains all of them, so any one is a
necessary prefix, and the rarest one makes the fewest candidates.  Two passes over the documents:

1. count how many times each benchmark shingle occurs in all documents (task-side counts, summed by Spark);
2. find each window's rarest shingle, at its known offset, and check every candidate: the length bound (the words before
   and after it must be there), then the exact words of the item-sized window.

The benchmark is the side that is broadcast, in blocks of at most ``BLOCK_BYTES`` of text and ids (and one item more): items of equal text are one with all their ids,
and running sums of bytes deal them to blocks.  A benchmark of several blocks takes as many narrow steps over the documents.  What is broadcast holds windows as places in the block's words,
about eight times its text.  Documents are never shuffled.

Cases: null has no words; an item without words occurs nowhere; equal items each count; repeated document
rows are separate; item_id null is not named among the items but its windows hit; ids are compared as strings.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_sums
from ..plans.storage import cut
from .jobs import released
from .text import BASES, Rolling, WordHashes, alnum_words, starts_in_documents, utf8

#: Words in a window, and in a shingle that is looked up.
WINDOW, SHINGLE = 13, 5
#: A document is contaminated from 1 hit word in so many.
SHARE = 20
#: Most bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 8_000_000
#: Documents handled together in a task.
ROWS = 300


class Index:
    """A block of items: their words as one text with the place of each, and their windows as (first word, words).

    Windows of equal words stand for themselves, each with its item.
    """

    def __init__(self, items: list[tuple[list, str | None]], window: int, shingle: int):
        """items: ids and text of each."""
        words = [alnum_words((text or "").encode()) for _, text in items]
        count = np.array([len(w) for w in words], np.int64)
        self.ids, self.shingle, self.of_word = [i for i, _ in items], shingle, np.cumsum(count)
        self.text = b" ".join([w for ws in words for w in ws])
        self.place = np.cumsum([0, *(len(w) + 1 for ws in words for w in ws)])  # of each word in text; the end of word i is place[i + 1] - 1
        short = np.flatnonzero((count > 0) & (count < window))
        self.first = np.r_[starts_in_documents(count, window), (np.cumsum(count) - count)[short]]
        self.size = np.r_[np.full(len(self.first) - len(short), window), count[short]]
        self.hashes = _shingles(WordHashes(alnum=True)([b" ".join(w) for w in words]), shingle)

    def wanted(self) -> dict[int, np.ndarray]:
        """By shingle length, the sorted distinct hashes of the shingles of all windows."""
        out = {}
        for k in range(1, self.shingle + 1):
            mine = np.flatnonzero(np.minimum(self.size, self.shingle) == k)
            if len(mine):
                n = self.size[mine] - k + 1
                at = np.repeat(self.first[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out[k] = np.unique(self.hashes[k][at])
        return out

    def prefixes(self, seen: dict[int, np.ndarray], wanted: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, ...]]:
        """By shingle length: hashes of the windows' rarest shingles (ties: first in the window), sorted, with offset in the window and window of each."""
        out = {}
        for k, hashes in wanted.items():
            mine = np.flatnonzero(np.minimum(self.size, self.shingle) == k)
            at = np.minimum(np.searchsorted(hashes, self.hashes[k]), len(hashes) - 1)
            often = np.append(seen[k][at], 0)
            best, offset = often[self.first[mine]], np.zeros(len(mine), np.int64)
            for i in range(1, int(self.size[mine].max()) - k + 1):
                inside = i <= self.size[mine] - k
                x = often[np.where(inside, self.first[mine] + i, -1)]
                less = inside & (x < best)
                best, offset = np.where(less, x, best), np.where(less, i, offset)
            h = self.hashes[k][self.first[mine] + offset]
            order = np.argsort(h, kind="stable")
            out[k] = h[order], offset[order].astype(np.int32), mine[order].astype(np.int32)
        return out

    def words(self, window: int) -> bytes:
        a = self.first[window]
        return self.text[self.place[a] : self.place[a + self.size[window]] - 1]


def _shingles(hashed: tuple[np.ndarray, np.ndarray], shingle: int) -> dict[int, np.ndarray]:
    """By length, the hash of the shingle that starts at each word (0 where the text ends before)."""
    x, count = hashed
    out = {}
    for k in range(1, shingle + 1):
        out[k] = np.zeros(len(x), np.uint64)
        at = starts_in_documents(count, k)
        out[k][at] = Rolling(k, BASES[1])(x)[at]
    return out


def _found(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(wanted, x)
    at[at == len(wanted)] = 0
    return wanted[at] == x


def _hashed(batches: Iterator[pa.RecordBatch], column: str | None):
    """Slices of rows with their texts, word hashes and word counts."""
    words = WordHashes(alnum=True)
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            texts = utf8(b.column("text") if column is None else b.column(column).field("text"))
            yield b, texts, *words(texts)


def _count(shared, shingle: int):
    kinds = pa.schema([("k", pa.int32()), ("at", pa.int32()), ("seen", pa.int64())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, rolls = shared.value, {k: Rolling(k, BASES[1]) for k in range(1, shingle + 1)}
        total = {k: np.zeros(len(w), np.int64) for k, w in wanted.items()}
        for _, _, x, count in _hashed(batches, None):
            for k, w in wanted.items():
                h = rolls[k](x)[starts_in_documents(count, k)]
                total[k] += np.bincount(np.searchsorted(w, h[_found(h, w)]), minlength=len(w))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some])], schema=kinds)

    return run


def _match(index, prefixes):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = index.value
        rolls = {k: Rolling(k, BASES[1]) for k in range(1, it.shingle + 1)}
        for b, texts, x, count in _hashed(batches, "row"):
            first = np.cumsum(count) - count
            hits: dict[int, list] = defaultdict(list)
            words: dict[int, list[bytes]] = {}
            for k, (wanted, offsets, windows) in prefixes.value.items():
                at = starts_in_documents(count, k)
                h = rolls[k](x)[at]
                ok = np.flatnonzero(_found(h, wanted))
                docs = np.searchsorted(first + count, at[ok], "right")
                low, high = np.searchsorted(wanted, h[ok]), np.searchsorted(wanted, h[ok], "right")
                for d, p, i, j in zip(docs.tolist(), (at[ok] - first[docs]).tolist(), low.tolist(), high.tolist()):
                    if d not in words:
                        words[d] = alnum_words(texts[d])
                    for offset, w in zip(offsets[i:j].tolist(), windows[i:j].tolist()):
                        a, n = p - offset, int(it.size[w])
                        if a >= 0 and a + n <= count[d] and b" ".join(words[d][a : a + n]) == it.words(w):
                            hits[d].append((a, a + n, w))
            spans, names = b.column("spans").to_pylist(), b.column("items").to_pylist()
            for d, found in hits.items():
                spans[d] = (spans[d] or b"") + np.array([y[:2] for y in found], np.int32).tobytes()
                items = np.unique(np.searchsorted(it.of_word, it.first[[y[2] for y in found]], "right"))
                names[d] = sorted({*(names[d] or ()), *(str(i) for k in items for i in it.ids[k])})
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(count, pa.int64()), pa.array(spans, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Each row of docs as the struct ``row``, with n_words, spans (int32 pairs [first word, end) of window occurrences; null: none) and items (sorted ids as strings)."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").groupBy("text").agg(F.collect_set("item_id").alias("ids"))  # ids of equal items are named together in any result, too
    items = items.withColumn("bytes", (F.octet_length("text") + 24 * F.size("ids")).cast("long"))
    blocks = 1
    if (items.agg(F.sum("bytes")).first()[0] or 0) > BLOCK_BYTES:
        items = running_sums(items.withColumn("all", F.lit(1)), ["all"], [F.xxhash64("text"), F.col("text")], {"total": "bytes"})
        items = cut(items.select("text", "ids", F.floor((F.col("total") - F.col("bytes")) / BLOCK_BYTES).alias("block")))
        blocks = items.agg(F.max("block")).first()[0] + 1
    out = docs.select(F.struct(*docs.columns).alias("row"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    schema = out.schema
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.col("block") == block)
        index = Index([(r.ids, r.text) for r in part.select("ids", "text").toLocalIterator()], window, shingle)
        wanted = index.wanted()
        counted = docs.select("text").mapInArrow(_count(spark.sparkContext.broadcast(wanted), shingle), "k int, at int, seen long").groupBy("k", "at").agg(F.sum("seen").alias("seen"))
        seen = {k: np.zeros(len(w), np.int64) for k, w in wanted.items()}
        found = counted.toArrow()  # a number for each shingle of the block
        for k, n in seen.items():
            mine = found.column("k").to_numpy() == k
            n[found.column("at").to_numpy()[mine]] = found.column("seen").to_numpy()[mine]
        prefixes = index.prefixes(seen, wanted)
        index.hashes = {}  # not needed in the tasks
        out = out.mapInArrow(_match(spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(prefixes)), schema)
    return out


def _covered(spans: bytes | None) -> int:
    if not spans:
        return 0
    total = end = 0
    for a, b in sorted(np.frombuffer(spans or b"", np.int32).reshape(-1, 2).tolist()):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


@released
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = b.column("n_words").to_pylist()
        hit = [_covered(s) for s in b.column("spans").to_pylist()]
        items = [x or [] for x in b.column("items").to_pylist()]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        bad = [n > 0 and SHARE * n >= w for n, w in zip(hit, words)]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_())], ["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of docs as the struct ``row``, with n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = find_items(docs.select(*dict.fromkeys([*keep, "text"])), benchmark, window, shingle)
    kind = found.select(F.struct(*(F.col("row")[c].alias(c) for c in keep)).alias("row"), "n_words", "spans", "items")
    row = kind.schema["row"].dataType.simpleString()
    return kind.mapInArrow(_digest, f"row {row}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the figures of each row."""
    return contamination(docs, benchmark, ["doc_id"]).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    return contamination(docs, benchmark, docs.columns).where("not contaminated").select("row.*")
