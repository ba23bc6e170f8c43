"""Removal of word windows that occur more than once in a corpus (operator 8).

Every window of ``n`` words gets a Rabin-Karp hash inside the task that reads its document; the hashes
are dealt out by value, counted, and the places of repeated ones go back to their documents, where
overlapping windows merge into maximal intervals.

A hash travels as 8 bytes in a block for one (batch of documents, bucket of hash values), with its place
as a compressed difference to the one before, not as a row of its own; a batch sends a hash once
however often it holds it, so a passage that a third of all documents share costs one entry a batch.
The bucket is taken from a second, independent hash: windows count as equal if 64 bits and the bucket agree.

Cases: null and empty texts have no words; texts under ``n`` words have no window; rows that repeat, or share
a doc_id, are separate documents, so a repeated row of ``n`` words or more loses all of them; a null doc_id
is an id like any other.  Other columns of the input pass through ``remove_repeats`` as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import released, row_key, shuffle_width
from .text import BASES, Rolling, WordHashes, space_words, starts_in_documents, utf8

#: Words in a window of the contract.
WINDOW = 35
#: Words after which a task closes a batch.
BATCH_WORDS = 1_000_000
#: Documents handled together in a task.
ROWS = 500

_BLOCKS = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.string()), ("at", pa.binary()), ("data", pa.binary())])


def _pack(places: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), "<u4"), dtype=np.int64)


def _blocks(n: int, buckets: int):
    def close(batch: int, keys: list, counts: list, hashes: list, rolls: tuple[Rolling, Rolling]) -> pa.RecordBatch:
        x, count = np.concatenate(hashes), np.array(counts, np.int64)
        at = starts_in_documents(count, n)
        h, bucket = rolls[0](x)[at], ((rolls[1](x)[at] >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)  # a hash that this batch already sent
        again[order[1:][same]] = True
        known = again.copy()
        known[order[:-1][same]] = True
        rows = [(batch % buckets, batch, "documents", np.array(keys, np.int64).tobytes(), count.tobytes()), (batch % buckets, batch, "places", _pack(at[known]), b"")]
        once = np.flatnonzero(~again)
        once = once[np.argsort(bucket[once], kind="stable")]
        edges = np.searchsorted(bucket[once], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            mine = once[edges[b] : edges[b + 1]]
            rows.append((int(b), batch, "hashes", _pack(at[mine]), h[mine].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rolls, number, part = WordHashes(), (Rolling(n, BASES[0]), Rolling(n, BASES[1])), 0, 0
        keys, counts, hashes, held = [], [], [], 0
        for whole in batches:
            part = whole.column("part")[0].as_py() if whole.num_rows else part
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x, count = words(utf8(b.column("text")))
                for k1, k2, c, h in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), count.tolist(), np.split(x, np.cumsum(count)[:-1])):
                    if c < n:
                        continue
                    keys.append((k1, k2))
                    counts.append(c)
                    hashes.append(h)
                    held += c
                    if held >= BATCH_WORDS:
                        yield close(part << 24 | number, keys, counts, hashes, rolls)
                        keys, counts, hashes, held, number = [], [], [], 0, number + 1
        if keys:
            yield close(part << 24 | number, keys, counts, hashes, rolls)

    return run


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the places of hashes that several batches hold; what isn't hashes passes."""
    is_hash = group["kind"] == "hashes"
    rest, group = group[~is_hash], group[is_hash]
    out = [rest[["batch", "kind", "at", "data"]]]
    if len(group) > 1:
        each = [np.frombuffer(x, np.uint64) for x in group["data"]]
        h = np.concatenate(each)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        hit = np.zeros(len(h), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        edges = np.cumsum([0, *map(len, each)])
        found = [(batch, "places", _pack(_unpack(at)[hit[a:b]]), b"") for batch, at, a, b in zip(group["batch"], group["at"], edges, edges[1:]) if hit[a:b].any()]
        out.append(pd.DataFrame(found, columns=["batch", "kind", "at", "data"]))
    return pd.concat(out)


def _intervals(n: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        places = [_unpack(x) for x in group.loc[group["kind"] == "places", "at"]]
        at = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
        rows = []
        for keys, counts in group.loc[group["kind"] == "documents", ["at", "data"]].itertuples(index=False):
            key, count = np.frombuffer(keys, np.int64).reshape(-1, 2), np.frombuffer(counts, np.int64)
            first = np.cumsum(count) - count
            doc = np.searchsorted(first, at, "right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] - at[:-1] > n) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            end = np.r_[begin[1:] - 1, len(at) - 1]
            owner = doc[begin]
            spans = np.stack([at[begin] - first[owner], at[end] + n - first[owner]], 1).astype(np.int32) if len(at) else np.zeros((0, 2), np.int32)
            for d in np.unique(owner):
                rows.append((int(key[d, 0]), int(key[d, 1]), spans[slice(*np.searchsorted(owner, [d, d + 1]))].tobytes()))
        return pd.DataFrame(rows, columns=["k1", "k2", "spans"])

    return run


def repeated_spans(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """(k1, k2, spans) of the documents that hold repeated windows; spans: int32 pairs [first word, end) of maximal intervals to remove."""
    read = docs.select(*row_key("doc_id", "text"), "text", F.spark_partition_id().cast("long").alias("part"))
    buckets = max(3 * shuffle_width(docs), 4 * docs.rdd.getNumPartitions())
    blocks = read.mapInArrow(_blocks(n, buckets), "bucket int, batch long, kind string, at binary, data binary")
    found = blocks.groupBy("bucket").applyInPandas(lambda g: _repeated(g), "batch long, kind string, at binary, data binary")
    spans = found.groupBy("batch").applyInPandas(_intervals(n), "k1 long, k2 long, spans binary")
    return spans.dropDuplicates(["k1", "k2"])  # rows equal in doc_id and text have equal spans


def kept_words(text: bytes, spans: bytes | None) -> tuple[int, list[bytes]]:
    """Number of words, and the words outside the spans."""
    words = space_words(text)
    if not spans:
        return len(words), words
    keep, at = [], 0
    for a, b in np.frombuffer(spans, np.int32).reshape(-1, 2).tolist():
        keep += words[at:a]
        at = b
    return len(words), keep + words[at:]


def with_spans(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """Each row of docs as the struct ``row``, with its spans (null: nothing to remove)."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *row_key("doc_id", "text"))
    return keyed.join(repeated_spans(docs, n).hint("shuffle_hash"), ["k1", "k2"], "left").select("row", "spans")


def removal_digest(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (the kept words joined by one space) of every row."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, sha = [], [], []
            for text, spans in zip(utf8(b.column("text")), b.column("spans").to_pylist()):
                count, keep = kept_words(text, spans)
                total.append(count)
                removed.append(count - len(keep))
                sha.append(hashlib.sha256(b" ".join(keep)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_spans(docs, n).select("row.doc_id", "row.text", "spans").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs with repeated windows cut from text (what is kept is joined by one space; n_chars follows); texts without any stay as they are."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else b" ".join(kept_words(t.encode(), s)[1]).decode() for t, s in zip(text, spans)], dtype=object)

    found = with_spans(docs, n).withColumn("kept", cut("row.text", "spans"))
    changed = {"text": F.col("kept"), "n_chars": F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("kept"))} if "n_chars" in docs.columns else {"text": F.col("kept")}
    return found.select(*(changed.get(f.name, F.col("row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema))
