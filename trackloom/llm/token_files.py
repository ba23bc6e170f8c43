"""Token ids in Re-Pair compressed files, with random access (operator 9).

Documents are dealt out by ranges of (doc_id, text's hash), so that rows without an id are many tasks' too, and sorted; each task encodes its texts and closes a shard every ``SHARD_IDS``
ids.  Re-Pair: in each round the most frequent pairs of neighbouring symbols become rules and are replaced from left to right,
never across the end of a document.  Ids and rules together stay below 65,536, so a symbol takes two bytes.  A round takes at most
half of the rules that are left, so there is room for rules of rules; rounds end when no pair occurs ``LEAST`` times (a rule
of fewer costs more than it saves), no rule is left, or a round saved less than one symbol in ``PAYS``.

File format: a Parquet folder with a row for each shard, written and read by Spark (so it can lie in any store):
``part, shard`` (their order is the order of documents), ``doc_ids`` (int64), ``counts`` (uint32: ids of each document), ``offsets`` (uint32:
its first symbol, and the end), ``rules`` (uint16 pairs; rule k is symbol VOCABULARY + k), ``lengths`` (uint32: ids
a rule expands to) and ``symbols`` (uint16).  ``expand`` decodes one document or any range of its ids by the lengths,
without touching the rest.

Encoding equals the tokenizers library's on the whole text.  Texts are cut at ASCII white space, and words of plain ASCII at the borders of
the pattern's pieces; each unit goes to the library once and is remembered by its hash within a task.  Words with other characters or
apostrophes are units as they are, capitals included, as case and composition may move borders in them (a capital and a mark may have no composed form where the small letter has).  That holds for the normalizer and pattern named
in ``SPLITS``; of a tokenizer with others, whole texts go to the library.

Cases: a null or empty text is the end id alone; rows with equal ids follow each other in an order that depends on their texts;
null ids come first; an empty table gives no shard.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import cut, shared_dir
from .jobs import released, shuffle_width
from .text import BASES, Places, Prefix, ranges, utf8

#: Ids of the vocabulary, and the id that ends a document.
VOCABULARY, END = 49408, 1
#: Ids after which a shard is closed; occurrences that a pair needs; see above.
SHARD_IDS, LEAST, PAYS = 2_000_000, 5, 250
#: Units that a task remembers, and ids of all of them; bytes of texts encoded together.
REMEMBER, POOL, BYTES = 500_000, 4_000_000, 600_000

_FILE = "part long, shard int, doc_ids binary, null_ids binary, counts binary, offsets binary, rules binary, lengths binary, symbols binary"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Fixed values of the tokenizer: what its normalizer and pattern must be for texts to be cut into units.
SPLITS = (["NFC", "Replace", "Lowercase"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")

#: Classes of bytes: white space, letters, digits, other ASCII, and what makes a word a unit.
_SPACE, _LETTER, _DIGIT, _MARK, _WHOLE = range(5)
_CLASS = np.array([_SPACE if c in b" \t\n\x0b\x0c\r" else _WHOLE if c >= 128 or c == 39 else _LETTER if 97 <= c <= 122 else _DIGIT if 48 <= c <= 57 else _MARK for c in range(256)], np.int8)


@lru_cache(maxsize=2)
def _library(path: str | None):
    """The tokenizer, and whether it cuts texts as ``SPLITS`` says."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    told = json.load(open(path or default_path()))
    steps = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", ())]
    split = [x.get("pattern", {}).get("Regex") for x in (told.get("pre_tokenizer") or {}).get("pretokenizers", ())]
    return Tokenizer.from_file(path or default_path()), (steps, split[:1]) == (SPLITS[0], [SPLITS[1]])


class Encoder:
    """Ids (uint16) of texts; what the library gave for each unit is remembered in arrays."""

    def __init__(self, path: str | None):
        self.library, self.splits = _library(path)
        if self.library.get_vocab_size() > VOCABULARY:
            raise ValueError("the vocabulary is larger than the file format's")
        self.prefix = Prefix(BASES[0])
        self._clear()

    def _clear(self) -> None:
        self.places, self.used = Places(REMEMBER), 0
        self.pool, self.first, self.count = np.zeros(1 << 16, np.uint16), np.zeros(REMEMBER, np.int64), np.zeros(REMEMBER, np.int64)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.uint16)

    def _together(self, units: list[bytes], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after the other, and how many each has; many go to the library in one text.  alone: which may be several of the pattern's pieces."""
        ids, counts = [], []
        border = int((~alone).sum())  # these come last
        groups = [(units[i : min(i + 128, b)], i >= border) for a, b in ((0, border), (border, len(units))) for i in range(a, b, 128)]
        texts = [b" ".join(g).decode() for g, _ in groups]
        for (group, several), text, e in zip(groups, texts, self.library.encode_batch(texts, add_special_tokens=False)):
            ids.append(np.array(e.ids, np.uint16))
            if several:  # by the places of the words that tokens begin in
                size = np.fromiter((len(u.decode()) + 1 for u in group), np.int64, len(group))
                begin = np.array([a for a, _ in e.offsets], np.int64)
                counts.append(np.bincount(np.searchsorted(np.cumsum(size), begin, "right"), minlength=len(group)))
            else:
                counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(group)))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, keys: np.ndarray, units: list[bytes], several: np.ndarray) -> None:
        order = np.argsort(several, kind="stable")
        ids, counts = self._together([units[i] for i in order], several[order])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros(len(self.pool), np.uint16)]
        self.pool[self.used : self.used + len(ids)] = ids
        mine = slice(self.places.size, self.places.size + len(keys))
        self.first[mine], self.count[mine] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)
        self.places.learn(keys[order])

    def _units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        blob = b"\n".join(texts) + b"\n"
        x = np.frombuffer(blob.lower(), np.uint8)
        kind = _CLASS[x]
        filled = kind != _SPACE
        before = np.r_[False, filled[:-1]]
        odd = np.flatnonzero(kind == _WHOLE)
        if len(odd):
            word = np.cumsum(filled & ~before)
            whole = np.zeros(int(word[-1]) + 1, bool)
            whole[word[odd]] = True
            kind[whole[word] & filled] = _WHOLE
            x = np.where(kind == _WHOLE, np.frombuffer(blob, np.uint8), x)  # as it stands: the library composes before it lower-cases
        blob = x.tobytes()
        start = np.flatnonzero(filled & (~before | (kind != np.r_[_SPACE, kind[:-1]]) | (kind == _DIGIT)))
        size = np.r_[start[1:], len(x)] - start
        gap = np.r_[0, np.cumsum(~filled)]
        size -= gap[start + size] - gap[start]  # white space follows a unit, and is not of it
        keys = self.prefix(x, start, size)
        at = self.places.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            if self.places.size + len(fresh) > REMEMBER or self.used > POOL:
                self._clear()
                fresh, first = np.unique(keys, return_index=True)
                new = np.arange(len(keys))
            first = new[first]
            for i in range(0, len(fresh), REMEMBER):
                some = first[i : i + REMEMBER]
                self._learn(fresh[i : i + REMEMBER], [blob[a : a + n] for a, n in zip(start[some].tolist(), size[some].tolist())], kind[start[some]] == _WHOLE)
            at[new] = self.places.find(keys[new])
        ends = np.cumsum([len(t) + 1 for t in texts])
        document, count = np.searchsorted(ends, start, "right"), self.count[at]
        ids, unit = ranges(self.first[at], self.first[at] + count)
        counts = np.bincount(document, count, len(texts)).astype(np.int64) + 1
        out = np.full(len(ids) + len(texts), END, np.uint16)
        out[np.arange(len(ids)) + document[unit]] = self.pool[ids]
        return out, counts

    def documents(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of texts some at a time: ids one after the other, the end id after each text, and how many each has."""
        at = 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and (upto == at or held + len(texts[upto]) <= BYTES):
                held += len(texts[upto])
                upto += 1
            some = texts[at:upto]
            special = [not self.splits or b"<|" in t for t in some]  # a special token's name stands for itself wherever it is
            ids, counts = self._units([b"" if own else t for t, own in zip(some, special)])
            if any(special):
                parts = np.split(ids, np.cumsum(counts)[:-1])
                parts = [np.r_[self._whole(t), part] if own else part for t, own, part in zip(some, special, parts)]
                ids, counts = np.concatenate(parts).astype(np.uint16), np.array([len(p) for p in parts], np.int64)
            yield ids, counts
            at = upto


def _replaced(s: np.ndarray, last: np.ndarray, chosen: np.ndarray, key: np.ndarray, first_symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """s and last with the chosen pairs (sorted) as symbols from first_symbol on, from left to right."""
    known = np.zeros(1 << 20, bool)  # most pairs are told apart by a hash
    hashed = lambda k: (k * np.uint32(0x9E3779B1)) >> np.uint32(12)
    known[hashed(chosen)] = True
    here = np.flatnonzero(known[hashed(key)] & ~last[:-1])
    at = np.searchsorted(chosen, key[here])
    at[at == len(chosen)] = 0
    hit = chosen[at] == key[here]
    here, at = here[hit], at[hit]
    run = np.ones(len(here), bool)  # overlapping pairs: every other one, from the left
    run[1:] = np.diff(here) > 1
    begin = np.maximum.accumulate(np.where(run, np.arange(len(here)), 0))
    even = (np.arange(len(here)) - begin) % 2 == 0
    here, at = here[even], at[even]
    s[here] = at.astype(np.uint32) + np.uint32(first_symbol)
    last[here] |= last[here + 1]
    keep = np.ones(len(s), bool)
    keep[here + 1] = False
    return s[keep], last[keep]


def repair(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, offsets of documents in them, rules, lengths) of concatenated documents of so many ids."""
    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)  # a document's last symbol: no pair begins there
    last[np.cumsum(counts) - 1] = True
    rules: list[np.ndarray] = []
    lengths = np.ones(VOCABULARY, np.uint32)
    while len(s) > 1 and len(lengths) < 65_536:
        key = s[:-1] << np.uint32(16) | s[1:]
        sorted_ = np.sort(key[~last[:-1]])
        edge = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1], True]) if len(sorted_) else np.zeros(1, np.int64)
        n = np.diff(edge)
        best = np.flatnonzero(n >= LEAST)
        best = best[np.argsort(-n[best], kind="stable")][: (65_537 - len(lengths)) // 2]  # ties: the smaller pair
        if not len(best):
            break
        chosen = np.sort(sorted_[edge[best]])
        before = len(s)
        s, last = _replaced(s, last, chosen, key, len(lengths))
        new = np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], 1)
        rules.append(new)
        lengths = np.r_[lengths, lengths[new].sum(1, dtype=np.uint32)]
        if (before - len(s)) * PAYS < before:
            break
    offsets = np.r_[0, np.flatnonzero(last) + 1].astype(np.uint32)
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return s.astype("<u2"), offsets, flat.astype("<u2"), lengths[VOCABULARY:]


def _unfold(s: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids of symbols: rules are replaced by their two sides until none is left."""
    table = np.r_[np.zeros((VOCABULARY, 2), np.int32), rules.astype(np.int32).reshape(-1, 2)]
    s = s.astype(np.int32)
    while (is_rule := s >= VOCABULARY).any():
        at = np.cumsum(1 + is_rule) - 1  # where each symbol's last part goes
        out = np.empty(at[-1] + 1, np.int32)
        out[at[~is_rule]] = s[~is_rule]
        out[at[is_rule] - 1], out[at[is_rule]] = table[s[is_rule]].T
        s = out
    return s


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from start to stop that symbols stand for; symbols outside that range are skipped by their lengths."""
    sizes = np.r_[np.ones(VOCABULARY, np.int64), lengths]
    s = symbols.astype(np.int64)
    ends = np.cumsum(sizes[s])
    stop = int(ends[-1]) if stop is None and len(s) else stop or 0
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skipped = int(ends[a - 1]) if a else 0
    s = s[a:b]
    total = int(lengths.sum())
    if total > len(s):
        return _unfold(s, rules)[start - skipped : stop - skipped]
    # a long range: every rule is unfolded once, and its ids are copied to where it stands
    pool = np.r_[np.arange(VOCABULARY, dtype=np.int32), _unfold(np.arange(VOCABULARY, VOCABULARY + len(lengths)), rules)]
    first = np.cumsum(sizes) - sizes
    at, _ = ranges(first[s], first[s] + sizes[s])
    return pool[at][start - skipped : stop - skipped]


def write(docs: DataFrame, path: str, model: str | None = None) -> None:
    """Writes the ids of docs, in ascending doc_id order, as a folder of shards."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, held, part = Encoder(model), 0, 0, 0
        ids, parts, counts = [], [], []

        def close() -> pa.RecordBatch:
            count = np.concatenate(counts)
            symbols, offsets, rules, lengths = repair(np.concatenate(parts), count)
            known = np.array([i or 0 for i in ids], "<i8")
            blobs = (known, np.array([i is None for i in ids], np.uint8), count.astype("<u4"), offsets.astype("<u4"), rules, lengths.astype("<u4"), symbols)
            names = [x.split()[0] for x in _FILE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names)

        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            keys, at = b.column("id").to_pylist(), 0
            for some, count in encoder.documents(utf8(b.column("text"))):
                parts.append(some)
                counts.append(count)
                ids += keys[at : at + len(count)]
                at += len(count)
                held += len(some)
                if held >= SHARD_IDS:
                    yield close()
                    number, held, ids, parts, counts = number + 1, 0, [], [], []
        if ids:
            yield close()

    width = max(shuffle_width(docs), docs.rdd.getNumPartitions())
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").repartitionByRange(width, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, _FILE).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_FILE).parquet(path)


def documents_of(shard: dict) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids of a shard's documents, where the ids of each end, and all ids."""
    ids, null = np.frombuffer(shard["doc_ids"], "<i8"), np.frombuffer(shard["null_ids"], np.uint8)
    symbols, rules, lengths = np.frombuffer(shard["symbols"], "<u2"), np.frombuffer(shard["rules"], "<u2"), np.frombuffer(shard["lengths"], "<u4")
    end = np.cumsum(np.frombuffer(shard["counts"], "<u4").astype(np.int64))
    return [None if n else i for i, n in zip(ids.tolist(), null.tolist())], end, expand(symbols, rules, lengths)


def document(shard: dict, k: int) -> np.ndarray:
    """The ids of the k-th document of a shard, without touching the others."""
    a, b = np.frombuffer(shard["offsets"], "<u4")[k : k + 2].tolist()
    symbols, rules, lengths = np.frombuffer(shard["symbols"], "<u2"), np.frombuffer(shard["rules"], "<u2"), np.frombuffer(shard["lengths"], "<u4")
    return expand(symbols[a:b], rules, lengths)


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (shard,) = b.slice(i, 1).to_pylist()
                ids, end, every = documents_of(shard)
                raw, begin = memoryview(every.astype("<u4").tobytes()), np.r_[0, end[:-1]]
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begin.tolist(), end.tolist())]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard["part"]] * n, pa.int64()), pa.array([shard["shard"]] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(begin), pa.array(end - begin), pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    # a table of a row for each document, as three readers follow
    found = cut(read_shards(spark, path).mapInArrow(run, "part long, shard int, doc_id long, at long, n_tokens long, ids_crc32 long"))
    shards = found.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    # ids before each part (a row for each partition of the write), then before each shard within it
    parts = shards.groupBy("part").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    first = shards.withColumn("within", F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")).join(parts, "part")
    return found.join(first.select("part", "shard", (F.col("before") + F.col("within")).alias("first")), ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Writes docs to a new folder in the shared one and returns what reading its files gives."""
    path = f"{shared_dir(docs.sparkSession)}/{uuid.uuid4().hex}-ids"
    write(docs, path, model)
    return index(docs.sparkSession, path)
