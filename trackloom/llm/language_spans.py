"""The languages of texts, by spans: scripts narrow the candidates of each word, and Viterbi over per-word scores with a switching penalty labels the words (operator 12).

A word is a run of letters (with their marks) of one script.  It is scored for each language by the log-probabilities of its lower-cased n-grams of code
points (orders ``ORDERS``, with borders), hashed into ``BUCKETS`` a order; a language that the learned rows hardly ever write in
the word's script is no candidate and costs ``MISFIT``.  The best path of labels pays ``SWITCH`` for each change of language.  A text's language is that of most
of its letters, and its score their share.

Scores are whole numbers, so the search is exact, also where it is cut: texts are searched in blocks of ``BLOCK`` words, all blocks of a batch side
by side.  A block's search forgets where it began as soon as the languages behind have all been overtaken by a switch; blocks are first searched from a level start and
then again from what the block before them really ended with, until nothing changes.  So a text of any length takes linear work and few array passes.

What is learned: n-gram and script counts of a sample of labelled rows that aren't held out, drawn by a hash of id and text so that about
``PER_LANGUAGE`` rows of each language are expected; counts are made in tasks and added up by Spark, so their size depends on the buckets and languages alone.

Cases: a null text, or one without letters, is ``und`` with score 0; rows without an id or language are never learned from; letters of scripts that no learned
language has count for whatever language is around them; equal paths: staying before switching, then the language of more labelled rows, then by name; without
labelled rows every text is ``und``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import released
from .text import BASES, Prefix, ranges, slices

#: Rows of each language that are expected in the sample.
PER_LANGUAGE = 2000
#: Code points of an n-gram, and hash buckets of each order.
ORDERS, BUCKETS = (2, 3, 4), 1 << 16
#: Added to each count; hundredths of a nat in a score; cost of a change of language and of a word in a script that a language doesn't use, in scores.
SMOOTH, SCALE, SWITCH, MISFIT = 0.5, 100, 1200, 2000
#: Share of a language's letters from which it uses a script.
USES = 0.01
#: Words of a block; letters of texts that are labelled together, and of distinct words that are scored together.
BLOCK, LETTERS, SCORED = 64, 1_500_000, 300_000
#: Rows with crc32(doc_id as text) modulo FOLDS = HELD are held out.
FOLDS, HELD = 4, 2
#: The label of texts without letters.
UNKNOWN = "und"

# Ranges of code points by script, from the Unicode block list.
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F),
    ("Sinhala", 0x0D80, 0x0DFF), ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF), ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF),
    ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Latin", 0xFF21, 0xFF5A), ("Han", 0x20000, 0x323AF),
)
#: Scripts by number; 0 is any other.
NAMES = ["other", *dict.fromkeys(n for n, _, _ in SCRIPTS)]
#: Marks of code points that are no letters.
_MARK, _NONE, _TOP = 254, 255, 0x323B0


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its script's number (or _MARK or _NONE), and its lower case where that is one code point."""
    kind, low = np.full(_TOP + 1, _NONE, np.uint8), np.arange(_TOP + 1, dtype=np.uint32)
    for c in range(_TOP):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = 0
            small = chr(c).lower()
            low[c] = ord(small) if len(small) == 1 else c
        elif k == "M":
            kind[c] = _MARK
    for name, a, b in SCRIPTS:
        part = kind[a : b + 1]
        part[part == 0] = NAMES.index(name)
    return kind, low


class Words:
    """The words of texts: code points of all texts (x, lower case), and of each word its start and size in them, its text and script; at: where each text begins."""

    def __init__(self, texts: list[str]):
        kind, low = _tables()
        x = np.minimum(np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32), _TOP)
        self.x, kind = low[x], kind[x]
        self.at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        letter = kind < _MARK
        # a mark takes the script of the letter before it, if there is no other sign between them
        last = np.maximum.accumulate(np.where(kind == _MARK, -1, np.arange(len(x)))) if len(x) else np.zeros(0, np.int64)
        script = np.where(last >= 0, kind[np.maximum(last, 0)], _NONE)
        inside = script < _MARK
        first = inside & np.r_[True, script[1:] != script[:-1]] if len(x) else inside
        start, size = slices(inside)
        self.start = np.flatnonzero(first)
        ends = np.searchsorted(start, self.start, "right") - 1
        self.size = np.minimum(np.r_[self.start[1:], len(x)], (start + size)[ends]) - self.start if len(self.start) else np.zeros(0, np.int64)
        self.text = np.searchsorted(self.at, self.start, "right") - 1
        self.script = script[self.start]
        self.letters = np.add.reduceat(np.r_[letter, False].astype(np.int64), np.c_[self.start, self.start + self.size].ravel())[::2] if len(self.start) else np.zeros(0, np.int64)


def grams(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of these words, by word within an order; orders have buckets of their own."""
    at, of = ranges(start, start + size)
    padded = np.zeros(len(at) + len(start) + 1, np.uint64)  # a border, a word, a border, a word, ..., a border
    padded[np.arange(len(at)) + of + 1] = x[at].astype(np.uint64) + np.uint64(2)
    padded[padded == 0] = 1
    border = np.r_[0, np.cumsum(size + 1)]
    out = []
    for k, n in enumerate(ORDERS):
        a, word = ranges(border[:-1], np.maximum(border[1:] - n + 2, border[:-1]))
        h = padded[a]
        for i in range(1, n):
            h = h * np.uint64(BASES[0]) + padded[a + i]
        out.append((((h * np.uint64(BASES[1])) >> np.uint64(48)).astype(np.int64) % BUCKETS + k * BUCKETS, word))
    return tuple(np.concatenate(c) for c in zip(*out))


class Model:
    """languages, most rows first; score: bucket x language; uses: script x language."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray):
        """counts: bucket x language; letters: script x language."""
        self.languages, width = languages, len(languages)
        p = counts.reshape(len(ORDERS), BUCKETS, width) + SMOOTH
        p = np.log(p / p.sum(1, keepdims=True)) / len(ORDERS)
        self.score = np.round(SCALE * p.reshape(len(ORDERS) * BUCKETS, width)).astype(np.int32)
        self.uses = letters >= USES * np.maximum(letters.sum(0), 1)

    def words(self, words: Words) -> np.ndarray:
        """word x language: the scores of words."""
        h = Prefix(BASES[0])(words.x, words.start, words.size)
        _, one, back = np.unique(h, return_index=True, return_inverse=True)
        parts = []
        edge = np.searchsorted(np.cumsum(words.size[one]), np.arange(0, words.size[one].sum() + SCORED, SCORED))
        for a, b in zip(edge, [*edge[1:], len(one)]):
            if b > a:
                mine = one[a:b]
                bucket, word = grams(words.x, words.start[mine], words.size[mine])
                parts.append(np.stack([np.bincount(word, self.score[bucket, k], b - a) for k in range(len(self.languages))], 1))
        score = np.concatenate(parts).astype(np.int64)[back] if parts else np.zeros((0, len(self.languages)), np.int64)
        fits = self.uses[words.script]
        known = fits.any(1)
        score[known] -= MISFIT * ~fits[known]
        score[~known] = 0
        return score

    def label(self, words: Words) -> np.ndarray:
        """The language of each word on the best path of its text."""
        return viterbi(self.words(words), np.bincount(words.text, minlength=len(words.at) - 1), SWITCH)


def viterbi(score: np.ndarray, count: np.ndarray, switch: int, block: int = BLOCK) -> np.ndarray:
    """Labels of the best paths through score (item x label, whole numbers) of sequences of so many items, paying switch for each change of label.

    Ties: staying, then the smaller label.  Exact: see the module's text.
    """
    count = count[count > 0]
    if not len(count):
        return np.zeros(0, np.int64)
    width, pieces = score.shape[1], -(-count // block)
    total = int(pieces.sum())
    first = np.cumsum(pieces) - pieces
    item, of = ranges(np.zeros(len(count), np.int64), count)
    slot = (first[of] + item // block) * block + item % block
    full = np.zeros((total * block, width), np.int64)
    full[slot] = score
    full = full.reshape(total, block, width)
    there = np.zeros(total * block, bool)
    there[slot] = True
    there = there.reshape(total, block)
    inner = np.ones(total, bool)  # blocks that another one comes before
    inner[first] = False
    change, best = np.zeros((total, block, width), bool), np.zeros((total, block), np.int64)
    begun, end = np.zeros((total, width), np.int64), np.zeros((total, width), np.int64)
    todo = np.arange(total)
    while len(todo):
        v, mine = begun[todo], full[todo]
        for t in range(block):
            most = v.argmax(1)
            jump = v[np.arange(len(todo)), most][:, None] - switch
            less = v < jump
            change[todo, t], best[todo, t] = less, most
            v = np.where(less, jump, v) + mine[:, t]
        end[todo] = v - v.max(1, keepdims=True)
        after = todo[todo + 1 < total] + 1
        after = after[inner[after]]
        todo = after[(begun[after] != end[after - 1]).any(1)]
        begun[todo] = end[todo - 1]
    change &= there[:, :, None]
    # where each end of a block comes from: the label at the end of the block before
    back = np.tile(np.arange(width), (total, 1))
    rows = np.arange(total)
    for t in range(block - 1, -1, -1):
        back = np.where(change[rows[:, None], t, back], best[:, t][:, None], back)
    last = np.zeros(total, np.int64)
    at = first + pieces - 1
    last[at] = end[at].argmax(1)
    more = np.flatnonzero(pieces > 1)
    while len(more):
        b = at[more]
        last[b - 1] = back[b, last[b]]
        at[more] -= 1
        more = more[at[more] > first[more]]
    label, now = np.zeros((total, block), np.int64), last
    for t in range(block - 1, -1, -1):
        label[:, t] = now
        now = np.where(change[rows, t, now], best[:, t], now)
    return label.reshape(-1)[slot]


@released
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n) of a task's rows: kind 0, rows; 1, letters of each script; 2, n-grams of each bucket."""
    found: dict[str, list] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            words = Words([text or ""])
            if lang not in found:
                found[lang] = [0, np.zeros(len(NAMES), np.int64), np.zeros(len(ORDERS) * BUCKETS, np.int64)]
            mine = found[lang]
            mine[0] += 1
            mine[1] += np.bincount(words.script, words.letters, len(NAMES)).astype(np.int64)
            for a in range(0, len(words.start), 50_000):
                mine[2] += np.bincount(grams(words.x, words.start[a : a + 50_000], words.size[a : a + 50_000])[0], minlength=len(mine[2]))
    for lang, (rows, letters, n) in found.items():
        for kind, x in enumerate((np.array([rows]), letters, n)):
            some = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(np.full(len(some), kind, np.int32)), pa.array(some.astype(np.int32)), pa.array(x[some])], ["lang", "kind", "key", "n"])


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model of a sample of the rows of docs that have an id and a language and aren't held out."""
    usable = docs.where(F.col("lang").isNotNull() & ~held_out())
    rows = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    languages = sorted(rows, key=lambda x: (-rows[x], x))
    if not languages:
        return Model([], np.zeros((len(ORDERS) * BUCKETS, 0)), np.zeros((len(NAMES), 0)))
    share = usable.sparkSession.createDataFrame([(x, min(1 << 30, per_language * (1 << 30) // n)) for x, n in rows.items()], "lang string, share long")
    drawn = usable.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("draw")).join(F.broadcast(share), "lang").where("draw < share")
    found = drawn.select("lang", "text").mapInArrow(_counts, "lang string, kind int, key int, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array([languages.index(x) for x in found.column("lang").to_pylist()], np.int64)
    kind, key, n = (found.column(c).to_numpy() for c in ("kind", "key", "n"))
    letters, counts = np.zeros((len(NAMES), len(languages))), np.zeros((len(ORDERS) * BUCKETS, len(languages)))
    letters[key[kind == 1], lang[kind == 1]], counts[key[kind == 2], lang[kind == 2]] = n[kind == 1], n[kind == 2]
    return Model(languages, counts, letters)


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """Each row of docs as the struct ``row``, with lang_pred, score and spans: (first code point, one after the last, language) of each stretch of words of a language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["row", "lang_pred", "score", "spans"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            texts = whole.column("row").field("text").to_pylist()
            at = 0
            while at < len(texts):
                upto, held = at, 0
                while upto < len(texts) and (upto == at or held + len(texts[upto] or "") <= LETTERS):
                    held += len(texts[upto] or "")
                    upto += 1
                b = whole.slice(at, upto - at)
                yield pa.RecordBatch.from_arrays([b.column("row"), *_told(m, Words([t or "" for t in texts[at:upto]]))], names)
                at = upto

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def _told(m: Model, words: Words) -> list[pa.Array]:
    texts, width = len(words.at) - 1, len(m.languages)
    if not width:
        words.start, words.size, words.text, words.letters, width = words.start[:0], words.size[:0], words.text[:0], words.letters[:0], 1
        label = words.text
    else:
        label = m.label(words)
    weight = np.bincount(words.text * width + label, words.letters, texts * width).reshape(texts, width)
    total, most = weight.sum(1), weight.argmax(1)
    names = np.array([*m.languages, UNKNOWN], object)
    score = np.where(total > 0, weight[np.arange(texts), most] / np.maximum(total, 1), 0.0)
    pred = names[np.where(total > 0, most, len(m.languages))]
    new = np.flatnonzero(np.r_[True, (words.text[1:] != words.text[:-1]) | (label[1:] != label[:-1])]) if len(label) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(label)] - 1 if len(new) else new
    base = words.at[words.text[new]]
    spans = pa.StructArray.from_arrays([pa.array((words.start[new] - base).astype(np.int32)), pa.array((words.start[last] + words.size[last] - base).astype(np.int32)), pa.array(names[label[new]].tolist(), pa.string())], ["start", "end", "lang"])
    offsets = np.searchsorted(words.text[new], np.arange(texts + 1)).astype(np.int32)
    return [pa.array(pred.tolist(), pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), spans)]


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and how many spans, of every row."""
    marked = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    found = labelled(marked, fit(docs.select("doc_id", "lang", "text")))
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
