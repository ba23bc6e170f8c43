import random
import unicodedata
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from trackloom.llm import token_files as tf

SCHEMA = "doc_id long, text string, part string"


def texts(seed=2):
    r = random.Random(seed)
    some = ["the", "Tion", "er's", "anst", "ÉAU", "ß", "é", "12", "--", "́x", " ", " y", "\x1c", "ΣΑΣ", "<|endoftext|>", "I'll", "日本", "🙂", "GEZİ.", "EVİ,"]
    return ["".join(r.choice([*some, " ", "\n", "\t ", "  "]) for _ in range(r.randrange(0, 60))) for _ in range(60)]


@pytest.mark.parametrize("size", [tf.SHARD_IDS, 200])
def test_files_give_the_library_ids(spark, monkeypatch, size):
    monkeypatch.setattr(tf, "SHARD_IDS", size)
    monkeypatch.setattr(tf, "LEAST", 2)
    rows = [(i * 3, t, "x") for i, t in enumerate(texts())] + [(500, None, "x"), (501, "", None), (502, "word " * 3000, "x"), (None, "no id", "x"), (6, texts()[2], "x")]
    library = Tokenizer.from_file(tf.default_path())
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t, _ in rows]
    want, start = [], 0
    for d, x in sorted(ids, key=lambda x: (x[0] is not None, x[0])):
        want.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    got = tf.written_and_read(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_expand_ranges():
    r = random.Random(4)
    ids = np.array([r.randrange(6) for _ in range(3000)], np.int64)
    counts = np.array([1, 999, 1500, 500])
    s, offsets, rules, lengths = tf.repair(ids, counts)
    assert len(s) < 0.6 * len(ids) and len(rules) > 10
    end = np.cumsum(counts)
    for k in range(4):
        mine = s[offsets[k] : offsets[k + 1]]
        want = ids[end[k] - counts[k] : end[k]]
        assert (tf.expand(mine, rules, lengths) == want).all()
        shard = {"offsets": offsets.astype("<u4").tobytes(), "symbols": s.tobytes(), "rules": rules.tobytes(), "lengths": lengths.astype("<u4").tobytes()}
        assert (tf.document(shard, k) == want).all()
        for _ in range(30):
            a, b = sorted(r.randrange(counts[k] + 1) for _ in range(2))
            assert (tf.expand(mine, rules, lengths, a, b) == want[a:b]).all()


def test_empty_table(spark):
    assert tf.written_and_read(spark.createDataFrame([], SCHEMA)).collect() == []


def fuzz(seed=7):
    """Every cased or composed character, next to letters, digits, marks and spaces of several kinds."""
    r = random.Random(seed)
    odd = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (c.lower() != c or c.upper() != c or unicodedata.combining(c) or unicodedata.decomposition(c))]
    around = ["a", "Z", "1", ".", ",", "'", "'s", "'LL", " ", "\u0301", "\u0307", "\u00a0", "\u0085", "\u3000", "\x1c", "\0", "İ", "Σ", "ﬁ", "가", "ᄀ", "ᅡ", "-", "<", "|", "\n"]
    texts = []
    for i in range(0, len(odd), 6):
        texts.append("".join(c + "".join(r.choice(around) for _ in range(r.randrange(3))) for c in odd[i : i + 6]))
    return texts + ["".join(r.choice(around) for _ in range(r.randrange(1, 12))) for _ in range(3000)]


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(tf, "BYTES", 3000)
    monkeypatch.setattr(tf, "REMEMBER", 2500)
    encoder, texts = tf.Encoder(None), fuzz()
    assert encoder.splits
    ids, counts = (np.concatenate(x) for x in zip(*encoder.documents([t.encode() for t in texts])))
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == [*encoder.library.encode(text, add_special_tokens=False).ids, tf.END], text


def test_letters_beside_marks_equal_the_library(monkeypatch):
    """A capital may have no composed form where its small letter has one: T, H, J, W, Y with some marks."""
    encoder = tf.Encoder(None)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    marks = [c for c in map(chr, range(0x300, 0x1E000)) if unicodedata.combining(c)]
    texts = ["T\u0308", "J\u030c x", "H\u0331amza", "W\u030a", "Y\u030a"] + ["".join(a + m + " x"[i % 2] for i, a in enumerate(letters)) for m in marks]
    ids, counts = (np.concatenate(x) for x in zip(*encoder.documents([t.encode() for t in texts])))
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == [*encoder.library.encode(text, add_special_tokens=False).ids, tf.END], text


def test_rows_without_an_id_are_many_tasks(spark):
    rows = [(None, f"text {i}", "x") for i in range(300)]
    path = f"{tf.shared_dir(spark)}/{tf.uuid.uuid4().hex}"
    tf.write(spark.createDataFrame(rows, SCHEMA).repartition(4), path)
    assert tf.read_shards(spark, path).select("part").distinct().count() > 1


def test_other_tokenizers_get_whole_texts():
    encoder = tf.Encoder(None)
    encoder.splits = False
    ids, counts = zip(*encoder.documents([b"Some words, here", b""]))
    assert np.concatenate(ids).tolist() == [*encoder.library.encode("Some words, here", add_special_tokens=False).ids, tf.END, tf.END]


def test_copies_shrink_to_deep_rules():
    r = random.Random(5)
    one = np.array([*(r.randrange(40_000) for _ in range(400)), 1])
    s, offsets, rules, lengths = tf.repair(np.tile(one, 300), np.full(300, len(one)))
    assert lengths.max() > 100 and len(s) < 300 * 4
    assert (tf.expand(s, rules, lengths) == np.tile(one, 300)).all()
