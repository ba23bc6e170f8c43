import itertools
import random
import zlib

import numpy as np
import pytest
import sentencepiece

from trackloom.llm import nbest, token_count
from trackloom.llm.pieces import SPACE, chunks, decode, default_path, load

TEXTS = ["", " ", "Hello world", "the theater is here", "  two  spaces ", "naïve café", "a\nb\tc", "日本語 text", "x" * 90, "▁mark", "Ünïcödé 🙂 ok", "zzzqqq", "in the of and to a"]


def read_varint(b, i):
    n = shift = 0
    while True:
        n |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return n, i


def unigram_library():
    """The same pieces and scores in the library as a unigram model: the model type is changed, runs of spaces marked unused, and a single space scored as in Pieces."""
    import struct

    raw, out, i = open(default_path(), "rb").read(), b"", 0
    while i < len(raw):
        tag, j = read_varint(raw, i)
        size, j = read_varint(raw, j)
        body = raw[j : j + size]
        i = j + size
        if tag == 10:
            n, k = read_varint(body, 1)
            score = struct.unpack("<f", body[k + n + 1 : k + n + 5])[0]
            if score < -1e6:
                single = body[k : k + n].decode() == SPACE
                body = body[: k + n + 1] + struct.pack("<f", load(None).normal[SPACE][0]) + (b"" if single else b"\x18\x05")
        elif tag == 18:
            at = body.index(b"\x18\x02 ")
            body = body[:at] + b"\x18\x01" + body[at + 2 :]
        head = bytes([tag]) + bytes([len(body) & 127 | 128, len(body) >> 7 & 127 | (128 if len(body) >> 14 else 0)][: 2 if len(body) > 127 else 0]) if len(body) > 127 else bytes([tag, len(body)])
        out += head + body
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def words(n, seed=1):
    r = random.Random(seed)
    some = ["the", "tion", "er", "anst", "éau", "ß", "schaft", "1", "-", "ing", ".", "Q", "\n"]
    return ["".join(r.choice(some) for _ in range(r.randrange(1, 5))) for _ in range(n)]


def test_best_and_counts_equal_the_library():
    library, encoder, counts = unigram_library(), nbest.Encoder(None, 3), token_count.Counts(None)
    for text in [*TEXTS, *(" ".join(words(6, s)) for s in range(60))]:
        if SPACE in text:
            continue
        ids = library.encode(text)
        assert encoder.encode(text)[0][1] == ids, text
        assert sum(counts[c] for c in chunks(text)) == len(ids), text
        assert decode(ids, encoder.pieces) == text


def every(chunk, pieces):
    if not chunk:
        return [(0.0, (), ())]
    out = []

    def back(at, score, starts, ids):
        if at == 0:
            out.append((-score, starts, ids))
        for a, s, piece in nbest.into(chunk, at, pieces) if at else ():
            back(a, score + s, (*starts, a), piece + ids)

    back(len(chunk), 0.0, (), ())
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_nbest_equals_brute_force(n):
    encoder = nbest.Encoder(None, n)
    for text in ["", "the", "of an er", "tio", "aa b", "é\n", *(" ".join(words(3, s))[:11] for s in range(25))]:
        parts = [every(c, encoder.pieces)[: n + 1] for c in chunks(text)]
        want = []
        for some in itertools.product(*(range(len(p)) for p in parts)):
            want.append((sum(p[k][0] for p, k in zip(parts, some)), some[::-1], [i for p, k in zip(parts, some) for i in p[k][2]]))
        assert [(-s, ids) for s, ids in encoder.encode(text)] == [(s, ids) for s, _, ids in sorted(want)[:n]], text


def test_queries_over_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])] + [(None, "again", None), (2, TEXTS[2], "x"), (99, " ".join(words(20000)), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = {r.doc_id: r for r in nbest.digest(df).collect()}
    count = {r.doc_id: r.n_tokens for r in token_count.counted(df).collect()}
    assert all(r.decoded and r.n_tokens == count[d] for d, r in got.items())
    encoder = nbest.Encoder(None, nbest.N)
    for d, t, _ in rows:
        best = encoder.encode(t or "")
        assert got[d].nbest_scores == [s for s, _ in best] == sorted(got[d].nbest_scores, reverse=True)
        assert got[d].nbest_crc32 == [zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids in best]
    best = nbest.encoded(df).selectExpr("row.doc_id", "nbest[0].ids ids", "row.text text")
    for r in nbest.decoded(best).collect():
        assert r.text == (r.row.text or "").replace(SPACE, " ")
    assert nbest.digest(df.where("false")).collect() == [] == token_count.counted(df.where("false")).collect()


def test_long_text_without_spaces_takes_linear_time_and_memory():
    import time
    import tracemalloc

    r = random.Random(9)
    encoder = nbest.Encoder(None, nbest.N)
    some = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABC0123456789+/日本語=") for _ in range(60_000))
    took, most = [], []
    for text in (some[:6_000], some, "a" * 30_000):
        began = time.process_time()
        tracemalloc.start()
        ((best, decodes),) = encoder.batch([text.encode()])
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        took.append(time.process_time() - began)
        assert decodes and len(best) == nbest.N and [s for s, _ in best] == sorted((s for s, _ in best), reverse=True)
        assert len({ids for _, ids in best}) == nbest.N and not encoder.known and not encoder.more
    assert took[1] < 30 * took[0] and most[1] < 30 * most[0] and most[1] < 200e6, (took, most)


def test_short_and_long_chunks_agree(monkeypatch):
    texts = [t.encode() for t in [*TEXTS, *(" ".join(words(8, s)) for s in range(40)), "日本語日本" * 9, "\0a\0", "=" * 60]]
    want = list(nbest.Encoder(None, 4).batch(texts))
    monkeypatch.setattr(nbest, "LONGEST", 2)
    got = list(nbest.Encoder(None, 4).batch(texts))
    assert [(round(s, 6), ids) for best, _ in got for s, ids in best] == [(round(s, 6), ids) for best, _ in want for s, ids in best]
    monkeypatch.setattr(nbest, "LONGEST", 64)
    monkeypatch.setattr(nbest, "REMEMBER", 5)
    monkeypatch.setattr(nbest, "TEXTS", 3)
    assert list(nbest.Encoder(None, 4).batch(texts)) == want and all(d for _, d in want)
