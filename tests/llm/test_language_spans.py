import random
import zlib

import numpy as np
import pytest

from trackloom.llm import language_spans as ls


def brute(score, count, switch):
    out, at = [], 0
    for n in count.tolist():
        s = score[at : at + n]
        at += n
        v, back = None, []
        for row in s.tolist():
            if v is None:
                v = row
                continue
            best = max(range(len(v)), key=lambda k: (v[k], -k))
            back.append([best if v[k] < v[best] - switch else k for k in range(len(v))])
            v = [max(v[k], v[best] - switch) + row[k] for k in range(len(v))]
        if v is not None:
            path = [max(range(len(v)), key=lambda k: (v[k], -k))]
            for b in reversed(back):
                path.append(b[path[-1]])
            out += path[::-1]
    return out


def test_blocks_equal_one_search():
    r = np.random.default_rng(0)
    for _ in range(200):
        count = r.choice([0, 1, 2, 3, 7, 8, 9, 40, 100], size=r.integers(1, 8))
        score = -r.integers(0, r.choice([2, 5, 50]), size=(count.sum(), r.integers(1, 6)))
        switch, block = int(r.choice([1, 3, 20, 60])), int(r.choice([1, 2, 4, 8, 64]))
        assert ls.viterbi(score, count, switch, block).tolist() == brute(score, count, switch)


def test_words_by_script():
    w = ls.Words(["Hello wörld, été", "Приветworld日本 ́x", "", "12 !"])
    got = [("".join(map(chr, w.x[a : a + n])), t, ls.NAMES[s], k) for a, n, t, s, k in zip(w.start.tolist(), w.size.tolist(), w.text.tolist(), w.script.tolist(), w.letters.tolist())]
    assert got == [("hello", 0, "Latin", 5), ("wörld", 0, "Latin", 5), ("été", 0, "Latin", 3), ("привет", 1, "Cyrillic", 6), ("world", 1, "Latin", 5), ("日本", 1, "Han", 2), ("x", 1, "Latin", 1)]


def test_grams_equal_slices():
    w = ls.Words(["abc a", "xyzzy ab"])
    bucket, word = ls.grams(w.x, w.start, w.size)
    assert np.bincount(word).tolist() == [sum(max(0, n + 3 - k) for k in ls.ORDERS) for n in w.size.tolist()]
    again, of = ls.grams(w.x, w.start[1:2], w.size[1:2])
    assert sorted(bucket[word == 1].tolist()) == sorted(again.tolist()) and set(of.tolist()) == {0}


SYLLABLES = {"aa": ["the", "ing", "of", "and", "er"], "bb": ["der", "sch", "ung", "zu", "ein"], "cc": ["при", "вет", "мир", "ны"]}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(2)
    rows = [(i, sentence(r, lang, 40), lang) for i, lang in enumerate(["aa", "aa", "bb", "cc"] * 40)]
    return ls.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_mixed_text_has_spans(spark, model):
    r = random.Random(5)
    parts = [sentence(r, "aa", 15), sentence(r, "bb", 9), sentence(r, "cc", 1), sentence(r, "aa", 200)]
    text = ". ".join(parts)
    (row,) = ls.labelled(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, lang_pred string"), model).collect()
    assert [s.lang for s in row.spans] == ["aa", "bb", "cc", "aa"] and row.lang_pred == "aa" and 0.8 < row.score < 1 and row.row.lang_pred == "x"
    assert [text[s.start : s.end] for s in row.spans] == parts


def test_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "12 - !"), (None, "the ing"), (5, "กข"), (6, "der " * 60_000), (6, "der")]
    got = [(r.lang_pred, r.score, len(r.spans)) for r in ls.labelled(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()]
    assert got[:3] == [("und", 0.0, 0)] * 3
    assert got[3] == ("aa", 1.0, 1) and got[4] == ("aa", 1.0, 1) and got[5] == got[6] == ("bb", 1.0, 1)


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "the", None), (None, "the", "aa"), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score, r.n_spans) for r in ls.report(df).collect()} == {("und", 0.0, 0)}
    assert ls.report(df.limit(0)).collect() == []


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    df = spark.createDataFrame([(i, "the ing", "aa") for i in ids], "doc_id long, text string, lang string")
    assert ls.fit(df).languages == []


def test_held_out_accuracy(spark, sf):
    got = {r.doc_id: r for r in ls.report(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in got.items())
    test = [(got[d].lang_pred, lang) for d, lang in docs if got[d].held_out and lang]
    assert sum(a == b for a, b in test) >= 0.95 * len(test)
