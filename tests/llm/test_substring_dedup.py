import hashlib
import random

import pytest

from trackloom.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, k1 string, n_chars long"


def brute(docs, n):
    words = [(d, (t or "").encode().split()) for d, t in docs]
    seen = {}
    for i, (_, w) in enumerate(words):
        for a in range(len(w) - n + 1):
            seen.setdefault(tuple(w[a : a + n]), []).append((i, a))
    hit = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                hit[i].update(range(a, a + n))
    out = []
    for (d, w), h in zip(words, hit):
        keep = [x for k, x in enumerate(w) if k not in h]
        out.append((d, len(w), len(h), hashlib.sha256(b" ".join(keep)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é x", "ß"]
    block = [r.choice(words) for _ in range(20)]
    docs = []
    for i in range(120):
        body = [r.choice(words) for _ in range(r.choice([0, 3, 6, 40, 90]))]
        if i % 3 == 0:
            k = r.randrange(len(block) - 8)
            body += block[k : k + 8 + r.randrange(6)] * r.choice([1, 1, 2])
        docs.append((i, r.choice([" ", "\n", "\t "]).join(body)))
    docs += [(7, docs[9][1]), (200, None), (201, ""), (202, "  \n "), (None, docs[3][1]), docs[5], (203, " ".join(["a"] * 30))]
    return docs


@pytest.mark.parametrize("batch", [sd.BATCH_WORDS, 150])
def test_equals_brute_force(spark, monkeypatch, batch):
    docs = corpus(batch)
    # the task function closes over the value on the driver
    monkeypatch.setattr(sd, "BATCH_WORDS", batch)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(3)
    got = sorted(map(tuple, sd.removal_digest(df, 8).collect()), key=repr)
    assert got == brute(docs, 8)


def test_removal_keeps_columns_and_clean_texts(spark):
    long = " ".join(f"x{i}" for i in range(12))
    docs = [(1, f"keep me  {long}", "a", 5), (2, f"{long} tail", "b", 5), (3, "clean \n text", "c", 5), (4, None, "d", None)]
    df = spark.createDataFrame(docs, SCHEMA)
    out = {r.doc_id: r for r in sd.remove_repeats(df, 10).collect()}
    assert sd.remove_repeats(df, 10).columns == df.columns
    assert (out[1].text, out[1].n_chars, out[1].k1) == ("keep me", 7, "a")
    assert (out[2].text, out[2].n_chars) == ("tail", 4)
    assert (out[3].text, out[3].n_chars, out[4].text, out[4].n_chars) == ("clean \n text", 5, None, None)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sd.removal_digest(df).collect() == [] and sd.remove_repeats(df).collect() == []
