import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from trackloom.llm import bm25


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)


def brute(docs, k):
    count = [Counter(words(t)) for _, t in docs]
    n, mean = len(docs), sum(map(sum, (c.values() for c in count))) / len(docs)
    df = Counter(w for c in count for w in c)
    out = []
    for q, t in sorted({(d, t) for d, t in docs if d is not None and t is not None and d % 100 == 0}):
        scored = []
        for (d, _), c in zip(docs, count):
            size = sum(c.values())
            s = math.fsum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in set(words(t)) if w in c)
            if s > 0:
                scored.append((-round(s, 9), d is None, d or 0))
        out += [(q, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("documents,terms", [(bm25.SHARD_DOCUMENTS, bm25.QUERY_TERMS), (70, 40)])
def test_equals_brute_force(spark, monkeypatch, documents, terms):
    for name, value in (("SHARD_DOCUMENTS", documents), ("QUERY_TERMS", terms), ("BLOCK", 4), ("FIRST", 2), ("WIDER", 2)):
        monkeypatch.setattr(bm25, name, value)
    r = random.Random(1)
    vocabulary = [f"w{int(r.paretovariate(0.6))}" for _ in range(300)] + ["É", "ß"]
    docs = [(i * 10, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 20, 80])))) for i in range(150)]
    docs += [(5, docs[20][1]), (100, "W1 w2"), (None, docs[20][1]), (3, None), (900, None), docs[20], (7, "w1 " * 500)]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double").repartition(2)
    got = [(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in bm25.neighbours(df, 7).collect()]
    want = brute(docs, 7)
    # two queries share the id 100: compare as multisets
    key = lambda x: (x[0], x[1], -x[3], repr(x[2]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 3e-9 for a, b in zip(got, want))


def test_pruning_leaves_documents_out():
    rare = [f"r{i}" for i in range(400)]
    texts = [(i, f"common words here {rare[i]} {rare[i]}") for i in range(400)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t for _, t in texts]), pa.array([0] * 400)], ["id", "text", "part"])
    (row,) = next(bm25._build(iter([batch]))).to_pylist()
    shard = bm25.Shard(row, 5.0)
    hashed = bm25.WordHashes(alnum=True)
    ((terms, _),) = bm25._terms([b"common words here r7"], hashed)
    (r7,) = hashed([b"r7"])[0].tolist()
    docs, _, read = shard.find(np.searchsorted(shard.terms, terms), np.array([5.0 if t == r7 else 0.1 for t in terms.tolist()]), 1)
    assert docs.tolist() == [7] and read < 200


def test_empty_table(spark):
    assert bm25.neighbours(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_threshold_from_before_keeps_ties():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([f"same w{i % 2}" for i in range(100)]), pa.array([0] * 100)], ["id", "text", "part"])
    (row,) = next(bm25._build(iter([batch]))).to_pylist()
    shard = bm25.Shard(row, 2.0)
    at = np.searchsorted(shard.terms, bm25._terms([b"same w1"], bm25.WordHashes(alnum=True))[0][0])
    docs, score, _ = shard.find(at, np.array([0.3, 0.7]), 3)
    assert docs.tolist() == [1, 3, 5] and len(set(score)) == 1
    again, _, _ = shard.find(at, np.array([0.3, 0.7]), 3, float(score[0]))
    assert again.tolist() == [1, 3, 5]
    assert not len(shard.find(at, np.array([0.3, 0.7]), 3, float(score[0]) + 1e-8)[0])
