import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from trackloom.llm import ranked_search as rs


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)


def brute(docs, items, k):
    count = [Counter(terms(t)) for _, t in docs]
    n, size = sum(bool(c) for c in count), sum(map(sum, (c.values() for c in count)))
    df = Counter(w for c in count for w in c)
    out = []
    for i, text in {(i, t) for i, t in items if t is not None}:
        q, found = Counter(terms(text)), []
        for (d, _), c in zip(docs, count):
            m = 75 + 25 * sum(c.values()) * n // max(1, size)
            s = sum(q[t] * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in q if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("pairs,items,columns,documents", [(rs.BLOCK_PAIRS, rs.ITEMS, rs.TERMS, rs.DOCUMENTS), (12, 3, 5, 40)])
def test_equals_brute_force(spark, monkeypatch, pairs, items, columns, documents):
    for name, value in (("BLOCK_PAIRS", pairs), ("ITEMS", items), ("TERMS", columns), ("DOCUMENTS", documents), ("TEXTS", 20)):
        monkeypatch.setattr(rs, name, value)
    shrunk = pairs == 12
    r = random.Random(1)
    vocabulary = [f"w{int(r.paretovariate(0.6))}" for _ in range(200)] + ["É", "ß"]
    docs = [(r.choice([None, *range(300)]), " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 20, 80])))) for _ in range(150)]
    docs += [(5, "W1 w2"), (4, "w1 w2"), (4, "w1 w2"), (None, "w1 w2"), (3, None), (8, "w1 " * 500), (9, "--")]
    asked = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 9])))) for i in range(9 if shrunk else 40)] + [(1, "W1 w1 w2"), (1, "W1 w1 w2"), (2, "w1"), (None, "w1 w2"), (50, None), (51, ""), (52, "absent")]
    df = spark.createDataFrame([(d, t, 1.0, 2) for d, t in docs], "doc_id long, text string, score double, rank int").repartition(3)
    got = [(x.item_id, x["rank"], x.doc_id, x.score) for x in rs.search(df, spark.createDataFrame([(i, t, "x") for i, t in asked], "item_id long, text string, doc_id string"), 7).collect()]
    assert sorted(got, key=repr) == brute(docs, asked, 7)


def test_tiles_stay_exact():
    """A weight near the bound is dealt to several tiles, each of whose sums is below 2**53."""
    most = (rs.EXACT - 1) // rs.LARGEST
    of, place = np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 1, 3])
    value = np.array([3 * most + 5, most, 7, 2, most - 1])
    w = rs.Weights(2, of, place, value)
    (first, width, tiles) = w.tiles[0]
    assert (first, width) == (0, 2) and len(tiles) > 3
    for _, weights in tiles:
        assert (weights.sum(0) * rs.LARGEST < rs.EXACT).all()
    impact = np.array([rs.LARGEST - 1, rs.LARGEST - 2, 5, 1], np.int64)
    ((_, total),) = w.scores(1, 4, np.zeros(4, np.int64), np.arange(4), impact)
    want = [sum(int(v) * int(impact[p]) for o, p, v in zip(of, place, value) if o == i) for i in range(2)]
    assert total[0].tolist() == want and want[0] > 2**53


def test_best_keeps_ties_by_id():
    best = rs.Best(2, 3)
    null = np.zeros(6, np.uint8)
    best.add(0, np.array([[5, 0], [5, 1], [5, 1], [5, 1], [9, 1], [0, 0]]), null, np.array([30, 2, 20, 10, 40, 1]))
    best.add(0, np.array([[5, 1], [4, 7]]), np.array([0, 1], np.uint8), np.array([1, 0]))
    assert [(s.tolist(), i.tolist()) for s, _, i in best.held] == [([9, 5, 5], [40, 1, 2]), ([7, 1, 1], [0, 1, 2])]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rs.search(docs, items).collect() == []
    assert rs.search(spark.createDataFrame([(1, "a")], docs.schema), items.limit(0)).collect() == []
