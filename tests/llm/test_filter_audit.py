import random
import re
from itertools import permutations

import numpy as np
import pytest

from trackloom.llm import filter_audit as fa


@pytest.mark.parametrize("step", [2, 5, fa.STEP])
def test_lists_equal_sets(monkeypatch, step):
    monkeypatch.setattr(fa, "STEP", step)
    r = random.Random(3)
    for _ in range(200):
        lists = [np.array(sorted(r.sample(range(200), r.choice([0, 1, 3, 40, 150]))), np.int32) for _ in range(r.randint(1, 5))]
        sets = [set(x.tolist()) for x in lists]
        assert fa.union(lists).tolist() == sorted(set().union(*sets))
        assert fa.difference(lists[0], lists[1:]).tolist() == sorted(sets[0].difference(*sets[1:]))
        assert fa.common(lists[0], lists[-1]) == len(sets[0] & sets[-1])


def test_gallop_finds_the_first_place():
    x = np.array([1, 1, 4, 4, 9, 30], np.int32)
    for at in range(7):
        for border in range(-1, 32):
            want = next((i for i in range(at, 6) if x[i] >= border), 6)
            assert fa.gallop(x, at, border) == want


def brute(docs, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        rows.append((s or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                before = set(p[:k])
                lost = [r for r in mine if f in r[0] and not r[0] & before]
                shapley[f] += len(lost)
                out[part, "".join(p), k + 1] = [sum(not r[0] & (before | {f}) for r in mine), len(lost), sum(f in r[0] for r in mine) - len(lost), sum(r[0] == {f} for r in mine), sum(r[1] for r in lost), sum(r[2] for r in lost), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
def test_equals_brute_force(spark, batch):
    r = random.Random(1)
    texts = [None, "", "Same text", "x " * 250, " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(199)) + " #", "ABC de", "é" * 30 + "A", "\x1c   a\tb"]
    docs = [(r.choice([None, *range(-5, 40), 5000, 2**40]), r.choice(texts), r.choice(["a", "a", "a", "b", None, ""])) for _ in range(150)]
    docs += [docs[0], docs[0], (7, "x", "a"), (7, "y", "a")]
    labels = [(d, r.choice([0, 1, None]), r.choice([0, 1, None])) for d in [*range(-5, 40), None, 3, 3]]
    df = spark.createDataFrame([(d, t, s, True, 1) for d, t, s in docs], "doc_id long, text string, source string, A boolean, kept int").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(x["part"], x["filter_order"], x["step"]): [x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for x in fa.report(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute(docs, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.report(none, labels).collect() == []
    one = spark.createDataFrame([(1, "a", None)], none.schema)
    assert fa.report(one, labels).count() == 600


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", i, i % 2 == 0, i % 3 == 0, i == 6) for i in range(12)], "part string, id long, even boolean, three boolean, odd boolean")
    got = {(x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.odd_lost) for x in fa.audit(rows, ["even", "three"], ["odd"]).collect()}
    assert got == {("eventhree", 1): (6, 6, 0, 1), ("eventhree", 2): (4, 2, 2, 0), ("threeeven", 1): (8, 4, 0, 1), ("threeeven", 2): (4, 4, 2, 0)}
