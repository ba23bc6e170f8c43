import hashlib
import random
import re

import pytest

from trackloom.llm import decontamination as dc


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench, n):
    out = []
    for d, text in docs:
        w = words(text)
        hit, items = set(), set()
        for i, t in bench:
            b = words(t)
            for a in range(max(1, len(b) - n + 1)) if b else ():
                x = b[a : a + n]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit.update(range(p, p + len(x)))
                        items.add(i)
        names = sorted(str(i) for i in items)
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def tables(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß", "don't", "x-1"]
    bench = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 4, 6, 8, 15])))) for i in range(20)]
    bench += [(20, bench[0][1]), (21, bench[5][1] + "!"), (22, None), (23, "?! "), (100, "same same same same same same same same same")]
    docs = []
    for i in range(80):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 2, 10, 40, 200]))]
        for _ in range(r.choice([0, 0, 1, 3])):
            p = r.randrange(len(w) + 1)
            w[p:p] = (r.choice(bench)[1] or "w1").split(" ")
        docs.append((i, r.choice([" ", "; ", "\n"]).join(w).upper() if i % 3 else " ".join(w)))
    return docs + [(200, None), (201, ""), (None, bench[4][1]), docs[3], (202, "same " * 30)], bench


@pytest.mark.parametrize("seed,block", [(1, dc.BLOCK_BYTES), (2, 300)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    docs, bench = tables(seed)
    bench = [(i, t) for i, t in bench if t is not None] + [(22, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    for n in (dc.WINDOW, 6):
        found = dc.contamination(df, items, ["doc_id"], n).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, bench, n)


def test_equal_items_are_one_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 4000)
    held = []
    made = dc.Index.__init__
    monkeypatch.setattr(dc.Index, "__init__", lambda self, items, *a: (held.append(sum(len(t) for _, t in items)), made(self, items, *a))[1])
    long = " ".join(f"b{i}" for i in range(400))
    bench = [(i, long) for i in range(200)] + [(1000 + i, f"item {i} " + " ".join(f"c{i}x{k}" for k in range(60))) for i in range(30)] + [(None, long)]
    docs = [(1, f"x {long} y"), (2, bench[205][1]), (3, "clean words only")]
    got = {r.doc_id: r for r in dc.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert (got[1].n_items, got[1].n_hit, got[2].n_items, got[3].n_items) == (200, 400, 1, 0)
    assert len(held) > 3 and max(held) < 8000


def test_clean_keeps_columns(spark):
    item = " ".join(f"b{i}" for i in range(14))
    docs = spark.createDataFrame([(1, item, "x", 3), (2, "fine text", "y", 4), (3, None, None, None)], "doc_id long, text string, row string, spans long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = dc.clean(docs, bench)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(2, "fine text", "y", 4), (3, None, None, None)]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.report(docs, bench).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.n_hit for r in dc.report(one, bench).collect()] == [0]
