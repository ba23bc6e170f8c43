import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from trackloom.llm import toxicity as tx


def corpus(n=400):
    r = random.Random(3)
    plain = [f"{a}{b}" for a in ("tra", "lon", "mei", "sou", "vel") for b in ("dan", "tor", "lin", "est", "ump", "ola")]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.choice([5, 40, 80]))]
        bad = r.random() < 0.2
        if bad:
            for _ in range(r.choice([1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(["blarg", "Zonk", "krummel" + r.choice(["a", "o", "en"])])
        docs.append((i, " ".join(w), "x"))
        if i % 4:
            labels.append((i, 1, int(bad)))
    return docs, labels, {i: "blarg" in t or "Zonk" in t or "krummel" in t for i, t, _ in docs}


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, row string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_cases(spark):
    docs, labels, truth = corpus()
    docs += [(900, None, "x"), (901, "", None), (902, "zonk " * 3000, "x"), docs[5], (None, "plain words", "x")]
    labels += [(None, 1, 1), (900, 1, None), (5, 1, 0)]
    d, lab = frames(spark, docs, labels)
    out = tx.report(d, lab).collect()
    assert len(out) == len(docs)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in out}
    assert by[902].predicted == 1 and by[902].neighbours and by[900].predicted == by[901].predicted == 0
    assert all(zlib.crc32(str(i).encode()) % 5 for r in out for i in r.neighbours)
    kept = tx.reject(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.predicted}


def test_nearest_equals_brute_force(monkeypatch):
    monkeypatch.setattr(tx, "BLOCK", 4)
    monkeypatch.setattr(tx, "FIRST", 2)
    r = random.Random(5)
    weight = np.array([r.uniform(0.5, 3) for _ in range(12)])
    counts = lambda n: {f: r.randrange(1, 5) for f in sorted(r.sample(range(12), n))}
    examples = [(i, i % 2, counts(r.randrange(0, 5))) for i in range(60)]
    examples += [(100 + i, 0, dict(examples[3][2])) for i in range(5)]
    m = tx.Model(np.arange(12, dtype=np.uint64), weight, {}, [(i, y, np.array(list(c), np.int64), np.array(list(c.values()), np.int64)) for i, y, c in examples], 0.1, (1.0, 1.0))
    place = {int(i): k for k, i in enumerate(m.ids)}

    def unit(c):
        v = {f: (1 + math.log(n)) * weight[f] for f, n in c.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {f: w / norm for f, w in v.items()}

    docs = [counts(4) for _ in range(50)] + [{}]
    of = np.array([k for k, c in enumerate(docs) for _ in c])
    at, n = np.array([f for c in docs for f in c]), np.array([x for c in docs for x in c.values()])
    row, example, cosine = m.nearest(*m.vectors(of, at, n, len(docs)), len(docs), k=7)
    for k, c in enumerate(docs):
        v = unit(c) if c else {}
        every = sorted((-round(s, 9), place[i]) for i, _, e in examples if (s := sum(v.get(f, 0) * w for f, w in unit(e).items() if e)) > 0)
        got = [(-round(x, 9), e) for x, e in zip(cosine[row == k].tolist(), example[row == k].tolist())]
        assert got == every[:7]


def brute(docs, labels):
    """Scores of (doc_id, text) by the docstring's rules, with plain loops and no index."""
    use = sorted({(i, y) for i, y in labels if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 5})
    texts: dict = {}
    for i, t in docs:
        for j, y in use:
            if i == j and t is not None:
                a, b = texts.get(t, (i, 0))
                texts[t] = min(a, i), max(b, y)

    def features(t):
        out: dict = {}
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()
        for w in re.findall(rb"[a-z\x80-\xff]+", low):
            for f in [(0, w)] + [(n, w[:n]) for n in (4, 5) if len(w) > n]:
                out[f] = out.get(f, 0) + 1
        return out

    sample = [(i, y, features(t)) for t, (i, y) in texts.items()]
    n1 = sum(y for _, y, _ in sample)
    n0 = len(sample) - n1
    n = n0 + n1
    a, b = Counter(f for _, y, c in sample if y for f in c), Counter(f for _, y, c in sample if not y for f in c)
    strong = {f for f in {*a, *b} if a[f] + b[f] >= tx.LEAST_DOCUMENTS and n * (a[f] * n0 - b[f] * n1) ** 2 / (n0 * n1 * (a[f] + b[f]) * (n + 1 - a[f] - b[f])) >= tx.LEAST_CHI2}
    known = {f for f in {*a, *b} if f in strong or not f[0]}
    df = Counter(f for _, t in docs for f in features(t) if f in known)
    weight = {f: (math.log((len(docs) + 1) / (df[f] + 1)) + 1) * (1 if f in strong else tx.PLAIN) for f in known}

    def unit(c):
        v = {f: (1 + math.log(k)) * weight[f] for f, k in c.items() if f in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / norm for f, x in v.items()}

    vectors = [(i, y, unit(c)) for i, y, c in sample if c]
    total = Counter(y for _, y in use)
    stands = [total[0] / n0, total[1] / n1]
    scale = sum(total.values()) / n
    bare = [sum(not set(c) & strong for _, y, c in sample if y == k) * stands[k] for k in (0, 1)]
    share = bare[1] / max(sum(bare), 1e-9)

    def votes(v, skip=None):
        near = sorted((-round(s, 12), j) for j, (i, _, e) in enumerate(vectors) if i != skip and (s := sum(x * e.get(f, 0) for f, x in v.items())) > 0)[: tx.NEAREST]
        toxic, all_ = tx.PRIOR_VOTES * share, tx.PRIOR_VOTES
        for s, j in near:
            y = vectors[j][1]
            w = stands[y] / scale * tx.NEAR / (1 - min(-s, 1) + tx.NEAR) * tx.NEAREST / len(near)
            toxic, all_ = toxic + w * y, all_ + w
        return toxic / all_

    told = [(votes(v, i), y) for i, y, v in vectors]
    curve = tx.Model._fit(tx.Model, [x for x, _ in told], [y for _, y in told], [stands[y] / scale for _, y in told])
    out = []
    for i, t in docs:
        v = unit(features(t))
        z = curve[0] * float(tx.Model._logit(np.array(votes(v)))) + curve[1] if v else 0
        out.append((i, 1 / (1 + math.exp(-z)) if v else share))
    return out


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tx, "LEAST_CHI2", 4.0)
    monkeypatch.setattr(tx, "NEAREST", 5)
    r = random.Random(11)
    names = [f"{a}{b}{c}" for a in ("sol", "mar", "É") for b in ("an", "ert", "") for c in ("o", "is", "ung")]
    docs = [(i, " ".join(r.choice(names) for _ in range(r.randrange(1, 12))) + r.choice([" ", " Blargen", " blarger!", "-zonk", ""])) for i in range(120)]
    docs += [(500, None), (501, ""), (None, "blargen"), (502, "nothing known")]
    labels = [(i, int("larg" in t or "zonk" in t)) for i, t in docs[:90]] + [(3, 1), (4, None), (None, 1)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = sorted(((x.doc_id, x.score) for x in tx.report(d, lab).collect()), key=repr)
    want = sorted(brute(docs, labels), key=repr)
    assert [i for i, _ in got] == [i for i, _ in want]
    # where cosines tie, the voters are other ones: few rows
    same = sum(abs(a[1] - b[1]) < 1e-6 for a, b in zip(got, want))
    assert same >= 0.9 * len(want), (same, [x for x in zip(got, want) if abs(x[0][1] - x[1][1]) > 1e-6][:5])


def test_equal_texts_with_other_labels(spark):
    docs, labels, _ = corpus()
    d, lab = frames(spark, [*docs, (1001, docs[1][1], "x"), (1002, docs[1][1], "x")], [*labels, (1001, 1, 1), (1002, 1, 0)])
    first, second = (sorted((r.doc_id, r.score) for r in tx.report(x, lab).collect()) for x in (d, d.repartition(7, "doc_id")))
    assert first == second


def test_without_labels(spark):
    docs, labels, _ = corpus(20)
    d, lab = frames(spark, docs, labels)
    assert {r.score for r in tx.report(d, lab.where("false")).collect()} == {0.0}
    assert {r.score for r in tx.report(d, lab.where("false").unionByName(spark.createDataFrame([(1, 1, 1)], lab.schema))).collect()} == {1.0}
    assert tx.report(d.where("false"), lab).collect() == []
