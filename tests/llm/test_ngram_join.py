import random

import pytest

from trackloom.llm import ngram_join as nj


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, num, den):
    sets = [shingles(t, n) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    name = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            name[root(i)] = min(d, name.get(root(i), d))
    return sorted(((d, len(sets[i]), name.get(root(i))) for i, (d, _) in enumerate(docs)), key=repr)


def corpus(seed, copies):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)] + ["É", "ß x"]
    common = [r.choice(vocabulary) for _ in range(30)]
    docs = []
    for g in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 8, 9, 10, 11, 30, 60, 120]))]
        if g % 4 == 0:
            base = common + base
        for _ in range(copies if g == 8 else r.choice([1, 1, 2, 4])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                k = r.randrange(len(words))
                words[k : k + 1] = r.choice([[], [r.choice(vocabulary)], [words[k], words[k]]])
                words = words or ["x"]
            text = r.choice([" ", "\n"]).join(words)
            docs.append((len(docs), r.choice([text, text.lower()])))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (3, docs[3][1]), (None, docs[5][1]), (None, "alone " * 7)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,similarity,levels", [(1, (90, 100), 4), (2, (80, 100), 4), (3, (60, 100), 2)])
def test_equals_brute_force(spark, monkeypatch, seed, similarity, levels):
    monkeypatch.setattr(nj, "LEVELS", levels)
    monkeypatch.setattr(nj, "PART", 5)
    docs = corpus(seed, 40)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, node string").repartition(3)
    got = sorted(map(tuple, nj.components(df, 3, similarity).collect()), key=repr)
    assert got == brute(docs, 3, *similarity)


def test_exact_step_alone(spark, monkeypatch):
    """Without the min-hash contraction the prefix join still finds every link."""
    docs = corpus(5, 12)
    monkeypatch.setattr(nj, "_links_of_part", lambda num, den: lambda g: g.head(0)[["node", "part"]].set_axis(["a", "b"], axis=1))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, nj.components(df, 3, (80, 100)).collect()), key=repr) == brute(docs, 3, 80, 100)


def test_null_ids(spark, monkeypatch):
    """Near copies without an id on one side and on both, and as the middle of a chain, by either step."""
    docs = corpus(4, 12)
    docs = [(None if d is not None and d % 3 == 0 else d, t) for d, t in docs]
    words = [f"v{i}" for i in range(60)]
    chain = [" ".join(words[:k] + ["new"] * (k < 60) + words[k + 1 :]) for k in (60, 20, 40)]
    docs += [(None, chain[0]), (2000, chain[1]), (2001, chain[2]), (None, "u " + " ".join(words[::-1])), (None, " ".join(words[::-1])), (None, " ".join(words[::-1]).upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, nj.components(df, 3, (80, 100)).collect()), key=repr) == brute(docs, 3, 80, 100)
    kept = [t.lower() for _, t in map(tuple, nj.keep_one(df, 3, (80, 100)).collect()) if t and t.split()]
    assert sum(t in {c.lower() for c in chain} for t in kept) == 1 and sum("v59 v58" in t for t in kept) == 1
    monkeypatch.setattr(nj, "_links_of_part", lambda num, den: lambda g: g.head(0)[["node", "part"]].set_axis(["a", "b"], axis=1))
    assert sorted(map(tuple, nj.components(df, 3, (80, 100)).collect()), key=repr) == brute(docs, 3, 80, 100)


def test_keep_one(spark):
    a = " ".join(f"w{i}" for i in range(40))
    docs = [(1, a, "s"), (2, a + " end", "s"), (2, a + " end", "t"), (3, "other words here", "s"), (4, "", "s"), (5, None, "s"), (6, "", "s"), (3, "other words here", "u")]
    df = spark.createDataFrame(docs, "doc_id long, text string, row string")
    out = nj.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5, 6]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.components(df).collect() == [] and nj.keep_one(df).collect() == []
