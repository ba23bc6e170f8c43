from test_ngram_join import brute, corpus

import corpus_pipeline
from trackloom.llm import nbest


def test_stages_equal_their_operators_in_turn(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
    assert seen[0] >= seen[1] > seen[2] == seen[3] >= seen[4] > 0
    encoder = nbest.Encoder(None, nbest.N)
    want = {r.doc_id: len(encoder.encode(r.text or "")[0][1]) for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_near_copies_equal_brute_force(spark, sf):
    """Five words and 0.8: one of 100 words with three changed is a near copy, of three-word shingles at 0.9 it would be none."""
    docs = sorted({d: (d, t) for d, t in corpus(6, 12) if d is not None}.values())
    words = [f"v{i}" for i in range(100)]
    docs += [(2000, " ".join(words)), (2001, " ".join("new" if i in (1, 50, 98) else w for i, w in enumerate(words)))]
    want = {d for d, n, component in brute(docs, 5, 80, 100) if not n or d == component}
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf)
    assert 2001 not in want and sorted(r.doc_id for r in got.collect()) == sorted(want)
