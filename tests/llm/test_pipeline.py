from brute import jaccard

import corpus_pipeline as pipeline
from tallyspan.llm import langid, mixing, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    (_, language), (_, clean), (_, distinct), (_, mixed), (_, tokens) = pipeline.STAGES
    rows = {r.doc_id: r for r in docs.collect()}

    model = langid.train(docs)
    names, scores = model.predict([r.text for r in rows.values()])
    a = language(spark, docs, FOLDER).persist()
    assert a.columns == columns
    assert {r.doc_id for r in a.collect()} == {i for i, n, s in zip(rows, names, scores) if n != "und" and s >= pipeline.LEAST_SURE}

    model = toxicity.train(a, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    b = clean(spark, a, FOLDER).persist()
    kept = {r.doc_id for r in a.collect()}
    assert b.columns == columns and {r.doc_id for r in b.collect()} == {i for i in kept if model.scores([rows[i].text])[0] < pipeline.TOXIC}

    c = distinct(spark, b, FOLDER).persist()
    want = jaccard([(r.doc_id, r.text) for r in b.collect()], 5, 80)
    assert c.columns == columns and {r.doc_id for r in c.collect()} == {g for _, g in want.values()}

    d = mixed(spark, c, FOLDER).persist()
    assert d.columns == columns and {r.doc_id for r in d.collect()} == {r.doc_id for r in mixing.mix(c).where("selected").collect()}

    e = tokens(spark, d, FOLDER)
    assert all(r.round_trip and r.n_tokens * 4 == len(r.ids) for r in e.collect()) and e.count() == d.count()


def test_run(spark):
    out = pipeline.run(spark, FOLDER)
    assert 0 < out.count() < 200
