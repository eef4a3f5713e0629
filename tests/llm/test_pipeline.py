import corpus_pipeline


def test_whole_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in pieces}
    assert kept < set(docs) and len(kept) > 100
    for i in kept:
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == own[0].doc_tokens
