import corpus_pipeline


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_packing"]
    packed = corpus_pipeline.run(spark, d).toPandas()
    inside = {i for x in packed.doc_ids for i in x}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    passages = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    # So small a table has two to four labelled toxic documents in some languages, too few to learn their words.
    toxic = [i for i in labels if labels[i]["toxic"]]
    assert sum(i in inside for i in toxic) <= 0.2 * len(toxic)
    assert len({texts[i] for i in inside}) == len(inside)
    assert not any(p in texts[i] for i in inside for p in passages)
