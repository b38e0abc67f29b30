import corpus_pipeline
from loomline.llm import registry


def test_stages_keep_what_they_should(spark, tmp_path):
    """Planted cases go, clean documents stay, packing holds all that is left."""
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    item = bench.first()["text"]
    clean = " ".join(f"clean{k} piece{k % 7}" for k in range(80))
    other = clean.replace("clean40", "changed")
    rows = [(5001, clean), (5002, clean), (5003, other), (5004, "before it " + item + " after it"), (5005, " ".join(f"lone{k}" for k in range(50))), (5006, None)]
    docs = base.unionByName(spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], base.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        if name != "packing":
            assert now.columns == docs.columns
    assert {5001, 5002, 5003, 5004, 5005} <= kept["toxicity"]
    assert {5001, 5003} <= kept["exact_dedup"] and 5002 not in kept["exact_dedup"]
    assert 5001 in kept["ngram_join"] and 5003 not in kept["ngram_join"] and 5005 in kept["ngram_join"]
    assert 5004 not in kept["decontaminate"] and {5001, 5005} <= kept["decontaminate"]
    assert kept["packing"] == kept["decontaminate"]


def test_registry():
    q = registry.queries()
    assert "pipeline" in q and all(any(x.startswith(f"op{n}_") for x in q) for n in range(1, 11))
    assert set(registry.oracle_sql()) <= set(q) and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_edges(spark, edge_docs, no_docs, tmp_path):
    """Nulls, empties, repeated rows, clashing names and an empty table through every stage."""
    import corpus_pipeline

    sf = str(tmp_path)
    spark.createDataFrame([(1, 0, 0), (5, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "six seven"), (2, None), (None, "one")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    counts = []
    for docs in (edge_docs, no_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                out.write.parquet(f"{sf}/{len(counts)}.parquet")
                docs = spark.read.parquet(f"{sf}/{len(counts)}.parquet")
                counts.append(docs.count())
            else:
                counts.append(out.count())
    # 10 rows; of empty and of equal texts one each stays; the text of seven words holds an item
    assert counts[:4] == [10, 6, 6, 5] and counts[5:] == [0] * 5 and counts[4] >= 5
