"""The pipeline: each stage on what its predecessor kept, against plain versions of the stages."""

import corpus_pipeline
from slotwise.llm import common, packing, pii, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas().set_index("doc_id")
        path = common.folder(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        if name == "packing":
            pieces = docs.toPandas()
            assert set(pieces.doc_id) == set(before.index)
            assert pieces.groupby("doc_id").length.sum().equals(pieces.groupby("doc_id").doc_tokens.first())
            continue
        assert docs.columns == columns
        after = docs.toPandas().set_index("doc_id")
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            predicted = quality.classified(spark.read.parquet(f"{SF}/documents.parquet"), labels).toPandas().set_index("doc_id").predicted
            assert set(after.index) == set(predicted[predicted == 1].index)
        if name == "near_duplicates":
            prints = {i: simhash.fingerprint(t.encode()) for i, t in before.text.items()}
            kept = list(after.index)
            assert all((prints[a] ^ prints[b]).bit_count() > 4 for a in kept for b in kept if a < b)
            assert all(i in after.index or any((prints[i] ^ prints[j]).bit_count() <= 4 for j in before.index if j != i) for i in before.index)
        if name == "pii":
            assert not any(pii.base_spans(t) for t in after.text)
            clean = [i for i, t in before.text.items() if not any(c in t for c in "0123456789@")]
            assert clean and (before.text[clean] == after.text[clean]).all()
            assert (after.n_chars == after.text.str.len()).all()
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]


def test_run_and_extra_columns(spark, edge_docs, no_docs):
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.columns == packing.PIECES.names and pieces.count() > 100
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, SF)
            assert docs.columns == edge_docs.columns
        docs.collect()
