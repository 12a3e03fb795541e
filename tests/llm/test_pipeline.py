import corpus_pipeline
from partloom.llm import pii, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 100
    texts = [r.text for r in docs.collect()]
    assert not any(pii.base_spans(t) for t in texts) and any("<EMAIL>" in t or "<IP>" in t or "<PHONE>" in t for t in texts)
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == len(texts)


def test_stages_take_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "x " * 50_000), (None, "no id"), (5, "same words here to see it twice"), (6, "same words here to see it twice"), (6, "same words here to see it twice")]
    for given in (rows, []):
        docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 7) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long, score double, base int")
        for name, stage in corpus_pipeline.STAGES:
            last, docs = docs, stage(spark, docs, SMALL)
            if name != "packing":
                assert docs.columns == last.columns, name
        assert docs.select("doc_id").distinct().count() == (5 if given else 0)


def test_held_out_rows_never_train(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    import zlib

    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.select("doc_id", toxicity.held_out().alias("h")).collect())
