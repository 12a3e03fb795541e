import corpus_pipeline
from partloom.llm import store

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_whose_names_clash(spark):
    """Columns named like any of the operators' own go through all stages unharmed, and rows of a null id too."""
    names = ("w", "bits", "_toxic", "_toxic_score", "_base", "_added", "_text", "score", "predicted", "base", "added", "toxic", "h", "size", "h1", "h2", "prefix", "marks", "component_id", "n_shingles", "a", "b", "node", "item_id", "luck", "spans")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    for k, c in enumerate(names):
        docs = docs.withColumn(c, docs.doc_id * 100 + k)
    want = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = store.materialize(stage(spark, docs, SMALL), name)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == want[r.doc_id][c] for r in got for c in names), name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).select("doc_id").distinct().count() == docs.count()


def test_rows_of_a_null_id_stay_as_they_are(spark):
    from partloom.llm import jaccard

    rows = [(None, "the same text of some words here")] * 3 + [(1, "the same text of some words here"), (2, "the same text of some words here")]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, None, None, None]


def test_sieve_is_sized_by_its_keys(spark):
    few = store.sieve(spark.range(100), "id")
    assert few.words == 1 << 10
    df = spark.range(5000).withColumn("w", store.F.lit(1)).withColumn("bits", store.F.lit(2))
    inside = store.sifted(df, "id", few)
    assert inside.columns == df.columns and set(range(100)) <= {r.id for r in inside.collect()} and inside.count() + store.sifted(df, "id", few, False).count() == 5000
    none = store.Sieve(None, 0)
    assert store.sifted(df, "id", none).count() == 5000 and store.sifted(df, "id", none, False).count() == 0


def test_rounds_find_links_of_an_open_token(spark, monkeypatch):
    """A family around one passage whose members are linked in pairs only: every pair is found, whatever the first rounds try."""
    import random

    from partloom.llm import jaccard

    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "GROWTH", 2)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    common, rows = " ".join(word() for _ in range(40)), []
    for k in range(30):
        own = [word() for _ in range(22)]
        rows += [(2 * k, f"{common} {' '.join(own)}"), (2 * k + 1, f"{common} {' '.join([*own[:-1], word()])}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard.components(docs, 3, 90, 100).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
