import corpus_pipeline
from tetraflow.llm import decontam, linededup, quality, simhash
from tetraflow.llm._shared import stage


def test_every_stage_against_its_operator(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        was = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality.ledger(before).where(quality.passes("v3")).collect()}
        elif name == "line_dedup":
            left = {r.doc_id: r.text for r in linededup.delete_later_runs(before, 1).collect()}
            assert ids == {i for i, t in left.items() if t.split() or not was[i].split()}
            assert all(r.text == left[r.doc_id] and r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near_dedup":
            assert ids == {r.component_id for r in simhash.near_duplicates(before, shingle=5).collect()}
        elif name == "decontaminate":
            hit = {r.doc_id for r in decontam.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert ids == set(was) - hit
        assert docs.count() == len(ids)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == ids
    whole = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in whole.collect()} == ids


def test_stages_take_odd_rows_clashing_columns_and_empty_tables(spark):
    """Nulls in any column, repeated rows, empty and long texts; every column passes through every stage but the last."""
    sf = "/root/testdata/sf0.001"
    good = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) for i in range(8))
    names = "doc_id long, text string, lang string, source string, n_chars int, row string, fp long, __row int, __gone int, __report int, __bits int, __measures int, part int"
    rows = [(1, good, "en", "s", len(good), "r", 1, 2, 3, 4, 5, 6, 7), (1, good, "en", "s", len(good), "r", 1, 2, 3, 4, 5, 6, 7), (None, None, *[None] * 11), (3, "", *[None] * 11), (4, "x " * 50_000, *[None] * 11), (None, good.upper(), *[None] * 11)]
    docs = spark.createDataFrame(rows, names)
    for table in (docs, docs.limit(0)):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, table, sf)
            if name == "pack":
                assert {r.doc_id for r in out.collect()} == {r.doc_id for r in table.collect()}
            else:
                assert out.columns == docs.columns, name
                assert out.count() <= table.count(), name
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()} == {1}
    assert corpus_pipeline.near_dedup(spark, docs, sf).where("doc_id = 1").count() == 1
