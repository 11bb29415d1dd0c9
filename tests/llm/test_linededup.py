import re

from tetraflow.llm import linededup

HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows, run=2, long_line=5):
    """(doc_id, text, kept): rows in document order, equal rows once."""
    order = {}
    seen, out = {}, []
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if HAS_WORD.search(x)]
        gone = set()
        windows = [at[k : k + run] for k in range(len(at) - run + 1)]
        if long_line and run > 1:
            windows += [[i] for i in at if len(re.findall(r"[^\x20\x09-\x0D]+", lines[i])) >= long_line]
        for window in windows:
            key = tuple(lines[i] for i in window)
            if key in seen:
                gone.update(window)
            else:
                seen[key] = doc_id
        order[(doc_id, text)] = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
    for row in rows:
        out.append((*row, order[row]))
    return sorted(out, key=str)


def got(docs, run=2, long_line=5):
    left = linededup.delete_later_runs(docs.withColumn("was", docs["text"]), run, long_line)
    return sorted(((r.doc_id, r.was, r.text) for r in left.collect()), key=str)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for run, long_line in ((1, None), (2, 5), (3, None), (4, 9)):
        assert got(docs, run, long_line) == brute(rows, run, long_line)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "a\nb\nc"), (5, "x\na\nb\n\ny"), (6, "a\n\nb"), (6, "a\n\nb"), (7, "r\nr\nr\nr"), (None, "q\nb\nc"), (8, "b\nc\nd"), (9, "A\nb"), (10, "solo"), (11, "solo"), (12, "z\n" * 20_000)]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, fp int, win int")
    assert got(docs) == brute(rows)
    assert linededup.delete_later_runs(docs.limit(0)).count() == 0
    assert linededup.delete_later_runs(docs).columns[:4] == ["doc_id", "text", "fp", "win"]


def test_windows_select_their_least_hash(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne\na\na")], "doc_id long, text string")
    rows = {r.i: r.fp for r in linededup.selected(docs, 3, None).collect()}
    hashes = [r.h for r in spark.sql("select xxhash64(x) h from values 'a','b','c','d','e','a','a' t(x)").collect()]
    want = {max(range(k, k + 3), key=lambda i: (-hashes[i], i)) for k in range(5)}
    assert rows == {i: hashes[i] for i in want} and len(want) < 7


def test_clashing_columns_pass(spark):
    rows = [(1, "a\nb", 7, "x", 3, 9), (2, "a\nb\nc", 8, "y", 4, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone long, __lines string, __ROW int, __report int")
    left = linededup.delete_later_runs(docs, report="lines")
    assert sorted(tuple(r) for r in left.select(*docs.columns).collect()) == [(1, "a\nb", 7, "x", 3, 9), (2, "c", 8, "y", 4, 9)]
    import corpus_pipeline

    kept = corpus_pipeline.line_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["__report"] for r in kept.collect()) == [9, 9]


def test_a_hot_line_costs_each_task_one_row(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "concat('the same first line\nthe same second line\nown ', id) text").repartition(8)
    left = linededup.delete_later_runs(docs, report="lines")
    assert left.where("size(lines.gone) = 2").count() == 3999
    pairs = linededup.selected(docs).where("i < 2").count()
    assert pairs <= 2 * 4000  # a row for each selected line, none for a pair of documents


def test_single_repeated_lines_go_in_the_pipeline(spark):
    import corpus_pipeline

    rows = [(1, "a\nshared\nb"), (2, "c\nshared\nd"), (3, "solo"), (4, "solo"), (5, "e\n\ne")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert left == {1: "a\nshared\nb", 2: "c\nd", 3: "solo", 5: "e\n"}
