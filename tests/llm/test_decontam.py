import re

from tetraflow.llm import decontam


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [x for x in re.split("[^a-z0-9\u00c0-\u1fff\u2070-\u2fff\u3040-\U0010ffff]+", lower) if x]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs, items):
    out = []
    sets = [(i, shingles(t)) for i, t in items]
    for d, text in docs:
        own = shingles(text)
        out += [(d, i, len(s & own), len(s)) for i, s in sets if s and len(s & own) >= 0.8 * len(s)]
    return sorted(out, key=str)


def got(docs, items, **options):
    return sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontam.contaminated(docs, items, **options).collect()), key=str)


def test_whole_tables_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(docs, items) == expected and expected
    assert got(docs, items, block_items=7) == expected
    clean = decontam.keep_clean(docs, items)
    assert clean.count() == docs.count() - len({d for d, *_ in expected}) and clean.columns == docs.columns


def test_items_inside_long_documents_are_recalled(spark):
    words = [f"w{i * 7919 % 50021}" for i in range(60_000)]
    rows, items = [], []
    for k in range(60):
        size = 5 + 9 * k
        at = 900 * k + 37
        items.append((k, " ".join(words[at : at + size])))
    rows.append((1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, spark.createDataFrame(items, "item_id long, text string")) == brute(rows, items)


def test_odd_rows(spark):
    item = "One two, three four five six seven"
    rows = [(1, None), (2, ""), (3, "a b c d"), (4, "x " + item.upper() + "! y"), (4, item), (None, item), (5, "one two three four"), (6, "né " * 30_000 + item)]
    items = [(7, item), (7, item), (8, None), (9, ""), (10, "one two three four"), (None, "a b c d e")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    assert got(docs, bench) == brute(rows, items)
    assert got(docs.limit(0), bench) == [] and got(docs, bench.limit(0)) == []
    assert sorted(str(r.doc_id) for r in decontam.keep_clean(docs, bench).collect()) == ["1", "2", "3", "5"]


def test_rows_that_share_a_doc_id_are_judged_each_for_itself(spark):
    item = "one two three four five six seven"
    rows = [(None, item, 1), (None, "clean text without any item", 2), (5, "x " + item, 3), (5, "another clean text", 4), (None, None, 5), (6, "a second item with six words", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    bench = spark.createDataFrame([(1, item), (2, "second item with six words")], "item_id long, text string")
    for block_items in (1, 100):
        assert sorted(r.n for r in decontam.keep_clean(docs, bench, block_items=block_items).collect()) == [2, 4, 5]
    assert decontam.keep_clean(docs, bench.limit(0)).count() == 6 and decontam.keep_clean(docs.limit(0), bench).count() == 0


def test_short_items_are_found_exactly():
    words = [f"w{i}" for i in range(12_000)]
    items = [(i, " ".join(words[i : i + 5 + i % 4])) for i in range(0, 11_990, 3)]
    block = decontam.Items(items, 2)  # so few minima that windows would miss most
    found = {i for _, i, *_ in block.matches(["w0 w1 w2", " ".join(words), "w1"], 0.8)}
    assert found == {i for i, _ in items}


def test_signs_beyond_ascii_hide_no_item(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog today")], "item_id long, text string")
    rows = [(1, "\u201cthe quick\u2014brown fox\u2019 jumps\u00a0over \u00abthe lazy dog\u00bb today\u2026"), (2, "th\u00e9 quick brown fox"), (3, "\u3001the quick brown fox jumps over\u3000the lazy dog today\u3002")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, items) == [(1, 1, 6, 6), (3, 1, 6, 6)] == brute(rows, [(r.item_id, r.text) for r in items.collect()])


def test_no_item_of_five_to_thirty_words_is_missed(spark):
    """6,000 items, each whole in a long document."""
    words = [f"w{i * 7919 % 50021}" for i in range(50_000)]
    cut = [(k, 8 * k, 5 + k % 26) for k in range(6000)]
    items = spark.createDataFrame([(k, " ".join(words[at : at + n])) for k, at, n in cut], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words[i * 5000 : i * 5000 + 5040])) for i in range(10)], "doc_id long, text string")
    assert {i for _, i, *_ in got(docs, items)} == set(range(6000))
