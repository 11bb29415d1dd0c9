import re
from collections import Counter

from tetraflow.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 3))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


ODD = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x x x x x", "Zwölf é\x85é \x1c q", "l\nl\r\nl\n\n l\nl", "#*$ %&| <>", "w " * 70_000, "ONE TWO " * 40]


def test_measurements_of_the_whole_table_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None if i == 3 else -i, x) for i, x in enumerate(ODD)], "doc_id long, text string")
    for df in (docs, odd):
        texts = {r.doc_id: r.text for r in df.collect()}
        rows = quality.ledger(df.withColumn("n_words", quality.F.lit("clash"))).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), r.doc_id
            base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert bool(r.failed_bits & quality.BASE) == base
    assert quality.ledger(docs.limit(0)).count() == 0


def test_policies_ablations_and_filter_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.ledger(docs).cache()
    bits = [r.failed_bits for r in rows.collect()]
    for version, mask in quality.POLICIES.items():
        kept = rows.where(quality.passes(version)).count()
        assert kept == sum(not b & mask for b in bits)
        assert quality.keep_good(docs, version).count() == kept
        for r in quality.ablations(rows, version).collect():
            bit = quality.BITS[r.rule]
            assert r.n_failed == sum(bool(b & bit) for b in bits)
            assert r.n_only_this == sum(b & mask == bit for b in bits)
            assert r.n_kept_without == kept + r.n_only_this


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    rows = quality.ledger(docs).join(labels, "doc_id").where(quality.passes("base"))
    assert rows.where(quality.passes()).count() >= 0.98 * rows.count()


def test_keep_good_passes_clashing_names_and_odd_rows(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(60))
    rows = [(1, good, 1, 2), (None, good, 3, 4), (1, good, 5, 6), (2, None, 7, 8), (3, "", 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __measures int, n_words int")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.n_words) for r in kept.collect()) == [(False, 2), (False, 6), (True, 4)]
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_the_pipeline_s_policy_keeps_good_documents_and_no_bad_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    kept = {r.quality: r.share for r in quality.ledger(docs).join(labels, "doc_id").groupBy("quality").agg(quality.F.avg(quality.passes("v3").cast("int")).alias("share")).collect()}
    assert kept[1] >= 0.99 and kept[0] <= 0.02
