import hashlib
import re
from collections import Counter

from tetraflow.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    counts = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(substring.remove_repeats(docs, block_chars=50_000, range_chars=100_000)) == brute(rows, 35)


def test_odd_rows(spark):
    run = " ".join(f"w{i}" for i in range(9))
    rows = [(1, None), (2, ""), (3, "a b"), (4, run), (4, run), (None, "\x0bx " + run + " y\n"), (5, "é " * 30), (6, "z\x85z\xa0q " * 3), (7, "k " * 50_000), (8, run.replace(" ", "\x1c"))]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, block int, blob string")
    for window in (1, 2, 4, 7, 35):
        assert got(substring.remove_repeats(docs, window=window, block_chars=20_000)) == brute(rows, window)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_lots_of_a_block_change_nothing(spark, monkeypatch):
    texts = ["a b", None, "c" * 30, "", "d e f", "g" * 9]
    monkeypatch.setattr(substring, "LOT_CHARS", 10)
    lots = [texts[x] for x in substring._lots(texts)]
    assert [t for lot in lots for t in lot] == texts and len(lots) == 4 and list(substring._lots([])) == []


def test_spans_are_maximal(spark):
    docs = spark.createDataFrame([(1, "p q a b c d e r"), (2, "a b c d e"), (3, "z z y")], "doc_id long, text string")
    spans = {r.doc_id: [(s.start, s.end) for s in r.removed_spans] for r in substring.remove_repeats(docs, window=3).collect()}
    assert spans == {1: [(2, 7)], 2: [(0, 5)], 3: []}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_confuse_are_told_apart(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"x {one[:32]} {rest}"), (4, f"x {other[:32]} {rest}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substring.remove_repeats(docs)) == brute(rows, 35) and not any(r[2] for r in brute(rows, 35))


def test_colliding_first_hashes_are_told_apart_by_the_second(monkeypatch):
    """The four steps in one process, with first hashes of three bits."""
    import numpy as np
    import pyarrow as pa

    whole = substring.Block.hashes
    monkeypatch.setattr(substring.Block, "hashes", lambda self, seed: whole(self, seed) & np.uint64(7 << 61 if seed == substring._SEED else 2**64 - 1))
    rows = [(i, " ".join(f"w{(i * 7 + j * 13) % 40}" for j in range(30))) for i in range(12)] + [(12, "w0 w13 w26 q w0 w13 w26")]
    blocks = [pa.table({"doc_id": [r[0] for r in rows[b::3]], "text": [r[1] for r in rows[b::3]], "block": [b] * len(rows[b::3])}) for b in range(3)]

    def counted(sent):
        every = pa.concat_tables(sent)
        out = [substring._counter(every.filter(pa.compute.equal(every["part"], p))) for p in every["part"].unique()]
        every = pa.concat_tables(out)
        return [every.filter(pa.compute.equal(every["block"], b)) for b in range(3)]

    hashed = counted([substring._hasher(3, 4)(x) for x in blocks])
    assert sum(map(len, hashed)) > 0
    proven = counted([substring._prover(3, 4)(x, y) for x, y in zip(blocks, hashed)])
    done = pa.concat_tables([substring._cutter(3, True)(x, y) for x, y in zip(blocks, proven)])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in done.to_pylist()), key=str) == brute(rows, 3)


def test_packed_hashes_come_back():
    import numpy as np

    x = np.sort(np.random.default_rng(5).integers(0, 2**63, 3000).astype("u8") * np.uint64(2))
    assert (substring.unpack(substring.pack(x)) == x).all() and len(substring.unpack(substring.pack(x[:0]))) == 0
    doubled = np.sort(np.concatenate([x, x, x[:9]]))
    assert (substring._twice(doubled) == np.sort(np.concatenate([x, x]))).all()
    assert substring.found(doubled, x[::2]).tolist() == [v in set(x[::2].tolist()) for v in doubled.tolist()]
