import re

import xxhash

from tetraflow.llm import simhash

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = SEP.findall(text)
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=2):
    prints = [(i, brute_print(t)) for i, t in rows]
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    least = {}
    for i, p in prints:
        if i is not None:
            r = find(p)
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{p:016x}", least.get(find(p))) for i, p in prints), key=str)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_components(rows)


def test_odd_rows(spark):
    base = "the quick brown fox jumps over the lazy dog while many other words follow here"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, base), (4, base), (None, base), (5, "one"), (6, "ONE"), (7, "Ä one"), (8, "long word " * 40000)]
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, fp string, cell int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_components(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_chains_cross_tiles(spark):
    chain = [0]
    for step in range(1, 33):
        chain.append(chain[-1] | (3 << (2 * step - 2)))
    prints = [x - 2**64 if x >= 2**63 else x for x in chain] + [0x0F0F << 20]
    distinct = spark.createDataFrame([(p,) for p in prints], "fp long")
    for tile_rows in (1, 3, 2048):
        found = simhash.components(distinct, simhash.links(distinct, tile_rows=tile_rows)).collect()
        assert len(found) == 34 and len({r.comp for r in found}) == 2


def test_links_equal_brute_force_on_any_tiles(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    centres = rng.integers(0, 2**63, 30).astype("u8") * np.uint64(2)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for c in centres for _ in range(12)]
    low = [int(x) for x in rng.integers(0, 2**12, 300)]  # two of three lanes are hot
    distinct = sorted({int(c) for c in centres} | set(near) | set(low))
    root = {p: p for p in distinct}
    for radius in (1, 2, 3):
        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        root = {p: p for p in distinct}
        for i, a in enumerate(distinct):
            for b in distinct[:i]:
                if (a ^ b).bit_count() <= radius:
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        df = spark.createDataFrame([(signed(p),) for p in distinct], "fp long")
        want = {frozenset(signed(p) for p in distinct if find(p) == r) for r in {find(p) for p in distinct}}
        for tile_rows in (20, 2048):
            got = {}
            for r in simhash.components(df, simhash.links(df, radius, tile_rows)).collect():
                got.setdefault(r.comp, set()).add(r.node)
            assert {frozenset(x) for x in got.values()} == want


def test_keep_one(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(3, text, "a"), (1, text, "b"), (2, "something else entirely is here now", "c"), (None, text, "d")], "doc_id long, text string, component_id string")
    assert sorted((str(r.doc_id), r.component_id) for r in simhash.keep_one(docs).collect()) == [("1", "b"), ("2", "c"), ("None", "d")]


def test_keep_one_chooses_rows_not_ids(spark):
    one, two = " ".join(f"word{i}" for i in range(60)), " ".join(f"other{i}" for i in range(60))
    rows = [(1, one, "a"), (5, one, "b"), (5, two, "c"), (7, two, "d"), (8, "a third text that stands alone", "e"), (8, "and a fourth one that nothing else is like", "f"), (None, "null id text of its own kind", "g"), (None, "null id text of its own kind", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    assert sorted(r.tag for r in simhash.keep_one(docs).collect()) == ["a", "c", "e", "f", "g"]
