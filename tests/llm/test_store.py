import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tetraflow.llm import store

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    whole = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = (whole.encode(text, add_special_tokens=False).ids if text else []) + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(spark, docs, tmp_path, name):
    path = store.write(docs, PATH, path=f"{tmp_path}/{name}")
    return path, sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in store.verify(spark, path).collect()), key=lambda r: r[1])


def test_whole_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path, got = read(spark, docs, tmp_path, "a")
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])
    chunks = spark.read.parquet(f"{path}/chunks").where("ids is not null")
    assert chunks.count() == chunks.select("digest").distinct().count()
    stored = sum(len(r.ids) for r in chunks.collect())
    assert stored < 2 * sum(n for _, _, n, _ in got)  # copies share their chunks
    for r in store.reconstruct(spark, path).collect():
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert (r.doc_id, r.start, len(ids), zlib.crc32(ids)) in got


def test_odd_rows(spark, tmp_path):
    rows = [(5, None), (2, ""), (3, "one two"), (6, "a<|endoftext|>b"), (None, "null id"), (4, "long text " * 30_000)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, row int")
    assert read(spark, docs, tmp_path, "b")[1] == expected(rows)
    twice = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string")
    assert read(spark, twice, tmp_path, "c")[1] == expected([(1, "same"), (1, "same")])
    assert read(spark, docs.limit(0), tmp_path, "d")[1] == []


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text"), (2, "other text")], "doc_id long, text string")
    path = store.write(docs, PATH, path=f"{tmp_path}/e")
    chunks = spark.read.parquet(f"{path}/chunks").where("ids is not null").collect()
    spark.createDataFrame([(r.digest, bytes(r.ids)[::-1]) for r in chunks], "digest binary, ids binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        store.verify(spark, path).collect()


def test_cuts_follow_content():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_000, 20_000).astype("<u2")
    ends = store.cut(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= store.MOST and sizes[:-1].min() >= store.LEAST
    moved = np.concatenate((rng.integers(0, 50_000, 777).astype("<u2"), ids))
    chunks = lambda x: {x[a:b].tobytes() for a, b in zip([0, *store.cut(x)], store.cut(x))}
    assert len(chunks(ids) & chunks(moved)) > 0.8 * len(ends)
    parts = [ids[a:b].astype("<u4") for a, b in zip([0, *ends], ends)]
    got = store.join_crcs(np.array([zlib.crc32(p) for p in parts]), np.array([4 * len(p) for p in parts]), np.array([0, 3]))
    assert got.tolist() == [zlib.crc32(np.concatenate(parts[:3])), zlib.crc32(np.concatenate(parts[3:]))]


def test_neighbours_do_not_change_a_document_s_cuts():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 50_000, n).astype("<u2") for n in (5000, 1, 63, 64, 65, 1024, 1025, 3000)]
    bounds = np.cumsum([0, *map(len, docs)]).tolist()
    for doc, at, ends in zip(docs, bounds, store.cuts(np.concatenate(docs), bounds)):
        assert [e - at for e in ends] == store.cut(doc)


def test_merkle_roots_tell_order_and_number():
    a, b, c = b"a", b"b", b"c"
    assert len({store.merkle(x) for x in ([], [a], [a, b], [b, a], [a, b, c], [a, b, b])}) == 6


def test_lost_recipes_are_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    path = store.write(docs, PATH, path=f"{tmp_path}/lost")
    recipes = spark.read.parquet(f"{path}/recipes")
    rows, schema = recipes.collect(), recipes.schema
    for kept in ([r for r in rows if r.doc_id != 3], [r for r in rows if r.file != rows[0].file]):
        spark.createDataFrame(kept, schema).write.mode("overwrite").parquet(f"{path}/recipes")
        with pytest.raises(ValueError, match="manifest"):
            store.verify(spark, path)


def test_a_lost_manifest_row_or_an_altered_root_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    path = store.write(docs, PATH, path=f"{tmp_path}/rows")
    manifest = spark.read.parquet(f"{path}/manifest")
    rows, schema = [r.asDict() for r in manifest.collect()], manifest.schema
    for kept in (rows[1:], [rows[0] | {"root": "0" * 64}, *rows[1:]], [rows[0] | {"n_docs": 99}, *rows[1:]]):
        spark.createDataFrame(kept, schema).write.mode("overwrite").parquet(f"{path}/manifest")
        with pytest.raises(ValueError, match="manifest"):
            store.verify(spark, path)


def test_a_lost_chunk_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    path = store.write(docs, PATH, path=f"{tmp_path}/chunk")
    chunks = spark.read.parquet(f"{path}/chunks")
    kept, schema = chunks.where("ids is not null").collect()[1:], chunks.schema
    spark.createDataFrame(kept, schema).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="does not have"):
        store.verify(spark, path).collect()


def test_words_before_a_comma_take_no_general_path(monkeypatch):
    import public_tokenizers

    from tetraflow.llm._tokens import Encoder

    coder, text = Encoder(public_tokenizers.path("byte_bpe_50k.json")), "alpha, beta gamma. Äpfel, x.\nnext, ü."
    monkeypatch.setattr(coder, "line_break", coder.fresh("\n"))
    coder.at_start["."], coder.at_start[","] = coder.fresh("."), coder.fresh(",")
    wanted = coder.whole.encode(text, add_special_tokens=False).ids
    met, fresh = [], coder.fresh
    monkeypatch.setattr(coder, "fresh", lambda x: met.append(x) or fresh(x))
    assert coder.encode(text).tolist() == wanted
    assert not [x for x in met if x[-1] in ".,"]
