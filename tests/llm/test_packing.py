import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tetraflow.llm import packing
from tetraflow.llm._tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 25))
@settings(max_examples=150, deadline=None)
def test_closest_is_the_best_sub_multiset(counts, target):
    best = 0
    for used in itertools.product(*(range(n + 1) for n in counts.values())):
        total = sum(k * n for k, n in zip(counts, used))
        best = max(best, total if total <= target else 0)
    got = packing.closest(counts, target)
    assert all(0 < n <= counts[k] for k, n in got.items())
    assert sum(k * n for k, n in got.items()) == best


@given(st.lists(st.integers(1, 70), max_size=30))
@settings(max_examples=150, deadline=None)
def test_plan_covers_every_position_once_without_padding(lengths):
    seen = Counter()
    for sequence in packing.plan(lengths, 16):
        total = sum(n for _, _, n in sequence)
        assert total == 16 or total & (total - 1) == 0
        for item, start, n in sequence:
            seen.update((item, start + i) for i in range(n))
    assert seen == Counter((i, k) for i, n in enumerate(lengths) for k in range(n))


@pytest.fixture(scope="module")
def whole():
    out = Tokenizer.from_file(PATH)
    return out


def test_encoder_equals_the_library(spark, whole):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["", " ", "\n", "a  b", "a\n\nb", "a \n b ", "\ta\tb", "<|endoftext|>x", "a<|endoftext|>b", " <|endoftext|> <|endoftext|>", "<|endoftext", "it's we'll 'S", "x²½ 　y z \x1c \x85", "\U0001f600 नमस्ते", "1 234 5,6", "q" * 5000]
    own = Encoder(PATH)
    for text in texts:
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert own.encode(None).tolist() == []


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library_on_any_text(text):
    own, library = _both()
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_line_that_ends_in_a_blank():
    own, library = _both()
    for text in (" ", "word ", "one \ntwo", "\none. ", "a , b .c ", ". a"):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet="ab \n\t\x0b\x1c\x85\xa0\u2003\u3000\u200b", max_size=8))
@settings(max_examples=500, deadline=None)
def test_blanks_that_meet_are_seen(text):
    from tetraflow.llm import _tokens

    assert _tokens._blanks_meet(text) == bool(_tokens._TWO_BLANKS.search(text))


_KEPT = []


def _both():
    if not _KEPT:
        library = Tokenizer.from_file(PATH)
        _KEPT.append((Encoder(PATH), library))
    return _KEPT[0]


def check(docs, whole, **options):
    rows = packing.pack(docs, PATH, **options).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append((whole.encode(r.text or "", add_special_tokens=False).ids if r.text else []) + [1])
    ids, sequences = Counter(), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert any(r.ids == x[r.start : r.start + r.length] and r.doc_tokens == len(x) for x in texts[r.doc_id])
        ids[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert ids == Counter({d: sum(map(len, x)) for d, x in texts.items()})
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_whole_table_round_trip(spark, whole):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), whole, group_tokens=60_000)


def test_odd_rows(spark, whole):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "null id"), (4, "long " * 30_000)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, ids string")
    check(docs, whole)
    assert packing.pack(docs.limit(0), PATH).count() == 0
