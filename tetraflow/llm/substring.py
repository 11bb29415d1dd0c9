"""Substring dedup: words covered by a window of words that starts elsewhere too.

1. Texts are dealt once to blocks of bounded size by a hash of the row.
2. In each block, Rabin-Karp hashes of every window are sorted; each goes to
   its hash range as often as it starts in the block, twice at most, packed as
   byte planes of differences (about five bytes a window). A window that a
   third of all documents share costs a block two entries.
3. Each hash range counts over all blocks and answers every block with the
   hashes of its own that repeat: its candidates.
4. Candidates are verified: each block, whose texts come from the same
   exchange, hashes their words anew, by other letters and bases, and sends
   these second hashes to the range of the first, which counts and answers again.
5. Each block marks the windows that the second answer confirms, merges them
   into maximal intervals and cuts.

Windows are equal if 128 bits of two independent polynomials are, up to the
bits that name a range; words over LONG_WORD bytes enter by a keyed digest. The
numbers of blocks and ranges grow with the input. So that a packed row still
holds a hundred hashes or so, their sizes grow too, with the square root of the
input, from 4 and 8 million characters below 28 GB of text to 0.3 billion at
100 TB; within a block texts are hashed and cut a lot of 4 million characters
at a time, so only the eight bytes of each window add up.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetraflow.llm._vector import SEPARATORS, rolling, separated_by, word_hashes, word_spans

WINDOW = 35
BLOCK_CHARS = 4_000_000
RANGE_CHARS = 8_000_000
LOT_CHARS = 4_000_000
#: Characters of a block times those of a range, over those of the input: a hundred windows of under six characters.
SPREAD = 570
_SEED, _PROOF = 20_011, 40_031
_IS_WORD = separated_by(SEPARATORS)


def found(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each hash whether it is one of the sorted ``among``."""
    if not len(among):
        return np.zeros(len(x), dtype=bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def pack(x: np.ndarray) -> bytes:
    """Sorted hashes as byte planes of their differences."""
    steps = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(8, len(blob) // 8)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class Block:
    """The words of a few texts, side by side, and the windows within each text."""

    def __init__(self, texts: list[str | None], window: int) -> None:
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
        self.data = b"\n".join(raw)
        self.flat, self.window = np.frombuffer(self.data, dtype=np.uint8), window
        self.starts, self.ends = word_spans(self.flat, _IS_WORD)
        begins = np.cumsum([0, *(len(x) + 1 for x in raw)])
        self.bounds = np.searchsorted(self.starts, begins)
        n = max(0, len(self.starts) - window + 1)
        left = self.bounds[1:] - window  # the last window of each text, if it has one
        own = np.repeat(left, np.diff(self.bounds))[:n]
        self.at = np.flatnonzero(np.arange(n) <= own)

    def hashes(self, seed: int) -> np.ndarray:
        """Of every window within a text, in order."""
        return rolling(word_hashes(self.flat, self.starts, self.ends, seed), self.window, seed)[self.at]

    def covered(self, hit: np.ndarray) -> np.ndarray:
        """For each word whether one of the windows marked in ``hit`` covers it."""
        at = self.at[hit]
        depth = np.zeros(len(self.starts) + 1, dtype=np.int32)
        depth[at] += 1
        depth[at + self.window] -= 1
        return np.cumsum(depth[:-1]) > 0


def _lots(texts: list[str | None]) -> Iterator[slice]:
    """Places of the texts in lots of LOT_CHARS, or of one longer text."""
    start = chars = 0
    for i, text in enumerate(texts):
        if chars and chars + len(text or "") > LOT_CHARS:
            yield slice(start, i)
            start, chars = i, 0
        chars += len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


def _twice(x: np.ndarray) -> np.ndarray:
    """Of sorted hashes each twice at most."""
    return x if len(x) < 3 else x[np.concatenate(([True, True], x[2:] != x[:-2]))]


def _edges(n_ranges: int) -> np.ndarray:
    """Where each hash range but the first begins."""
    return np.array([(2**64 * i) // n_ranges for i in range(1, n_ranges)], dtype=np.uint64)


def _joined(blobs: pa.ChunkedArray) -> np.ndarray:
    own = [unpack(x) for x in blobs.to_pylist()]
    return np.sort(np.concatenate(own)) if own else np.empty(0, dtype=np.uint64)


def _dealt(block: int, parts: np.ndarray, blobs: list[bytes]) -> pa.Table:
    return pa.table({"part": pa.array(parts, pa.int32()), "block": pa.array([block] * len(parts), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _hasher(window: int, n_ranges: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        texts = table["text"].to_pylist()
        x = _twice(np.sort(np.concatenate([Block(texts[lot], window).hashes(_SEED) for lot in _lots(texts)])))
        cuts = np.array([0, *np.searchsorted(x, _edges(n_ranges)), len(x)])
        full = np.flatnonzero(np.diff(cuts))
        return _dealt(table["block"][0].as_py(), full, [pack(x[cuts[i] : cuts[i + 1]]) for i in full])

    return run


def _prover(window: int, n_ranges: int) -> Callable:
    """Second hashes of the windows whose first hash is a candidate, to the first hash's range."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        candidates, texts = _joined(answers["blob"]), docs["text"].to_pylist()
        parts, proofs = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
        for lot in _lots(texts) if len(candidates) else ():
            block = Block(texts[lot], window)
            first = block.hashes(_SEED)
            hit = np.flatnonzero(found(first, candidates))
            if len(hit):
                parts.append(np.searchsorted(_edges(n_ranges), first[hit], side="right"))
                proofs.append(block.hashes(_PROOF)[hit])
        part, proof = np.concatenate(parts), np.concatenate(proofs)
        order = np.lexsort((proof, part))
        part, proof = part[order], proof[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.array([0])
        blobs = [pack(_twice(proof[a:b])) for a, b in zip(cuts, cuts[1:])]
        return _dealt(docs["block"][0].as_py() if docs.num_rows else -1, part[cuts[:-1]], blobs)

    return run


def _counter(table: pa.Table) -> pa.Table:
    blocks, arrays = table["block"].to_pylist(), [unpack(x) for x in table["blob"].to_pylist()]
    every = np.sort(np.concatenate(arrays))
    repeated = np.unique(every[1:][every[1:] == every[:-1]])
    out_blocks, out_blobs = [], []
    for block, own in zip(blocks, arrays):
        hit = np.unique(own[found(own, repeated)])
        if len(hit):
            out_blocks.append(block)
            out_blobs.append(pack(hit))
    return pa.table({"block": pa.array(out_blocks, pa.int64()), "blob": pa.array(out_blobs, pa.binary())})


def _cutter(window: int, keep_text: bool) -> Callable:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        repeated = _joined(answers["blob"])
        texts = docs["text"].to_pylist()
        kept_text, spans, words, removed, digests = [], [], [], [], []
        for lot in _lots(texts):
            block = Block(texts[lot], window)
            gone = block.covered(found(block.hashes(_PROOF), repeated)) if len(repeated) else np.zeros(len(block.starts), dtype=bool)
            total = np.concatenate(([0], np.cumsum(gone)))
            for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist()):
                out = int(total[b] - total[a])
                if out:
                    here = np.flatnonzero(~gone[a:b]) + a
                    text = b" ".join([block.data[s:e] for s, e in zip(block.starts[here].tolist(), block.ends[here].tolist())])
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:b], [False])))).tolist()
                else:
                    text, edges = b" ".join(block.data[block.starts[a] : block.ends[b - 1]].split()) if b > a else b"", []
                words.append(b - a)
                removed.append(out)
                digests.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    kept_text.append(text.decode("utf-8", "surrogatepass"))
                    spans.append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])])
        out = {"doc_id": docs["doc_id"], "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if keep_text:
            out |= {"kept_text": pa.array(kept_text, pa.string()), "removed_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_chars: int | None = None, range_chars: int | None = None, keep_text: bool = True) -> DataFrame:
    """Per row of ``docs`` what is left when repeated windows of words go.

    Columns: doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``,
    kept_text and removed_spans (maximal intervals of word positions, end
    exclusive). Needs doc_id and text; other columns are ignored. Null and
    empty texts have no words. Texts shorter than the window lose nothing.
    Repeated rows are documents of their own, so each removes the other's
    windows; a null doc_id is carried through. An empty table gives no rows.
    A text is never cut: the largest task holds the texts of one block, which
    passes ``block_chars`` only by chance of the hash or by a longer text.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    grown = math.isqrt(SPREAD * chars)
    block_chars, range_chars = block_chars or max(BLOCK_CHARS, grown), range_chars or max(RANGE_CHARS, grown)
    n_blocks, n_ranges = max(1, -(-chars // block_chars)), max(1, -(-chars // range_chars))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))).repartition("block")
    hashed = dealt.groupBy("block").applyInArrow(_hasher(window, n_ranges), "part int, block long, blob binary")
    count = lambda sent: sent.groupBy("part").applyInArrow(_counter, "block long, blob binary")
    proofs = dealt.groupBy("block").cogroup(count(hashed).groupBy("block")).applyInArrow(_prover(window, n_ranges), "part int, block long, blob binary")
    answers = count(proofs)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if keep_text:
        schema += ", kept_text string, removed_spans array<struct<start: long, end: long>>"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_cutter(window, keep_text), schema)
