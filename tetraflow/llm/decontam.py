"""Benchmark decontamination: size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity to it, which
no MinHash threshold finds. So items are partitioned by size, geometrically,
and for each size class documents are seen as overlapping windows about as
long as the class's items: an item that stands in a document fills a good part
of some window. With Jaccard similarity s of window and item, K independent
minima miss with probability (1 - s)**K; an item of which 0.8 stands in one
place has s of 0.19 at least, so K = 64 misses one in 700,000. That holds from
five shingles on; shorter items must be there whole and are looked up exactly,
by the hashes of their shingles among all of a document's.

1. Each item's K minimum hashes over its shingles (five words) form its
   signature; a block of items, bounded in number, is what a pass compares.
2. Documents are read once per block of items, in no shuffle: shingle hashes,
   then for each of K permutations the minima of runs of shingles. Longer
   windows take their minima from shorter ones. A window whose minimum is in
   some item's signature is a candidate.
3. Candidates are verified by exact containment: the share of the item's
   distinct shingles, as text, that the whole document has.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetraflow.llm._shared import slices
from tetraflow.llm._vector import rolling, word_hashes, word_spans

SHINGLE, CONTAINMENT, MINIMA = 5, 0.8, 64
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 20_000_000
LEAST_RUN = 8
EXACT_SHINGLES = 4
BATCH_CHARS = 600_000
_SEED = 31_337
_LEAST_BITS, _MOST_BITS = 12, 18
_IS_WORD = np.array([1 if chr(b).isalnum() and b < 128 or b >= 128 else 0 for b in range(256)], dtype=np.int8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_SALT = np.random.Generator(np.random.PCG64(_SEED)).integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _unglued(flat: np.ndarray) -> np.ndarray:
    """UTF-8 with blanks in place of U+0080 to U+00BF, U+2000 to U+206F and U+3000 to U+303F: quotes, dashes, spaces and signs."""
    data = flat.tobytes()
    if b"\xc2" in data:
        at = np.flatnonzero(flat == 0xC2)
        flat[at] = flat[at + 1] = 0x20
    for lead, second, last in ((0xE2, 0x80, 0xBF), (0xE2, 0x81, 0xAF), (0xE3, 0x80, 0xBF)):
        if bytes((lead, second)) in data:
            at = np.flatnonzero(flat[:-2] == lead)
            at = at[(flat[at + 1] == second) & (flat[at + 2] <= last)]
            flat[at] = flat[at + 1] = flat[at + 2] = 0x20
    return flat


class Texts:
    """Texts side by side: words (runs of ASCII letters and digits and of characters that are no sign, lower-cased) and shingles."""

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
        flat = _unglued(_LOWER[np.frombuffer(b"\n".join(raw), dtype=np.uint8)])
        self.data = flat.tobytes()
        self.starts, self.ends = word_spans(flat, _IS_WORD)
        self.bounds = np.searchsorted(self.starts, np.cumsum([0, *(len(x) + 1 for x in raw)]))
        self.shingles = rolling(word_hashes(flat, self.starts, self.ends, _SEED), SHINGLE, _SEED)
        self.counts = np.maximum(0, np.diff(self.bounds) - SHINGLE + 1)  # shingles of each text

    def own(self, i: int) -> np.ndarray:
        """Hashes of the shingles of text i."""
        return self.shingles[self.bounds[i] : self.bounds[i] + self.counts[i]]

    def exact(self, i: int) -> set[bytes]:
        """The shingles of text i, as text."""
        at, n = int(self.bounds[i]), int(self.counts[i])
        a, b = self.starts[at : at + n + SHINGLE].tolist(), self.ends[at : at + n + SHINGLE].tolist()
        words = [self.data[x:y] for x, y in zip(a, b)]
        return {b" ".join(words[j : j + SHINGLE]) for j in range(n)}


class Runs:
    """The shingles of texts in runs of LEAST_RUN, and longer runs over those; no run crosses texts."""

    def __init__(self, texts: Texts, lengths: list[int]) -> None:
        full = np.flatnonzero(texts.counts)
        blocks = -(-texts.counts[full] // LEAST_RUN)
        self.text = np.repeat(full, blocks)  # of each shortest run
        last = np.repeat(texts.bounds[full] + texts.counts[full] - 1, blocks)
        within = np.arange(len(self.text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = np.repeat(texts.bounds[full], blocks) + within * LEAST_RUN
        # a text's last run repeats its last shingle, which changes no minimum
        self.shingles = texts.shingles[np.minimum(first + np.arange(LEAST_RUN)[:, None], last)]
        self.levels = {}
        for run in lengths:
            starts = np.flatnonzero(within % (run // LEAST_RUN) == 0)
            owner = self.text[starts]
            self.levels[run] = starts, owner, np.flatnonzero(owner[:-1] == owner[1:])


def permuted(shingles: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of each shingle."""
    return (shingles ^ _SALT[k]) * _SALT[k - 1]


class Items:
    """A block of items: shingle sets, and signatures by size class."""

    def __init__(self, rows: list[tuple[int, str | None]], minima: int) -> None:
        self.ids, self.sets, self.minima = [], [], minima
        self.short: dict[int, list[int]] = defaultdict(list)
        self.by_minimum: dict[int, list[dict[int, list[int]]]] = {}
        texts = Texts([t for _, t in rows])
        for i, (item_id, _) in enumerate(rows):
            if not texts.counts[i]:
                continue
            number = len(self.ids)
            self.ids.append(item_id)
            self.sets.append(texts.exact(i))
            if len(self.sets[-1]) <= EXACT_SHINGLES:
                for one in set(texts.own(i).tolist()):  # any of them, as a lower containment may ask for only one
                    self.short[one].append(number)
                continue
            tables = self.by_minimum.setdefault(self.run_of(len(self.sets[-1])), [defaultdict(list) for _ in range(minima)])
            for k in range(minima):
                tables[k][int(permuted(texts.own(i), k).min())].append(number)
        # a filter before the tables, by the leading bits of a minimum; small, so that it stays in the processor's cache
        self.shift = np.uint64(64 - min(_MOST_BITS, max(_LEAST_BITS, (64 * len(self.ids)).bit_length())))
        self.bitmaps = {run: np.stack([self._bitmap(t) for t in tables]) for run, tables in self.by_minimum.items()}
        self.short_bits = self._bitmap(self.short)

    @staticmethod
    def run_of(size: int) -> int:
        """Half a window of the item's class: some window of two runs holds an item of at most that many shingles whole."""
        return max(LEAST_RUN, 1 << (size - 1).bit_length())

    def _bitmap(self, table: dict[int, list[int]]) -> np.ndarray:
        out = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        out[np.fromiter(table, dtype=np.uint64, count=len(table)) >> self.shift] = True
        return out

    def candidates(self, texts: Texts) -> dict[int, set[int]]:
        """For each text the numbers of the items whose signature shares a minimum with a window of their class."""
        found: dict[int, set[int]] = defaultdict(set)
        if self.short and len(texts.shingles):
            for at in np.flatnonzero(self.short_bits[texts.shingles >> self.shift]).tolist():
                hit = self.short.get(int(texts.shingles[at]))
                if hit:
                    i = int(np.searchsorted(texts.bounds, at, side="right")) - 1
                    if at < texts.bounds[i] + texts.counts[i]:  # else it crosses into the next text
                        found[i].update(hit)
        if not self.by_minimum:
            return found
        runs = Runs(texts, sorted(self.by_minimum))
        if not len(runs.text):
            return found
        for k in range(self.minima):
            shortest = np.minimum.reduce(permuted(runs.shingles, k), axis=0)
            for run, (starts, owner, paired) in runs.levels.items():
                windows = shortest.copy() if run == LEAST_RUN else np.minimum.reduceat(shortest, starts)
                windows[paired] = np.minimum(windows[paired], windows[paired + 1])
                table = self.by_minimum[run][k]
                for at in np.flatnonzero(self.bitmaps[run][k][windows >> self.shift]).tolist():
                    hit = table.get(int(windows[at]))
                    if hit:
                        found[int(owner[at])].update(hit)
        return found

    def matches(self, batch: list[str | None], containment: float) -> Iterator[tuple[int, int, int, int]]:
        """(place in the batch, item_id, shared, size) of contained items, verified exactly."""
        texts = Texts(batch)
        for i, candidates in sorted(self.candidates(texts).items()):
            there = texts.exact(i)
            for number in sorted(candidates):
                shared, size = len(there & self.sets[number]), len(self.sets[number])
                if shared >= containment * size:
                    yield i, self.ids[number], shared, size


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts in lots of about BATCH_CHARS."""
    ids, texts, held = [], [], 0
    for batch in slices(batches, 256):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc_id)
            texts.append(text)
            held += len(text or "")
            if held >= BATCH_CHARS:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, minima: int = MINIMA, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment): items contained in documents.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other
    columns are ignored. Null, empty and texts of fewer than five words have
    no shingle and match nothing, on either side. Repeated documents and items
    match each for itself; null ids are carried. Either table empty gives no
    rows. The benchmark goes out in blocks of ``block_items`` items (and BLOCK_CHARS
    characters, or one longer item), one pass over the documents for each, so that what a task holds stays bounded.
    """
    names = ["doc_id", "item_id", "n_shared", "n_shingles", "containment"]
    types = [pa.int64()] * 4 + [pa.float64()]
    schema = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def one_pass(rows: list[tuple[int, str | None]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        made: list[Items] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(Items(sent.value, minima))
            for ids, texts in _by_length(batches):
                rows = [(ids[i], item, n, size, n / size) for i, item, n, size in made[0].matches(texts, containment)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        return base.mapInArrow(run, schema)

    out = None
    for block in _blocks(benchmark, block_items):
        done = one_pass(block)
        out = done if out is None else out.unionAll(done)
    return out


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks bounded by number and characters; one empty block if there are none."""
    block: list[tuple[int, str | None]] = []
    chars, some = 0, False
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append((row[0], row[1]))
        chars += len(row[1] or "")
        if len(block) == block_items or chars >= BLOCK_CHARS:
            yield block
            block, chars, some = [], 0, True
    if block or not some:
        yield block


def keep_clean(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is contained.

    Each row is judged by its own text, whatever its doc_id: rows that share a
    doc_id, or have none, go or stay each for itself.
    """
    at = docs.columns.index("text")

    def one_pass(left: DataFrame, rows: list[tuple[int, str | None]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        made: list[Items] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(Items(sent.value, MINIMA))
            for batch in slices(batches, 256):
                texts = batch.column(at).to_pylist()
                ends = np.cumsum([len(x or "") for x in texts]) // BATCH_CHARS
                cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
                for a, b in zip(cuts, cuts[1:]):
                    hit = {i for i, *_ in made[0].matches(texts[a:b], containment)}
                    yield batch.slice(a, b - a).filter(pa.array([i not in hit for i in range(b - a)], pa.bool_()))

        return left.mapInArrow(run, left.schema)

    for block in _blocks(benchmark, block_items):
        docs = one_pass(docs, block)
    return docs
