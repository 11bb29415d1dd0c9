"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

1. Each text's fingerprint is computed where the text is read; only
   (doc_id, fingerprint) goes on, staged once in the shared folder.
2. Fingerprints within the radius agree in whole in one of radius + 1 bit
   lanes, so each distinct one is dealt once for each lane, by the lane's bits.
   What meets there is a tile; it is compared in full with exclusive-or and bit
   counts, in the order of population counts, as far as these differ by the
   radius or less.
3. A lane's bits that more than TILE_ROWS fingerprints share are cut into tiles
   by the population counts of the other lanes, and by hash where one is still
   too large. Flipping a bit changes a count by one, so two tiles can hold a
   link only if their counts differ by the radius or less in sum; all other
   tile pairs are skipped unread.
4. A tile, or pair of tiles, yields stars that connect what it links, so the
   links of a large group never grow with its square.
5. Components by local contraction and alternating stars, each round staged.

Tiles stay small as fingerprints grow in number, as a lane has 2**21 values.
Skew: copies collapse to one fingerprint before anything is dealt; a hot lane
goes by tile pairs of bounded size. Nothing is broadcast by force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetraflow.llm._shared import slices, stage, unused
from tetraflow.operators.components import components, merged

RADIUS = 2
SHINGLE = 3
TILE_ROWS = 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ASCII = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"\x20\x20\x20\x20\x20")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; 0 for null, empty and wordless ones."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    width = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    first, last = starts[:n].tolist(), ends[width - 1 :].tolist()
    for at in range(0, n, 65536):  # bounds the bit matrix of a very long text
        to = min(n, at + 65536)
        hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(first[at:to], last[at:to])), dtype="<u8", count=to - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    set_bits = np.flatnonzero(counts * 2 > n)
    return int(np.bitwise_or.reduce(np.uint64(1) << set_bits.astype(np.uint64))) if len(set_bits) else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp): the row's key, and the fingerprint as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            values = np.array([fingerprint(x, shingle) for x in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["doc_id", "row", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row"), "text").mapInArrow(run, "doc_id long, row string, fp long")


def _bits(radius: int) -> list[tuple[int, int]]:
    """(first, width) of radius + 1 lanes that make up the 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _lane(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit(2**width - 1 if width < 64 else -1).cast("long"))


def _offsets(n: int, radius: int) -> list[tuple[int, ...]]:
    """All differences of n counts whose absolute values sum to the radius or less."""
    found = [()]
    for _ in range(n):
        found = [(*o, d) for o in found for d in range(-radius, radius + 1) if sum(map(abs, o)) + abs(d) <= radius]
    return found


def _stars(fps: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    leaf = np.flatnonzero(label != np.arange(len(fps)))
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (fps[leaf], fps[label[leaf]])], ["a", "b"])


def within_tiles(tile: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Of each place the least one linked to it, where ``tile`` (sorted, as are the population counts in a tile) is the same."""
    label, counts = np.arange(len(fps)), np.bitwise_count(fps).astype(np.int16)
    near, step = np.arange(len(fps)), 0
    while True:
        step += 1
        near = near[near + step < len(fps)]
        near = near[(tile[near + step] == tile[near]) & (counts[near + step] - counts[near] <= radius)]
        if not len(near):
            return label
        hit = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= radius]
        if len(hit):
            label = merged(label, hit, hit + step)


def between(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Labels, as above, of the places of a and then b, by the links between the two."""
    label, step = np.arange(len(a) + len(b)), max(1, 4_000_000 // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        if len(i):
            label = merged(label, i + at, j + len(a))
    return label


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links that connect every two fingerprints within ``radius`` bits.

    ``distinct`` has the column fp, each value once. Links are the stars of a
    tile or pair of tiles: they connect what is linked there, no component is
    lost, and none is joined that no links join.
    """
    lanes = _bits(radius)
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("lane"), _lane(F.col("fp"), *x).alias("bits")) for i, x in enumerate(lanes)]))
    dealt = stage(distinct.select("fp", each), "simhash-lanes")
    hot = dealt.groupBy("lane", "bits").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows).select("lane", "bits")
    hot = stage(hot, "simhash-hot")
    usual = dealt.join(hot, ["lane", "bits"], "left_anti").repartition("lane", "bits").sortWithinPartitions("lane", "bits", F.bit_count("fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty((3, 0), dtype=np.int64)]
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]))
            rows = np.concatenate(held, axis=1)
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            whole = int(new[-1]) if len(new) else 0  # the last tile may go on in the next batch
            held = [rows[:, whole:]]
            yield compared(rows[:, :whole])
        yield compared(held[0])

    def compared(rows: np.ndarray) -> pa.RecordBatch:
        tile = np.cumsum((np.diff(rows[0], prepend=-1) != 0) | (np.diff(rows[1], prepend=-1) != 0))
        fps = np.ascontiguousarray(rows[2]).view(np.uint64)
        return _stars(fps, within_tiles(tile, fps, radius))

    found = usual.select("lane", "bits", "fp").mapInArrow(run, "a long, b long")
    return found.union(_hot_links(dealt.join(hot, ["lane", "bits"], "left_semi"), lanes, radius, tile_rows))


def _hot_links(rows: DataFrame, lanes: list[tuple[int, int]], radius: int, tile_rows: int) -> DataFrame:
    """(a, b) of the lanes whose bits too many share: tiles by the other lanes' population counts, pairs of tiles as rows."""
    counts = [f"p{i}" for i in range(len(lanes))]
    own = [F.when(F.col("lane") == i, 0).otherwise(F.bit_count(_lane(F.col("fp"), *x))).cast("int").alias(c) for i, (c, x) in enumerate(zip(counts, lanes))]
    cells = rows.select("lane", "bits", "fp", *own)
    cell = ["lane", "bits", *counts]
    sizes = stage(cells.groupBy(*cell).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles")), "simhash-cells")
    cut = cells.join(sizes, cell).withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    tiles = stage(cut.groupBy(*cell, "tile").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "simhash-tiles")

    moves = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip(counts, o)]) for o in _offsets(len(lanes), radius)]))
    near = tiles.select(*cell, "tile", "fps", moves.alias("move"))
    near = near.select("lane", "bits", *[(F.col(c) + F.col(f"move.{c}")).alias(c) for c in counts], F.struct(*counts).alias("from"), F.col("tile").alias("tile_a"), F.col("fps").alias("fps_a"))
    to = F.struct(*counts)
    near = near.where(to >= F.col("from")).join(sizes, cell).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    near = near.where((to > F.col("from")) | (F.col("tile") >= F.col("tile_a")))
    pairs = near.join(tiles, [*cell, "tile"]).select("fps_a", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = (z.values.to_numpy(zero_copy_only=False).view(np.uint64) for z in (x, y))
                yield _stars(np.concatenate((a, b)), between(a, b, radius))

    return pairs.mapInArrow(run, "a long, b long")


def _row_key() -> Column:
    """What tells rows apart: 128 bits of doc_id and text. A null text counts as empty."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))


def _classes(docs: DataFrame, radius: int, shingle: int) -> DataFrame:
    """(doc_id, row, fp, root, component_id, copies) for every row; root names the component by a fingerprint."""
    prints = stage(fingerprints(docs, shingle), "simhash-prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    nodes = stage(nodes, "simhash-nodes")
    rooted = nodes.join(components(nodes.select("fp"), links(nodes.select("fp"), radius)).toDF("fp", "root"), "fp")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "root", "component_id", "copies"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies) for every row of ``docs``.

    Needs columns doc_id and text, others are ignored. Null, empty and
    wordless texts have fingerprint zero, which links like any other.
    Repeated rows stay, each with its class. Ties need no rule: the component
    is named by the smallest doc_id in it, nulls aside (null if it has none).
    An empty table gives an empty result. ``copies`` counts the rows with the
    same fingerprint.
    """
    return _classes(docs, radius, shingle).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: the smallest doc_id's.

    The choice falls on a row, by doc_id and text, so a doc_id that stands on
    several texts keeps each that is its component's first; of texts with the
    same doc_id in one component the smallest key's stays. Rows with a null
    doc_id are compared among themselves: one of each component stays beside
    the named one, as no row names them.
    """
    classes = _classes(docs, radius, shingle)
    (key,) = unused(docs, "__row")
    first = classes.groupBy("root", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "row"))["row"].alias(key))
    keyed = docs.withColumn(key, _row_key())
    return keyed.join(first.select(key), key, "left_semi").dropDuplicates([key]).select(*docs.columns)
