"""Sequence packing by minimum bin slack.

Texts are tokenised where they are read and packed in groups of a few million
tokens: no shuffle, and each group is close to full by itself. Whole windows
of a long document are sequences of their own. What remains of each document
is an item; the items of a group are a multiset of lengths. Each sequence takes
the longest item left and, by subset-sum dynamic programming over a bit set,
the sub-multiset of the others that brings it closest to capacity; the counts
are read back from the saved bit sets. If slack is left, the next item is cut
to fill it. The last, partly filled sequence of a group is cut into parts whose
lengths are powers of two, which need no padding either.

A retried task repeats its whole partition, so its pieces stay consistent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetraflow.llm._shared import slices
from tetraflow.llm._tokens import encoder

CAPACITY = 2048
END_ID = 1
GROUP_TOKENS = 2_000_000
#: Numbers of sequences that one partition can name.
PARTITION_SEQUENCES = 2**36


def closest(counts: dict[int, int], target: int) -> dict[int, int]:
    """The sub-multiset of ``counts`` (length: how many) whose sum is closest to ``target`` from below.

    Lengths enter from the longest; a length that may be used k times enters
    in powers of two, so each needs log k shifts of a bit set. It stops at the
    first exact fill.
    """
    mask, goal = (1 << (target + 1)) - 1, 1 << target
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= target), reverse=True):
        left, size = min(counts[length], target // length), 1
        while left and not reach & goal:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, size = left - take, size * 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start in the item, length); each position of an item in exactly one."""
    bins: list[list[tuple[int, int, int]]] = []
    open_items: dict[int, list[tuple[int, int]]] = {}
    counts: dict[int, int] = {}

    def put(item: int, start: int, length: int) -> None:
        open_items.setdefault(length, []).append((item, start))
        counts[length] = counts.get(length, 0) + 1

    def take(length: int) -> tuple[int, int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return (*open_items[length].pop(), length)

    for item, length in enumerate(lengths):
        whole = length // capacity * capacity
        bins += [[(item, at, capacity)] for at in range(0, whole, capacity)]
        if length > whole:
            put(item, whole, length - whole)
    while counts:
        chosen = [take(max(counts))]
        slack = capacity - chosen[0][2]
        for length, n in closest(counts, slack).items():
            chosen += [take(length) for _ in range(n)]
            slack -= length * n
        while slack and counts:
            item, start, length = take(max(counts))
            used = min(slack, length)
            chosen.append((item, start, used))
            if length > used:
                put(item, start + used, length - used)
            slack -= used
        bins.append(chosen)
        if slack:
            bins[-1:] = _powers_of_two(chosen)
    return bins


def _powers_of_two(chosen: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One partly filled sequence as several whose lengths are powers of two."""
    total, out, queue = sum(x[2] for x in chosen), [], list(chosen)[::-1]
    for bit in reversed(range(total.bit_length())):
        room = total & 1 << bit
        if room:
            out.append([])
        while room:
            item, start, length = queue.pop()
            used = min(room, length)
            out[-1].append((item, start, used))
            if length > used:
                queue.append((item, start + used, length - used))
            room -= used
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32 and, with ``keep_ids``, ids.

    ids_crc32 is of the piece's ids as little-endian unsigned 32-bit integers.
    Needs doc_id and text; other columns are ignored. A null or empty text has
    the end id alone. Repeated rows and null ids are documents of their own.
    Every id of a document, however long, lies in exactly one piece; sequences
    hold ``capacity`` ids, or a power of two of them at the end of a group of
    ``group_tokens``. An empty table gives no pieces.
    """
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(vocabulary).encode, TaskContext.get().partitionId() * PARTITION_SEQUENCES
        group: list[tuple[int | None, np.ndarray]] = []
        held = done = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, done
            rows, pieces = [], []
            for sequence in plan([len(x) for _, x in group], capacity):
                offset = 0
                for item, start, length in sequence:
                    doc_id, ids = group[item]
                    piece = ids[start : start + length]
                    rows.append((doc_id, start, length, len(ids), first + done, offset, zlib.crc32(piece)))
                    if keep_ids:
                        pieces.append(piece)
                    offset += length
                done += 1
            for at in range(0, len(rows), 4096):
                columns = [pa.array(x, pa.int64()) for x in zip(*rows[at : at + 4096])]
                if keep_ids:
                    part = pieces[at : at + 4096]
                    bounds = np.cumsum([0, *map(len, part)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(part).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)
            group.clear()
            held = 0

        for batch in slices(batches, 512):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                group.append((doc_id, ids))
                held += len(ids)
                if held >= group_tokens:
                    yield from flush()
        if group:
            yield from flush()

    schema = ", ".join(f"{x} long" for x in names if x != "ids") + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
