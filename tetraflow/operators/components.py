"""Connected components: local contraction, then alternating large and small stars.

First each block of node numbers contracts its links to stars by pointer jumping
in one pass; mesh numbers are local, so most of a mesh falls together there. Then
rounds over what is left grow with the logarithm of the nodes, not with a
mesh's diameter. Each round groups and joins on nodes and is staged in the
shared folder; only a count and a checksum come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tetraflow.operators.topology import CORNERS, tetra_faces
from tetraflow.staging import staged


#: Links that a task holds before it gives out the stars it has.
LOCAL_LINKS = 2_000_000
#: Links whose joins Spark may choose; of more, what it takes for few takes several times as much as a broadcast table, in every round.
FEW_LINKS = 50_000
#: Numbers that differ in these bits only are contracted in the same task.
BLOCK_BITS = 20


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (of each place the least place known to be connected) after places a and b are linked, by pointer jumping."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): each node of the links but the least of its component, and that."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = merged(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[leaf], nodes[label[leaf]]


def contracted(links: DataFrame) -> DataFrame:
    """(a, b) with a > b: fewer links of integer nodes that connect the same nodes; stars of each block of a.

    With two more columns p and q, longs, only links of equal p and q connect;
    the others come through as they are, and stars have zeros there.
    """
    names = links.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def given() -> Iterator[pa.RecordBatch]:
            if held:
                out = stars(*map(np.concatenate, zip(*held)))
                held.clear()
                zeros = [np.zeros(len(out[0]), np.int64)] * (len(names) - 2)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*out, *zeros)], names)

        for batch in batches:
            columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if len(columns) > 2:
                apart = columns[2] != columns[3]
                yield pa.RecordBatch.from_arrays([pa.array(x[apart], pa.int64()) for x in columns], names)
                columns = [x[~apart] for x in columns]
            held.append(tuple(columns[:2]))
            if sum(len(x) for x, _ in held) > LOCAL_LINKS:
                yield from given()
        yield from given()

    # blocks of numbers near each other, without the pass that a range partitioning takes to find its bounds
    return links.selectExpr(*[f"cast({c} as long) {c}" for c in names]).repartition(F.shiftright("a", BLOCK_BITS)).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node (one column) reaches over links (a, b)."""
    own = nodes.toDF("node")
    return own.join(roots(links).toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("comp"))


def roots(links: DataFrame) -> DataFrame:
    """(a, b): each node of ``links`` but the least of its component, and that."""
    links = links.toDF("a", "b").where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b")
    if isinstance(links.schema["a"].dataType, T.IntegralType):
        contract = staged(contracted(links), "contracted")
        return gathered(contract, contract)
    return gathered(links)


def gathered(links: DataFrame, contract: DataFrame | None = None) -> DataFrame:
    """``roots`` of links with a > b; contract: the staged table that holds them, where they are contracted, whose files go."""
    whole = contract is not None

    def met(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
        """Joined by another key than ``small`` was grouped by: the rows of a hub are dealt anew, so that they can be split."""
        if many:
            small = small.hint("merge")
        if not whole:
            return rows.join(small, key)
        return rows.withColumn(key, F.bitwise_not(key)).join(small.withColumn(key, F.bitwise_not(key)), key).withColumn(key, F.bitwise_not(key))

    leaves = None
    if whole:
        # a node with one link, to a smaller one, goes where that goes; what is left is small after the contraction
        ends = links.select(F.explode(F.array("a", "b")).alias("a")).groupBy("a").agg(F.count("*").alias("n"))
        rows = staged(links.join(ends, "a"), "ends", instead=contract)
        leaves, links = rows.where("n = 1").select("a", "b"), rows.where("n > 1").select("a", "b")
    state = staged(links.distinct(), "stars")
    seen, many = None, state.count() > FEW_LINKS
    while True:
        both = state.unionAll(state.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = met(both, least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = met(large, low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = staged(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "stars", instead=state)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    if leaves is not None:
        further = leaves.join(state.toDF("b", "root"), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
        state = state.unionAll(further)
    return state


def part_components(tetra: DataFrame, part: str = "part") -> DataFrame:
    """(tid, part, comp): face-connected pieces of each partition."""
    if not _whole_numbers(tetra, part):
        return _labelled(tetra, part, roots(_inner(tetra, part).where("part_a = part_b").select("tid_a", "tid_b")))
    dealt = staged(faces_met(tetra, part), "met")
    return _pieces_met(dealt, _met_roots(dealt), tetra, part)


def reachable_parts(tetra: DataFrame, part: str = "part") -> DataFrame:
    """(part, comp, part_out): pieces of each partition, with the partitions they share a face with; faces are met once for both."""
    if not _whole_numbers(tetra, part):
        from tetraflow.operators.topology import interface_faces

        return reachable(part_components(tetra, part), interface_faces(tetra, part))
    dealt = staged(faces_met(tetra, part), "met")
    beside = dealt.where(F.col("kind") == BESIDE).select(F.col("a").alias("node"), "p", "q").distinct()
    out = beside.join(_met_roots(dealt).toDF("node", "root"), "node", "left").select("p", F.coalesce("root", "node").alias("comp"), "q").distinct()
    own = tetra.schema[part].dataType
    return out.select(F.col("p").cast(own).alias("part"), "comp", F.col("q").cast(own).alias("part_out"))


def _whole_numbers(tetra: DataFrame, part: str) -> bool:
    return all(isinstance(tetra.schema[c].dataType, T.IntegralType) for c in ("tid", part, *CORNERS))


#: Rows of ``faces_met``: a tetra and its root in a block; a link; a root and a partition beside it.
TETRA, LINK, BESIDE = 0, 1, 2
#: Faces belong to the block of their least vertex; of numbers that differ in these bits only.
FACE_BITS = 16


def faces_met(tetra: DataFrame, part: str) -> DataFrame:
    """(kind, a, b, p, q): faces met in blocks of vertex numbers, each block contracted where it is met.

    TETRA: tetra a of partition p has root b in the block of its least vertex.
    LINK: a and b, of which one root at least, are connected. BESIDE: what root a
    stands for, in partition p, has a face with partition q. A tetra goes to the
    one or two blocks that its faces belong to; a row without three more for
    each face is exchanged.
    """
    ids = [F.col(c).cast("long") for c in CORNERS]
    # faces without the largest or second largest vertex have the least; the one without the least has the next
    order = F.array_sort(F.array(*ids))
    rows = tetra.select(F.col("tid").cast("long").alias("tid"), F.col(part).cast("long").alias("part"), *[c.alias(n) for c, n in zip(ids, CORNERS)], F.shiftright(F.least(*ids), FACE_BITS).alias("home"), F.shiftright(F.get(order, F.lit(1)), FACE_BITS).alias("next"))
    each = rows.select("tid", "part", *CORNERS, "home", F.explode(F.when(F.col("home") == F.col("next"), F.array("home")).otherwise(F.array("home", "next"))).alias("block"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        tid = table["tid"].to_numpy()
        known = table["part"].is_valid().to_numpy()
        own = table["part"].fill_null(0).to_numpy()
        corners = np.sort(np.stack([table[c].to_numpy() for c in CORNERS], axis=1), axis=1)
        home = table["home"].to_numpy() == block
        n = len(tid)
        both = (corners[:, 0] >> FACE_BITS) == (corners[:, 1] >> FACE_BITS)
        # faces of this block: three with the least vertex at home, one without it where the next vertex is here
        here, after = np.flatnonzero(home), np.flatnonzero((corners[:, 1] >> FACE_BITS) == block)
        row = np.concatenate((here, here, here, after))
        f = [np.concatenate([corners[here, i] for i in three] + [corners[after, last]]) for three, last in (((0, 0, 0), 1), ((1, 1, 2), 2), ((2, 3, 3), 3))]
        order = _sorted_faces(*f)
        row, f = row[order], [x[order] for x in f]
        same = (f[0][1:] == f[0][:-1]) & (f[1][1:] == f[1][:-1]) & (f[2][1:] == f[2][:-1])
        before, behind = np.concatenate(([False], same[:-1])), np.concatenate((same[1:], [False]))
        at = np.flatnonzero(same & ~before & ~behind) if len(same) else np.empty(0, np.int64)  # faces of two tetra, no more
        x, y = row[at], row[at + 1]
        two = known[x] & known[y]
        x, y = x[two], y[two]
        inner = own[x] == own[y]
        # places by number, so that the least place is the least tid
        rank = np.argsort(tid, kind="stable")
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        root = tid[rank][merged(np.arange(n), place[x[inner]], place[y[inner]])][place]
        link = ~both & (root != tid)  # of a tetra in two blocks both roots are its own
        apart = [np.concatenate(z) for z in ((root[x[~inner]], root[y[~inner]]), (own[x[~inner]], own[y[~inner]]), (own[y[~inner]], own[x[~inner]]))]
        apart = np.unique(np.stack(apart, axis=1), axis=0) if len(apart[0]) else np.empty((0, 3), np.int64)
        sizes, zeros = (home.sum(), link.sum(), len(apart)), np.zeros(link.sum(), np.int64)
        columns = [np.repeat([TETRA, LINK, BESIDE], sizes), np.concatenate((tid[home], tid[link], apart[:, 0])), np.concatenate((root[home], root[link], apart[:, 0])), np.concatenate((own[home], zeros, apart[:, 1])), np.concatenate((np.zeros(sizes[0], np.int64), zeros, apart[:, 2]))]
        no_part = np.concatenate((~known[home], np.zeros(sizes[1] + sizes[2], bool)))
        return pa.table([pa.array(columns[0].astype(np.int32)), *[pa.array(z) for z in columns[1:3]], pa.array(columns[3], mask=no_part), pa.array(columns[4])], ["kind", "a", "b", "p", "q"])

    return each.groupBy("block").applyInArrow(run, "kind int, a long, b long, p long, q long")


def _sorted_faces(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The order of faces a < b < c, by one number where their differences leave room for it."""
    if not len(a):
        return np.empty(0, np.int64)
    parts = (a - a.min(), b - a, c - b)
    bits = [int(x.max()).bit_length() if 0 <= int(x.min()) and int(x.max()) >= 0 else 64 for x in parts]
    if sum(bits) > 62:
        return np.lexsort((c, b, a))
    return np.argsort((parts[0] << (bits[1] + bits[2])) | (parts[1] << bits[2]) | parts[2], kind="stable")


def _met_roots(dealt: DataFrame) -> DataFrame:
    """(a, b): each tetra or root of a block, if links say of a smaller one, and the least of its component."""
    return roots(dealt.where(F.col("kind") == LINK).select("a", "b"))


def _pieces_met(dealt: DataFrame, found: DataFrame, tetra: DataFrame, part: str) -> DataFrame:
    side = dealt.where(F.col("kind") == TETRA).select(F.col("a").alias("tid"), "b", F.col("p").cast(tetra.schema[part].dataType).alias("part"))
    met = side.join(found.toDF("b", "root"), "b", "left")
    return met.select(F.col("tid").cast(tetra.schema["tid"].dataType).alias("tid"), "part", F.coalesce("root", "b").cast(tetra.schema["tid"].dataType).alias("comp"))


def _inner(tetra: DataFrame, part: str) -> DataFrame:
    """(tid_a, tid_b, part_a, part_b): faces of two tetra that both have a partition; each pair in ascending order by itself."""
    # of a face of two tetra least and largest are all there is, and plain numbers take half the room of structs and no sort
    tid, own = F.col("tid"), F.col("part")
    faces = tetra_faces(tetra.select("tid", *CORNERS, F.col(part).alias("part"))).groupBy("f0", "f1", "f2")
    faces = faces.agg(F.count("*").alias("n"), F.count(own).alias("n_own"), F.min(tid).alias("tid_a"), F.max(tid).alias("tid_b"), F.min(own).alias("part_a"), F.max(own).alias("part_b"))
    return faces.where("n = 2 and n_own = 2").select("tid_a", "tid_b", "part_a", "part_b")


def _labelled(tetra: DataFrame, part: str, found: DataFrame) -> DataFrame:
    side = tetra.select("tid", F.col(part).alias("part"))
    return side.join(found.toDF("tid", "root"), "tid", "left").select("tid", "part", F.coalesce("root", "tid").alias("comp"))


def contiguity(pieces: DataFrame) -> DataFrame:
    """(part, n_pieces, largest): pieces of each partition; the maximum over rows is the mesh's figure."""
    sizes = pieces.groupBy("part", "comp").agg(F.count("*").alias("n"))
    return sizes.groupBy("part").agg(F.count("*").alias("n_pieces"), F.max("n").alias("largest"))


def fix_contiguity(tetra: DataFrame, part: str = "part") -> DataFrame:
    """``tetra`` with every piece but the largest of its partition (the first on ties) moved to a neighbour.

    A piece takes the neighbouring partition with which it shares most faces
    (the smallest on ties); one that has none stays, to be reported.
    """
    # faces are met once: those within a partition link its pieces, those between two are the votes
    both = _inner(tetra, part).where("tid_a <> tid_b").select(F.col("tid_b").alias("a"), F.col("tid_a").alias("b"), F.col("part_a").alias("p"), F.col("part_b").alias("q"))
    dealt = staged(contracted(both), "contracted")
    between = staged(dealt.where("p <> q").select(F.explode(F.array("a", "b")).alias("tid"), "p", "q"), "between")
    pieces = staged(_labelled(tetra, part, gathered(dealt.where("p = q").select("a", "b"), dealt)), "pieces")
    sizes = pieces.groupBy("part", "comp").agg(F.count("*").alias("n"))
    order = Window.partitionBy("part").orderBy(F.desc("n"), "comp")
    small = staged(sizes.withColumn("rank", F.row_number().over(order)).where("rank > 1").select("part", "comp"), "small")
    beside = between.join(pieces, "tid").join(small, ["part", "comp"]).withColumn("part_n", F.when(F.col("part") == F.col("p"), F.col("q")).otherwise(F.col("p")))
    votes = beside.groupBy("part", "comp", "part_n").agg(F.count("*").alias("n"))
    to = staged(votes.groupBy("part", "comp").agg(F.max_by("part_n", F.struct("n", -F.col("part_n"))).cast(tetra.schema[part].dataType).alias("to")), "to")
    moved = pieces.join(to, ["part", "comp"]).select("tid", "to")
    return tetra.join(moved, "tid", "left").withColumn(part, F.coalesce("to", part)).drop("to")


def reachable(pieces: DataFrame, iface_faces: DataFrame) -> DataFrame:
    """(part, comp, part_out): pieces that touch an interface with another partition."""
    met = iface_faces.select(F.col("tid_in").alias("tid"), "part_out").join(pieces, "tid")
    return met.select("part", "comp", "part_out").distinct()
