"""Faces, edges, adjacency, balls, boundaries and interface tables.

Everything joins and groups on sorted corner ids kept as scalar columns. A
face occurs in two tetra at most, so grouping by face keeps two rows, never a
list: min and max of a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetraflow.functions.geometry import sort3
from tetraflow.schema import EDGE_CORNERS, FACE_CORNERS

CORNERS = ("v0", "v1", "v2", "v3")


def _kept(df: DataFrame, wanted: tuple[str, ...]) -> list[str]:
    return [c for c in wanted if c in df.columns]


#: Vertices that are sent to every task, some 30 MB; beyond, corners and vertices meet in exchanges.
FEW_VERTICES = 200_000


def attach_corners(tetra: DataFrame, vertices: DataFrame, columns: tuple[str, ...] = ("x", "y", "z"), corners: tuple[str, ...] = CORNERS, key: str = "tid") -> DataFrame:
    """``tetra`` with the vertex columns of each corner, named x0, y0, z0, x1 and so on.

    Vertices are counted first. FEW_VERTICES or less are broadcast and nothing
    is exchanged. Beyond, narrow (key, corner, vid) rows meet the vertices once
    and are folded back by key: two exchanges of narrow rows, where a join for
    each corner would carry the whole, growing row through one exchange each.
    A corner without a vertex has nulls; a row of which none has one is left out.
    """
    if vertices.count() <= FEW_VERTICES:
        out, names = tetra, [f"{c}{i}" for i in range(len(corners)) for c in columns]
        for i, corner in enumerate(corners):
            at = vertices.select(F.col("vid").alias(corner), *[F.col(c).alias(f"{c}{i}") for c in columns], F.lit(True).alias(f"__met{i}"))
            out = out.join(F.broadcast(at), corner, "left")
        return out.where(F.coalesce(*[f"__met{i}" for i in range(len(corners))])).select(*tetra.columns, *names)
    each = tetra.select(key, F.posexplode(F.array(*corners)).alias("corner", "vid"))
    met = each.join(vertices.select("vid", *columns), "vid")
    folded = met.groupBy(key).agg(*[F.max(F.when(F.col("corner") == i, F.col(c))).alias(f"{c}{i}") for i in range(len(corners)) for c in columns])
    return tetra.join(folded, key)


def tetra_faces(tetra: DataFrame) -> DataFrame:
    """(tid, ref, part, ifac, f0 < f1 < f2, n0, n1, n2): four faces a tetra, sorted and in outward order."""
    faces = []
    for i, (a, b, c) in enumerate(FACE_CORNERS):
        p, q, r = (F.col(CORNERS[k]) for k in (a, b, c))
        low, mid, high = sort3(p, q, r)
        faces.append(F.struct(F.lit(i).alias("ifac"), low.alias("f0"), mid.alias("f1"), high.alias("f2"), p.alias("n0"), q.alias("n1"), r.alias("n2")))
    kept = _kept(tetra, ("ref", "part", "block", "tag"))
    return tetra.select("tid", *kept, F.explode(F.array(*faces)).alias("f")).select("tid", *kept, "f.*")


def face_adjacency(tetra: DataFrame) -> DataFrame:
    """(f0, f1, f2, n, a, b): each face once, how many tetra it has, and the first and last as structs (a = b on the boundary).

    More than two tetra at a face make n > 2: an invalid mesh, for the checks to report.
    """
    faces = tetra_faces(tetra)
    side = F.struct(*_kept(faces, ("tid", "ifac", "ref", "part", "block")), "n0", "n1", "n2")
    return faces.groupBy("f0", "f1", "f2").agg(F.count("*").alias("n"), F.min(side).alias("a"), F.max(side).alias("b"))


def dual_edges(tetra: DataFrame) -> DataFrame:
    """(tid_a, tid_b, f0, f1, f2): pairs of tetra that share a face, each pair once."""
    return face_adjacency(tetra).where("n = 2").select(F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b"), "f0", "f1", "f2")


def neighbours(tetra: DataFrame) -> DataFrame:
    """(tid, ifac, tid_n, ifac_n): across each face, null at the boundary."""
    both = face_adjacency(tetra).where("n <= 2")
    other = lambda c: F.when(F.col("n") == 2, F.col(c))
    one = both.select(F.col("a.tid").alias("tid"), F.col("a.ifac").alias("ifac"), other("b.tid").alias("tid_n"), other("b.ifac").alias("ifac_n"))
    two = both.where("n = 2").select(F.col("b.tid").alias("tid"), F.col("b.ifac").alias("ifac"), F.col("a.tid").alias("tid_n"), F.col("a.ifac").alias("ifac_n"))
    return one.unionAll(two)


def boundary_faces(tetra: DataFrame, between_refs: bool = False) -> DataFrame:
    """(f0, f1, f2, n0, n1, n2, tid, ifac, ref): faces of one tetra; with ``between_refs`` also faces whose two sides differ in ref, taken from the lower."""
    kept = _kept(tetra, ("ref", "part"))
    if not between_refs:
        # of a face of one tetra every minimum is its own value: plain numbers are hashed, where structs are sorted and spilled
        sorted_ids, outward = [F.col(f"f{i}") for i in range(3)], [F.col(f"n{i}") for i in range(3)]
        place = lambda n: F.when(n == sorted_ids[0], 0).when(n == sorted_ids[1], 1).otherwise(2)
        code = place(outward[0]) * 9 + place(outward[1]) * 3 + place(outward[2])
        alone = tetra_faces(tetra).withColumn("turn", code).groupBy("f0", "f1", "f2").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("turn", "tid", "ifac", *kept)]).where("n = 1")
        at = lambda i: F.when(i == 0, F.col("f0")).when(i == 1, F.col("f1")).otherwise(F.col("f2"))
        turned = [at(F.expr(x)).alias(f"n{i}") for i, x in enumerate(("turn div 9", "turn div 3 % 3", "turn % 3"))]
        return alone.select("f0", "f1", "f2", *turned, "tid", "ifac", *kept)
    faces = face_adjacency(tetra)
    keep = (F.col("n") == 1) | ((F.col("n") == 2) & (F.col("a.ref") != F.col("b.ref")))
    side = F.when((F.col("n") == 2) & (F.col("b.ref") < F.col("a.ref")), F.col("b")).otherwise(F.col("a"))
    return faces.where(keep).withColumn("s", side).select("f0", "f1", "f2", "s.n0", "s.n1", "s.n2", "s.tid", "s.ifac", *[f"s.{c}" for c in kept])


def tetra_edges(tetra: DataFrame) -> DataFrame:
    """(tid, iedge, a < b): six edges a tetra."""
    edges = []
    for i, (p, q) in enumerate(EDGE_CORNERS):
        u, v = F.col(CORNERS[p]), F.col(CORNERS[q])
        edges.append(F.struct(F.lit(i).alias("iedge"), F.least(u, v).alias("a"), F.greatest(u, v).alias("b")))
    kept = _kept(tetra, ("ref", "part", "block"))
    return tetra.select("tid", *kept, F.explode(F.array(*edges)).alias("e")).select("tid", *kept, "e.*")


def unique_edges(tetra: DataFrame) -> DataFrame:
    """(a, b, n): each edge once, and how many tetra have it. Partial aggregation folds it before the exchange."""
    return tetra_edges(tetra).groupBy("a", "b").agg(F.count("*").alias("n"))


def triangle_edges(triangles: DataFrame) -> DataFrame:
    """(fid, ref, iedge, a < b, forward): three edges a triangle; forward if it runs from a to b."""
    edges = []
    for i, (p, q) in enumerate((("v0", "v1"), ("v1", "v2"), ("v2", "v0"))):
        u, v = F.col(p), F.col(q)
        edges.append(F.struct(F.lit(i).alias("iedge"), F.least(u, v).alias("a"), F.greatest(u, v).alias("b"), (u < v).alias("forward")))
    return triangles.select("fid", *_kept(triangles, ("ref", "tag", "nx", "ny", "nz", "part")), F.explode(F.array(*edges)).alias("e")).select("*", "e.*").drop("e")


def vertex_ball(tetra: DataFrame) -> DataFrame:
    """(vid, tid, corner): the tetra around each vertex, as rows."""
    return tetra.select("tid", F.posexplode(F.array(*CORNERS)).alias("corner", "vid")).select("vid", "tid", "corner")


def triangle_key(triangles: DataFrame) -> DataFrame:
    """``triangles`` with f0 < f1 < f2."""
    low, mid, high = sort3(F.col("v0"), F.col("v1"), F.col("v2"))
    return triangles.withColumns({"f0": low, "f1": mid, "f2": high})


def triangle_tetra(triangles: DataFrame, tetra: DataFrame) -> DataFrame:
    """(fid, tid, ifac, tid_2, ifac_2): the one or two tetra of each triangle; nulls if it is no face."""
    faces = face_adjacency(tetra)
    second = lambda c: F.when(F.col("n") == 2, F.col(c))
    sides = faces.select("f0", "f1", "f2", F.col("a.tid").alias("tid"), F.col("a.ifac").alias("ifac"), second("b.tid").alias("tid_2"), second("b.ifac").alias("ifac_2"))
    return triangle_key(triangles).join(sides, ["f0", "f1", "f2"], "left").select("fid", "tid", "ifac", "tid_2", "ifac_2")


def clean_triangles(triangles: DataFrame, tetra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(extra, missing): triangles on no boundary face (or repeated), and boundary faces without a triangle."""
    boundary = boundary_faces(tetra, between_refs="ref" in tetra.columns).select("f0", "f1", "f2", "n0", "n1", "n2", "tid")
    keyed = triangle_key(triangles)
    first = keyed.groupBy("f0", "f1", "f2").agg(F.min("fid").alias("fid"))
    good = first.join(boundary.select("f0", "f1", "f2"), ["f0", "f1", "f2"], "left_semi").select("fid")
    return triangles.join(good, "fid", "left_anti"), boundary.join(keyed.select("f0", "f1", "f2"), ["f0", "f1", "f2"], "left_anti")


def edge_tags(edges: DataFrame, tagged: DataFrame) -> DataFrame:
    """``edges`` (a, b, tag) with the bits of ``tagged`` (a, b, tag) added; unmatched edges keep theirs."""
    more = tagged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "tag").groupBy("a", "b").agg(F.bit_or("tag").alias("more"))
    return edges.join(more, ["a", "b"], "left").withColumn("tag", F.coalesce("tag", F.lit(0)).bitwiseOR(F.coalesce("more", F.lit(0)))).drop("more")


def part_vertices(tetra: DataFrame, part: str = "part") -> DataFrame:
    """(part, vid): the vertices that each partition's tetra touch, once."""
    return tetra.select(F.col(part).alias("part"), F.explode(F.array(*CORNERS)).alias("vid")).distinct()


def shared_by(touch: DataFrame, key: tuple[str, ...] = ("vid",)) -> DataFrame:
    """(key, parts): the sorted partitions of each entity that several touch.

    One grouping gives what rounds of neighbour exchanges converge to,
    whatever the multiplicity. A list is as long as the partitions that meet.
    """
    return touch.groupBy(*key).agg(F.array_sort(F.collect_set("part")).alias("parts")).where(F.size("parts") > 1)


def interface(touch: DataFrame, kind: str, key: tuple[str, ...] = ("vid",)) -> DataFrame:
    """(kind, part_in, part_out, key): a row for each ordered pair of partitions that share an entity."""
    shared = shared_by(touch, key).select(*key, F.explode("parts").alias("part_in"), "parts")
    return shared.select(F.lit(kind).alias("kind"), "part_in", F.explode(F.array_except("parts", F.array("part_in"))).alias("part_out"), *key)


def interface_nodes(tetra: DataFrame, part: str = "part") -> DataFrame:
    return interface(part_vertices(tetra, part), "node").withColumnRenamed("vid", "gid")


def interface_edges(tetra: DataFrame, part: str = "part") -> DataFrame:
    touch = tetra_edges(tetra).select(F.col(part).alias("part"), "a", "b").distinct()
    return interface(touch, "edge", ("a", "b"))


def interface_faces(tetra: DataFrame, part: str = "part") -> DataFrame:
    """(f0, f1, f2, part_in, part_out, tid_in, tid_out): inner faces between partitions, in both directions."""
    cut = face_adjacency(tetra).where((F.col("n") == 2) & (F.col(f"a.{part}") != F.col(f"b.{part}")))

    def one(i: str, o: str) -> DataFrame:
        return cut.select("f0", "f1", "f2", F.col(f"{i}.{part}").alias("part_in"), F.col(f"{o}.{part}").alias("part_out"), F.col(f"{i}.tid").alias("tid_in"), F.col(f"{o}.tid").alias("tid_out"))

    return one("a", "b").unionAll(one("b", "a"))


def faces_from_nodes(triangles: DataFrame, node_gids: DataFrame) -> DataFrame:
    """Interface faces from interface nodes: triangles of two partitions whose corners have the same global ids.

    ``triangles`` is (part, fid, v0, v1, v2) with local ids, ``node_gids``
    (part, lid, gid). Gives (g0, g1, g2, part_in, part_out, fid_in, fid_out).
    """
    each = triangles.select("part", "fid", F.explode(F.array("v0", "v1", "v2")).alias("lid"))
    sides = each.join(node_gids.select("part", "lid", "gid").distinct(), ["part", "lid"]).groupBy("part", "fid").agg(F.array_sort(F.collect_list("gid")).alias("g"))
    keyed = sides.where(F.size("g") == 3).select("part", "fid", *[F.col("g")[i].alias(f"g{i}") for i in range(3)])
    other = keyed.select("g0", "g1", "g2", F.col("part").alias("part_out"), F.col("fid").alias("fid_out"))
    met = keyed.join(other, ["g0", "g1", "g2"]).where("part <> part_out")  # two sides a face
    return met.select("g0", "g1", "g2", F.col("part").alias("part_in"), "part_out", F.col("fid").alias("fid_in"), "fid_out")


def interface_positions(iface: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``iface`` with pos: the place in the list of a pair of partitions, alike on both sides."""
    from pyspark.sql import Window

    low, high = F.least("part_in", "part_out"), F.greatest("part_in", "part_out")
    order = Window.partitionBy("kind", "part_in", "part_out", low, high).orderBy(*key)
    return iface.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def nonmanifold_edges(triangles: DataFrame) -> DataFrame:
    """(a, b, n): surface edges of one triangle or more than two."""
    return triangle_edges(triangles).groupBy("a", "b").agg(F.count("*").alias("n")).where("n <> 2")


def parallel_edges(iface_faces: DataFrame) -> DataFrame:
    """(a, b): the edges of interface faces, once."""
    pairs = [F.struct(F.col(f"f{i}").alias("a"), F.col(f"f{j}").alias("b")) for i, j in ((0, 1), (0, 2), (1, 2))]
    return iface_faces.select(F.explode(F.array(*pairs)).alias("e")).select("e.*").distinct()


def is_set(tag: Column, bit: int) -> Column:
    return tag.bitwiseAND(bit) != 0
