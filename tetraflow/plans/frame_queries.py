"""Queries of the access layer, files, coordinates, transfer and splitting, beside those of ``lattice_queries``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetraflow import schema as S
from tetraflow.frame import MeshFrame
from tetraflow.functions import geometry as G
from tetraflow.operators import checks, exchange, interpolate, levelset, locate, partition, stats, tags, topology
from tetraflow.plans.files import localised
from tetraflow.plans.lattice_queries import _LS, _SKIN, LS_VALUE, _query, _skin, _warped
from tetraflow.sources import catalog, medit, vtk
from tetraflow.sources.lattice import lattice
from tetraflow.staging import shared_folder


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@_query("frame_flags", f"SELECT vid, CASE WHEN vid % 11 = 0 THEN {S.CRN} ELSE 0 END + CASE WHEN vid % 7 = 0 AND vid % 14 <> 0 THEN {S.REQ} ELSE 0 END AS tag FROM vtx")
def frame_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and required vertices by id lists; some are taken back."""
    vertices, _, _ = lattice(spark, sf_dir)
    mesh = MeshFrame(spark).set("vertices", vertices.select("vid", "x", "y", "z"))
    ids = lambda n: vertices.where(F.col("vid") % n == 0).select("vid")
    mesh = mesh.corners(ids(11)).required("vertices", ids(7)).flag("vertices", "vid", ids(14), S.REQ, on=False)
    return mesh.vertices.select("vid", "tag")


@_query("frame_edge_flags", f"SELECT a * 1000000 + b AS eid, CASE WHEN a % 5 = 0 THEN {S.GEO} ELSE 0 END + CASE WHEN b % 3 = 0 THEN {S.REQ} ELSE 0 END AS tag FROM (SELECT DISTINCT a, b FROM edg) u")
def frame_edge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridges and required edges."""
    _, tetra, _ = lattice(spark, sf_dir)
    edges = topology.unique_edges(tetra).select((F.col("a") * 1_000_000 + F.col("b")).alias("eid"), "a", "b")
    mesh = MeshFrame(spark).set("edges", edges)
    mesh = mesh.ridges(edges.where("a % 5 = 0").select("eid")).required("edges", edges.where("b % 3 = 0").select("eid"))
    return mesh.edges.select("eid", "tag")


@_query("frame_sizes", "SELECT 'vertices' AS entity, count(*) AS n FROM vtx UNION ALL SELECT 'tetra', count(*) FROM tet UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT a, b FROM edg) u")
def frame_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, tetra, _ = lattice(spark, sf_dir)
    edges = topology.unique_edges(tetra).select(F.xxhash64("a", "b").alias("eid"), "a", "b")
    mesh = MeshFrame(spark).set("vertices", vertices.select("vid", "x", "y", "z")).set("tetra", tetra.select("tid", *topology.CORNERS, "ref", "part")).set("edges", edges)
    return spark.createDataFrame(sorted(mesh.sizes().items()), "entity string, n long")


def _with_sols(spark: SparkSession, sf_dir: str) -> MeshFrame:
    vertices, _, _ = lattice(spark, sf_dir)
    mesh = MeshFrame(spark).set("vertices", vertices.select("vid", "x", "y", "z"))
    mesh = mesh.set_sols("metric", "size", vertices.select("vid", F.array("size").alias("val"))).set_sols("field", "val", vertices.select("vid", F.array("cust").alias("val")))
    mesh = mesh.set_sols("field", "velocity", vertices.where("vid % 2 = 0").select("vid", F.array("x", "y", "z").alias("val")))
    return mesh.set_sols("field", "val", vertices.select("vid", F.array("val").alias("val")))  # takes the place of the first


@_query("solution_sizes", "SELECT 'metric' AS kind, 'size' AS name, count(*) AS n, CAST(1 AS INTEGER) AS size FROM vtx UNION ALL SELECT 'field', 'val', count(*), 1 FROM vtx UNION ALL SELECT 'field', 'velocity', count(*), 3 FROM vtx WHERE vid % 2 = 0")
def solution_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_sols(spark, sf_dir).sol_sizes()


@_query("solution_values", "SELECT vid, round(val, 2) AS val FROM vtx")
def solution_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_sols(spark, sf_dir).sol("field", "val").select("vid", F.round(F.get("val", F.lit(0)), 2).alias("val"))


@_query("interface_sizes", "SELECT 'node' AS kind, part_in, part_out, count(*) AS n FROM (SELECT ps, unnest(ps) AS part_in, vid FROM (SELECT vid, list(part) AS ps FROM bv GROUP BY vid HAVING count(*) > 1) u) v, (SELECT unnest([0, 1, 2, 3]) AS part_out) w WHERE list_contains(ps, part_out) AND part_out <> part_in GROUP BY ALL")
def interface_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node interfaces declared on a mesh, and their sizes asked for."""
    nodes = topology.interface_nodes(lattice(spark, sf_dir)[1], "block")
    mesh = MeshFrame(spark).set("iface", topology.interface_positions(nodes, ("gid",)).select("kind", "part_in", "part_out", "pos", F.col("gid").alias("lid"), "gid"))
    return mesh.interface_sizes()


@_query("declared_interfaces", """
, sh AS (SELECT vid, list(part) AS ps FROM bv GROUP BY vid HAVING count(*) > 1), pr AS (SELECT vid AS gid, ps, unnest(ps) AS part_in FROM sh),
al AS (SELECT gid, part_in, unnest(list_filter(ps, lambda q: q <> part_in)) AS part_out FROM pr)
SELECT 'read' AS side, part_in, part_out, gid FROM al WHERE gid % 10 = 3 AND gid % 15 <> 13 UNION ALL SELECT 'declared', part_in, part_out, gid FROM al WHERE gid % 15 = 13 AND gid % 10 <> 3""")
def declared_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declaration that lacks some nodes held against a reading that lacks others."""
    rows = topology.interface_nodes(lattice(spark, sf_dir)[1], "block").select("part_in", "part_out", "gid")
    return checks.differing(rows.where("gid % 10 <> 3"), rows.where("gid % 15 <> 13")).select("side", "part_in", "part_out", "gid")


@_query("declared_files", "SELECT part_in, part_out, count(*) AS n, CAST(min(rank) AS BIGINT) AS first_pos, sum(gid) AS sum_gid FROM (SELECT part_in, part_out, gid, row_number() OVER (PARTITION BY part_in, part_out ORDER BY gid) - 1 AS rank FROM (SELECT vid AS gid, part_in, unnest(list_filter(ps, lambda q: q <> part_in)) AS part_out FROM (SELECT vid, ps, unnest(ps) AS part_in FROM (SELECT vid, list(part) AS ps FROM pv GROUP BY vid HAVING count(*) > 1) a) b) c) d GROUP BY part_in, part_out")
def declared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node interfaces written into the files of the parts and read back from them."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    nodes = topology.interface_positions(topology.interface_nodes(tetra), ("gid",)).withColumn("lid", F.col("gid"))
    path = _fresh(spark, "declared")
    medit.write_mesh(MeshFrame(spark, localised(_warped(vertices), tetra) | {"iface": nodes}), path)
    back = medit.read_mesh(spark, path).table("iface")
    return back.groupBy("part_in", "part_out").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.sum("gid").alias("sum_gid"))


@_query("solution_files", "SELECT part, name, count(*) AS n, CAST(max(size) AS INTEGER) AS size, round(sum(total), 2) AS total FROM (SELECT part, 'sol0' AS name, 1 AS size, v.val AS total FROM pv JOIN vtx v USING (vid) UNION ALL SELECT part, 'sol1', 3, v.i + 2 * v.j + 3 * v.k FROM pv JOIN vtx v USING (vid)) u GROUP BY part, name")
def solution_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar and a vector side by side in the solution file of each part, read back."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    local = localised(vertices, tetra)["vertices"].join(vertices.select("x", "y", "z", "val"), ["x", "y", "z"])
    one = local.select("part", F.lit("a").alias("name"), "vid", F.array("val").alias("val"))
    two = local.select("part", F.lit("b").alias("name"), "vid", F.array(F.col("x"), 2 * F.col("y"), 3 * F.col("z")).alias("val"))
    path = _fresh(spark, "sol")
    medit.write_sol(one.unionAll(two), path)
    back = medit.read_sol(spark, path)
    total = F.aggregate("val", F.lit(0.0), lambda s, x: s + x)
    return back.groupBy("part", "name").agg(F.count("*").alias("n"), F.max(F.size("val")).alias("size"), F.round(F.sum(total), 2).alias("total"))


@_query("grid_pieces", "SELECT p.part, p.n_vertices, t.n_tetra, p.sum_x FROM (SELECT part, count(*) AS n_vertices, round(sum(x), 3) AS sum_x FROM pv JOIN wrp USING (vid) GROUP BY part) p JOIN (SELECT part, count(*) AS n_tetra FROM tet GROUP BY part) t USING (part)")
def grid_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part written as a piece in XML with an index, and each piece read back."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    tables, path, out = localised(_warped(vertices), tetra), _fresh(spark, "grid"), None
    for name in vtk.write_grid(tables["vertices"], tables["tetra"], path):
        part, mesh = int(name.split(".")[1]), vtk.read_vtu(spark, f"{path}/{name}")
        n = mesh.vertices.agg(F.count("*").alias("n_vertices"), F.round(F.sum("x"), 3).alias("sum_x")).withColumn("part", F.lit(part))
        one = n.join(mesh.tetra.agg(F.count("*").alias("n_tetra")).withColumn("part", F.lit(part)), "part").where("n_tetra > 0").select("part", "n_vertices", "n_tetra", "sum_x")
        out = one if out is None else out.unionAll(one)
    return out


@_query("catalog_selection", f"SELECT vid, CASE WHEN vid % 3 = 0 THEN {S.CRN} ELSE 0 END AS tag FROM vtx")
def catalog_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only vertices are stored, without the family of required ones."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    tag = F.when(F.col("vid") % 3 == 0, S.CRN).otherwise(0) + F.when(F.col("vid") % 4 == 0, S.REQ).otherwise(0)
    mesh = MeshFrame(spark).set("vertices", vertices.select("vid", "x", "y", "z", tag.alias("tag"))).set("tetra", tetra.select("tid", *topology.CORNERS, "ref", "part"))
    path = _fresh(spark, "catalog")
    catalog.save(mesh, path, tables=("vertices",), without=("required",))
    return catalog.load(spark, path).vertices.select("vid", "tag")


@_query("catalog_description", """
SELECT 'Topology' AS item, CAST(count(*) AS BIGINT) AS n, CAST(4 AS BIGINT) AS width FROM tet UNION ALL SELECT 'Geometry', count(*), 3 FROM vtx UNION ALL SELECT 'size', count(*), 1 FROM vtx UNION ALL SELECT 'stress', count(*), 6 FROM vtx""")
def catalog_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the XML description of a catalog says of its tables and solutions."""
    import xml.etree.ElementTree as ET

    vertices, tetra, _ = lattice(spark, sf_dir)
    text = catalog.sidecar("mesh", {"vertices": vertices.count(), "tetra": tetra.count()}, {"size": 1, "stress": 6})
    rows = [(x.get("Name") or x.tag, *map(int, x.find("DataItem").get("Dimensions").split())) for x in ET.fromstring(text).find("./Domain/Grid")]
    return spark.createDataFrame(rows, "item string, n long, width long")


@_query("barycentrics", "SELECT tid, 0.4 AS phi0, 0.3 AS phi1, 0.2 AS phi2, 0.1 AS phi3 FROM (SELECT tid FROM tet) t".replace("0.4", "0.4::DOUBLE").replace("0.3", "0.3::DOUBLE").replace("0.2", "0.2::DOUBLE").replace("0.1", "0.1::DOUBLE"))
def barycentrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point put into each tetra by weights, and the weights found again."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    at = topology.attach_corners(tetra.select("tid", *topology.CORNERS), _warped(vertices))
    p = [G.point("", i) for i in range(4)]
    q = tuple(sum((p[i][k] * w for i, w in ((1, 0.3), (2, 0.2), (3, 0.1))), p[0][k] * 0.4) for k in range(3))
    return at.select("tid", *[F.round(x, 6).alias(f"phi{i}") for i, x in enumerate(G.barycentric(p, q))])


@_query("surface_coordinates", "SELECT fid, 0.5::DOUBLE AS phi0, 0.3::DOUBLE AS phi1, 0.2::DOUBLE AS phi2, 0.25::DOUBLE AS height FROM wall", _SKIN)
def surface_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point above each triangle of the skin: the weights of its projection, and its height."""
    triangles, vertices = _skin(spark, sf_dir)
    at = topology.attach_corners(triangles, vertices, corners=("v0", "v1", "v2"), key="fid")
    p, n = [G.point("", i) for i in range(3)], [F.col(f"n{c}") for c in "xyz"]
    q = tuple(p[0][k] * 0.5 + p[1][k] * 0.3 + p[2][k] * 0.2 + n[k] * 0.25 for k in range(3))
    phi, height = G.barycentric2d(p, q)
    return at.select("fid", *[F.round(x, 6).alias(f"phi{i}") for i, x in enumerate(phi)], F.round(height, 6).alias("height"))


@_query("border_kinds", "SELECT unnest(['vertex', 'edge', 'face', 'inside']) AS kind, n FROM (SELECT count(*) AS n FROM tet) u")
def border_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corner, an edge's middle, a face's and the middle of each tetra, told apart by their coordinates."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    at = topology.attach_corners(tetra.select("tid", *topology.CORNERS), _warped(vertices))
    p = [G.point("", i) for i in range(4)]
    kinds = []
    for n in range(1, 5):
        q = tuple(sum((p[i][k] for i in range(1, n)), p[0][k]) / n for k in range(3))
        kinds.append(F.struct(locate.border(F.array(*G.barycentric(p, q)), 1e-6).alias("kind")))
    return at.select(F.inline(F.array(*kinds))).groupBy("kind").agg(F.count("*").alias("n"))


@_query("transfer_fields", """
SELECT vid, CASE WHEN vid % 5 = 0 THEN CAST(1000 + vid AS DOUBLE) ELSE round(2.0 * least(i + 0.3, m - 1) + 3.0 * least(j + 0.2, m - 1) - least(k + 0.1, m - 1), 6) END AS val FROM vtx""")
def transfer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear field on moved vertices: required ones keep what they had, boundary ones ask the surface, others the volume."""
    vertices, tetra, m = lattice(spark, sf_dir)
    faces = topology.boundary_faces(tetra)
    triangles = faces.select((F.col("tid") * 4 + F.col("ifac")).alias("fid"), F.col("n0").alias("v0"), F.col("n1").alias("v1"), F.col("n2").alias("v2"))
    at = [F.least(F.col(c) + d, F.lit(float(m - 1))).alias(c) for c, d in (("x", 0.3), ("y", 0.2), ("z", 0.1))]
    wall = (F.col("i") == m - 1) | (F.col("j") == m - 1) | (F.col("k") == m - 1)
    new = vertices.select("vid", *at, (F.col("vid") % 5 == 0).alias("required"), wall.alias("on_boundary"))
    linear = 2.0 * F.col("x") + 3.0 * F.col("y") - F.col("z")
    field = vertices.select("vid", F.array(linear).alias("val"))
    kept = vertices.select("vid", F.array(F.when(F.col("vid") % 5 == 0, 1000.0 + F.col("vid")).otherwise(linear)).alias("val"))
    moved = interpolate.transfer(new.where("not required"), vertices, tetra, triangles, field, 0.01)
    held = interpolate.transfer(new.where("required"), vertices, tetra, triangles, kept, 0.01)
    return held.unionAll(moved).select("vid", F.round(F.get("val", F.lit(0)), 6).alias("val"))


@_query("split_parts", """
SELECT t.part, t.n_tetra, v.n_vertices, coalesce(f.n, 0) AS n_faces FROM (SELECT block AS part, count(*) AS n_tetra FROM tet GROUP BY block) t JOIN (SELECT part, count(*) AS n_vertices FROM bv GROUP BY part) v USING (part)
LEFT JOIN (SELECT part, count(*) AS n FROM (SELECT unnest([ba, bb]) AS part FROM sid WHERE n = 2 AND ba <> bb) u GROUP BY part) f USING (part)""")
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh split by another assignment: tetra, vertices and interface faces of each part."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    dealt, own, faces = partition.split(tetra, vertices, tetra.select("tid", F.col("block").alias("part")))
    out = dealt.groupBy("part").agg(F.count("*").alias("n_tetra")).join(own.groupBy("part").agg(F.count("*").alias("n_vertices")), "part")
    n_faces = faces.groupBy(F.col("part_in").alias("part")).agg(F.count("*").alias("n_faces"))
    return out.join(n_faces, "part", "left").na.fill(0, ["n_faces"]).select("part", "n_tetra", "n_vertices", "n_faces")


@_query("group_numbers", """
, ne AS (SELECT count(*) AS ne FROM tet) SELECT target, redistribution, CAST(greatest(1, least(greatest(1, (ne + target - 1) // target), CASE WHEN redistribution THEN 1000 ELSE 100 END, CASE WHEN ne // 6 = 0 THEN 1 ELSE ne // 6 END)) AS BIGINT) AS n_groups
FROM ne, (SELECT unnest([10, 100, 1000, 30000000]) AS target) t, (SELECT unnest([true, false]) AS redistribution) r""")
def group_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups a mesh of this size is cut into, for several target sizes."""
    n = lattice(spark, sf_dir)[1].count()
    rows = [(target, r, partition.n_groups(n, target, redistribution=r)) for target in (10, 100, 1000, 30_000_000) for r in (True, False)]
    return spark.createDataFrame(rows, "target int, redistribution boolean, n_groups long")


@_query("old_interfaces", """
, a AS (SELECT vid FROM pv GROUP BY vid HAVING count(*) > 1), b AS (SELECT vid FROM bv GROUP BY vid HAVING count(*) > 1) SELECT vid FROM a WHERE vid NOT IN (SELECT vid FROM b)""")
def old_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of interfaces that were, after the parts have changed."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    on = lambda part: topology.interface_nodes(tetra, part).select(F.col("gid").alias("vid")).distinct()
    was = vertices.select("vid").join(on("part").withColumn("was", F.lit(True)), "vid", "left").join(on("block").withColumn("now", F.lit(True)), "vid", "left")
    old = F.when(F.col("was"), tags.tag_parallel(F.lit(0))).otherwise(0)
    left = tags.untag_parallel(tags.keep_old(old))
    tagged = was.withColumn("tag", F.when(F.col("now"), tags.tag_parallel(left)).otherwise(left))
    return tagged.where(tags.is_old_interface(F.col("tag"))).select("vid")


@_query("ls_snapped", "SELECT vid, CASE WHEN abs(val - 200000.0) < 5000.0 THEN 0.0 ELSE round(val - 200000.0, 2) END AS v FROM vtx")
def ls_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values near the level go to it."""
    vertices, _, _ = lattice(spark, sf_dir)
    return levelset.snapped(vertices.select("vid", (F.col("val") - LS_VALUE).alias("v")), 5000.0).select("vid", F.round("v", 2).alias("v"))


@_query("ls_lowered", """
, fl AS (SELECT tid FROM tet WHERE tid % 97 = 0), nr AS (SELECT tid, min(abs(v)) AS near FROM cor JOIN fl USING (tid) JOIN ls USING (vid) GROUP BY tid), lo AS (SELECT DISTINCT vid FROM cor WHERE tid IN (SELECT tid FROM nr WHERE near < 10000.0))
SELECT vid, CASE WHEN vid IN (SELECT vid FROM lo) THEN -10000.0 ELSE round(v, 2) END AS v FROM ls""", _LS)
def ls_lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around tetra that pass for flat here, values near the level go below it."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    measured = tetra.withColumn("quality", F.when(F.col("tid") % 97 == 0, 0.0).otherwise(100.0))
    ls = levelset.snapped(vertices.select("vid", (F.col("val") - LS_VALUE).alias("v")))
    return levelset.lowered_at_flat(measured, ls, 10.0).select("vid", F.round("v", 2).alias("v"))


@_query("same_places", "SELECT part, vid AS lid, min(part) OVER (PARTITION BY vid) AS home FROM bv")
def same_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a point that differ by less than the tolerance, on both sides of any grid line."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    off = (F.col("part") - 1.5) * 2e-10
    local = topology.part_vertices(tetra, "block").join(_warped(vertices), "vid").select("part", F.col("vid").alias("lid"), *[(F.col(c) + off).alias(c) for c in "xyz"])
    return exchange.merge_by_coordinates(local).select("part", "lid", F.shiftright("gid", 40).cast("int").alias("home"))


@_query("sorted_corners", "SELECT fid, least(v0, v1, v2) AS f0, v0 + v1 + v2 - least(v0, v1, v2) - greatest(v0, v1, v2) AS f1, greatest(v0, v1, v2) AS f2 FROM wall", _SKIN)
def sorted_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.triangle_key(_skin(spark, sf_dir)[0]).select("fid", "f0", "f1", "f2")


@_query("triangle_edges", "SELECT fid, 0 AS iedge, least(v0, v1) AS a, greatest(v0, v1) AS b, v0 < v1 AS forward FROM sk UNION ALL SELECT fid, 1, least(v1, v2), greatest(v1, v2), v1 < v2 FROM sk UNION ALL SELECT fid, 2, least(v2, v0), greatest(v2, v0), v2 < v0 FROM sk", _SKIN)
def triangle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.triangle_edges(_skin(spark, sf_dir)[0]).select("fid", "iedge", "a", "b", "forward")


@_query("face_areas", """
SELECT fid, 0.5::DOUBLE AS area, CASE w WHEN 1 THEN -1.0 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS nx, CASE w WHEN 3 THEN -1.0 WHEN 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS ny, CASE w WHEN 5 THEN -1.0 WHEN 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS nz FROM wall""", _SKIN)
def face_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and unit normal of each triangle of the skin."""
    triangles, _ = _skin(spark, sf_dir)
    return triangles.select("fid", F.round("area", 6).alias("area"), *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")])


@_query("front_one_layer", """
, sz AS (SELECT part, count(*) AS n FROM tet GROUP BY part), ball AS (SELECT c.vid, c.tid, c.part, sz.n FROM cor c JOIN sz USING (part)),
vb AS (SELECT vid, min((n, part)) AS best, max((n, part)) AS most FROM ball GROUP BY vid), fo AS (SELECT b.tid, min(v.best) AS best FROM ball b JOIN vb v USING (vid) WHERE v.best <> v.most GROUP BY b.tid)
SELECT t.tid, CAST(coalesce(best[2], t.part) AS INTEGER) AS part FROM tet t LEFT JOIN fo USING (tid)""")
def front_one_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts after the interfaces have moved by one layer."""
    return partition.displaced_front(lattice(spark, sf_dir)[1], 1).select("tid", "part")


@_query("merged_solutions", "SELECT vid, round(val, 2) AS val, CAST(min(part) AS INTEGER) AS part FROM bv JOIN vtx USING (vid) GROUP BY vid, val")
def merged_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's own table of vertices with their solutions, put together again."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    copies = topology.part_vertices(tetra, "block").join(vertices.select("vid", "val"), "vid")
    blocks = [copies.where(F.col("part") == i) for i in range(4)]
    return exchange.merge_parts(blocks, ("vid",)).select("vid", F.round("val", 2).alias("val"), "part")


@_query("file_round_trip", """
, tri AS (SELECT t.part, count(*) AS n FROM wall w JOIN tet t ON t.tid = w.fid // 4 GROUP BY t.part),
ifc AS (SELECT part_in AS part, count(*) AS n FROM (SELECT ps, unnest(ps) AS part_in FROM (SELECT vid, list(part) AS ps FROM pv GROUP BY vid HAVING count(*) > 1) a) b, (SELECT unnest([0, 1, 2, 3]) AS q) c WHERE list_contains(ps, q) AND q <> part_in GROUP BY part_in)
SELECT 'vertices' AS entity, part, count(*) AS n FROM pv GROUP BY part UNION ALL SELECT 'tetra', part, count(*) FROM tet GROUP BY part UNION ALL SELECT 'triangles', part, n FROM tri UNION ALL SELECT 'iface', part, n FROM ifc
UNION ALL SELECT 'corners', part, count(*) FROM pv WHERE vid % 13 = 0 GROUP BY part""", _SKIN)
def file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices with tags, tetra, triangles and node interfaces of each part, written as text files and read back."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    triangles, _ = _skin(spark, sf_dir)
    tagged = vertices.select("vid", "x", "y", "z", F.when(F.col("vid") % 13 == 0, S.CRN).otherwise(0).alias("tag"))
    path = _fresh(spark, "files")
    medit.write_mesh(MeshFrame(spark, localised(tagged, tetra, triangles.select("fid", "v0", "v1", "v2", "ref"), interfaces=True)), path)
    back = medit.read_mesh(spark, path)
    counted = {k: back.table(k) for k in ("vertices", "tetra", "triangles")} | {"iface": back.table("iface").withColumn("part", F.col("part_in")), "corners": back.vertices.where(F.col("tag").bitwiseAND(S.CRN) != 0)}
    out = None
    for name, df in counted.items():
        one = df.groupBy("part").agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "part", "n")
        out = one if out is None else out.unionAll(one)
    return out


@_query("ls_snapped_cut", """
, pl AS (SELECT tid, count(*) FILTER (WHERE i < (m - 1) // 2) AS low FROM (SELECT c.tid, v.i, v.m FROM cor c JOIN vtx v USING (vid)) u GROUP BY tid) SELECT CAST(CASE WHEN low > 0 THEN 3 ELSE 2 END AS INTEGER) AS ref, count(*) AS n FROM pl GROUP BY 1""")
def ls_snapped_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level set close to a plane of vertices: values are taken to it, and no tetra is cut."""
    vertices, tetra, m = lattice(spark, sf_dir)
    ls = vertices.select("vid", (F.col("x") - float((m - 1) // 2) + 1e-8).alias("v"))
    cut, _ = levelset.discretise(tetra, vertices, ls, snap=True)
    return cut.groupBy("ref").agg(F.count("*").alias("n"))
