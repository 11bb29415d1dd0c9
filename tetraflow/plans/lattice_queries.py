"""Queries of the mesh engine over the lattice that the driver's orders table spans, with DuckDB oracles.

Every callable takes (spark, sf_dir); every oracle builds the same lattice in
SQL and gets the answer its own way: by plain joins, windows, or closed forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetraflow import schema as S
from tetraflow.functions import geometry as G
from tetraflow.operators import checks, components, exchange, interpolate, levelset, locate, numbering, partition, stats, surface, tags, topology
from tetraflow.sources.lattice import lattice
from tetraflow.staging import staged

LS_VALUE = 200_000.0

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

#: The lattice in SQL: m, vertices vtx, tetra tet, their faces fac, distinct faces adj, the same with their two sides sid, edges edg.
LATTICE = """
WITH m AS (SELECT max(g) AS m FROM range(1, 3000) t(g), (SELECT count(*) AS c FROM orders) n WHERE g * g * g <= n.c),
vtx AS (SELECT o_orderkey AS vid, o_orderkey % m AS i, (o_orderkey // m) % m AS j, o_orderkey // (m * m) AS k, o_totalprice AS val,
  o_custkey AS cust, 0.5 + ((o_orderkey * 7919) % 100) / 64.0::DOUBLE AS size, m FROM orders, m WHERE o_orderkey < m * m * m),
perm AS (SELECT * FROM (VALUES (0, 1, 0, 0, 1, 1, 0), (1, 1, 0, 1, 1, 0, 0), (2, 1, 1, 0, 0, 1, 0), (3, 0, 1, 0, 0, 1, 1), (4, 0, 0, 1, 1, 0, 1), (5, 0, 1, 1, 0, 0, 1)) t(p, a1, am, an, b1, bm, bn)),
tet AS (SELECT vid * 6 + p AS tid, vid AS v0, vid + a1 + am * m + an * m * m AS v1,
  CASE p WHEN 0 THEN vid + 1 + m WHEN 1 THEN vid + 1 WHEN 2 THEN vid + m WHEN 3 THEN vid + m + m * m WHEN 4 THEN vid + m * m + 1 ELSE vid + m * m END AS v2,
  vid + 1 + m + m * m AS v3, CAST(cust % 2 AS INTEGER) AS ref, CAST(least(i * 4 // (m - 1), 3) AS INTEGER) AS part,
  CAST((i * 2 // (m - 1)) * 2 + j * 2 // (m - 1) AS INTEGER) AS block, i, j, k, p, m
  FROM vtx, perm WHERE i < m - 1 AND j < m - 1 AND k < m - 1),
fac AS (SELECT tid, ref, part, block, ifac, least(a, b, c) AS f0, a + b + c - least(a, b, c) - greatest(a, b, c) AS f1, greatest(a, b, c) AS f2, a AS n0, b AS n1, c AS n2 FROM (
  SELECT tid, ref, part, block, 0 AS ifac, v1 AS a, v2 AS b, v3 AS c FROM tet UNION ALL SELECT tid, ref, part, block, 1, v0, v3, v2 FROM tet
  UNION ALL SELECT tid, ref, part, block, 2, v0, v1, v3 FROM tet UNION ALL SELECT tid, ref, part, block, 3, v0, v2, v1 FROM tet) u),
adj AS (SELECT f0, f1, f2, count(*) AS n, min(tid) AS ta, max(tid) AS tb FROM fac GROUP BY f0, f1, f2),
sid AS MATERIALIZED (SELECT f0, f1, f2, count(*) AS n, min(tid) AS ta, max(tid) AS tb, arg_min(ifac, tid) AS ia, arg_max(ifac, tid) AS ib,
  arg_min(part, tid) AS pa, arg_max(part, tid) AS pb, arg_min(block, tid) AS ba, arg_max(block, tid) AS bb FROM fac GROUP BY f0, f1, f2),
edg AS (SELECT least(a, b) AS a, greatest(a, b) AS b, tid, part, block, ref FROM (
  SELECT v0 AS a, v1 AS b, tid, part, block, ref FROM tet UNION ALL SELECT v0, v2, tid, part, block, ref FROM tet UNION ALL SELECT v0, v3, tid, part, block, ref FROM tet
  UNION ALL SELECT v1, v2, tid, part, block, ref FROM tet UNION ALL SELECT v1, v3, tid, part, block, ref FROM tet UNION ALL SELECT v2, v3, tid, part, block, ref FROM tet) u),
cor AS (SELECT tid, part, block, 0 AS c, v0 AS vid FROM tet UNION ALL SELECT tid, part, block, 1, v1 FROM tet UNION ALL SELECT tid, part, block, 2, v2 FROM tet UNION ALL SELECT tid, part, block, 3, v3 FROM tet),
pv AS (SELECT DISTINCT part, vid FROM cor),
bv AS (SELECT DISTINCT block AS part, vid FROM cor),
wrp AS (SELECT vid, i + (size - 1.0) / 8.0 AS x, j + (size - 1.0) / 16.0 AS y, CAST(k AS DOUBLE) AS z, size, val FROM vtx)
"""

_WARPED_TET = """
, pos AS (SELECT t.tid, t.part, t.v0, t.v1, t.v2, t.v3, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2, d.x AS x3, d.y AS y3, d.z AS z3
  FROM tet t JOIN wrp a ON a.vid = t.v0 JOIN wrp b ON b.vid = t.v1 JOIN wrp c ON c.vid = t.v2 JOIN wrp d ON d.vid = t.v3),
qual AS (SELECT tid, part, round(CASE WHEN s > 0 THEN 124.70765814495915 * (det / 6.0) / (s * sqrt(s)) ELSE 0 END, 9) AS q FROM (SELECT tid, part,
  (x1 - x0) * ((y2 - y0) * (z3 - z0) - (z2 - z0) * (y3 - y0)) + (y1 - y0) * ((z2 - z0) * (x3 - x0) - (x2 - x0) * (z3 - z0)) + (z1 - z0) * ((x2 - x0) * (y3 - y0) - (y2 - y0) * (x3 - x0)) AS det,
  ((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)+(z1-z0)*(z1-z0)) + ((x2-x0)*(x2-x0)+(y2-y0)*(y2-y0)+(z2-z0)*(z2-z0)) + ((x3-x0)*(x3-x0)+(y3-y0)*(y3-y0)+(z3-z0)*(z3-z0))
  + ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)+(z2-z1)*(z2-z1)) + ((x3-x1)*(x3-x1)+(y3-y1)*(y3-y1)+(z3-z1)*(z3-z1)) + ((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2)+(z3-z2)*(z3-z2)) AS s FROM pos) u)
"""


def _query(name: str, oracle: str | None = None, with_: str = "") -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = LATTICE + with_ + oracle
        return f

    return add


def _warped(vertices: DataFrame) -> DataFrame:
    """The lattice with its points moved a little, so that qualities and lengths differ."""
    off = F.col("size") - 1.0
    return vertices.select("vid", (F.col("i") + off / 8.0).alias("x"), (F.col("j") + off / 16.0).alias("y"), F.col("k").cast("double").alias("z"), "size", "val")


@_query("quality_and_interfaces", with_=_WARPED_TET, oracle="""
, fp AS (SELECT f.part, count(*) FILTER (WHERE a.n = 1) AS n_boundary, count(*) FILTER (WHERE a.n = 2) AS n_inner_sides,
    count(*) FILTER (WHERE a.n = 2 AND ta.part <> tb.part) AS n_interface
  FROM fac f JOIN adj a USING (f0, f1, f2) JOIN tet ta ON ta.tid = a.ta JOIN tet tb ON tb.tid = a.tb GROUP BY f.part),
own AS (SELECT owner AS part, count(*) AS n_owned FROM (SELECT vid, max(part) AS owner FROM pv GROUP BY vid) u GROUP BY owner)
SELECT q.part, count(*) AS n_tetra, n_boundary, n_inner_sides, n_interface, n_owned, round(avg(q), 6) AS avg_q, round(max(q), 6) AS max_q, round(min(q), 6) AS min_q, arg_min(tid, (q, tid)) AS worst_tid
FROM qual q JOIN fp USING (part) JOIN own USING (part) GROUP BY q.part, n_boundary, n_inner_sides, n_interface, n_owned""")  # fmt: skip
def quality_and_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: per part its tetra, faces by kind, owned vertices, quality and worst element."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    adjacency = topology.face_adjacency(tetra)
    sides = F.when(F.col("n") == 1, F.array("a.part")).otherwise(F.array("a.part", "b.part"))
    faces = adjacency.select("n", (F.col("a.part") != F.col("b.part")).alias("cut"), F.explode(sides).alias("part"))
    by_part = faces.groupBy("part").agg(F.count_if(F.col("n") == 1).alias("n_boundary"), F.count_if(F.col("n") == 2).alias("n_inner_sides"), F.count_if((F.col("n") == 2) & F.col("cut")).alias("n_interface"))
    owned = numbering.point_counts(topology.part_vertices(tetra)).withColumnRenamed("n", "n_owned")
    quality = stats.quality_summary(stats.tetra_quality(tetra, _warped(vertices)), ("part",))
    return quality.join(by_part, "part").join(owned, "part").select("part", F.col("ne").alias("n_tetra"), "n_boundary", "n_inner_sides", "n_interface", "n_owned", "avg_q", "max_q", "min_q", "worst_tid")


@_query("lattice_counts", """
SELECT (SELECT count(*) FROM vtx) AS n_vertices, (SELECT count(*) FROM tet) AS n_tetra, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM edg) u) AS n_edges,
  count(*) AS n_faces, count(*) FILTER (WHERE n = 1) AS n_boundary, count(*) FILTER (WHERE n > 2) AS n_crowded FROM adj""")
def lattice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, tetra, _ = lattice(spark, sf_dir)
    faces = topology.face_adjacency(tetra).agg(F.count("*").alias("n_faces"), F.count_if(F.col("n") == 1).alias("n_boundary"), F.count_if(F.col("n") > 2).alias("n_crowded"))
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("k", F.lit(0))
    out = one(vertices, "n_vertices").join(one(tetra, "n_tetra"), "k").join(one(topology.unique_edges(tetra), "n_edges"), "k")
    return out.join(faces.withColumn("k", F.lit(0)), "k").drop("k")


@_query("face_adjacency", "SELECT f0, f1, f2, n, ta AS tid_a, tb AS tid_b FROM adj")
def face_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.face_adjacency(lattice(spark, sf_dir)[1]).select("f0", "f1", "f2", "n", F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b"))


@_query("neighbours", """
SELECT ta AS tid, ia AS ifac, CASE WHEN n = 2 THEN tb END AS tid_n, CASE WHEN n = 2 THEN ib END AS ifac_n FROM sid UNION ALL SELECT tb, ib, ta, ia FROM sid WHERE n = 2""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.neighbours(lattice(spark, sf_dir)[1])


@_query("boundary_faces", """
SELECT f0, f1, f2, n0, n1, n2, tid, ifac, ref FROM (SELECT f.*, a.n, ta.ref AS ra, tb.ref AS rb FROM fac f JOIN adj a USING (f0, f1, f2) JOIN tet ta ON ta.tid = a.ta JOIN tet tb ON tb.tid = a.tb) u
WHERE n = 1 OR (ra <> rb AND ref = least(ra, rb))""")
def boundary_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.boundary_faces(lattice(spark, sf_dir)[1], between_refs=True).drop("part")


@_query("edge_table", "SELECT a, b, count(*) AS n FROM edg GROUP BY a, b")
def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.unique_edges(lattice(spark, sf_dir)[1])


@_query("vertex_ball", "SELECT vid, count(*) AS n_tetra, min(tid) AS first_tid, max(tid) AS last_tid FROM cor GROUP BY vid")
def vertex_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    ball = topology.vertex_ball(lattice(spark, sf_dir)[1])
    return ball.groupBy("vid").agg(F.count("*").alias("n_tetra"), F.min("tid").alias("first_tid"), F.max("tid").alias("last_tid"))


@_query("interface_nodes", "SELECT 'node' AS kind, p.part AS part_in, q.part AS part_out, vid AS gid FROM bv p JOIN bv q USING (vid) WHERE p.part <> q.part")
def interface_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.interface_nodes(lattice(spark, sf_dir)[1], "block")


@_query("interface_edges", """
, te AS (SELECT a, b, list(DISTINCT block) AS ps FROM edg GROUP BY a, b HAVING min(block) < max(block)), one AS (SELECT a, b, ps, unnest(ps) AS part_in FROM te)
SELECT 'edge' AS kind, part_in, unnest(list_filter(ps, lambda q: q <> part_in)) AS part_out, a, b FROM one""")
def interface_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.interface_edges(lattice(spark, sf_dir)[1], "block")


_IFACE = "SELECT f0, f1, f2, ba AS part_in, bb AS part_out, ta AS tid_in, tb AS tid_out FROM sid WHERE n = 2 AND ba <> bb UNION ALL SELECT f0, f1, f2, bb, ba, tb, ta FROM sid WHERE n = 2 AND ba <> bb"


@_query("interface_faces", _IFACE)
def interface_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.interface_faces(lattice(spark, sf_dir)[1], "block")


@_query("faces_from_nodes", "SELECT f0 AS g0, f1 AS g1, f2 AS g2, pa AS part_in, pb AS part_out FROM sid WHERE n = 2 AND pa <> pb UNION ALL SELECT f0, f1, f2, pb, pa FROM sid WHERE n = 2 AND pa <> pb")
def faces_from_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface faces rebuilt from interface nodes alone; each part's own boundary triangles are the candidates."""
    _, tetra, _ = lattice(spark, sf_dir)
    own = topology.tetra_faces(tetra).groupBy("part", "f0", "f1", "f2").agg(F.count("*").alias("n")).where("n = 1")
    triangles = own.select("part", F.xxhash64("f0", "f1", "f2").alias("fid"), F.col("f0").alias("v0"), F.col("f1").alias("v1"), F.col("f2").alias("v2"))
    nodes = topology.interface_nodes(tetra).select(F.col("part_in").alias("part"), F.col("gid").alias("lid"), "gid").distinct()
    return topology.faces_from_nodes(triangles, nodes).select("g0", "g1", "g2", "part_in", "part_out")


@_query("interface_positions", f"SELECT part_in, part_out, f0, f1, f2, CAST(row_number() OVER (PARTITION BY part_in, part_out ORDER BY f0, f1, f2) - 1 AS BIGINT) AS pos FROM ({_IFACE}) u")
def interface_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = topology.interface_faces(lattice(spark, sf_dir)[1], "block").withColumn("kind", F.lit("face"))
    return topology.interface_positions(faces, ("f0", "f1", "f2")).select("part_in", "part_out", "f0", "f1", "f2", "pos")


@_query("owner_highest", "SELECT vid, max(part) AS owner, count(*) AS n_parts FROM bv GROUP BY vid")
def owner_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.owners(topology.part_vertices(lattice(spark, sf_dir)[1], "block"))


@_query("owner_lowest", "SELECT a, b, min(block) AS owner, count(DISTINCT block) AS n_parts FROM edg GROUP BY a, b")
def owner_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    touch = topology.tetra_edges(lattice(spark, sf_dir)[1]).select(F.col("block").alias("part"), "a", "b")
    return numbering.edge_owners(touch)


@_query("global_numbering", """
, own AS (SELECT vid, max(part) AS owner FROM bv GROUP BY vid), num AS (SELECT vid, owner, row_number() OVER (ORDER BY owner, vid) AS gnum FROM own)
SELECT b.part, b.vid, n.owner, n.gnum FROM bv b JOIN num n USING (vid)""")
def global_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.global_vertices(topology.part_vertices(lattice(spark, sf_dir)[1], "block"))


@_query("triangle_numbering", """
, tri AS (SELECT f0, f1, f2, max(f.block) AS top, a.n = 2 AND ta.ref = tb.ref AS pure FROM fac f JOIN adj a USING (f0, f1, f2) JOIN tet ta ON ta.tid = a.ta JOIN tet tb ON tb.tid = a.tb
  WHERE a.n = 1 OR ta.block <> tb.block GROUP BY f0, f1, f2, a.n, ta.ref, tb.ref)
SELECT f0, f1, f2, CASE WHEN pure THEN NULL ELSE top END AS owner, row_number() OVER (ORDER BY pure, top, f0, f1, f2) AS gnum FROM tri""")
def triangle_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = topology.face_adjacency(lattice(spark, sf_dir)[1])
    outer, cut = F.col("n") == 1, (F.col("n") == 2) & (F.col("a.block") != F.col("b.block"))
    pure = cut & (F.col("a.ref") == F.col("b.ref"))
    own = faces.where(outer | cut).select(F.struct("f0", "f1", "f2").alias("fid"), F.explode(F.array("a.block", "b.block")).alias("part"), pure.alias("pure"))
    return numbering.global_triangles(own).select("fid.f0", "fid.f1", "fid.f2", "owner", "gnum")


@_query("interface_node_owners", """
, sh AS (SELECT vid AS gid, min(part) AS owner FROM bv GROUP BY vid HAVING count(*) > 1) SELECT gid, owner, row_number() OVER (ORDER BY owner, gid) AS gnum FROM sh""")
def interface_node_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.interface_node_owners(topology.interface_nodes(lattice(spark, sf_dir)[1], "block")).select("gid", "owner", "gnum")


@_query("interface_node_counts", """
, sh AS (SELECT vid, min(part) AS owner FROM bv GROUP BY vid HAVING count(*) > 1)
SELECT p.part, count(*) AS n_shared, count(*) FILTER (WHERE p.part = owner) AS n_owned FROM bv p JOIN sh USING (vid) GROUP BY p.part""")
def interface_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.interface_node_counts(topology.interface_nodes(lattice(spark, sf_dir)[1], "block"))


@_query("interface_face_owners", f"SELECT f0, f1, f2, part_in AS owner, part_out AS other, row_number() OVER (ORDER BY part_in, part_out, f0, f1, f2) AS gnum FROM ({_IFACE}) u WHERE part_in < part_out")
def interface_face_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.interface_face_owners(topology.interface_faces(lattice(spark, sf_dir)[1], "block"))


@_query("dense_edge_numbers", "SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS eid FROM (SELECT DISTINCT a, b FROM edg) u")
def dense_edge_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.dense_ids(topology.unique_edges(lattice(spark, sf_dir)[1]).select("a", "b"), ("a", "b"), 0, "eid")


@_query("point_counts", "SELECT owner AS part, count(*) AS n FROM (SELECT vid, max(part) AS owner FROM bv GROUP BY vid) u GROUP BY owner")
def point_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.point_counts(topology.part_vertices(lattice(spark, sf_dir)[1], "block"))


@_query("entity_counts", """
, c AS (SELECT 'tetra' AS entity, part, count(*) AS n FROM tet GROUP BY part UNION ALL SELECT 'vertices', part, count(*) FROM pv GROUP BY part)
SELECT entity, part, n, CAST(coalesce(sum(n) OVER (PARTITION BY entity ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM c""")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tetra, _ = lattice(spark, sf_dir)
    return numbering.entity_counts({"tetra": tetra, "vertices": topology.part_vertices(tetra)})


@_query("quality_histogram", with_=_WARPED_TET, oracle="""
SELECT count(*) AS ne, round(avg(q), 6) AS avg_q, round(max(q), 6) AS max_q, count(*) FILTER (WHERE q > 0.5) AS n_good, count(*) FILTER (WHERE q > 0.12) AS n_fair,
  count(*) FILTER (WHERE q < 0.2) AS bin0, count(*) FILTER (WHERE q >= 0.2 AND q < 0.4) AS bin1, count(*) FILTER (WHERE q >= 0.4 AND q < 0.6) AS bin2, count(*) FILTER (WHERE q >= 0.6 AND q < 0.8) AS bin3,
  count(*) FILTER (WHERE q >= 0.8) AS bin4, round(min(q), 6) AS min_q, arg_min(tid, (q, part, tid)) AS worst_tid FROM qual""")  # fmt: skip
def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, tetra, _ = lattice(spark, sf_dir)
    return stats.quality_summary(stats.tetra_quality(tetra, _warped(vertices)))


@_query("edge_length_histogram", """
, len AS (SELECT a, b, round(CASE WHEN abs(h1 - h0) < 1e-6 * h0 THEN l / h0 ELSE l * ln(h1 / h0) / (h1 - h0) END, 9) AS l FROM (
  SELECT e.a, e.b, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) AS l, p.size AS h0, q.size AS h1
  FROM (SELECT DISTINCT a, b FROM edg) e JOIN wrp p ON p.vid = e.a JOIN wrp q ON q.vid = e.b) u)
SELECT count(*) AS n, round(avg(l), 6) AS mean, count(*) FILTER (WHERE l <= 0) AS n_zero, count(*) FILTER (WHERE l < 0.3) AS bin0, count(*) FILTER (WHERE l >= 0.3 AND l < 0.6) AS bin1,
  count(*) FILTER (WHERE l >= 0.6 AND l < 0.7071) AS bin2, count(*) FILTER (WHERE l >= 0.7071 AND l < 0.9) AS bin3, count(*) FILTER (WHERE l >= 0.9 AND l < 1.3) AS bin4, count(*) FILTER (WHERE l >= 1.3 AND l < 1.4142) AS bin5,
  count(*) FILTER (WHERE l >= 1.4142 AND l < 2) AS bin6, count(*) FILTER (WHERE l >= 2 AND l < 5) AS bin7, count(*) FILTER (WHERE l >= 5) AS bin8,
  round(min(l), 6) AS min_len, arg_min(a, (l, a, b)) AS min_a, arg_min(b, (l, a, b)) AS min_b, round(max(l), 6) AS max_len, arg_min(a, (-l, a, b)) AS max_a, arg_min(b, (-l, a, b)) AS max_b FROM len""")  # fmt: skip
def edge_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, tetra, _ = lattice(spark, sf_dir)
    edges = topology.unique_edges(tetra).select("a", "b")
    return stats.length_summary(stats.edge_lengths(edges, _warped(vertices)))


@_query("tensor_edge_lengths", """
SELECT e.a, e.b, round((sqrt(dx * dx / (p.size * p.size) + dy * dy / 4.0 + 2.0 * 0.125 * dy * dz + dz * dz) + sqrt(dx * dx / (q.size * q.size) + dy * dy / 4.0 + 2.0 * 0.125 * dy * dz + dz * dz)) / 2.0, 6) AS length
FROM (SELECT e.a, e.b, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz FROM (SELECT DISTINCT a, b FROM edg) e JOIN wrp p ON p.vid = e.a JOIN wrp q ON q.vid = e.b) e JOIN wrp p ON p.vid = e.a JOIN wrp q ON q.vid = e.b""")
def tensor_edge_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, tetra, _ = lattice(spark, sf_dir)
    warped = _warped(vertices)
    zero = F.lit(0.0)
    metric = warped.select("vid", F.array(1.0 / (F.col("size") * F.col("size")), zero, zero, F.lit(0.25), F.lit(0.125), F.lit(1.0)).alias("val"))
    lengths = stats.tensor_edge_lengths(topology.unique_edges(tetra).select("a", "b"), warped.select("vid", "x", "y", "z"), metric)
    return lengths.select("a", "b", F.round("length", 6).alias("length"))


@_query("part_bbox", "SELECT part, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM pv JOIN wrp USING (vid) GROUP BY part")
def part_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, tetra, _ = lattice(spark, sf_dir)
    return stats.boxes(topology.part_vertices(tetra), _warped(vertices))


@_query("bbox_overlap", """
, bx AS (SELECT part, min(i) AS x0, max(i) AS x1, min(j) AS y0, max(j) AS y1, min(k) AS z0, max(k) AS z1 FROM bv JOIN vtx USING (vid) GROUP BY part)
SELECT p.part AS part_a, q.part AS part_b FROM bx p, bx q WHERE p.part < q.part AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1 AND p.z0 < q.z1 AND q.z0 < p.z1
UNION ALL SELECT p.part + 10, q.part + 10 FROM (SELECT part, min(x) AS x0, max(x) AS x1 FROM pv JOIN wrp USING (vid) GROUP BY part) p, (SELECT part, min(x) AS x0, max(x) AS x1 FROM pv JOIN wrp USING (vid) GROUP BY part) q
WHERE p.part < q.part AND p.x0 < q.x1 AND q.x0 < p.x1""")
def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the lattice only touch, so none meet; slabs of the warped one do (numbered from 10)."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    plain = stats.overlapping_boxes(stats.boxes(topology.part_vertices(tetra, "block"), vertices))
    warped = stats.overlapping_boxes(stats.boxes(topology.part_vertices(tetra), _warped(vertices)))
    return plain.unionAll(warped.select(F.col("part_a") + 10, F.col("part_b") + 10))


@_query("part_balance", "SELECT part, count(*) AS ne, round(count(*) / avg(count(*)) OVER (), 6) AS imbalance FROM tet GROUP BY part")
def part_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.balance(lattice(spark, sf_dir)[1])


@_query("dual_graph", "SELECT ta AS tid_a, tb AS tid_b, CAST(1 AS BIGINT) AS weight FROM adj WHERE n = 2")
def dual_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.dual_graph(lattice(spark, sf_dir)[1])


@_query("group_graph", "SELECT least(ba, bb) AS group_a, greatest(ba, bb) AS group_b, count(*) AS weight FROM sid WHERE n = 2 AND ba <> bb GROUP BY ALL")
def group_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.group_graph(lattice(spark, sf_dir)[1], "block")


@_query("interface_weight", """
, ml AS (SELECT a, b, CASE WHEN l <= 1 THEN l - 1 ELSE 1 / l - 1 END AS d FROM (SELECT a, b, CASE WHEN abs(h1 - h0) < 1e-6 * h0 THEN l / h0 ELSE l * ln(h1 / h0) / (h1 - h0) END AS l FROM (
  SELECT e.a, e.b, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) AS l, p.size AS h0, q.size AS h1
  FROM (SELECT DISTINCT a, b FROM edg) e JOIN wrp p ON p.vid = e.a JOIN wrp q ON q.vid = e.b) u) w)
SELECT f.f0, f.f1, f.f2, round(ln(least(1 / exp(28.0 * (x.d + y.d + z.d) / 3), 1e6)), 4) AS log_weight FROM adj f JOIN tet ta ON ta.tid = f.ta JOIN tet tb ON tb.tid = f.tb
JOIN ml x ON x.a = f.f0 AND x.b = f.f1 JOIN ml y ON y.a = f.f0 AND y.b = f.f2 JOIN ml z ON z.a = f.f1 AND z.b = f.f2 WHERE n = 2 AND ta.part <> tb.part""")
def interface_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, tetra, _ = lattice(spark, sf_dir)
    faces = topology.interface_faces(tetra).where("part_in < part_out").select("f0", "f1", "f2")
    return partition.face_weights(faces, _warped(vertices)).select("f0", "f1", "f2", F.round(F.log("weight"), 4).alias("log_weight"))


def _bisect_level(level: int, axis: str, before: str) -> str:
    return f"""
, e{level} AS (SELECT part, min({axis}) AS lo, max({axis}) AS hi FROM {before} GROUP BY part),
b{level} AS (SELECT s.*, CAST(least(CASE WHEN hi > lo THEN floor(({axis} - lo) * 1024 / (hi - lo)) ELSE 0 END, 1023) AS INTEGER) AS bin FROM {before} s JOIN e{level} USING (part)),
c{level} AS (SELECT part, min(bin) AS cut FROM (SELECT part, bin, sum(count(*)) OVER (PARTITION BY part ORDER BY bin) AS c, sum(count(*)) OVER (PARTITION BY part) AS t FROM b{level} GROUP BY part, bin) u WHERE 2 * c >= t GROUP BY part),
s{level} AS (SELECT tid, x, y, z, part * 2 + CASE WHEN bin > cut THEN 1 ELSE 0 END AS part FROM b{level} JOIN c{level} USING (part))"""


_CENTRES = """
, s AS (SELECT tid, a.x + b.x + c.x + d.x AS x, a.y + b.y + c.y + d.y AS y, a.z + b.z + c.z + d.z AS z, 0 AS part FROM tet t
  JOIN (SELECT vid, i::DOUBLE AS x, j::DOUBLE AS y, k::DOUBLE AS z FROM vtx) a ON a.vid = v0 JOIN (SELECT vid, i::DOUBLE AS x, j::DOUBLE AS y, k::DOUBLE AS z FROM vtx) b ON b.vid = v1
  JOIN (SELECT vid, i::DOUBLE AS x, j::DOUBLE AS y, k::DOUBLE AS z FROM vtx) c ON c.vid = v2 JOIN (SELECT vid, i::DOUBLE AS x, j::DOUBLE AS y, k::DOUBLE AS z FROM vtx) d ON d.vid = v3)"""


@_query("bisection_parts", _CENTRES + _bisect_level(1, "x", "s") + _bisect_level(2, "y", "s1") + _bisect_level(3, "z", "s2") + "SELECT tid, CAST(part AS INTEGER) AS part FROM s3")
def bisection_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, tetra, _ = lattice(spark, sf_dir)
    return partition.bisect(partition.centres(tetra, vertices), 8)


@_query("contiguity", """
, st AS (SELECT tid, CAST((i // 3) % 2 AS INTEGER) AS part, i // 3 AS slab FROM tet), p AS (SELECT part, slab, count(*) AS n FROM st GROUP BY part, slab)
SELECT part, count(*) AS n_pieces, max(n) AS largest FROM p GROUP BY part""")
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts in alternating stripes of three cells: as many pieces as stripes."""
    return components.contiguity(components.part_components(_striped(spark, sf_dir)))


def _striped(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tetra, m = lattice(spark, sf_dir)
    return tetra.withColumn("part", (F.floor((F.col("v0") % m) / 3) % 2).cast("int"))


@_query("component_labels", ", st AS (SELECT tid, CAST((i // 3) % 2 AS INTEGER) AS part, i // 3 AS slab FROM tet) SELECT tid, part, min(tid) OVER (PARTITION BY slab) AS comp FROM st")
def component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.part_components(_striped(spark, sf_dir)).select("tid", "part", "comp")


_FIXED = """
, st AS (SELECT tid, CAST((i // 3) % 2 AS INTEGER) AS part, i // 3 AS slab FROM tet), sz AS (SELECT part, slab, count(*) AS n, min(tid) AS first FROM st GROUP BY part, slab),
big AS (SELECT part, arg_min(slab, (-n, first)) AS slab FROM sz GROUP BY part)
SELECT tid, CASE WHEN st.slab = big.slab THEN st.part ELSE 1 - st.part END AS part FROM st JOIN big ON big.part = st.part"""


@_query("fix_contiguity", _FIXED)
def fix_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.fix_contiguity(_striped(spark, sf_dir)).select("tid", F.col("part").cast("int").alias("part"))


@_query("halo_tetra", "SELECT DISTINCT q.part AS part_out, c.tid FROM cor c JOIN bv q USING (vid) WHERE q.part <> c.block")
def halo_tetra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.halo_tetra(lattice(spark, sf_dir)[1], "block")


@_query("halo_counts", """
, h AS (SELECT DISTINCT c.block AS part_in, q.part AS part_out, c.tid FROM cor c JOIN bv q USING (vid) WHERE q.part <> c.block)
SELECT h.part_in, h.part_out, count(DISTINCT h.tid) AS n_tetra, count(DISTINCT CASE WHEN o.vid IS NULL THEN c.vid END) AS n_points
FROM h JOIN cor c USING (tid) LEFT JOIN bv o ON o.vid = c.vid AND o.part = h.part_out GROUP BY h.part_in, h.part_out""")
def halo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.halo_counts(lattice(spark, sf_dir)[1], "block")


@_query("halo_round_trip", "SELECT block AS part, count(*) AS ne FROM tet GROUP BY block")
def halo_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tetra, _ = lattice(spark, sf_dir)
    back = exchange.without_halo(exchange.with_halo(tetra, "block"))
    return back.groupBy(F.col("block").alias("part")).agg(F.count("*").alias("ne"))


@_query("merge_dedup", "SELECT vid, min(part) AS part, val, cust FROM bv JOIN vtx USING (vid) GROUP BY vid, val, cust")
def merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block's copy of its vertices, merged again: once each, from the lowest."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    copies = topology.part_vertices(tetra, "block").join(vertices.select("vid", "val", "cust"), "vid")
    return exchange.merge_copies(copies, ("vid",)).select("vid", "part", "val", "cust")


@_query("merge_by_coordinates", "SELECT b.part, b.vid AS lid, min(c.part) OVER (PARTITION BY b.vid) AS home FROM bv b JOIN bv c ON b.part = c.part AND b.vid = c.vid")
def merge_by_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a point found by where they stand, not by id: home is the lowest part that has it."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    local = topology.part_vertices(tetra, "block").join(_warped(vertices), "vid").select("part", F.col("vid").alias("lid"), "x", "y", "z")
    return exchange.merge_by_coordinates(local).select("part", "lid", F.shiftright("gid", 40).cast("int").alias("home"))


@_query("consistency", "SELECT 'crowded_faces' AS rule, CAST(0 AS BIGINT) AS broken UNION ALL SELECT 'dangling', 0 UNION ALL SELECT 'inverted', 0 UNION ALL SELECT 'merged_nodes', 0 UNION ALL SELECT 'split_nodes', 0 UNION ALL SELECT 'unmirrored', 0 UNION ALL SELECT 'unused_vertices', 0")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each rule; a mesh that conforms has none."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    warped = _warped(vertices)
    copies = topology.part_vertices(tetra, "block").join(warped.select(F.col("vid"), "x", "y", "z"), "vid").withColumnRenamed("vid", "gid")
    found = {
        "crowded_faces": checks.crowded_faces(tetra),
        "dangling": checks.dangling(tetra, vertices),
        "inverted": checks.inverted(stats.tetra_quality(tetra, warped)),
        "merged_nodes": checks.merged_nodes(copies),
        "split_nodes": checks.split_nodes(copies),
        "unmirrored": checks.unmirrored(topology.interface_faces(tetra, "block"), ("f0", "f1", "f2")),
        "unused_vertices": checks.unused_vertices(tetra, vertices),
    }
    # one rule after the other: a union of all would hold the shuffle files, and plan the lattice, of all rules at once
    return checks.counted(spark, found)


def _asked(spark: SparkSession, sf_dir: str, m: int) -> DataFrame:
    """A point in the lattice for each customer."""
    key = F.col("c_custkey")
    at = lambda a, b: ((key * a) % b) / F.lit(float(b)) * float(m - 1)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("pid"), at(37, 1000).alias("x"), at(91, 997).alias("y"), at(53, 991).alias("z"))


_ASKED = """
, pts AS (SELECT c_custkey AS pid, ((c_custkey * 37) % 1000) / 1000.0::DOUBLE * (m - 1) AS x, ((c_custkey * 91) % 997) / 997.0::DOUBLE * (m - 1) AS y, ((c_custkey * 53) % 991) / 991.0::DOUBLE * (m - 1) AS z, m FROM customer, m),
near AS (SELECT pid, x, y, z, m, CAST(floor(x) AS BIGINT) + di AS ci, CAST(floor(y) AS BIGINT) + dj AS cj, CAST(floor(z) AS BIGINT) + dk AS ck FROM pts, (VALUES (0), (-1)) a(di), (VALUES (0), (-1)) b(dj), (VALUES (0), (-1)) c(dk)),
frac AS (SELECT pid, m, ci + cj * m + ck * m * m AS v0, x - ci AS fx, y - cj AS fy, z - ck AS fz FROM near WHERE ci BETWEEN 0 AND m - 2 AND cj BETWEEN 0 AND m - 2 AND ck BETWEEN 0 AND m - 2),
bar AS (SELECT pid, v0 * 6 + p AS tid, m, 1 - fa AS p0, fa - fb AS pa, fb - fc AS pb, fc AS p3, p FROM (SELECT pid, v0, m, p, CASE p WHEN 0 THEN fx WHEN 1 THEN fx WHEN 2 THEN fy WHEN 3 THEN fy ELSE fz END AS fa,
  CASE p WHEN 0 THEN fy WHEN 1 THEN fz WHEN 2 THEN fx WHEN 3 THEN fz WHEN 4 THEN fx ELSE fy END AS fb, CASE p WHEN 0 THEN fz WHEN 1 THEN fy WHEN 2 THEN fz WHEN 3 THEN fx WHEN 4 THEN fy ELSE fx END AS fc FROM frac, perm) u),
loc AS (SELECT pid, tid, p0, CASE WHEN p IN (1, 2, 5) THEN pb ELSE pa END AS p1, CASE WHEN p IN (1, 2, 5) THEN pa ELSE pb END AS p2, p3 FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tid) AS r FROM bar WHERE least(p0, pa, pb, p3) > -1e-6) u WHERE r = 1)
"""


@_query("locate_points", "SELECT pid, tid, 'inside' AS how, round(p0, 5) + 0.0 AS phi0, round(p1, 5) + 0.0 AS phi1, round(p2, 5) + 0.0 AS phi2, round(p3, 5) + 0.0 AS phi3 FROM loc", _ASKED)
def locate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, tetra, m = lattice(spark, sf_dir)
    found = locate.locate(_asked(spark, sf_dir, m), tetra, vertices)
    return found.select("pid", "tid", "how", *[(F.round(F.get("phi", F.lit(i)), 5) + F.lit(0.0)).alias(f"phi{i}") for i in range(4)])


@_query("interp_scalar", "SELECT pid, round(p0 * a.val + p1 * b.val + p2 * c.val + p3 * d.val, 3) AS val FROM loc JOIN tet USING (tid) JOIN vtx a ON a.vid = v0 JOIN vtx b ON b.vid = v1 JOIN vtx c ON c.vid = v2 JOIN vtx d ON d.vid = v3", _ASKED)
def interp_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, tetra, m = lattice(spark, sf_dir)
    values = vertices.select("vid", F.array("val").alias("val"))
    out = interpolate.at_points(_asked(spark, sf_dir, m), tetra, vertices, values)
    return out.select("pid", F.round(F.get("val", F.lit(0)), 3).alias("val"))


@_query("interp_tensor", "SELECT pid, round(1.0 / (p0 * a.size * a.size + p1 * b.size * b.size + p2 * c.size * c.size + p3 * d.size * d.size), 5) AS xx, 0.25::DOUBLE AS yy, 1.0::DOUBLE AS zz FROM loc JOIN tet USING (tid) JOIN vtx a ON a.vid = v0 JOIN vtx b ON b.vid = v1 JOIN vtx c ON c.vid = v2 JOIN vtx d ON d.vid = v3", _ASKED)
def interp_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverses combine: the size squared in x is linear, whatever its inverse is."""
    vertices, tetra, m = lattice(spark, sf_dir)
    zero = F.lit(0.0)
    metric = vertices.select("vid", F.array(1.0 / (F.col("size") * F.col("size")), zero, zero, F.lit(0.25), zero, F.lit(1.0)).alias("val"))
    out = interpolate.at_points(_asked(spark, sf_dir, m), tetra, vertices, metric, 6, tensor_metric=True)
    return out.select("pid", *[F.round(F.get("val", F.lit(i)), 5).alias(c) for i, c in ((0, "xx"), (3, "yy"), (5, "zz"))])


_LS = """
, ls AS (SELECT vid, CASE WHEN abs(val - 200000.0) < 1e-6 THEN 0.0 ELSE val - 200000.0 END AS v FROM vtx),
crs AS (SELECT e.a, e.b, p.v / (p.v - q.v) AS s FROM (SELECT DISTINCT a, b FROM edg) e JOIN ls p ON p.vid = e.a JOIN ls q ON q.vid = e.b WHERE p.v * q.v < 0),
sg AS (SELECT t.tid, count(*) FILTER (WHERE v < 0) AS neg, count(*) FILTER (WHERE v > 0) AS pos FROM cor t JOIN ls USING (vid) GROUP BY t.tid)
"""


@_query("ls_edges", "SELECT a, b, round(greatest(1e-6, least(1 - 1e-6, s)), 6) AS s FROM crs", _LS)
def ls_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, tetra, _ = lattice(spark, sf_dir)
    ls = levelset.snapped(vertices.select("vid", (F.col("val") - LS_VALUE).alias("v")))
    return levelset.cut_edges(tetra, ls).select("a", "b", F.round("s", 6).alias("s"))


def _cut(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    vertices, tetra, m = lattice(spark, sf_dir)
    cut, points = levelset.discretise(tetra, vertices, vertices.select("vid", F.col("val").alias("v")), LS_VALUE)
    return tetra, cut, points, m  # not staged: each query reads the pieces once


@_query("ls_split_counts", """
SELECT neg, pos, count(*) AS n_parents, CAST(count(*) * CASE WHEN neg = 0 OR pos = 0 THEN 1 WHEN neg + pos = 2 THEN 2 WHEN neg + pos = 3 THEN 3 WHEN neg = pos THEN 6 ELSE 4 END AS BIGINT) AS n_pieces FROM sg GROUP BY neg, pos""", _LS)
def ls_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of parents by the signs of their corners, counted from the pieces that were made."""
    vertices, _, _ = lattice(spark, sf_dir)
    tetra, cut, _, _ = _cut(spark, sf_dir)
    ls = levelset.snapped(vertices.select("vid", (F.col("val") - LS_VALUE).alias("v")))
    corner = tetra.select("tid", F.explode(F.array(*topology.CORNERS)).alias("vid")).join(ls, "vid")
    signs = corner.groupBy("tid").agg(F.count_if(F.col("v") < 0).alias("neg"), F.count_if(F.col("v") > 0).alias("pos"))
    pieces = cut.groupBy(F.col("parent").alias("tid")).agg(F.count("*").alias("k"))
    return signs.join(pieces, "tid").groupBy("neg", "pos").agg(F.count("*").alias("n_parents"), F.sum("k").alias("n_pieces"))


@_query("ls_conforming", "SELECT 12 * (m - 1) * (m - 1) AS lower_bound_boundary, CAST(0 AS BIGINT) AS n_crowded, CAST(0 AS BIGINT) AS n_hanging FROM m", _LS)
def ls_conforming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of the cut mesh with more than two tetra, and free faces inside the cube: none, if both sides of every face agree."""
    _, cut, points, m = _cut(spark, sf_dir)
    odd = topology.tetra_faces(cut.select("tid", *topology.CORNERS)).groupBy("f0", "f1", "f2").agg(F.count("*").alias("n")).where("n <> 2")
    faces = staged(odd, "odd-faces")
    free = faces.where("n = 1").select(F.xxhash64("f0", "f1", "f2").alias("fid"), F.col("f0").alias("v0"), F.col("f1").alias("v1"), F.col("f2").alias("v2"))
    at = topology.attach_corners(free, points, corners=("v0", "v1", "v2"), key="fid")
    outer = F.lit(False)
    for c in "xyz":
        for wall in (0.0, float(m - 1)):
            on = F.lit(True)
            for i in range(3):
                on = on & (F.abs(F.col(f"{c}{i}") - wall) < 1e-9)
            outer = outer | on
    hanging = at.agg(F.count_if(~outer).alias("n_hanging"))
    crowded = faces.agg(F.count_if(F.col("n") > 2).alias("n_crowded"))
    return crowded.withColumn("k", F.lit(0)).join(hanging.withColumn("k", F.lit(0)), "k").select(F.lit(12 * (m - 1) ** 2).cast("long").alias("lower_bound_boundary"), "n_crowded", "n_hanging")


_VOLUME = """
, w AS (SELECT tid, a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM tet JOIN ls a ON a.vid = v0 JOIN ls b ON b.vid = v1 JOIN ls c ON c.vid = v2 JOIN ls d ON d.vid = v3),
fr AS (SELECT tid, CASE WHEN least(a, b, c, d) >= 0 THEN 0.0 WHEN greatest(a, b, c, d) <= 0 THEN 1.0 ELSE
  CASE WHEN a < 0 THEN a * a * a / ((a - b) * (a - c) * (a - d)) ELSE 0 END + CASE WHEN b < 0 THEN b * b * b / ((b - a) * (b - c) * (b - d)) ELSE 0 END
  + CASE WHEN c < 0 THEN c * c * c / ((c - a) * (c - b) * (c - d)) ELSE 0 END + CASE WHEN d < 0 THEN d * d * d / ((d - a) * (d - b) * (d - c)) ELSE 0 END END AS f FROM w)
SELECT 3 AS ref, round(sum(f) / 6, 3) AS volume FROM fr UNION ALL SELECT 2, round(sum(1 - f) / 6, 3) FROM fr"""


@_query("ls_volume", _VOLUME, _LS)
def ls_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume on each side from the pieces; the oracle has it in closed form from the values at the corners."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    sides = levelset.side_volumes(tetra, vertices, vertices.select("vid", F.col("val").alias("v")), LS_VALUE)
    return sides.select("ref", F.round("volume", 3).alias("volume"))


def _skin(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Boundary triangles of the lattice with refs by x (two patches) and unit normals."""
    vertices, tetra, m = lattice(spark, sf_dir)
    faces = topology.boundary_faces(tetra)
    half = (F.col("tid") % 6 * 0 + F.floor(F.col("tid") / 6) % m >= F.lit((m - 1) // 2)).cast("int")
    triangles = faces.select((F.col("tid") * 4 + F.col("ifac")).alias("fid"), F.col("n0").alias("v0"), F.col("n1").alias("v1"), F.col("n2").alias("v2"), half.alias("ref"))
    return stats.surface_normals(triangles, vertices), vertices


_SKIN = """
, sk AS (SELECT f.tid * 4 + ifac AS fid, n0 AS v0, n1 AS v1, n2 AS v2, CASE WHEN t.i >= (t.m - 1) // 2 THEN 1 ELSE 0 END AS ref FROM fac f JOIN adj a USING (f0, f1, f2) JOIN tet t ON t.tid = f.tid WHERE a.n = 1),
wall AS (SELECT s.*, CASE WHEN a.i = 0 AND b.i = 0 AND c.i = 0 THEN 1 WHEN a.i = a.m - 1 AND b.i = a.m - 1 AND c.i = a.m - 1 THEN 2 WHEN a.j = 0 AND b.j = 0 AND c.j = 0 THEN 3 WHEN a.j = a.m - 1 AND b.j = a.m - 1 AND c.j = a.m - 1 THEN 4
  WHEN a.k = 0 AND b.k = 0 AND c.k = 0 THEN 5 ELSE 6 END AS w FROM sk s JOIN vtx a ON a.vid = v0 JOIN vtx b ON b.vid = v1 JOIN vtx c ON c.vid = v2),
se AS (SELECT least(a, b) AS a, greatest(a, b) AS b, fid, ref, w FROM (SELECT v0 AS a, v1 AS b, fid, ref, w FROM wall UNION ALL SELECT v1, v2, fid, ref, w FROM wall UNION ALL SELECT v2, v0, fid, ref, w FROM wall) u),
ft AS (SELECT a, b, count(*) AS n, CAST((CASE WHEN min(w) <> max(w) THEN 4 ELSE 0 END) + (CASE WHEN min(ref) <> max(ref) THEN 8 ELSE 0 END) AS INTEGER) AS tag FROM se GROUP BY a, b)
"""


@_query("edge_features", "SELECT a, b, n, tag FROM ft", _SKIN)
def edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.edge_features(_skin(spark, sf_dir)[0])


@_query("vertex_singular", """
, en AS (SELECT a AS vid, b AS o, tag FROM ft WHERE tag <> 0 UNION ALL SELECT b, a, tag FROM ft WHERE tag <> 0),
ct AS (SELECT vid, count(*) FILTER (WHERE tag & 4 <> 0) AS n_ridge, count(*) FILTER (WHERE tag & 4 = 0) AS n_ref, min(o) AS o1, max(o) AS o2 FROM en GROUP BY vid)
SELECT c.vid, n_ridge, n_ref, CASE WHEN n_ridge + n_ref > 2 OR n_ridge + n_ref = 1 THEN 3 WHEN n_ridge = 1 AND n_ref = 1 THEN 1
  WHEN -((p.i - v.i) * (q.i - v.i) + (p.j - v.j) * (q.j - v.j) + (p.k - v.k) * (q.k - v.k)) / sqrt(((p.i - v.i)**2 + (p.j - v.j)**2 + (p.k - v.k)**2) * ((q.i - v.i)**2 + (q.j - v.j)**2 + (q.k - v.k)**2)) < cos(pi() / 4) THEN 2 ELSE 0 END AS tag
FROM ct c JOIN vtx v USING (vid) JOIN vtx p ON p.vid = o1 JOIN vtx q ON q.vid = o2""", _SKIN)
def vertex_singular(spark: SparkSession, sf_dir: str) -> DataFrame:
    triangles, vertices = _skin(spark, sf_dir)
    return surface.singular_vertices(surface.edge_features(triangles), vertices)


@_query("patch_normals", """
, wv AS (SELECT DISTINCT v0 AS vid, w, ref FROM wall UNION SELECT v1, w, ref FROM wall UNION SELECT v2, w, ref FROM wall)
SELECT vid, CASE w WHEN 1 THEN -1.0 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS nx, CASE w WHEN 3 THEN -1.0 WHEN 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS ny, CASE w WHEN 5 THEN -1.0 WHEN 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS nz FROM wv""", _SKIN)
def patch_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One normal for each smooth patch at a vertex: on a cube, a wall's axis."""
    triangles, _ = _skin(spark, sf_dir)
    found = surface.patch_normals(triangles, surface.edge_features(triangles))
    return found.select("vid", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")])


@_query("vertex_normals", """
, vn AS (SELECT vid, sum(x) AS x, sum(y) AS y, sum(z) AS z, count(*) AS n FROM (SELECT unnest([v0, v1, v2]) AS vid, CASE w WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 0 END AS x, CASE w WHEN 3 THEN -1 WHEN 4 THEN 1 ELSE 0 END AS y, CASE w WHEN 5 THEN -1 WHEN 6 THEN 1 ELSE 0 END AS z FROM wall) u GROUP BY vid)
SELECT vid, n, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 AS nx, round(y / sqrt(x * x + y * y + z * z), 6) + 0.0 AS ny, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0 AS nz FROM vn""", _SKIN)
def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.vertex_normals(_skin(spark, sf_dir)[0])
    return found.select("vid", "n", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")])


@_query("surface_checks", "SELECT 'missing' AS what, count(*) AS n FROM adj a JOIN fac f USING (f0, f1, f2) WHERE n = 1 AND f.tid % 10 = 0 UNION ALL SELECT 'extra', count(*) FROM adj WHERE n = 2 AND ta % 10 = 0", ", keep AS (SELECT 1)")
def surface_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surface that lacks a tenth of its triangles and has inner faces in their place."""
    _, tetra, _ = lattice(spark, sf_dir)
    faces = topology.face_adjacency(tetra.drop("ref"))
    part = (F.col("n") == 1) & (F.col("a.tid") % 10 != 0) | (F.col("n") == 2) & (F.col("a.tid") % 10 == 0)
    some = faces.where(part).select(F.xxhash64("f0", "f1", "f2").alias("fid"), F.col("f0").alias("v0"), F.col("f1").alias("v1"), F.col("f2").alias("v2"))
    extra, missing = topology.clean_triangles(some, tetra.drop("ref"))
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return one(missing, "missing").unionAll(one(extra, "extra"))


@_query("triangle_tetra", "SELECT f.tid * 4 + f.ifac AS fid, f.tid, f.ifac FROM fac f JOIN adj a USING (f0, f1, f2) WHERE a.n = 1")
def triangle_tetra(spark: SparkSession, sf_dir: str) -> DataFrame:
    triangles, _ = _skin(spark, sf_dir)
    return topology.triangle_tetra(triangles, lattice(spark, sf_dir)[1]).select("fid", "tid", "ifac")


@_query("interface_marks", ", c AS (SELECT tid, count(*) AS n FROM (SELECT unnest([ta, tb]) AS tid FROM sid WHERE n = 2 AND pa <> pb) u GROUP BY tid) SELECT t.tid, 1 + coalesce(n, 0) AS mark FROM tet t LEFT JOIN c USING (tid)")
def interface_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tetra, _ = lattice(spark, sf_dir)
    return tags.interface_marks(tetra, topology.interface_faces(tetra))


@_query("updated_tags", f"""
, fk AS (SELECT f0, f1, f2, n = 1 AS outer_, n = 2 AND ta.ref <> tb.ref AS refs, n = 2 AND ta.part <> tb.part AS parts FROM adj a JOIN tet ta ON ta.tid = a.ta JOIN tet tb ON tb.tid = a.tb),
ftag AS (SELECT f0, f1, f2, CASE WHEN refs AND parts THEN {S.PARBDY | S.PARBDYBDY | S.BDY} WHEN parts THEN {S.PARBDY | S.BDY} WHEN outer_ OR refs THEN {S.BDY} ELSE 0 END AS tag FROM fk),
vt AS (SELECT vid, bit_or(tag) AS tag FROM (SELECT unnest([f0, f1, f2]) AS vid, tag FROM ftag WHERE tag <> 0) u GROUP BY vid)
SELECT v.vid, CAST(CASE WHEN t & {S.PARBDY} <> 0 AND u & {S.REQ} = 0 THEN t | u | {S.REQ | S.NOSURF} ELSE t | u END AS INTEGER) AS tag
FROM (SELECT v.vid, coalesce(vt.tag, 0) AS t, CASE WHEN v.vid % 7 = 0 THEN {S.REQ} ELSE 0 END AS u FROM vtx v LEFT JOIN vt USING (vid)) v""")
def updated_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface and boundary bits of vertices rebuilt from faces; each seventh was required by the user and stays so, unfrozen."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    tagged = vertices.select("vid", F.when(F.col("vid") % 7 == 0, S.REQ).otherwise(0).alias("tag"))
    return tags.updated_tags(tagged, topology.face_adjacency(tetra))


@_query("displaced_front")
def displaced_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts after two layers have moved; iterative, held against brute force in the tests."""
    return partition.displaced_front(lattice(spark, sf_dir)[1]).select("tid", "part")


@_query("adapted_lengths")
def adapted_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram before and after a bisection pass; iterative, held against invariants in the tests."""
    from tetraflow.plans.adapt import split_long_edges

    vertices, tetra, _ = lattice(spark, sf_dir)
    sized = vertices.select("vid", "x", "y", "z", (F.col("size") / 2.0).alias("size"))
    new_tetra, new_vertices = split_long_edges(tetra.select("tid", *topology.CORNERS, "ref", "part"), sized)
    out = None
    for name, t, v in (("before", tetra, sized), ("after", new_tetra, new_vertices)):
        one = stats.length_summary(stats.edge_lengths(topology.unique_edges(t).select("a", "b"), v)).select(F.lit(name).alias("mesh"), "*")
        out = one if out is None else out.unionAll(one)
    return out


@_query("medit_round_trip", "SELECT p.part, p.n_vertices, t.n_tetra, p.sum_x FROM (SELECT part, count(*) AS n_vertices, round(sum(x), 3) AS sum_x FROM pv JOIN wrp USING (vid) GROUP BY part) p JOIN (SELECT part, count(*) AS n_tetra FROM tet GROUP BY part) t USING (part)")
def medit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part written as a text mesh with local ids, read back, and its entities counted."""
    from tetraflow.plans.files import round_trip

    vertices, tetra, _ = lattice(spark, sf_dir)
    back = round_trip(spark, _warped(vertices), tetra)
    v = back.tables["vertices"].groupBy("part").agg(F.count("*").alias("n_vertices"), F.round(F.sum("x"), 3).alias("sum_x"))
    t = back.tables["tetra"].groupBy("part").agg(F.count("*").alias("n_tetra"))
    return v.join(t, "part").select("part", "n_vertices", "n_tetra", "sum_x")


_CUT_FACES = ", cutf AS (SELECT f0, f1, f2 FROM sid WHERE n = 2 AND pa <> pb)"


@_query("parallel_edges", "SELECT DISTINCT unnest([f0, f0, f1]) AS a, unnest([f1, f2, f2]) AS b FROM cutf", _CUT_FACES)
def parallel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.parallel_edges(topology.interface_faces(lattice(spark, sf_dir)[1]))


@_query("nonmanifold_edges", ", op AS (SELECT * FROM se WHERE fid % 5 <> 0) SELECT a, b, count(*) AS n FROM op GROUP BY a, b HAVING count(*) <> 2", _SKIN)
def nonmanifold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the skin with holes in it."""
    return topology.nonmanifold_edges(_skin(spark, sf_dir)[0].where("fid % 5 <> 0"))


@_query("edge_tags", f", bt AS (SELECT DISTINCT unnest([f0, f0, f1]) AS a, unnest([f1, f2, f2]) AS b FROM cutf) SELECT e.a, e.b, CASE WHEN e.a % 3 = 0 THEN {S.GEO} ELSE 0 END + CASE WHEN bt.a IS NULL THEN 0 ELSE {S.PARBDY} END AS tag FROM (SELECT DISTINCT a, b FROM edg) e LEFT JOIN bt ON bt.a = e.a AND bt.b = e.b", _CUT_FACES)
def edge_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tetra, _ = lattice(spark, sf_dir)
    edges = topology.unique_edges(tetra).select("a", "b", F.when(F.col("a") % 3 == 0, S.GEO).otherwise(0).alias("tag"))
    tagged = topology.parallel_edges(topology.interface_faces(tetra)).select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(S.PARBDY).alias("tag"))
    return topology.edge_tags(edges, tagged)


@_query("vertex_tags_from_edges", f"SELECT vid, {S.REF} AS tag FROM (SELECT unnest([a, b]) AS vid, tag FROM ft WHERE tag & {S.REF} <> 0) u GROUP BY vid", _SKIN)
def vertex_tags_from_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.vertices_from_edges(surface.edge_features(_skin(spark, sf_dir)[0]))


@_query("boundary_between_refs", f"SELECT f0, f1, f2, CASE WHEN n = 2 AND ta.ref <> tb.ref AND ta.part <> tb.part THEN {S.PARBDY | S.PARBDYBDY | S.BDY} WHEN n = 2 AND ta.part <> tb.part THEN {S.PARBDY | S.BDY} ELSE {S.BDY} END AS tag FROM adj a JOIN tet ta ON ta.tid = a.ta JOIN tet tb ON tb.tid = a.tb WHERE n = 1 OR ta.ref <> tb.ref OR ta.part <> tb.part")
def boundary_between_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.boundary_between_refs(topology.face_adjacency(lattice(spark, sf_dir)[1]))


@_query("stable_labels", "SELECT vid AS gid, max(part) AS owner, vid AS label FROM bv GROUP BY vid HAVING count(*) > 1")
def stable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.stable_labels(topology.interface_nodes(lattice(spark, sf_dir)[1], "block"))


@_query("location_statistics", "SELECT count(*) AS n, count(*) AS n_inside, CAST(0 AS BIGINT) AS n_nearest FROM loc", _ASKED)
def location_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, tetra, m = lattice(spark, sf_dir)
    return stats.candidate_counts(locate.locate(_asked(spark, sf_dir, m), tetra, vertices)).select("n", "n_inside", "n_nearest")


@_query("surface_distance", """
, out AS (SELECT pid, x, y, z, m FROM pts WHERE x >= m - 1.4 AND x > 0 AND y BETWEEN 1 AND m - 2 AND z BETWEEN 1 AND m - 2) SELECT pid, round(m - 1 - x, 6) AS distance FROM out""", _ASKED)
def surface_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points near one wall of the cube and far from the others: the distance is along x."""
    vertices, tetra, m = lattice(spark, sf_dir)
    faces = topology.boundary_faces(tetra)
    triangles = faces.select((F.col("tid") * 4 + F.col("ifac")).alias("fid"), F.col("n0").alias("v0"), F.col("n1").alias("v1"), F.col("n2").alias("v2"))
    inner = F.col("y").between(1, m - 2) & F.col("z").between(1, m - 2)
    points = _asked(spark, sf_dir, m).where((F.col("x") >= m - 1.4) & inner)
    return locate.locate_on_surface(points, triangles, vertices, 0.41).select("pid", F.round("distance", 6).alias("distance"))


@_query("cut_size", "SELECT count(*) AS n_inner, count(*) FILTER (WHERE ta.part <> tb.part) AS n_cut FROM adj a JOIN tet ta ON ta.tid = a.ta JOIN tet tb ON tb.tid = a.tb WHERE n = 2")
def cut_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.cut_size(lattice(spark, sf_dir)[1])


@_query("repair_empty", ", big AS (SELECT part FROM tet GROUP BY part ORDER BY count(*) DESC, part LIMIT 1), k AS (SELECT tid, row_number() OVER (ORDER BY tid) AS r FROM tet WHERE part = (SELECT part FROM big)) SELECT t.tid, CAST(CASE WHEN r = 1 THEN 4 WHEN r = 2 THEN 5 ELSE t.part END AS INTEGER) AS part FROM tet t LEFT JOIN k USING (tid)")
def repair_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six parts of which two are empty: each gets an element of the largest."""
    return partition.repair_empty(lattice(spark, sf_dir)[1].select("tid", "part"), 6)


@_query("reachable_pieces", ", st AS (SELECT tid, CAST((i // 3) % 2 AS INTEGER) AS part, i // 3 AS slab, min(tid) OVER (PARTITION BY i // 3) AS comp FROM tet) SELECT part, comp, 1 - part AS part_out FROM st WHERE (SELECT count(DISTINCT slab) FROM st) > 1 GROUP BY part, comp")
def reachable_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripes in two parts: every piece touches the other part."""
    return components.reachable_parts(_striped(spark, sf_dir))


@_query("ls_carried_field", "SELECT a, b, 200000.0::DOUBLE AS val FROM crs", _LS)
def ls_carried_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field whose level is cut, carried to the cut points: it is the level there."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    _, points = levelset.discretise(tetra, vertices, vertices.select("vid", F.col("val").alias("v")), LS_VALUE)
    fresh = points.where("a is not null").select("vid", "a", "b", "s")
    got = levelset.carried(fresh, vertices.select("vid", F.array("val").alias("val")))
    return fresh.join(got, "vid").select("a", "b", F.round(F.get("val", F.lit(0)), 0).alias("val"))


@_query("ls_materials", """
, ed AS (SELECT DISTINCT e.a, e.b FROM edg e JOIN ls p ON p.vid = e.a JOIN ls q ON q.vid = e.b WHERE e.ref = 0 AND p.v * q.v < 0)
SELECT t.ref AS was, count(*) AS n_parents, count(*) FILTER (WHERE c.kk > 0) AS n_cut FROM tet t LEFT JOIN (SELECT e.tid, count(*) AS kk FROM edg e JOIN ed USING (a, b) GROUP BY e.tid) c USING (tid) GROUP BY t.ref""", _LS)
def ls_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One material is split, the other not: tetra of either that are bisected, and refs that are kept."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    materials = spark.createDataFrame([(0, True, 10, 20), (1, False, None, None)], "ref int, split boolean, ref_in int, ref_out int")
    cut, _ = levelset.discretise(tetra, vertices, vertices.select("vid", F.col("val").alias("v")), LS_VALUE, materials=materials)
    pieces = cut.groupBy("parent").agg(F.count("*").alias("k"))
    return tetra.join(pieces, F.col("tid") == F.col("parent")).groupBy(F.col("ref").alias("was")).agg(F.count("*").alias("n_parents"), F.count_if(F.col("k") > 1).alias("n_cut"))


@_query("catalog_round_trip", "SELECT 'tetra' AS entity, part, count(*) AS n FROM tet GROUP BY part UNION ALL SELECT 'vertices', part, count(*) FROM pv GROUP BY part")
def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh saved as a Parquet catalog, loaded, and counted by part."""
    import uuid

    from tetraflow.frame import MeshFrame
    from tetraflow.plans.files import localised
    from tetraflow.sources import catalog
    from tetraflow.staging import shared_folder

    vertices, tetra, _ = lattice(spark, sf_dir)
    path = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    catalog.save(MeshFrame(spark, localised(_warped(vertices), tetra)), path)
    return catalog.sizes(catalog.load(spark, path)).select("entity", "part", "n")


@_query("load_balance")
def load_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts after balancing, contiguous; iterative, held against invariants in the tests."""
    vertices, tetra, _ = lattice(spark, sf_dir)
    return partition.load_balance(tetra, vertices, S.AdaptParams()).select("tid", "part")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
