import math
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tetraflow import schema as S
from tetraflow import staging
from tetraflow.functions import geometry as G
from tetraflow.operators import checks, components, exchange, interpolate, levelset, locate, partition, stats, surface, tags, topology
from tetraflow.plans import adapt
from tetraflow.sources.lattice import lattice, lattice_tetra, lattice_vertices, side


@pytest.fixture(scope="module")
def cube(spark):
    """A lattice of 5 points a side: (vertices, tetra)."""
    orders = spark.range(125).selectExpr("id o_orderkey", "1.0 * ((id * 7) % 11) o_totalprice", "(id * 5) % 3 o_custkey")
    v = lattice_vertices(orders, 5).cache()
    return v, lattice_tetra(v, 5).cache()


def volume(tetra, vertices):
    at = topology.attach_corners(tetra, vertices)
    return at.agg(F.sum(G.volume([G.point("", i) for i in range(4)]))).first()[0]


@pytest.mark.parametrize("n,m", [(0, 0), (1, 1), (7, 1), (8, 2), (26, 2), (27, 3), (150000, 53), (10**18, 10**6), (10**18 - 1, 10**6 - 1)])
def test_side(n, m):
    assert side(n) == m


def test_regular_tetra_has_quality_one(spark):
    p = [(1, 1, 1), (-1, 1, -1), (1, -1, -1), (-1, -1, 1)]
    df = spark.createDataFrame([tuple(float(c) for q in p for c in q)], ", ".join(f"{c}{i} double" for i in range(4) for c in "xyz"))
    q, v = df.select(G.quality([G.point("", i) for i in range(4)]), G.volume([G.point("", i) for i in range(4)])).first()
    assert abs(abs(q) - 1) < 1e-12 and abs(abs(v) - 8 / 3) < 1e-12


def test_tensor_inverse(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(20):
        a = rng.normal(size=(3, 3))
        m = a @ a.T + np.eye(3)
        rows.append([m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2]])
    rows.append([1.0, 1.0, 1.0, 1.0, 1.0, 1.0])
    df = spark.createDataFrame([(list(map(float, r)),) for r in rows], "m array<double>")
    got = [list(r) for r in df.select(*G.tensor_inverse(G.array_tensor(F.col("m")))).collect()]
    for m, i in zip(rows[:-1], got):
        full = lambda t: np.array([[t[0], t[1], t[2]], [t[1], t[3], t[4]], [t[2], t[4], t[5]]])
        assert np.allclose(full(m) @ full(i), np.eye(3))
    assert got[-1] == [None] * 6


def test_located_points_interpolate_linear_fields_exactly(spark, cube):
    v, t = cube
    rng = random.Random(2)
    points = [(i, *(rng.uniform(0, 4) for _ in range(3))) for i in range(200)] + [(900, 1.0, 2.0, 3.0), (901, 0.0, 0.0, 0.0), (902, 4.0, 4.0, 4.0)]
    asked = spark.createDataFrame(points, "pid long, x double, y double, z double")
    values = v.select("vid", F.array(F.col("x") * 2 - F.col("y") + 3, F.col("z"), F.col("x") + F.col("z")).alias("val"))
    got = {r.pid: r.val for r in interpolate.at_points(asked, t, v, values, 3).collect()}
    for pid, x, y, z in points:
        assert np.allclose(got[pid], [2 * x - y + 3, z, x + z])


def test_points_outside_take_the_nearest_vertex(spark, cube):
    v, t = cube
    corner = {r.vid: (r.x, r.y, r.z) for r in v.collect()}
    points = [(1, -3.0, 1.2, 0.9), (2, 40.0, 2.4, 2.6), (3, -1.0, -1.0, -1.0), (4, 1000.0, -2000.0, 5.0)]
    found = locate.locate(spark.createDataFrame(points, "pid long, x double, y double, z double"), t, v).join(t, "tid").collect()
    assert {r.pid for r in found} == {1, 2, 3, 4} and {r.how for r in found} == {"nearest"}
    for r in found:
        at = [r.v0, r.v1, r.v2, r.v3][list(r.phi).index(1.0)]
        p = next(q[1:] for q in points if q[0] == r.pid)
        assert math.dist(corner[at], p) == min(math.dist(c, p) for c in corner.values())
    assert stats.candidate_counts(locate.locate(spark.createDataFrame(points, "pid long, x double, y double, z double"), t, v)).first().n_nearest == 4


def skin(cube):
    v, t = cube
    faces = topology.boundary_faces(t)
    return faces.select((F.col("tid") * 4 + F.col("ifac")).alias("fid"), F.col("n0").alias("v0"), F.col("n1").alias("v1"), F.col("n2").alias("v2"), F.lit(0).alias("ref"))


def test_surface_location(spark, cube):
    v, _ = cube
    points = [(1, 1.3, 2.2, 4.2), (2, -0.1, 1.0, 1.0), (3, 4.2, 4.2, 4.2), (4, 2.0, 2.0, 2.0)]
    found = {r.pid: r for r in locate.locate_on_surface(spark.createDataFrame(points, "pid long, x double, y double, z double"), skin(cube), v, 0.5).collect()}
    assert set(found) == {1, 2, 3}
    assert abs(found[1].distance - 0.2) < 1e-12 and abs(found[2].distance - 0.1) < 1e-12 and abs(found[3].distance - 0.2 * 3**0.5) < 1e-12
    assert all(abs(sum(r.phi) - 1) < 1e-12 and min(r.phi) > -1e-12 for r in found.values())


def test_transfer_keeps_required_values(spark, cube):
    v, t = cube
    values = v.select("vid", F.array("x").alias("val"))
    new = spark.createDataFrame([(0, 3.0, 3.0, 3.0, True, False), (900, 1.5, 2.5, 0.5, False, False), (901, 2.5, 4.0, 1.0, False, True)], "vid long, x double, y double, z double, required boolean, on_boundary boolean")
    got = {r.vid: r.val for r in interpolate.transfer(new, v, t, skin(cube), values, 0.1).collect()}
    assert got[0] == [0.0] and np.allclose(got[900], [1.5]) and np.allclose(got[901], [2.5])
    assert {r.vid: r.val for r in interpolate.transfer(new, v, t, skin(cube), values, 0.1, constant=0.25).collect()} == {0: [0.25], 900: [0.25], 901: [0.25]}


def test_components_of_a_long_path_and_odd_links(spark):
    nodes = spark.range(2000).toDF("n")
    links = spark.range(999).selectExpr("id a", "id + 1 b").union(spark.createDataFrame([(1500, 1500), (1700, 1600), (1600, 1700)], "a long, b long"))
    got = {r.node: r.comp for r in components.components(nodes, links).collect()}
    assert all(got[i] == 0 for i in range(1000)) and got[1500] == 1500 and got[1700] == 1600 and len(got) == 2000
    assert components.components(nodes.limit(0), links.limit(0)).count() == 0


def brute_front(tetra, layers, least):
    part = {r.tid: r.part for r in tetra}
    corners = {r.tid: (r.v0, r.v1, r.v2, r.v3) for r in tetra}
    size = {p: sum(q == p for q in part.values()) for p in set(part.values())}
    for _ in range(layers):
        ball = {}
        for tid, vs in corners.items():
            for v in vs:
                ball.setdefault(v, set()).add((size[part[tid]], part[tid]))
        best = {v: min(s) for v, s in ball.items() if len(s) > 1}
        to = {tid: min((best[v] for v in vs if v in best), default=(0, part[tid]))[1] for tid, vs in corners.items()}
        left = {p: sum(q == p for q in to.values()) for p in size}
        part = {tid: part[tid] if left[part[tid]] < min(least, size[part[tid]] // 2 + 1) else to[tid] for tid in part}
    return part


@pytest.mark.parametrize("layers,least", [(1, 6), (2, 6), (2, 40)])
def test_displaced_front_against_brute_force(cube, layers, least):
    _, t = cube
    t = t.withColumn("part", F.when(F.col("v0") % 5 == 0, 0).when(F.col("v0") < 60, 1).otherwise(2))
    got = {r.tid: r.part for r in partition.displaced_front(t, layers, least).collect()}
    assert got == brute_front(t.collect(), layers, least)


def test_bisection_halves(cube):
    v, t = cube
    sizes = [r["count"] for r in partition.bisect(partition.centres(t, v), 8).groupBy("part").count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 384 and max(sizes) <= 2 * min(sizes)
    with pytest.raises(ValueError):
        partition.bisect(partition.centres(t, v), 0)


def test_group_numbers():
    assert partition.n_groups(100, 10) == 10 and partition.n_groups(5, 10) == 1 and partition.n_groups(0, 10) == 1
    assert partition.n_groups(10**9, 10) == 100 and partition.n_groups(10**9, 10, redistribution=True) == 1000
    assert partition.n_groups(30, 1) == 5  # six elements at least in each


def test_empty_parts_are_repaired(spark):
    assigned = spark.createDataFrame([(i, 0 if i < 10 else 3) for i in range(14)], "tid long, part int")
    got = {r.tid: r.part for r in partition.repair_empty(assigned, 5).collect()}
    assert set(got.values()) == {0, 1, 2, 3, 4} and sum(p == 0 for p in got.values()) == 7
    with pytest.raises(ValueError):
        partition.repair_empty(assigned.limit(2), 9)


def test_load_balance_leaves_contiguous_parts(cube):
    v, t = cube
    out = partition.load_balance(t, v, S.AdaptParams(groups_ratio=1.2))
    assert out.count() == t.count()
    assert {r.n_pieces for r in components.contiguity(components.part_components(out)).collect()} == {1}


def test_split_and_halo(cube):
    v, t = cube
    dealt, own, faces = partition.split(t, v, partition.bisect(partition.centres(t, v), 4))
    assert dealt.count() == t.count() and own.select("vid").distinct().count() == 125
    assert faces.where("part_in < part_out").count() * 2 == faces.count()
    halo = exchange.with_halo(dealt)
    assert halo.where("is_halo").count() == exchange.halo_tetra(dealt).count()
    assert exchange.without_halo(halo).exceptAll(dealt).count() == 0


@pytest.mark.parametrize("value", [3.0, 5.5, -1.0, 20.0])
def test_cut_keeps_volume_and_conforms(spark, cube, value):
    v, t = cube
    ls = v.select("vid", F.col("val").alias("v"))
    cut, points = levelset.discretise(t, v, ls, value)
    assert abs(volume(cut, points) - 64) < 1e-9
    at = topology.attach_corners(cut, points).select(G.volume([G.point("", i) for i in range(4)]).alias("w"))
    assert at.where("w <= 0").count() == 0
    faces = topology.face_adjacency(cut)
    assert faces.where("n > 2").count() == 0
    euler = points.join(cut.select(F.explode(F.array(*topology.CORNERS)).alias("vid")), "vid", "left_semi").count() - topology.unique_edges(cut).count() + faces.count() - cut.count()
    assert euler == 1
    signs = {r.vid: (r.v > value) - (r.v < value) for r in ls.collect()}
    for r in cut.collect():
        own = {signs.get(x, 0) for x in (r.v0, r.v1, r.v2, r.v3)} - {0}
        assert own <= {r.side} and r.ref == (3 if r.side < 0 else 2)


def test_materials_that_are_not_split_stay_whole_in_ref_and_conform(spark, cube):
    v, t = cube
    materials = spark.createDataFrame([(0, True, 10, 20), (1, False, None, None)], "ref int, split boolean, ref_in int, ref_out int")
    cut, points = levelset.discretise(t, v, v.select("vid", F.col("val").alias("v")), 5.5, materials=materials)
    assert abs(volume(cut, points) - 64) < 1e-9 and topology.face_adjacency(cut).where("n > 2").count() == 0
    parents = t.select(F.col("tid").alias("parent"), F.col("ref").alias("was"))
    refs = {(r.was, r.ref) for r in cut.join(parents, "parent").select("was", "ref").distinct().collect()}
    assert refs <= {(0, 10), (0, 20), (1, 1)} and (0, 10) in refs and (1, 1) in refs
    outer = topology.attach_corners(topology.boundary_faces(cut).select((F.col("tid") * 4 + F.col("ifac")).alias("fid"), F.col("f0").alias("v0"), F.col("f1").alias("v1"), F.col("f2").alias("v2")), points, corners=("v0", "v1", "v2"), key="fid")
    on_wall = F.lit(False)
    for c in "xyz":
        for wall in (0.0, 4.0):
            on_wall = on_wall | ((F.abs(F.col(f"{c}0") - wall) < 1e-9) & (F.abs(F.col(f"{c}1") - wall) < 1e-9) & (F.abs(F.col(f"{c}2") - wall) < 1e-9))
    assert outer.where(~on_wall).count() == 0


def test_snapping(spark, cube):
    v, t = cube
    ls = v.select("vid", (F.col("x") - 2.0 + F.when(F.col("vid") % 5 == 2, 1e-9).otherwise(0.0)).alias("v"))
    got = levelset.unsnapped_nonmanifold(t, ls)
    assert got.where("v = 0").count() == 25  # the plane x = 2: a manifold, so all stay
    lone = v.select("vid", F.when(F.col("vid") == 62, 1e-9).when(F.col("x") < 2, -1.0).when(F.col("x") > 2, -1.0).otherwise(1.0).alias("v"))
    assert abs(levelset.unsnapped_nonmanifold(t, lone).where("vid = 62").first().v - 100e-6) < 1e-12  # two negative pieces meet there


def test_flat_tetra_near_the_surface_are_lowered(spark):
    measured = spark.createDataFrame([(1, 1, 2, 3, 4, 0.0), (2, 3, 4, 5, 6, 0.9), (3, 7, 8, 9, 10, 0.0)], "tid long, v0 long, v1 long, v2 long, v3 long, quality double")
    ls = spark.createDataFrame([(i, 1e-4 if i == 1 else float(i)) for i in range(1, 11)], "vid long, v double")
    got = {r.vid: r.v for r in levelset.lowered_at_flat(measured, ls).collect()}
    assert got == {i: (-1e-3 if i <= 4 else float(i)) for i in range(1, 11)}


def test_carried_fields_follow_the_edge(spark):
    points = spark.createDataFrame([(9, 1, 2, 0.25)], "vid long, a long, b long, s double")
    values = spark.createDataFrame([(1, [0.0, 4.0]), (2, [8.0, 0.0])], "vid long, val array<double>")
    assert levelset.carried(points, values).first().val == [2.0, 3.0]


def test_open_and_crowded_edges_are_features(spark):
    rows = [(1, 1, 2, 3, 0, 0.0, 0.0, 1.0), (2, 2, 1, 4, 0, 0.0, 0.0, 1.0), (3, 1, 2, 5, 0, 0.0, 1.0, 0.0)]
    tri = spark.createDataFrame(rows, "fid long, v0 long, v1 long, v2 long, ref int, nx double, ny double, nz double")
    got = {(r.a, r.b): (r.n, r.tag) for r in surface.edge_features(tri).collect()}
    assert got[(1, 2)] == (3, S.GEO | S.NOM | S.REF) and got[(1, 3)] == (1, S.GEO | S.NOM | S.REF)
    two = {(r.a, r.b): r.tag for r in surface.edge_features(tri.where("fid < 3")).collect()}
    assert two[(1, 2)] == 0
    assert {(r.a, r.b): r.tag for r in surface.edge_features(tri.where("fid <> 2")).collect()}[(1, 2)] == S.GEO
    assert {(r.a, r.b): r.tag for r in surface.edge_features(tri.where("fid <> 2"), detect=False).collect()}[(1, 2)] == 0


def test_ridge_tangents_lie_along_the_ridge(cube):
    v, _ = cube
    tri = stats.surface_normals(skin(cube), v)
    normals = surface.patch_normals(tri, surface.edge_features(tri))
    for r in surface.ridge_tangents(normals).collect():
        assert sorted(abs(round(x, 9)) for x in (r.tx, r.ty, r.tz)) == [0.0, 0.0, 1.0]


def test_parallel_tags_keep_what_the_user_required(spark):
    df = spark.createDataFrame([(0,), (S.REQ,), (S.CRN,)], "tag int")
    on = df.select("tag", tags.tag_parallel(F.col("tag")).alias("t"))
    off = {r.tag: r.u for r in on.select("tag", tags.untag_parallel(F.col("t")).alias("u")).collect()}
    assert off == {0: 0, S.REQ: S.REQ, S.CRN: S.CRN}
    assert {r.tag: r.t for r in on.collect()}[0] == S.PARBDY | S.BDY | S.REQ | S.NOSURF
    old = on.select(tags.keep_old(F.col("t")).alias("o")).collect()
    assert all(r.o & S.OLDPARBDY for r in old)


def test_adapt_keeps_the_volume_and_shortens_edges(spark, cube):
    v, t = cube
    sized = v.select("vid", "x", "y", "z", F.lit(0.6).alias("size"))
    fields = v.select("vid", F.array(F.col("x") + 2 * F.col("y")).alias("val"))
    with warnings.catch_warnings():
        warnings.simplefilter("error", S.MeshDegraded)
        tetra, vertices, out, history = adapt.adapt(t.select("tid", *topology.CORNERS, "ref", "part"), sized, S.AdaptParams(niter=2), fields=fields)
    assert abs(volume(tetra, vertices) - 64) < 1e-9 and topology.face_adjacency(tetra).where("n > 2").count() == 0
    longest = lambda a, b: stats.length_summary(stats.edge_lengths(topology.unique_edges(a).select("a", "b"), b)).first()
    assert longest(tetra, vertices).mean < longest(t, sized).mean
    assert history.count() == 3 and tetra.count() > t.count()
    wrong = out.join(vertices, "vid").where(F.abs(F.get("val", F.lit(0)) - F.col("x") - 2 * F.col("y")) > 1e-9)
    assert wrong.count() == 0 and out.count() == vertices.count()


def test_a_failing_round_is_undone(spark, cube):
    v, t = cube
    sized = v.select("vid", "x", "y", "z", F.lit(0.6).alias("size"))

    def broken(tetra, vertices, frozen):
        return tetra.withColumn("v1", F.col("v0")), vertices

    with pytest.warns(S.MeshDegraded, match="undone"):
        tetra, *_ = adapt.adapt(t.select("tid", *topology.CORNERS, "ref"), sized, S.AdaptParams(niter=2), broken)
    assert tetra.count() == t.count()


def test_points_that_straddle_a_grid_line_are_one(spark):
    from tetraflow.operators import exchange

    rows = [(0, 1, 0.4999999995001, 0.0, 0.0), (1, 1, 0.49999999949999, 0.0, 0.0), (0, 2, 0.5, 0.0, 0.0), (1, 2, 0.5 + 9e-10, 0.0, 0.0), (2, 1, 0.5 + 18e-10, 0.0, 0.0), (0, 3, 0.6, 0.0, 0.0), (1, 3, 0.6 + 3e-9, 0.0, 0.0), (0, 4, None, 0.0, 0.0), (1, 4, None, 0.0, 0.0)]
    got = {(r.part, r.lid): r.gid for r in exchange.merge_by_coordinates(spark.createDataFrame(rows, "part int, lid long, x double, y double, z double")).collect()}
    groups = {}
    for k, v in got.items():
        groups.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == [[(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)], [(0, 3)], [(0, 4), (1, 4)], [(1, 3)]]


def test_a_huge_element_beside_small_ones_costs_few_cells(spark):
    from tetraflow.operators import locate

    vertices = [(0, 0.0, 0.0, 0.0), (1, 1000.0, 0.0, 0.0), (2, 0.0, 1000.0, 0.0), (3, 0.0, 0.0, -1000.0)]
    tetra, n = [(0, 0, 2, 1, 3)], 4
    for i in range(20):  # small ones above the plane z = 0
        base = (float(i), 0.0, 1.0)
        vertices += [(n, *base), (n + 1, base[0] + 0.5, 0.0, 1.0), (n + 2, base[0], 0.5, 1.0), (n + 3, base[0], 0.0, 1.5)]
        tetra.append((i + 1, n, n + 1, n + 2, n + 3))
        n += 4
    v = spark.createDataFrame(vertices, "vid long, x double, y double, z double")
    t = spark.createDataFrame(tetra, "tid long, v0 long, v1 long, v2 long, v3 long")
    at = locate._leveled(locate.attach_corners(t, v), 4)
    assert locate._cells(at, "tid", 4, locate.F.lit(1e-6)).groupBy("tid").count().agg({"count": "max"}).first()[0] <= 27
    points = [(1, 100.0, 100.0, -100.0), (2, 3.1, 0.1, 1.1), (3, 1e6, 0.0, 0.0)]
    found = {r.pid: (r.tid, r.how) for r in locate.locate(spark.createDataFrame(points, "pid long, x double, y double, z double"), t, v).collect()}
    assert found == {1: (0, "inside"), 2: (4, "inside"), 3: (0, "nearest")}


def test_corners_meet_vertices_alike_by_broadcast_and_by_exchange(spark, monkeypatch):
    from tetraflow.operators import topology

    t = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 1, 2, 3, 9), (2, 7, 8, 9, 9)], "tid long, v0 long, v1 long, v2 long, v3 long")
    v = spark.createDataFrame([(i, float(i), None, 2.0 * i) for i in range(5)], "vid long, x double, y double, z double")
    one = topology.attach_corners(t, v)
    monkeypatch.setattr(topology, "FEW_VERTICES", 0)
    other = topology.attach_corners(t, v)
    assert one.columns == other.columns and sorted(one.collect()) == sorted(other.collect()) and one.count() == 2


def test_any_number_of_parts_with_a_cut_no_larger_than_bisection_has(spark):
    from tetraflow.operators import partition
    from tetraflow.sources.lattice import lattice

    vertices, tetra, _ = lattice(spark, "/root/testdata/sf0.001")
    n = tetra.count()
    for parts in (3, 5, 6):
        first = partition.bisect(partition.centres(tetra, vertices), parts)
        last = partition.partitioned(tetra, vertices, parts)
        sizes = [r["count"] for r in last.groupBy("part").count().collect()]
        assert sorted(r.part for r in last.select("part").distinct().collect()) == list(range(parts)) and sum(sizes) == n
        assert max(sizes) <= 1.3 * n / parts
        cut = lambda a: partition.cut_size(tetra.drop("part").join(a, "tid")).first().n_cut
        assert cut(last) <= cut(first)


def test_a_level_set_is_snapped_where_it_stays_a_manifold(spark):
    from tetraflow.operators import levelset, topology
    from tetraflow.sources.lattice import lattice

    vertices, tetra, m = lattice(spark, "/root/testdata/sf0.001")
    ls = vertices.select("vid", (vertices["x"] - 3.0 + 1e-8).alias("v"))
    cut, points = levelset.discretise(tetra, vertices, ls, snap=True)
    assert cut.count() == tetra.count() and points.count() == vertices.count()  # every value near the plane went to it
    faces = topology.face_adjacency(cut.select("tid", *topology.CORNERS, "ref"))
    between = faces.where("n = 2 and a.ref <> b.ref").count()
    assert between == 2 * (m - 1) ** 2 and faces.where("n > 2").count() == 0


def test_cuts_are_looked_up_alike_in_place_and_by_exchange(spark, monkeypatch):
    from tetraflow.operators import levelset, topology
    from tetraflow.sources.lattice import lattice

    vertices, tetra, _ = lattice(spark, "/root/testdata/sf0.001")
    ls = vertices.select("vid", (vertices["val"] - 200_000.0).alias("v"))
    shape = lambda: sorted(tuple(r) for r in levelset.discretise(tetra, vertices, ls)[0].select(*topology.CORNERS, "ref", "part", "parent", "side").collect())
    one = shape()
    monkeypatch.setattr(levelset, "FEW_VERTICES", 0)
    assert shape() == one and len(one) > tetra.count()


def test_pieces_equal_those_of_the_general_bisection(spark):
    import numpy as np

    from tetraflow.operators import levelset

    rng = np.random.default_rng(4)
    rows, cuts = [], []
    for t in range(200):
        rows.append((t, *[10 * t + i for i in rng.permutation(4)]))
        for i in range(4):
            for j in range(i):
                if rng.random() < 0.5:
                    cuts.append((10 * t + j, 10 * t + i, 10_000 + len(cuts)))
    order = rng.permutation(len(cuts))
    cuts = [(a, b, 10_000 + int(n)) for (a, b, _), n in zip(cuts, order)]
    t = spark.createDataFrame([tuple(map(int, r)) for r in rows], "tid long, v0 long, v1 long, v2 long, v3 long")
    c = spark.createDataFrame([tuple(map(int, r)) for r in cuts], "a long, b long, vid long")
    want = {r.tid: [tuple(p) for p in r.pieces] for r in levelset.bisected(t, c).collect()}
    corners = np.array([r[1:] for r in rows])
    point = {(a, b): n for a, b, n in cuts}
    table = np.array([[point.get((min(r[i], r[j]), max(r[i], r[j])), 0) for i, j in levelset.EDGE_CORNERS] for r in corners.tolist()])
    pieces, row = levelset.halves(corners, table)
    assert {t: [tuple(p) for p in pieces[row == t].tolist()] for t in range(200)} == want


def test_lattice_does_not_pass_for_small(spark):
    """Spark broadcasts what it expects to be small; it must expect the rows that there are, not the compressed file's bytes."""
    for df in lattice(spark, "/root/testdata/sf0.1")[:2]:
        expected = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        assert expected >= df.count() * 8 * len(df.columns)


def test_hundreds_of_thousands_of_vertices_are_not_broadcast(spark):
    v = spark.range(300_000).selectExpr("id vid", "1.0D x", "2.0D y", "3.0D z")
    t = spark.createDataFrame([(1, 0, 1, 2, 299_999)], "tid long, v0 long, v1 long, v2 long, v3 long")
    at = topology.attach_corners(t, v)
    assert "ResolvedHint (strategy=broadcast)" not in at._jdf.queryExecution().analyzed().toString() and at.count() == 1


def test_components_leave_only_tables_that_are_read(spark, cube, tmp_path, monkeypatch):
    """What a round has replaced goes; a tetra without a part is linked to none."""
    _, t = cube
    none = t.withColumn("part", F.when(F.col("tid") % 7 != 0, F.lit(1)))
    monkeypatch.setattr(staging, "shared_folder", lambda _: f"file://{tmp_path}")
    found = {r.tid: (r.part, r.comp) for r in components.part_components(none).collect()}
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["ends", "stars"]
    assert len(found) == t.count() and all(comp == tid for tid, (part, comp) in found.items() if part is None)
    inner = topology.dual_edges(t).collect()
    assert all(found[r.tid_a][1] == found[r.tid_b][1] for r in inner if r.tid_a % 7 and r.tid_b % 7)


def test_border_kinds_are_counted_without_a_lambda(spark):
    rows = [(1.0, 0.0, 0.0, 0.0), (0.5, 0.5, 0.0, 0.0), (0.5, 0.25, 0.25, 0.0), (0.25, 0.25, 0.25, 0.25), (0.0, 0.0, 0.0, 0.0), (None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    kinds = df.select(locate.border(F.array("a", "b", "c", "d")).alias("kind"))
    assert "lambda" not in kinds._jdf.queryExecution().optimizedPlan().toString()
    assert [r.kind for r in kinds.collect()] == ["vertex", "edge", "face", "inside", "vertex", "face"]


def test_ids_of_vertices_alone_do_not_pass_for_no_bytes(spark):
    """AQE measures no bytes of a row without columns, nor of a product with it, and would broadcast any number of ids."""
    orders = spark.range(125).selectExpr("id o_orderkey", "cast(id as double) o_totalprice", "id o_custkey")
    vertices = lattice_vertices(orders, 5)
    for df in (vertices.select("vid"), vertices.select("vid", F.array("size").alias("val"))):
        node = df._jdf.queryExecution().optimizedPlan()
        while node.children().size() == 1:
            node = node.children().head()
        assert [node.children().apply(i).output().size() for i in (0, 1)] == [1, 1]
    assert sorted(r.vid for r in vertices.select("vid").collect()) == list(range(125))


def test_transfer_locates_nothing_where_every_vertex_keeps_its_value(spark, cube, monkeypatch):
    vertices, tetra = cube
    monkeypatch.setattr(interpolate, "at_points", None)
    monkeypatch.setattr(interpolate, "on_surface", None)
    new = vertices.select("vid", "x", "y", "z", F.lit(True).alias("required"), F.lit(False).alias("on_boundary"))
    got = interpolate.transfer(new, vertices, tetra, None, vertices.select("vid", F.array("x").alias("val")), 0.1)
    assert {r.vid: r.val[0] for r in got.collect()} == {r.vid: r.x for r in vertices.collect()}


def test_staged_tables_are_measured_by_their_rows(spark):
    """Rows that compress well are expected to take what they take, nulls in the first column stay, and so does an empty table."""
    table = staging.staged(spark.range(50_000).selectExpr("case when id > 9 then id div 1000 end a", "1.5D b"))
    expected = staging.measured(table)
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size(table) < size(expected) / 4 and expected.columns == table.columns
    assert sorted(expected.groupBy("a").count().collect(), key=str) == sorted(table.groupBy("a").count().collect(), key=str)
    assert staging.measured(table.where("b > 2")).count() == 0


def test_many_points_and_links_are_not_broadcast(spark, cube, monkeypatch):
    vertices, tetra = cube
    plans = []
    for module in (components, locate):
        monkeypatch.setattr(module, "staged", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staging.staged(df, *a, **k))
    points = vertices.select(F.col("vid").alias("pid"), "x", "y", "z")
    nodes = spark.range(40).select(F.struct((F.col("id") % 2).alias("s"), "id").alias("node"))
    links = spark.range(38).select(F.struct((F.col("id") % 2).alias("s"), "id").alias("a"), F.struct((F.col("id") % 2).alias("s"), (F.col("id") + 2).alias("id")).alias("b"))
    for few in (200_000, 0):
        plans.clear()
        monkeypatch.setattr(components, "FEW_LINKS", few)
        monkeypatch.setattr(locate, "FEW_VERTICES", few)
        assert {r.comp.id for r in components.components(nodes, links).collect()} == {0, 1}
        assert locate.locate(points, tetra, vertices).where("how = 'inside'").count() == 125
        merged = [p for p in plans if "SortMergeJoin" in p]
        assert bool(merged) == (few == 0)


def test_pieces_of_the_cut_are_not_staged(spark, monkeypatch):
    from tetraflow.plans import lattice_queries

    names = []
    monkeypatch.setattr(lattice_queries, "staged", lambda df, name="staged", **k: names.append(name) or staging.staged(df, name, **k))
    d = "/root/testdata/sf0.001"
    assert lattice_queries.ls_conforming(spark, d).first()[1:] == (0, 0)
    assert {r.ref for r in lattice_queries.ls_volume(spark, d).collect()} == {2, 3}
    assert lattice_queries.ls_split_counts(spark, d).agg(F.sum("n_parents")).first()[0] == lattice(spark, d)[1].count()
    assert "cut" not in names


def test_rules_are_counted_one_after_the_other(spark):
    """No plan holds all of them: neither the query's own, nor any before it."""
    from tetraflow.plans import lattice_queries

    out = lattice_queries.consistency(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Aggregate" not in plan and "parquet" not in plan
    assert {r.rule: r.broken for r in out.collect()} == dict.fromkeys(("crowded_faces", "dangling", "inverted", "merged_nodes", "split_nodes", "unmirrored", "unused_vertices"), 0)
    found = checks.counted(spark, {"some": spark.range(3), "none": spark.range(0)})
    assert {r.rule: r.broken for r in found.collect()} == {"some": 3, "none": 0}


def test_boundary_faces_are_hashed_and_keep_their_turn(spark, cube):
    """Plain minima need no sort; corners come in the tetra's own outward order, whichever number is the least."""
    _, tetra = cube
    renamed = tetra.select("tid", *[((F.col(c) * 37) % 127).alias(c) for c in topology.CORNERS], "ref", "part")
    out = topology.boundary_faces(renamed)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    wanted = topology.face_adjacency(renamed).where("n = 1").select("f0", "f1", "f2", "a.n0", "a.n1", "a.n2", "a.tid", "a.ifac", "a.ref", "a.part")
    assert out.columns == wanted.columns and out.count() == 192
    assert out.exceptAll(wanted).count() == 0 and wanted.exceptAll(out).count() == 0


def test_surface_corners_are_attached_once(spark, cube, monkeypatch):
    v, _ = cube
    calls = []
    monkeypatch.setattr(locate, "attach_corners", lambda *a, **k: calls.append(a) or topology.attach_corners(*a, **k))
    monkeypatch.setattr(stats, "attach_corners", lambda *a, **k: calls.append(a) or topology.attach_corners(*a, **k))
    points = spark.createDataFrame([(1, 4.25, 1.5, 2.5)], "pid long, x double, y double, z double")
    assert locate.locate_on_surface(points, skin(cube), v, 0.5).first().distance == 0.25
    assert len(calls) == 1 and calls[0][0]._staged_at


def test_faces_are_met_once_to_fix_contiguity(spark, cube, monkeypatch):
    _, t = cube
    calls = []
    monkeypatch.setattr(components, "tetra_faces", lambda df: calls.append(df) or topology.tetra_faces(df))
    monkeypatch.setattr(topology, "face_adjacency", None)
    striped = t.withColumn("part", (F.col("v0") % 5 % 2).cast("int"))
    out = components.fix_contiguity(striped)
    assert len(calls) == 1 and out.schema["part"].dataType == striped.schema["part"].dataType
    assert out.count() == t.count() and {(r.i, r.part) for r in out.select((F.col("v0") % 5).alias("i"), "part").collect()} == {(0, 0), (1, 1), (2, 1), (3, 0)}


def test_fronts_move_without_an_exchange_of_tetra(spark, cube, monkeypatch):
    """Few vertices between parts are broadcast; many are exchanged, with the same result."""
    _, t = cube
    plans, got, joins = [], [], []
    monkeypatch.setattr(partition, "staged", lambda df, name="staged", **k: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or staging.staged(df, name, **k))
    for few in (200_000, 0):
        plans.clear()
        monkeypatch.setattr(partition, "FEW_VERTICES", few)
        got.append({r.tid: r.part for r in partition.displaced_front(t, 1).collect()})
        joins.append(sum(p.count("SortMergeJoin") for name, p in plans if name == "front"))
        assert not any("SortAggregate" in p for _, p in plans)
    assert joins[0] < joins[1] and got[0] == got[1] and got[0] != {r.tid: r.part for r in t.collect()}


def test_corners_meet_their_vertices_in_blocks(spark):
    """Rows whose corners lie in other blocks, have no vertex or are null, by part too; no row is exchanged for each corner."""
    from tetraflow.operators import blocks

    far = 5 << blocks.BLOCK_BITS
    rows = spark.createDataFrame([(1, 0, 1, far), (1, 1, far, far + 1), (2, 2, far, 1), (2, 3, None, 1), (1, 4, 77, 78)], "part int, tid long, v0 long, v1 long")
    points = spark.createDataFrame([(1, 1, 0.5, "a"), (1, far, 1.5, "b"), (2, 1, 2.5, "c")], "part int, vid long, x double, s string")
    got = {r.tid: (r.x0, r.x1, r.s0, r.s1) for r in blocks.met(rows, ("v0", "v1"), points, ("x", "s"), ("part",)).collect()}
    assert got == {0: (0.5, 1.5, "a", "b"), 1: (1.5, None, "b", None), 2: (None, 2.5, None, "c"), 3: (None, 2.5, None, "c"), 4: (None, None, None, None)}


def test_pieces_of_faces_met_in_blocks(spark):
    """Against links of every face: blocks far apart, odd ids, faces of three tetra, no partition."""
    from tetraflow.operators import components as C

    draw = random.Random(5)
    step = 1 << C.FACE_BITS
    for spread in (1, step // 3, step * 7 + 1):
        rows = [(draw.randrange(1000) * 1000 + i, *[v * spread for v in draw.sample(range(9), 4)], draw.choice((0, 1, 1, None))) for i in range(60)]
        tetra = spark.createDataFrame(rows, "tid long, v0 long, v1 long, v2 long, v3 long, part int")
        links = C._inner(tetra, "part").where("part_a = part_b").select("tid_a", "tid_b")
        want = sorted(map(tuple, C._labelled(tetra, "part", C.roots(links)).collect()), key=str)
        assert sorted(map(tuple, C.part_components(tetra).collect()), key=str) == want
        own = tetra.join(spark.createDataFrame(want, "tid long, part int, comp long").drop("part"), "tid")
        comp = {r.tid: r.comp for r in own.collect()}
        part = {r.tid: r.part for r in own.collect()}
        both = topology.face_adjacency(tetra).where("n = 2").select("a.tid", F.col("b.tid").alias("other")).collect()
        beside = {(part[x], comp[x], part[y]) for r in both for x, y in ((r[0], r[1]), (r[1], r[0])) if None not in (part[x], part[y]) and part[x] != part[y]}
        assert {tuple(r) for r in C.reachable_parts(tetra).collect()} == beside


def test_volumes_of_sides_are_those_of_the_pieces(spark):
    """The volumes and numbers of pieces by side equal those of the pieces that the cut makes, values on the level and unordered corners included."""
    draw = random.Random(3)
    v = spark.createDataFrame([(i, *[draw.random() for _ in range(3)], draw.choice((0.0, draw.uniform(-1, 1)))) for i in range(12)], "vid long, x double, y double, z double, v double")
    t = spark.createDataFrame([(i, *draw.sample(range(12), 4)) for i in range(40)], "tid long, v0 long, v1 long, v2 long, v3 long")
    cut, points = levelset.discretise(t, v.select("vid", "x", "y", "z"), v.select("vid", "v"))
    at = topology.attach_corners(cut, points)
    want = {r.ref: (r.n, r.volume) for r in at.groupBy("ref").agg(F.count("*").alias("n"), F.sum(G.volume([G.point("", i) for i in range(4)])).alias("volume")).collect()}
    got = {r.ref: (r.n, r.volume) for r in levelset.side_volumes(t, v.select("vid", "x", "y", "z"), v.select("vid", "v")).collect()}
    assert got.keys() == want.keys() == {2, 3}
    for ref in got:
        assert got[ref][0] == want[ref][0] and got[ref][1] == pytest.approx(want[ref][1], abs=1e-12)
