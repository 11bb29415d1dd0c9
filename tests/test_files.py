import numpy as np
import pytest

from tetraflow import schema as S
from tetraflow.frame import MeshFrame
from tetraflow.plans.files import localised
from tetraflow.sources import catalog, medit, vtk

CUBE = """MeshVersionFormatted 2
# a comment with Vertices 9
Dimension
3
Vertices 5 0 0 0 1
1 0 0 1   0 1 0 1
0 0 1 1
1 1 1 2
Tetrahedra
2
1 2 3 4 7 2 3 4 5 8
Triangles 2
1 3 2 5  1 2 4 5
Corners 2 1 5
RequiredTriangles 1 2
Normals 1 0 0 1
NormalAtVertices 1 4 1
Unheard 2 9 9
End
ignored after
"""


def test_sections_and_tags(spark, tmp_path):
    (tmp_path / "a.mesh").write_text(CUBE)
    mesh = medit.read_mesh(spark, f"{tmp_path}/a.mesh")
    v = {r.vid: (r.x, r.y, r.z, r.ref, r.tag) for r in mesh.vertices.collect()}
    assert v[1] == (0.0, 0.0, 0.0, 1, S.CRN) and v[5] == (1.0, 1.0, 1.0, 2, S.CRN) and v[2][4] == 0
    assert sorted((r.tid, r.v0, r.v3, r.ref) for r in mesh.tetra.collect()) == [(1, 1, 4, 7), (2, 2, 5, 8)]
    assert {r.fid: r.tag for r in mesh.triangles.collect()} == {1: 0, 2: S.REQ}
    assert [(r.vid, r.nz) for r in mesh.normals.collect()] == [(4, 1.0)]
    assert mesh.iface.count() == 0 and mesh.tables["quads"].count() == 0


def test_distributed_files_and_interfaces(spark, tmp_path):
    for part, other in ((0, 1), (1, 0)):
        (tmp_path / f"m.{part}.mesh").write_text(
            CUBE.replace("End", f"NumberOfPartitions 2\nParallelTriangleCommunicators 1\n{other} 2\nParallelCommunicatorTriangles\n1 11 0\n2 12 0\nParallelVertexCommunicators 1 {other} 1 ParallelCommunicatorVertices 3 33 0\nEnd")
        )
    mesh = medit.read_mesh(spark, f"{tmp_path}/m.*.mesh")
    got = sorted((r.kind, r.part_in, r.part_out, r.pos, r.lid, r.gid) for r in mesh.iface.collect())
    assert got == [("face", 0, 1, 0, 1, 11), ("face", 0, 1, 1, 2, 12), ("face", 1, 0, 0, 1, 11), ("face", 1, 0, 1, 2, 12)]
    assert mesh.vertices.groupBy("part").count().count() == 2
    (tmp_path / "m.1.mesh").unlink()
    with pytest.raises(S.MeshInvalid, match="2 partitions"):
        medit.read_mesh(spark, f"{tmp_path}/m.*.mesh")


def test_globalised_copies_merge(spark, tmp_path):
    for part in (0, 1):
        (tmp_path / f"g.{part}.mesh").write_text(CUBE)
    mesh = medit.globalised(medit.read_mesh(spark, f"{tmp_path}/g.*.mesh"))
    assert mesh.vertices.count() == 5 and mesh.tetra.count() == 4
    ids = {r.vid for r in mesh.vertices.collect()}
    assert all({r.v0, r.v1, r.v2, r.v3} <= ids for r in mesh.tetra.collect())


def test_broken_files(spark, tmp_path):
    (tmp_path / "b.mesh").write_text("Dimension 3 Vertices 3 0 0 0 1")
    with pytest.raises(Exception, match="ends early"):
        medit.read_mesh(spark, f"{tmp_path}/b.mesh").vertices.collect()
    (tmp_path / "b.sol").write_text("Dimension 3")
    with pytest.raises(Exception, match="no solution"):
        medit.read_sol(spark, f"{tmp_path}/b.sol").collect()


def test_solutions_read_and_written(spark, tmp_path):
    (tmp_path / "s.sol").write_text("MeshVersionFormatted 2 Dimension 3\nSolAtVertices 2\n3 1 2 3\n" + " ".join(str(i) for i in range(20)) + "\nEnd")
    sols = medit.read_sol(spark, f"{tmp_path}/s.sol", names=("a", "b", "c"))
    got = {(r.name, r.vid): list(r.val) for r in sols.collect()}
    assert got[("a", 1)] == [0.0] and got[("b", 2)] == [11.0, 12.0, 13.0] and got[("c", 2)] == [14.0, 15.0, 16.0, 17.0, 18.0, 19.0]
    medit.write_sol(sols, f"{tmp_path}/out")
    back = medit.read_sol(spark, f"{tmp_path}/out/*/*.txt", names=("a", "b", "c"))
    assert {(r.name, r.vid): list(r.val) for r in back.collect()} == got


def test_mesh_written_and_read_again(spark, tmp_path):
    (tmp_path / "a.0.mesh").write_text(CUBE)
    mesh = medit.read_mesh(spark, f"{tmp_path}/a.0.mesh")
    iface = spark.createDataFrame([("face", 0, 3, 0, 1, 11), ("face", 0, 2, 0, 2, 12), ("node", 0, 2, 0, 4, 44)], S.IFACE)
    medit.write_mesh(mesh.set("iface", iface), f"{tmp_path}/out")
    back = medit.read_mesh(spark, f"{tmp_path}/out/*/*.txt")
    for name in ("vertices", "tetra", "triangles"):
        assert sorted(map(tuple, back.tables[name].collect())) == sorted(map(tuple, mesh.tables[name].select(back.tables[name].columns).collect()))
    assert sorted((r.kind, r.part_out, r.lid, r.gid) for r in back.iface.collect()) == [("face", 2, 2, 12), ("face", 3, 1, 11)]


def test_ranked_names():
    assert medit.ranked_name("x/a.b.mesh", 3) == "x/a.b.3.mesh" and medit.ranked_name("plain", 0) == "plain.0"


def test_catalog_round_trip_and_selection(spark, tmp_path):
    from tetraflow.sources.lattice import lattice_tetra, lattice_vertices

    orders = spark.range(27).selectExpr("id o_orderkey", "1.0 * id o_totalprice", "id o_custkey")
    v = lattice_vertices(orders, 3)
    t = lattice_tetra(v, 3)
    tables = localised(v, t)
    mesh = MeshFrame(spark).set("vertices", tables["vertices"].withColumn("tag", S_col())).set("tetra", tables["tetra"])
    catalog.save(mesh, f"{tmp_path}/c")
    back = catalog.load(spark, f"{tmp_path}/c")
    assert back.sizes() == mesh.sizes() and set(back.tables) == {"vertices", "tetra"}
    assert set(catalog.load(spark, f"{tmp_path}/c", ("tetra",)).tables) == {"tetra"}
    catalog.save(mesh, f"{tmp_path}/d", tables=("vertices",), without=("required",))
    left = catalog.load(spark, f"{tmp_path}/d")
    assert left.vertices.where("tag <> 0").count() == 0 and set(left.tables) == {"vertices"}
    with pytest.raises(S.MeshInvalid):
        catalog.save(mesh, f"{tmp_path}/e", tables=("nothing",))
    counts = {(r.entity, r.part): (r.n, r.offset) for r in catalog.sizes(back).collect()}
    assert counts[("tetra", 0)][1] == 0 and sum(n for (e, _), (n, _) in counts.items() if e == "tetra") == 48
    text = catalog.sidecar("c", {"vertices": 27, "tetra": 48}, {"h": 1, "m": 6})
    assert 'NumberOfElements="48"' in text and text.count("<Attribute") == 2


def S_col():
    from pyspark.sql import functions as F

    return F.lit(S.REQ)


def binary(version, order, sections):
    """A binary mesh or solution file of (code, counts, reals and integers by row)."""
    import struct

    real, whole, place = ("f" if version == 1 else "d"), ("q" if version == 4 else "i"), ("q" if version >= 3 else "i")
    out = struct.pack(order + "ii", 1, version)
    for code, head, rows in [(3, [], None), *sections]:
        body = struct.pack(order + "i", 3) if rows is None else b"".join(struct.pack(order + whole, x) for x in head)
        body += b"".join(struct.pack(order + (real if isinstance(x, float) else whole), x) for row in rows or () for x in row)
        after = len(out) + 4 + struct.calcsize(order + place) + len(body)
        out += struct.pack(order + "i" + place, code, after) + body
    return out + struct.pack(order + "i" + place, 54, 0)


@pytest.mark.parametrize("version,order", [(1, "<"), (2, "<"), (2, ">"), (3, "<"), (4, ">")])
def test_binary_meshes_and_solutions(spark, tmp_path, version, order):
    points = [(0.0, 0.0, 0.0, 1), (1.0, 0.0, 0.0, 2), (0.0, 1.0, 0.0, 3), (0.0, 0.0, 0.5, 4)]
    parts = [(4, [4], points), (99, [2], [(7, 7), (8, 8)]), (6, [1], [(1, 2, 3, 9)]), (8, [1], [(1, 2, 3, 4, 5)]), (13, [1], [(2,)]), (71, [1], [(1, 2)]), (73, [], [(1, 11, 0), (2, 12, 0)])]
    (tmp_path / "m.0.meshb").write_bytes(binary(version, order, parts))
    (tmp_path / "s.0.solb").write_bytes(binary(version, order, [(62, [4, 2, 1, 2], [(1.5 * i, 0.0, 1.0, 2.0) for i in range(4)])]))
    mesh = medit.read_mesh(spark, f"{tmp_path}/m.*.meshb")
    assert sorted((r.x, r.y, r.z, r.ref) for r in mesh.vertices.collect()) == sorted(points)
    assert [(r.v0, r.v1, r.v2, r.v3, r.ref) for r in mesh.tetra.collect()] == [(1, 2, 3, 4, 5)] and [(r.v0, r.ref) for r in mesh.triangles.collect()] == [(1, 9)]
    assert [r.vid for r in mesh.vertices.where(f"tag & {S.CRN} <> 0").collect()] == [2]
    assert sorted((r.part_out, r.lid, r.gid) for r in mesh.table("iface").collect()) == [(1, 1, 11), (1, 2, 12)]
    sols = {(r.name, r.vid): r.val for r in medit.read_sol(spark, f"{tmp_path}/s.*.solb").collect()}
    assert sols[("sol0", 3)] == [3.0] and sols[("sol1", 4)] == [0.0, 1.0, 2.0] and len(sols) == 8


def test_binary_files_that_are_none(tmp_path):
    whole = binary(2, "<", [(4, [4], [(0.0, 0.0, 0.0, 1)] * 4)])
    for bad in (b"", b"MeshVersionFormatted 2", whole[:40]):
        with pytest.raises(S.MeshInvalid):
            medit.unpack(bad)


@pytest.mark.parametrize("form", ["ascii", "binary", "binary apart", "base64", "raw"])
def test_grids_inline_and_appended(spark, tmp_path, form):
    import base64

    import numpy as np

    arrays = [("Points", "Float64", np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 0.25]])), ("connectivity", "Int32", np.array([0, 1, 2, 3])), ("offsets", "Int64", np.array([4])), ("types", "UInt8", np.array([10])), ("f", "Float32", np.array([1.5, 2.5, 3.5, 4.5]))]
    tail, nodes = b"", {}
    for name, kind, values in arrays:
        raw = values.astype(vtk.KINDS[kind]).tobytes()
        head = np.array([len(raw)], "u4").tobytes()
        at = len(tail)
        if form == "ascii":
            body, how = " ".join(map(str, values.ravel())), 'format="ascii"'
        elif form.startswith("binary"):
            body = (base64.b64encode(head) + base64.b64encode(raw) if "apart" in form else base64.b64encode(head + raw)).decode()
            how = 'format="binary"'
        else:
            tail += head + raw if form == "raw" else base64.b64encode(head + raw)
            body, how = "", f'format="appended" offset="{at}"'
        nodes[name] = f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{3 if name == "Points" else 1}" {how}>{body}</DataArray>'
    end = b'<AppendedData encoding="' + form.encode() + b'">_' + tail + b"</AppendedData>" if tail else b""
    text = f'<VTKFile type="UnstructuredGrid" byte_order="LittleEndian"><UnstructuredGrid><Piece NumberOfPoints="4" NumberOfCells="1"><PointData>{nodes["f"]}</PointData><Points>{nodes["Points"]}</Points><Cells>{nodes["connectivity"]}{nodes["offsets"]}{nodes["types"]}</Cells></Piece></UnstructuredGrid>'
    (tmp_path / "g.vtu").write_bytes(text.encode() + end + b"</VTKFile>")
    mesh = vtk.read_vtu(spark, f"{tmp_path}/g.vtu")
    assert sorted((r.vid, r.x, r.y, r.z) for r in mesh.vertices.collect()) == [(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.0, 0.0, 0.25)]
    assert [(r.v0, r.v1, r.v2, r.v3) for r in mesh.tetra.collect()] == [(1, 2, 3, 4)]
    assert sorted((r.vid, r.val) for r in mesh.sol("field", "f").collect()) == [(i + 1, [i + 1.5]) for i in range(4)]


def test_pieces_and_the_file_that_names_them(spark, tmp_path):
    v = spark.createDataFrame([(p, i + 1, float(i == 1) + 2 * p, float(i == 2), float(i == 3)) for p in (0, 1) for i in range(4)], "part int, vid long, x double, y double, z double")
    t = spark.createDataFrame([(p, 1, 1, 2, 3, 4) for p in (0, 1)], "part int, tid long, v0 long, v1 long, v2 long, v3 long")
    assert vtk.write_grid(v, t, f"{tmp_path}/g", "a.b") == ["a-b.0.vtu", "a-b.1.vtu"]
    assert sorted(x.name for x in (tmp_path / "g").iterdir() if not x.name.startswith(".")) == ["a-b.0.vtu", "a-b.1.vtu", "a-b.pvtu"]
    assert (tmp_path / "g" / "a-b.pvtu").read_text().count('Source="a-b.') == 2
    mesh = vtk.read_vtu(spark, f"{tmp_path}/g/a-b.1.vtu")
    assert mesh.tetra.count() == 1 and sorted(r.x for r in mesh.vertices.collect()) == [2.0, 2.0, 2.0, 3.0]


def test_grid_rows_come_one_by_one():
    """A piece's rows are never all in memory at once."""
    rows = vtk._rows(np.zeros((2, 3)), [(10, [0, 1, 2, 3]), (5, [0, 1, 2])], {"h": np.ones((2, 1))})
    assert iter(rows) is rows
    assert [r[:3] for r in rows] == [("p", 1, None), ("p", 2, None), ("t", 1, None), ("f", 1, None), ("d", 1, "h"), ("d", 2, "h")]


def test_files_are_read_once_and_tokenised_without_an_object_a_number(spark, tmp_path):
    import tracemalloc

    (tmp_path / "once.mesh").write_text(CUBE)
    mesh = medit.read_mesh(spark, f"{tmp_path}/once.mesh")
    (tmp_path / "once.mesh").unlink()
    assert mesh.vertices.count() == 5 and mesh.tetra.count() == 2
    text = "Vertices 100000\n" + "0.5 0.25 1e-3 7\n" * 100_000 + "End"
    tracemalloc.start()
    rows = medit.tokenise(text)["Vertices"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows.shape == (100_000, 4) and rows[-1].tolist() == [0.5, 0.25, 1e-3, 7.0]
    assert peak < 8 * len(text)
    with pytest.raises(S.MeshInvalid, match="no number"):
        medit.tokenise("Vertices 1 1 2 1x 4")


def test_tables_are_worked_out_once_for_a_file(spark, tmp_path):
    import uuid

    (tmp_path / "runs").mkdir()
    runs = str(tmp_path / "runs")

    def run(batches):
        open(f"{runs}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    kind = "part int, vid long, x double, y double, z double, ref int, tag int"
    vertices = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 1, S.CRN), (0, 2, 1.0, 0.0, 0.0, 1, 0)], kind).coalesce(1).mapInArrow(run, kind)
    medit.write_mesh(MeshFrame(spark, {"vertices": vertices}), f"{tmp_path}/w")
    assert len(list((tmp_path / "runs").iterdir())) == 1
    back = medit.read_mesh(spark, f"{tmp_path}/w").vertices
    assert sorted((r.vid, r.x, r.tag) for r in back.collect()) == [(1, 0.0, S.CRN), (2, 1.0, 0)]


def test_text_is_read_in_splits_wherever_they_cut(spark, tmp_path):
    """No task holds a file: keywords, counts, rows and comments are cut at any line, and all comes out as from the whole text."""
    text = CUBE.replace("End\n", "ParallelVertexCommunicators 2\n1 1 2\n1\nParallelCommunicatorVertices 1 11 0\n2\n22 1 9 9 9\nVertices\n4\n" + "1\n2 3 # x 7\n4\n" * 4 + "End\n")
    for part in (0, 1):
        (tmp_path / f"s.{part}.mesh").write_text(text)
    want = {k: x.tolist() for k, x in medit.tokenise(text).items()}
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    try:
        for size in (60, 10_000):
            spark.conf.set(keys[0], str(size)), spark.conf.set(keys[1], "0"), spark.conf.set(keys[2], "1")
            sections = medit.read_sections(spark, f"{tmp_path}/s.*.mesh")
            for part in (0, 1):
                got = {}
                for r in sections.where(f"part = {part}").orderBy("section", "pos").collect():
                    got.setdefault(r.section, []).append(r.v)
                assert got == want
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert spark.read.option("lineSep", "\n").text(f"{tmp_path}/s.0.mesh").count() > 20
    (tmp_path / "n.mesh").write_text("Vertices 1 1 2 1x 4")
    with pytest.raises(Exception, match="no number"):
        medit.read_mesh(spark, f"{tmp_path}/n.mesh")
