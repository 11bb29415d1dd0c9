import pytest

from tetraflow import cli
from tetraflow import schema as S
from tetraflow.plans.files import localised
from tetraflow.sources import catalog, vtk
from tetraflow.sources.lattice import lattice_tetra, lattice_vertices


@pytest.fixture
def files(spark, tmp_path):
    """A lattice of 4 points a side as a text mesh with a level set beside it."""
    orders = spark.range(64).selectExpr("id o_orderkey", "1.0 * id o_totalprice", "id o_custkey")
    v = lattice_vertices(orders, 4)
    t = lattice_tetra(v, 4, 1)
    tables = localised(v, t)
    rows = sorted((r.vid, r.x, r.y, r.z) for r in tables["vertices"].collect())
    cells = sorted((r.tid, r.v0, r.v1, r.v2, r.v3, r.ref) for r in tables["tetra"].collect())
    text = f"MeshVersionFormatted 2\nDimension 3\nVertices {len(rows)}\n" + "\n".join(f"{x} {y} {z} 0" for _, x, y, z in rows)
    text += f"\nTetrahedra {len(cells)}\n" + "\n".join(" ".join(map(str, c[1:])) for c in cells) + "\nEnd\n"
    (tmp_path / "m.mesh").write_text(text)
    (tmp_path / "m.sol").write_text(f"Dimension 3 SolAtVertices {len(rows)} 1 1\n" + "\n".join(str(x - 1.25) for _, x, _, _ in rows) + "\nEnd")
    return tmp_path


def run(spark, *arguments):
    return cli.run(spark, cli.parser().parse_args(list(map(str, arguments))))


def test_level_set_to_parquet(spark, files):
    run(spark, files / "m.mesh", "-sol", files / "m.sol", "-ls", "-check", "-v", "0", "-out", files / "out", "-parquet")
    back = catalog.load(spark, f"{files}/out")
    assert {r.ref for r in back.tetra.select("ref").distinct().collect()} == {2, 3} and back.vertices.count() > 64


def test_parting_and_text_output(spark, files):
    run(spark, files / "m.mesh", "-noadapt", "-parts", "4", "-check", "-v", "0", "-out", files / "text")
    mesh = cli.medit.read_mesh(spark, f"{files}/text/*/*.txt")
    assert mesh.tetra.count() == 162 and mesh.tetra.select("part").distinct().count() == 4
    merged = cli.medit.globalised(mesh)
    assert merged.vertices.count() == 64


def test_adaptation_by_one_size(spark, files):
    out = run(spark, files / "m.mesh", "-hsiz", "0.8", "-niter", "1", "-check", "-v", "0")
    assert out.tetra.count() > 162


def test_faults_end_with_a_message(spark, files, capsys):
    with pytest.raises(S.MeshInvalid):
        run(spark, files / "m.mesh", "-v", "0")
    with pytest.raises(S.MeshInvalid):
        run(spark, files / "m.mesh", "-ls", "0.5", "-v", "0")
    for name in ("a.h5", "a.msh"):
        with pytest.raises(S.MeshInvalid):
            cli.load(spark, name)


def test_grids_in_xml(spark, tmp_path):
    v = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 1.0, 0.0, 0.0), (0, 3, 0.0, 1.0, 0.0), (0, 4, 0.0, 0.0, 1.0)], "part int, vid long, x double, y double, z double")
    t = spark.createDataFrame([(0, 1, 1, 2, 3, 4)], "part int, tid long, v0 long, v1 long, v2 long, v3 long")
    vtk.write_pieces(v, t, f"{tmp_path}/g")
    (tmp_path / "g.vtu").write_text(next((tmp_path / "g" / "part=0").glob("*.txt")).read_text())
    mesh = cli.load(spark, f"{tmp_path}/g.vtu")
    assert sorted((r.vid, r.x, r.y, r.z) for r in mesh.vertices.collect()) == sorted((r.vid, r.x, r.y, r.z) for r in v.collect())
    assert [(r.v0, r.v1, r.v2, r.v3) for r in mesh.tetra.collect()] == [(1, 2, 3, 4)] and mesh.triangles.count() == 0
    assert vtk.index_file(["a", "b"]).count("<Piece") == 2


def full(spark, files):
    """The lattice with its boundary as triangles (refs 1 and 2), two edges, a corner, and a scalar and a vector field."""
    from pyspark.sql import functions as F

    from tetraflow.operators.topology import boundary_faces

    mesh = cli.load(spark, str(files / "m.mesh"))
    skin = sorted(tuple(r) for r in boundary_faces(mesh.tetra).select("n0", "n1", "n2").collect())
    points = sorted((r.vid, r.x, r.y, r.z) for r in mesh.vertices.collect())
    text = (files / "m.mesh").read_text().replace("\nEnd\n", "")
    text += f"\nTriangles {len(skin)}\n" + "\n".join(f"{a} {b} {c} {1 + (a % 2)}" for a, b, c in skin)
    text += "\nEdges 2\n1 2 5\n2 3 6\nCorners 1\n1\nRidges 1\n1\nEnd\n"
    (files / "full.mesh").write_text(text)
    (files / "f.sol").write_text(f"Dimension 3 SolAtVertices {len(points)} 2 1 2\n" + "\n".join(f"{2 * x + y} {x} {y} {z}" for _, x, y, z in points) + "\nEnd")
    return len(skin), {1 + (a % 2): sum(1 for t in skin if t[0] % 2 == a % 2) for a in (0, 1)}, F


def test_all_tables_and_fields_come_back(spark, files):
    n, by_ref, F = full(spark, files)
    run(spark, files / "full.mesh", "-noadapt", "-parts", "3", "-field", files / "f.sol", "-interfaces", "-v", "0", "-out", files / "whole")
    back = cli.medit.read_mesh(spark, f"{files}/whole/*/*.txt")
    assert back.triangles.count() == n and {r.ref: r["count"] for r in back.triangles.groupBy("ref").count().collect()} == by_ref
    assert {r.ref for r in back.edges.collect()} == {5, 6} and back.edges.where(F.col("tag").bitwiseAND(S.GEO) != 0).count() >= 1
    assert back.vertices.where(F.col("tag").bitwiseAND(S.CRN) != 0).select("x", "y", "z").distinct().count() == 1
    sols = cli.medit.read_sol(spark, f"{files}/whole.sol/*/*.txt").join(back.vertices.select("part", "vid", "x", "y", "z"), ["part", "vid"])
    assert sols.count() == 2 * back.vertices.count()
    assert all(r.val == ([2 * r.x + r.y] if r.name == "sol0" else [r.x, r.y, r.z]) for r in sols.collect())
    iface = back.table("iface")
    assert iface.count() > 0 and iface.groupBy("gid").count().where("count < 2").count() == 0


def test_a_cut_keeps_refs_tags_and_fields(spark, files):
    n, by_ref, F = full(spark, files)
    out = run(spark, files / "full.mesh", "-sol", files / "m.sol", "-ls", "-snap", "-field", files / "f.sol", "-check", "-v", "0")
    refs = {r.ref: r["count"] for r in out.triangles.groupBy("ref").count().collect()}
    assert set(refs) == {1, 2, 10} and refs[1] >= by_ref[1] and refs[2] >= by_ref[2]
    field = out.sol("field", "sol0").join(out.vertices, "vid").collect()
    assert len(field) == out.vertices.count() and all(abs(r.val[0] - 2 * r.x - r.y) < 1e-9 for r in field)


def test_sizes_are_bounded_and_graded(spark, files):
    from tetraflow.plans.adapt import bounded, graded

    mesh = cli.load(spark, str(files / "m.mesh"))
    sized = mesh.vertices.select("vid", "x", "y", "z").selectExpr("*", "case when vid = 1 then 0.1 else 9.0 end size")
    assert {r.size for r in bounded(sized, S.AdaptParams(hmin=0.5, hmax=2.0)).collect()} == {0.5, 2.0}
    left = {r.vid: r for r in graded(mesh.tetra, sized, 1.5).collect()}
    import math

    assert len(left) == 64 and left[1].size == 0.1
    assert all(r.size <= 0.1 + math.log(1.5) * (abs(r.x - left[1].x) + abs(r.y - left[1].y) + abs(r.z - left[1].z)) + 1e-9 for r in left.values())
    same = run(spark, files / "m.mesh", "-hsiz", "0.8", "-niter", "1", "-noinsert", "-v", "0")
    assert same.tetra.count() == 162
    skin = run(spark, files / "m.mesh", "-hsiz", "0.8", "-niter", "1", "-nosurf", "-v", "0")
    from tetraflow.operators.topology import boundary_faces

    assert boundary_faces(skin.tetra).count() == 108 and skin.tetra.count() > 162


def test_a_metric_without_values_for_some_vertices_is_refused(spark, files):
    lines = (files / "m.sol").read_text().replace(" 64 ", " 60 ").split("\n")
    (files / "short.sol").write_text("\n".join([lines[0], *["0.9"] * 60, "End"]))
    with pytest.raises(S.MeshInvalid, match="4 vertices"):
        run(spark, files / "m.mesh", "-sol", files / "short.sol", "-v", "0")


def test_parameters_that_nothing_acts_on_are_named(spark):
    from tetraflow.frame import MeshFrame

    with pytest.warns(S.MeshDegraded, match="hausd, noswap"):
        MeshFrame(spark, params=S.AdaptParams(hausd=0.5, noswap=True)).validate()
    assert S.AdaptParams().idle() == []
