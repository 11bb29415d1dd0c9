"""Command line: read a mesh, cut it, adapt it or part it, measure it, write it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetraflow import schema as S
from tetraflow.frame import MeshFrame
from tetraflow.operators import checks, levelset, partition, stats, topology
from tetraflow.plans.adapt import adapt, graded
from tetraflow.plans.files import localised
from tetraflow.sources import catalog, medit, vtk


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tetraflow", description=__doc__)
    p.add_argument("mesh", help="a .mesh or .meshb file, a glob of one file per partition, a .vtu file, or a Parquet folder")
    p.add_argument("-out", help="where to write: a folder of text files, or of Parquet tables with -parquet")
    p.add_argument("-sol", help="a metric, as a .sol file")
    p.add_argument("-field", help="fields to carry, as a .sol file")
    p.add_argument("-snap", action="store_true", help="take values near the level to it, where the surface stays a manifold")
    p.add_argument("-hmin", type=float, default=-1.0)
    p.add_argument("-hmax", type=float, default=-1.0)
    p.add_argument("-hgrad", type=float, default=-1.0, help="the most by which sizes grow a unit of length; off at one or less")
    p.add_argument("-noinsert", action="store_true")
    p.add_argument("-nosurf", action="store_true", help="leave the boundary as it is")
    p.add_argument("-interfaces", action="store_true", help="write node interfaces of the parts")
    p.add_argument("-ls", type=float, nargs="?", const=0.0, help="cut along this value of the level set in -sol")
    p.add_argument("-niter", type=int, default=S.AdaptParams.niter)
    p.add_argument("-hsiz", type=float, default=-1.0, help="one size everywhere")
    p.add_argument("-parts", type=int, default=0, help="part the mesh anew, into so many")
    p.add_argument("-nlayers", type=int, default=S.AdaptParams.ifc_layers)
    p.add_argument("-groups-ratio", type=float, default=S.AdaptParams.groups_ratio)
    p.add_argument("-nobalance", action="store_true", help="leave partitions as they are between rounds")
    p.add_argument("-noadapt", action="store_true", help="only part, cut, measure and write")
    p.add_argument("-parquet", action="store_true")
    p.add_argument("-vtu", action="store_true", help="write pieces and their index in XML")
    p.add_argument("-check", action="store_true", help="run the consistency checks and fail on a fault")
    p.add_argument("-v", type=int, default=1)
    return p


def load(spark: SparkSession, path: str) -> MeshFrame:
    """A mesh with global ids, from any of the formats."""
    if path.endswith(".vtu"):
        return vtk.read_vtu(spark, path)
    if path.endswith((".mesh", ".meshb")):
        mesh = medit.read_mesh(spark, path)
        return medit.globalised(mesh) if "*" in path else mesh
    if path.endswith((".msh", ".vtk", ".node", ".ele", ".h5")):
        raise S.MeshInvalid(f"the format of {path} is not supported")
    return catalog.load(spark, path)


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("tetraflow").getOrCreate()
    try:
        run(spark, a)
    except S.MeshInvalid as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 2
    return 0


def run(spark: SparkSession, a: argparse.Namespace) -> MeshFrame:
    params = S.AdaptParams(
        niter=a.niter, hsiz=a.hsiz, hmin=a.hmin, hmax=a.hmax, hgrad=a.hgrad, ifc_layers=a.nlayers, groups_ratio=a.groups_ratio, nobalance=a.nobalance,
        noinsert=a.noinsert, nosurf=a.nosurf, snap=a.snap, verbose=a.v, level_set=a.ls is not None,
    )
    mesh = load(spark, a.mesh)
    tables = {k: v for k, v in mesh.tables.items() if k not in ("quads", "prisms") or not v.isEmpty()}
    mesh = MeshFrame(spark, tables, params).validate()
    tetra, vertices = mesh.tetra, mesh.vertices
    rest = {k: mesh.tables[k] for k in ("triangles", "edges") if k in mesh.tables}
    if "part" not in tetra.columns or a.parts:
        tetra = tetra.drop("part").withColumn("part", F.lit(0))
    if a.parts > 1:
        tetra = tetra.drop("part").join(partition.partitioned(tetra, vertices, a.parts), "tid")
    values = medit.read_sol(spark, a.sol).where("name = 'sol0'").select("vid", F.get("val", F.lit(0)).alias("v")) if a.sol else None
    names, fields = _fields(medit.read_sol(spark, a.field)) if a.field else ({}, None)
    if a.ls is not None:
        if values is None:
            raise S.MeshInvalid("-ls needs the level set in -sol")
        old, (tetra, vertices) = vertices, levelset.discretise(tetra, vertices, values, a.ls, snap=a.snap)
        rest = {"triangles": levelset.carried_triangles(tetra, vertices, rest["triangles"])} if "triangles" in rest else {}
        if fields is not None:
            fields = fields.unionByName(levelset.carried(vertices.where("a is not null"), fields))
        vertices = _tagged(vertices, old)
    elif not a.noadapt:
        sized = graded(tetra, _sized(vertices, values, params), params.hgrad)
        old = vertices
        tetra, vertices, fields, history = adapt(tetra.select("tid", *topology.CORNERS, "ref", "part"), sized, params, fields=fields)
        if "triangles" in rest:
            rest = {"triangles": levelset.carried_triangles(tetra, vertices.withColumns({"a": F.lit(None).cast("long"), "b": F.lit(None).cast("long")}), rest["triangles"])}
        vertices = _tagged(vertices, old)
        if a.v:
            history.orderBy("iteration").show(truncate=False)
    measured = stats.tetra_quality(tetra, vertices)
    if a.v:
        stats.quality_summary(measured).show(truncate=False)
        stats.balance(tetra).orderBy("part").show()
    if a.check:
        checks.require_empty(checks.crowded_faces(tetra), "a face has more than two tetra")
        checks.require_empty(checks.inverted(measured), "a tetra has no positive volume")
        checks.require_empty(checks.dangling(tetra, vertices), "a tetra has a corner without a vertex")
    out = MeshFrame(spark, {"tetra": tetra, "vertices": vertices, **rest}, params)
    sols = None
    if fields is not None:
        for name, (at, size) in names.items():
            one = fields.select(F.lit(name).alias("name"), "vid", F.slice("val", at + 1, size).alias("val"))
            sols = one if sols is None else sols.unionAll(one)
            out = out.set_sols("field", name, one)
    if a.out and a.parquet:
        catalog.save(out, a.out)
    elif a.out and a.vtu:
        tables = localised(vertices, tetra)
        vtk.write_grid(tables["vertices"], tables["tetra"], a.out)
    elif a.out:
        tables = localised(vertices, tetra, rest.get("triangles"), rest.get("edges"), sols, a.interfaces)
        fresh = tables.pop("sols", None)
        medit.write_mesh(MeshFrame(spark, tables, params), a.out)
        if fresh is not None:
            medit.write_sol(fresh, f"{a.out}.sol")
    return out


def _fields(sols: DataFrame) -> tuple[dict[str, tuple[int, int]], DataFrame]:
    """(where each field begins in val, and its size, by name; (vid, val) of all fields side by side)."""
    sizes = {r.name: r.size for r in sols.groupBy("name").agg(F.max(F.size("val")).alias("size")).orderBy("name").collect()}  # a row per field
    names, at = {}, 0
    for name, size in sizes.items():
        names[name] = (at, size)
        at += size
    together = sols.groupBy("vid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("name", "val"))), lambda s: s["val"])).alias("val"))
    return names, together


def _tagged(vertices: DataFrame, old: DataFrame) -> DataFrame:
    """``vertices`` with the refs and tags that the old ones had; new points have none."""
    kept = [c for c in ("ref", "tag") if c in old.columns]
    return vertices.select("vid", "x", "y", "z").join(old.select("vid", *kept), "vid", "left").na.fill(0, kept) if kept else vertices


def _sized(vertices: DataFrame, values: DataFrame | None, params: S.AdaptParams) -> DataFrame:
    base = vertices.select("vid", "x", "y", "z")
    if params.hsiz > 0:
        return base.withColumn("size", F.lit(params.hsiz))
    if values is None:
        raise S.MeshInvalid("adaptation needs a metric in -sol, or -hsiz")
    sized = base.join(values.withColumnRenamed("v", "size"), "vid", "left")
    bare = sized.where("size is null").count()
    if bare:
        raise S.MeshInvalid(f"{bare} vertices have no value in the metric")
    return sized


if __name__ == "__main__":
    sys.exit(main())
