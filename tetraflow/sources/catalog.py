"""A mesh as a directory of Parquet tables: what a hierarchical file holds, column by column.

Each table is partitioned by part where it has one, so a reader of one
partition reads only its files, and only the columns it selects.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetraflow import schema as S
from tetraflow.frame import MeshFrame
from tetraflow.operators.numbering import entity_counts

VERSION = 1
ALL = tuple(S.TABLES)
#: Families of rows that a save can leave out: by table and tag bit.
FAMILIES = {"required": S.REQ, "parallel": S.PARBDY, "corners": S.CRN, "ridges": S.GEO}


def save(mesh: MeshFrame, path: str, tables: tuple[str, ...] | None = None, without: tuple[str, ...] = ()) -> None:
    """Write the chosen tables (all that there are) and a header; ``without`` clears families of tags. Fails if the path is there."""
    drop = 0
    for family in without:
        drop |= FAMILIES[family]
    chosen = [t for t in (tables or ALL) if t in mesh.tables]
    unknown = set(tables or ()) - set(ALL)
    if unknown:
        raise S.MeshInvalid(f"no table is called {', '.join(sorted(unknown))}")
    for name in chosen:
        df = mesh.tables[name]
        if drop and "tag" in df.columns:
            df = df.withColumn("tag", F.col("tag").bitwiseAND(~drop))
        writer = df.write.partitionBy("part") if "part" in df.columns else df.write
        writer.parquet(f"{path}/{name}")
    params = {k: str(v) for k, v in asdict(mesh.params).items() if k != "local"}
    rows = [("version", str(VERSION)), ("dimension", "3"), ("tables", ",".join(chosen)), *params.items()]
    mesh.spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(f"{path}/header")


def load(spark: SparkSession, path: str, tables: tuple[str, ...] | None = None, params: S.AdaptParams | None = None) -> MeshFrame:
    """Read the header and the chosen tables. Any number of partitions is read by any number of executors."""
    header = {r.key: r.value for r in spark.read.parquet(f"{path}/header").collect()}  # a row per parameter
    if int(header["version"]) > VERSION:
        raise S.MeshInvalid(f"the mesh was written by version {header['version']}")
    there = [t for t in header["tables"].split(",") if t]
    wanted = there if tables is None else [t for t in tables if t in there]
    return MeshFrame(spark, {t: spark.read.parquet(f"{path}/{t}") for t in wanted}, params or S.AdaptParams())


def sizes(mesh: MeshFrame) -> DataFrame:
    """(entity, part, n, offset) of the tables that have parts."""
    return entity_counts({k: v for k, v in mesh.tables.items() if "part" in v.columns})


def sidecar(path: str, counts: dict[str, int], sols: dict[str, int]) -> str:
    """An XML description of the tables for viewers: topology, geometry, and each solution with its components."""
    kind = {1: "Scalar", 3: "Vector", 6: "Tensor6"}
    attributes = "".join(f'\n    <Attribute Name="{name}" AttributeType="{kind[size]}" Center="Node"><DataItem Dimensions="{counts["vertices"]} {size}" Format="Parquet">{path}/sols</DataItem></Attribute>' for name, size in sols.items())
    return (
        f'<?xml version="1.0"?>\n<Xdmf Version="3.0"><Domain><Grid Name="mesh" GridType="Uniform">\n'
        f'    <Topology TopologyType="Tetrahedron" NumberOfElements="{counts["tetra"]}"><DataItem Dimensions="{counts["tetra"]} 4" Format="Parquet">{path}/tetra</DataItem></Topology>\n'
        f'    <Geometry GeometryType="XYZ"><DataItem Dimensions="{counts["vertices"]} 3" Format="Parquet">{path}/vertices</DataItem></Geometry>{attributes}\n'
        f"</Grid></Domain></Xdmf>\n"
    )
