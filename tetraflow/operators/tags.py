"""Tag bits as expressions and propagations from faces to edges to vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetraflow import schema as S
from tetraflow.operators.topology import is_set


def tag_parallel(tag: Column) -> Column:
    """On an interface: PARBDY and BDY; frozen (REQ and NOSURF) unless the user required it already."""
    on = tag.bitwiseOR(S.PARBDY | S.BDY)
    return F.when(is_set(tag, S.REQ), on).otherwise(on.bitwiseOR(S.REQ | S.NOSURF))


def untag_parallel(tag: Column) -> Column:
    """Off an interface; what the user required stays required."""
    off = tag.bitwiseAND(~(S.PARBDY | S.PARBDYBDY | S.BDY))
    return F.when(is_set(tag, S.NOSURF), off.bitwiseAND(~(S.REQ | S.NOSURF))).otherwise(off)


def keep_old(tag: Column) -> Column:
    """Interface bits become old-interface bits."""
    cleared = tag.bitwiseAND(~S.OLDPARBDY)
    return F.when(is_set(tag, S.PARBDY), cleared.bitwiseOR(S.OLDPARBDY)).otherwise(cleared)


def is_old_interface(tag: Column) -> Column:
    return is_set(tag, S.OLDPARBDY) & ~is_set(tag, S.PARBDY)


def interface_marks(tetra: DataFrame, iface_faces: DataFrame) -> DataFrame:
    """(tid, mark): one more than the interface faces of each tetra; the weight that balancing uses."""
    n = iface_faces.groupBy(F.col("tid_in").alias("tid")).agg(F.count("*").alias("n"))
    return tetra.select("tid").join(n, "tid", "left").select("tid", (1 + F.coalesce("n", F.lit(0))).alias("mark"))


def spread_tags(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (a, b, tag), vertices (vid, tag)): bits of faces (f0, f1, f2, tag) on what bounds them."""
    pairs = [F.struct(F.col(f"f{i}").alias("a"), F.col(f"f{j}").alias("b")) for i, j in ((0, 1), (0, 2), (1, 2))]
    edges = faces.select("tag", F.explode(F.array(*pairs)).alias("e")).groupBy("e.a", "e.b").agg(F.bit_or("tag").alias("tag"))
    vertices = faces.select("tag", F.explode(F.array("f0", "f1", "f2")).alias("vid")).groupBy("vid").agg(F.bit_or("tag").alias("tag"))
    return edges, vertices


def vertices_from_edges(edges: DataFrame, bits: int = S.REF) -> DataFrame:
    """(vid, tag): the given bits of edges (a, b, tag) on their ends."""
    return edges.select(F.col("tag").bitwiseAND(bits).alias("tag"), F.explode(F.array("a", "b")).alias("vid")).groupBy("vid").agg(F.bit_or("tag").alias("tag")).where("tag <> 0")


def boundary_between_refs(adjacency: DataFrame) -> DataFrame:
    """(f0, f1, f2, tag): faces by what they are: true boundary, boundary of refs, interface, or both."""
    outer = F.col("n") == 1
    refs = (F.col("n") == 2) & (F.col("a.ref") != F.col("b.ref"))
    parts = (F.col("n") == 2) & (F.col("a.part") != F.col("b.part"))
    tag = F.when(refs & parts, S.PARBDY | S.PARBDYBDY | S.BDY).when(parts, S.PARBDY | S.BDY).when(outer | refs, S.BDY)
    return adjacency.select("f0", "f1", "f2", F.coalesce(tag, F.lit(0)).alias("tag")).where("tag <> 0")


def updated_tags(vertices: DataFrame, adjacency: DataFrame) -> DataFrame:
    """``vertices`` with interface and boundary bits rebuilt from the faces there are; user bits stay."""
    _, fresh = spread_tags(boundary_between_refs(adjacency))
    old = F.coalesce("tag", F.lit(0))
    met = vertices.withColumn("tag", untag_parallel(keep_old(old))).join(fresh.withColumnRenamed("tag", "__tag"), "vid", "left")
    base = F.col("tag").bitwiseOR(F.coalesce("__tag", F.lit(0)))
    return met.withColumn("tag", F.when(is_set(F.coalesce("__tag", F.lit(0)), S.PARBDY), tag_parallel(base)).otherwise(base)).select(*vertices.columns)
