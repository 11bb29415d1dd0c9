"""Surface analysis: ridges, reference and non-manifold edges, singular vertices, normals by patch."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetraflow import schema as S
from tetraflow.operators.components import components
from tetraflow.operators.topology import is_set, triangle_edges


def edge_features(triangles: DataFrame, angle_degrees: float = S.RIDGE_ANGLE_DEGREES, detect: bool = True) -> DataFrame:
    """(a, b, n, tag) of each surface edge; triangles have ref and unit normals nx, ny, nz.

    One triangle or more than two: ridge, non-manifold and reference. Two of
    different refs: reference. Two whose normals part by more than the angle: ridge.
    """
    limit = math.cos(math.radians(angle_degrees))
    edges = triangle_edges(triangles)
    side = F.struct("fid", "ref", "nx", "ny", "nz")
    g = edges.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(side).alias("p"), F.max(side).alias("q"))
    cosine = sum((F.col(f"p.n{c}") * F.col(f"q.n{c}") for c in "yz"), F.col("p.nx") * F.col("q.nx"))
    other = F.when(F.col("p.ref") != F.col("q.ref"), S.REF).otherwise(0)
    sharp = F.when(cosine <= limit + S.EPS, S.GEO).otherwise(0) if detect else F.lit(0)
    tag = F.when(F.col("n") != 2, S.GEO | S.NOM | S.REF).otherwise(other.bitwiseOR(sharp))
    return g.select("a", "b", "n", tag.cast("int").alias("tag"))


def singular_vertices(features: DataFrame, vertices: DataFrame, angle_degrees: float = S.RIDGE_ANGLE_DEGREES) -> DataFrame:
    """(vid, n_ridge, n_ref, tag): vertices on feature edges; each edge counted once, whoever has it.

    n_ridge counts ridges, n_ref edges that are reference only. More than two:
    corner and required. One of each: required. One alone: corner and
    required. Two of a kind: corner if the line turns by more than the angle.
    """
    limit = math.cos(math.radians(angle_degrees))
    lines = features.where(F.col("tag") != 0)
    ends = lines.select(is_set(F.col("tag"), S.GEO).alias("ridge"), F.explode(F.array(F.struct(F.col("a").alias("vid"), F.col("b").alias("to")), F.struct(F.col("b").alias("vid"), F.col("a").alias("to")))).alias("e")).select("ridge", "e.*")
    met = ends.join(vertices.select("vid", "x", "y", "z"), "vid").join(vertices.select(F.col("vid").alias("to"), *[F.col(c).alias(f"{c}2") for c in "xyz"]), "to")
    d = [F.col(f"{c}2") - F.col(c) for c in "xyz"]
    size = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    unit = F.struct("to", *[(x / size).alias(c) for x, c in zip(d, "xyz")])
    g = met.groupBy("vid").agg(F.count_if("ridge").alias("n_ridge"), F.count_if(~F.col("ridge")).alias("n_ref"), F.min(unit).alias("p"), F.max(unit).alias("q"))
    total, turn = F.col("n_ridge") + F.col("n_ref"), -(F.col("p.x") * F.col("q.x") + F.col("p.y") * F.col("q.y") + F.col("p.z") * F.col("q.z"))
    tag = (
        F.when((total > 2) | (total == 1), S.CRN | S.REQ)
        .when((F.col("n_ridge") == 1) & (F.col("n_ref") == 1), S.REQ)
        .when(turn < limit, S.CRN)
        .otherwise(0)
    )
    return g.select("vid", "n_ridge", "n_ref", tag.alias("tag"))


def patch_normals(triangles: DataFrame, features: DataFrame) -> DataFrame:
    """(vid, patch, nx, ny, nz, n): at each vertex one unit normal for each smooth patch around it.

    Triangles at a vertex are linked through their common edges that are no
    feature; each component is a side of the ridge. patch is the smallest
    triangle of the component, so a smooth vertex has one row, one on a ridge two.
    """
    smooth = features.where((F.col("tag") == 0) & (F.col("n") == 2)).select("a", "b")
    pairs = triangle_edges(triangles).select("fid", "a", "b").join(smooth, ["a", "b"]).groupBy("a", "b").agg(F.min("fid").alias("f"), F.max("fid").alias("g"))
    at = lambda v, f: F.struct(F.col(v).alias("vid"), F.col(f).alias("fid"))
    links = pairs.select(F.explode(F.array(F.struct(at("a", "f").alias("p"), at("a", "g").alias("q")), F.struct(at("b", "f").alias("p"), at("b", "g").alias("q")))).alias("l")).select("l.p", "l.q")
    each = triangles.select(F.explode(F.array("v0", "v1", "v2")).alias("vid"), "fid", "area", "nx", "ny", "nz")
    found = components(each.select(F.struct("vid", "fid").alias("node")), links)
    met = found.select("node.vid", "node.fid", F.col("comp.fid").alias("patch")).join(each, ["vid", "fid"])
    total = met.groupBy("vid", "patch").agg(*[F.sum(F.col(f"n{c}") * F.col("area")).alias(c) for c in "xyz"], F.count("*").alias("n"))
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return total.select("vid", "patch", *[F.when(size > 0, F.col(c) / size).alias(f"n{c}") for c in "xyz"], "n")


def ridge_tangents(normals: DataFrame) -> DataFrame:
    """(vid, tx, ty, tz): at vertices of two patches the unit cross product of their normals, the smaller patch first."""
    side = F.struct("patch", "nx", "ny", "nz")
    two = normals.groupBy("vid").agg(F.count("*").alias("k"), F.min(side).alias("p"), F.max(side).alias("q")).where("k = 2")
    p, q = ([F.col(f"{s}.n{c}") for c in "xyz"] for s in "pq")
    t = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    size = F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2])
    return two.select("vid", *[F.when(size > 0, x / size).alias(f"t{c}") for x, c in zip(t, "xyz")])
