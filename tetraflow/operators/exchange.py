"""Halo layers, and merging of groups and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetraflow.operators.components import components
from tetraflow.operators.topology import CORNERS, part_vertices, shared_by
from tetraflow.staging import staged

#: Points whose coordinates differ by no more than this are one.
SAME_PLACE = 1e-9


def halo_tetra(tetra: DataFrame, part: str = "part") -> DataFrame:
    """(part_out, tid): tetra that partition ``part_out`` gets: those of others that touch one of its vertices, once."""
    shared = shared_by(part_vertices(tetra, part))
    touch = tetra.select("tid", F.col(part).alias("part"), F.explode(F.array(*CORNERS)).alias("vid")).join(shared, "vid")
    return touch.select("tid", F.explode(F.array_except("parts", F.array("part"))).alias("part_out")).distinct().select("part_out", "tid")


def with_halo(tetra: DataFrame, part: str = "part") -> DataFrame:
    """``tetra`` with is_halo, and each partition's halo copies under its own number."""
    copies = tetra.join(halo_tetra(tetra, part), "tid").withColumn(part, F.col("part_out").cast(tetra.schema[part].dataType)).drop("part_out")
    return tetra.withColumn("is_halo", F.lit(False)).unionByName(copies.withColumn("is_halo", F.lit(True)))


def without_halo(tetra: DataFrame) -> DataFrame:
    return tetra.where("not is_halo").drop("is_halo")


def halo_counts(tetra: DataFrame, part: str = "part") -> DataFrame:
    """(part_in, part_out, n_tetra, n_points): what one partition sends to another; points the receiver does not have."""
    sent = tetra.join(halo_tetra(tetra, part), "tid").select(F.col(part).alias("part_in"), "part_out", "tid", *CORNERS)
    n_tetra = sent.groupBy("part_in", "part_out").agg(F.count("*").alias("n_tetra"))
    points = sent.select("part_in", "part_out", F.explode(F.array(*CORNERS)).alias("vid")).distinct()
    own = part_vertices(tetra, part).select(F.col("part").alias("part_out"), "vid")
    fresh = points.join(own, ["part_out", "vid"], "left_anti").groupBy("part_in", "part_out").agg(F.count("*").alias("n_points"))
    return n_tetra.join(fresh, ["part_in", "part_out"], "left").na.fill(0, ["n_points"])


def merge_parts(parts: list[DataFrame], key: tuple[str, ...]) -> DataFrame:
    """Tables of several partitions as one: an entity that several have comes once, from the lowest part, where part is a column."""
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return merge_copies(out, key)


def merge_copies(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Each entity once: the copy of the lowest part. One partial aggregation; no window over all copies."""
    others = [c for c in df.columns if c not in key and c != "part"]
    first = F.min_by(F.struct(*others), F.col("part")) if others else F.lit(1)
    merged = df.groupBy(*key).agg(F.min("part").alias("part"), first.alias("__rest"))
    return merged.select(*key, "part", *[F.col(f"__rest.{c}").alias(c) for c in others])


def places(points: DataFrame, eps: float = SAME_PLACE) -> DataFrame:
    """``points`` (id, x, y, z) with place: the smallest id of those that stand together.

    Two points are together if no coordinate differs by more than ``eps``, and
    so are points that others connect. Points of equal coordinates fall
    together first; what is left goes to cells a few times as wide as ``eps``,
    and to the next cell too where it lies within ``eps`` of it, so that points
    on both sides of a border meet. Null coordinates stand with equal ones only.
    """
    at = points.groupBy("x", "y", "z").agg(F.min("id").alias("place"))
    wide = F.lit(8.0 * eps)
    axes = [F.array_distinct(F.array(F.floor((F.col(c) - eps) / wide), F.floor((F.col(c) + eps) / wide))) for c in "xyz"]
    cells = F.flatten(F.transform(axes[0], lambda i: F.flatten(F.transform(axes[1], lambda j: F.transform(axes[2], lambda k: F.struct(i.alias("i"), j.alias("j"), k.alias("k")))))))
    dealt = at.select("place", "x", "y", "z", F.explode(cells).alias("cell"))
    crowded = dealt.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    dealt = staged(dealt.join(crowded, "cell", "left_semi"), "cells")
    other = dealt.select("cell", *[F.col(c).alias(f"{c}_b") for c in ("place", "x", "y", "z")])
    near = F.col("place") < F.col("place_b")
    for c in "xyz":
        near = near & (F.abs(F.col(c) - F.col(f"{c}_b")) <= eps)
    links = dealt.join(other, "cell").where(near).select("place", "place_b")
    found = components(at.select("place").distinct(), links).toDF("place", "root")
    named = at.join(found, "place").select(*[F.col(c).alias(f"{c}_p") for c in "xyz"], F.col("root").alias("place"))
    met = F.lit(True)
    for c in "xyz":
        met = met & F.col(c).eqNullSafe(F.col(f"{c}_p"))
    return points.join(named, met).drop("x_p", "y_p", "z_p")


def merge_by_coordinates(vertices: DataFrame, eps: float = SAME_PLACE) -> DataFrame:
    """(part, lid, gid, x, y, z): local vertices (part, lid, x, y, z) with the number of the point they are.

    Points within ``eps`` of each other on every axis are the same. gid is a
    stable, not a dense, id: the smallest (part, lid) at the point, packed in one long.
    """
    packed = F.col("part").cast("long") * F.lit(2**40) + F.col("lid")
    named = places(vertices.withColumn("id", packed), eps)
    return named.select("part", "lid", F.col("place").alias("gid"), "x", "y", "z")
