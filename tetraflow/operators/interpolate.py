"""Interpolation of metrics and fields at located points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetraflow.functions import geometry as G
from tetraflow.operators.locate import locate, locate_on_surface
from tetraflow.operators.topology import CORNERS
from tetraflow.staging import measured, staged


def _weighted(values: Column, phi: Column, size: int) -> list[Column]:
    """Components of the combination of the corners' value arrays."""
    return [F.aggregate(F.zip_with(phi, values, lambda p, v: p * F.get(v, F.lit(k))), F.lit(0.0), lambda s, x: s + x) for k in range(size)]


def combine(at: DataFrame, values: DataFrame, corners: tuple[str, ...], size: int, tensor_metric: bool = False) -> DataFrame:
    """(pid, val) from ``at`` (pid, phi, corner ids) and vertex values (vid, val).

    Scalars, vectors and tensor fields combine by component. A tensor metric
    combines the inverses and inverts the result; it is null where one is singular.
    """
    each = at.select("pid", "phi", F.posexplode(F.array(*corners)).alias("corner", "vid"))
    met = each.join(values.select("vid", "val"), "vid")
    if tensor_metric:
        met = met.withColumn("val", F.array(*G.tensor_inverse(G.array_tensor(F.col("val")))))
    rows = met.groupBy("pid").agg(F.first("phi").alias("phi"), F.array_sort(F.collect_list(F.struct("corner", "val"))).alias("c"))
    rows = rows.where(F.size("c") == len(corners)).select("pid", "phi", F.transform("c", lambda s: s["val"]).alias("v"))
    mixed = F.array(*_weighted(F.col("v"), F.col("phi"), size))
    if tensor_metric:
        rows = rows.withColumn("m", mixed)
        mixed = F.array(*G.tensor_inverse(G.array_tensor(F.col("m"))))
        mixed = F.when(~F.exists(mixed, lambda x: x.isNull()), mixed)
    return rows.select("pid", mixed.alias("val"))


def at_points(points: DataFrame, tetra: DataFrame, vertices: DataFrame, values: DataFrame, size: int = 1, tensor_metric: bool = False) -> DataFrame:
    """(pid, val) at any points (pid, x, y, z): volume location, then combination."""
    found = locate(points, tetra, vertices).join(tetra.select("tid", *CORNERS), "tid")
    return combine(found, values, CORNERS, size, tensor_metric)


def on_surface(points: DataFrame, triangles: DataFrame, vertices: DataFrame, values: DataFrame, hausd: float, size: int = 1, tensor_metric: bool = False) -> DataFrame:
    found = locate_on_surface(points, triangles, vertices, hausd).join(triangles.select("fid", "v0", "v1", "v2"), "fid")
    return combine(found, values, ("v0", "v1", "v2"), size, tensor_metric)


def transfer(
    new: DataFrame, old_vertices: DataFrame, old_tetra: DataFrame, old_triangles: DataFrame, values: DataFrame,
    hausd: float, size: int = 1, tensor_metric: bool = False, constant: float | None = None,
) -> DataFrame:
    """(vid, val) for every new vertex (vid, x, y, z, required, on_boundary).

    Required vertices keep the value they had; boundary ones use the surface,
    and the volume where no triangle is near; all others the volume. With
    ``constant`` every vertex has that value and nothing is located; nor is
    it where every vertex keeps what it had.
    """
    if constant is not None:
        return new.select("vid", F.array(F.lit(constant)).alias("val"))
    kept = new.where("required").join(values, "vid").select("vid", "val")
    rest = new.join(kept.select("vid"), "vid", "left_anti")
    points = measured(staged(rest.select(F.col("vid").alias("pid"), "x", "y", "z", "on_boundary"), "asked"))
    if points.isEmpty():
        return kept
    # staged, as the volume's points are those that it leaves, and they are asked for in two queries
    surface = measured(staged(on_surface(points.where("on_boundary"), old_triangles, old_vertices, values, hausd, size, tensor_metric), "on-surface"))
    inner = staged(points.join(surface.select("pid"), "pid", "left_anti"), "in-volume")
    volume = at_points(inner.drop("on_boundary"), old_tetra, old_vertices, values, size, tensor_metric)
    return kept.unionAll(surface.select("pid", "val")).unionAll(volume.select("pid", "val"))
