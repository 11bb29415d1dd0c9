"""Quality, edge lengths, counts, boxes and surface normals as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tetraflow.functions import geometry as G
from tetraflow.operators.topology import attach_corners
from tetraflow.schema import LENGTH_BINS, QUALITY_BINS

GOOD_QUALITY, FAIR_QUALITY = 0.5, 0.12


def _points(n: int = 4) -> list[G.Vec]:
    return [tuple(F.col(f"{c}{i}") for c in "xyz") for i in range(n)]


def tetra_quality(tetra: DataFrame, vertices: DataFrame) -> DataFrame:
    """``tetra`` with its corners' coordinates, volume and quality."""
    p = _points()
    return attach_corners(tetra, vertices).withColumn("volume", G.volume(p)).withColumn("quality", G.quality(p))


def _bins(value: Column, edges: tuple[float, ...], name: str) -> list[Column]:
    """Counts of half-open bins; the last is open above, the first below."""
    out = []
    for i, low in enumerate(edges):
        inside = value >= low if i else F.lit(True)
        if i + 1 < len(edges):
            inside = inside & (value < edges[i + 1])
        out.append(F.count_if(inside).alias(f"{name}{i}"))
    return out


def quality_summary(measured: DataFrame, by: tuple[str, ...] = (), digits: int | None = 9) -> DataFrame:
    """Per group: count, sum, average, best, shares, a five-bin histogram and the worst tetra.

    Ties of the worst go to the smallest (part, tid). Quality is rounded to
    ``digits`` before it is binned, so that a value on a bin's edge does not
    depend on the last bit.
    """
    q = F.round("quality", digits) if digits is not None else F.col("quality")
    worst = F.min(F.struct(q.alias("q"), *[c for c in ("part",) if c in measured.columns], "tid"))
    out = measured.groupBy(*by).agg(
        F.count("*").alias("ne"), F.round(F.avg(q), 6).alias("avg_q"), F.round(F.max(q), 6).alias("max_q"),
        F.count_if(q > GOOD_QUALITY).alias("n_good"), F.count_if(q > FAIR_QUALITY).alias("n_fair"),
        *_bins(q, QUALITY_BINS[:-1], "bin"), worst.alias("w"),
    )
    return out.withColumns({"min_q": F.round("w.q", 6), "worst_tid": F.col("w.tid")}).drop("w")


def edge_lengths(edges: DataFrame, vertices: DataFrame, metric: str | None = "size") -> DataFrame:
    """(a, b, length): of unique edges; in the scalar size field ``metric`` of the vertices, or Euclidean without one."""
    columns = ("x", "y", "z", *([metric] if metric else []))
    met = attach_corners(edges.withColumn("__e", F.struct("a", "b")), vertices, columns, ("a", "b"), "__e")
    p, q = _points(2)
    e = G.sub(q, p)
    length = F.sqrt(G.dot(e, e))
    if metric:
        length = G.scalar_length(length, F.col(f"{metric}0"), F.col(f"{metric}1"))
    return met.select("a", "b", length.alias("length"))


def tensor_edge_lengths(edges: DataFrame, vertices: DataFrame, metric: DataFrame) -> DataFrame:
    """(a, b, length) in a tensor metric (vid, val of six)."""
    carried = vertices.join(metric, "vid")
    met = attach_corners(edges.withColumn("__e", F.struct("a", "b")), carried, ("x", "y", "z", "val"), ("a", "b"), "__e")
    p, q = _points(2)
    return met.select("a", "b", G.tensor_length(G.sub(q, p), G.array_tensor(F.col("val0")), G.array_tensor(F.col("val1"))).alias("length"))


def length_summary(lengths: DataFrame, digits: int | None = 9) -> DataFrame:
    """One row: count, mean, shortest and longest with their ends (each with its own), zero lengths, nine bins."""
    x = F.round("length", digits) if digits is not None else F.col("length")
    low, high = F.min(F.struct(x.alias("l"), "a", "b")), F.max(F.struct(x.alias("l"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b")))
    out = lengths.agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.count_if(x <= 0).alias("n_zero"), *_bins(x, LENGTH_BINS, "bin"), low.alias("lo"), high.alias("hi"))
    ends = {"min_len": F.round("lo.l", 6), "min_a": F.col("lo.a"), "min_b": F.col("lo.b"), "max_len": F.round("hi.l", 6), "max_a": -F.col("hi.a"), "max_b": -F.col("hi.b")}
    return out.withColumns(ends).drop("lo", "hi")


def boxes(touch: DataFrame, vertices: DataFrame) -> DataFrame:
    """(part, x_min, x_max, ...): the bounding box of each partition's vertices."""
    return touch.join(vertices.select("vid", "x", "y", "z"), "vid").groupBy("part").agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def overlapping_boxes(box: DataFrame) -> DataFrame:
    """(part_a, part_b): pairs whose boxes meet in more than a plane. One box per partition: the pairing is of that small table."""
    other = box.select(*[F.col(c).alias(f"o_{c}") for c in box.columns])
    meets = F.col("part") < F.col("o_part")
    for c in "xyz":
        meets = meets & (F.col(f"{c}_min") < F.col(f"o_{c}_max")) & (F.col(f"o_{c}_min") < F.col(f"{c}_max"))
    return box.join(other, meets).select(F.col("part").alias("part_a"), F.col("o_part").alias("part_b"))


def balance(tetra: DataFrame, by: tuple[str, ...] = ("part",)) -> DataFrame:
    """Per group the number of tetra and its ratio to the mean, from one aggregation and one row."""
    counts = tetra.groupBy(*by).agg(F.count("*").alias("ne"))
    mean = F.avg("ne").over(Window.partitionBy())  # over a row per group
    return counts.select(*by, "ne", F.round(F.col("ne") / mean, 6).alias("imbalance"))


def surface_normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """``triangles`` with nx, ny, nz (unit) and area."""
    met = attach_corners(triangles, vertices, corners=("v0", "v1", "v2"), key="fid")
    n = G.triangle_normal(_points(3))
    size = F.sqrt(G.dot(n, n))
    unit = {f"n{c}": F.when(size > 0, n[i] / size) for i, c in enumerate("xyz")}
    return met.withColumns(unit | {"area": size / 2.0}).select(*triangles.columns, "nx", "ny", "nz", "area")


def vertex_normals(normals: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz, n): the unit sum of the area-weighted normals around each vertex."""
    each = normals.select(F.explode(F.array("v0", "v1", "v2")).alias("vid"), *[(F.col(f"n{c}") * F.col("area")).alias(c) for c in "xyz"])
    total = each.groupBy("vid").agg(*[F.sum(c).alias(c) for c in "xyz"], F.count("*").alias("n"))
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return total.select("vid", *[F.when(size > 0, F.col(c) / size).alias(f"n{c}") for c in "xyz"], "n")


def candidate_counts(located: DataFrame) -> DataFrame:
    """One row on a location run: points, found inside, by the nearest vertex, and candidates a point."""
    return located.agg(F.count("*").alias("n"), F.count_if(F.col("how") == "inside").alias("n_inside"), F.count_if(F.col("how") == "nearest").alias("n_nearest"), F.max("candidates").alias("max_candidates"), F.round(F.avg("candidates"), 6).alias("avg_candidates"))
